"""Compare registered queries with their SQL twins: python check.py [sf] [name-prefix ...]."""

from __future__ import annotations

import sys
import time
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd

from tapeloom.plans import catalogue
from tapeloom.session import local_session
from tapeloom.sources.tables import STORED


def connect(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in STORED:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def tidy(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, q, directory: str) -> str:
    t0 = time.time()
    try:
        got = q.run(spark, directory).toPandas()
    except Exception as e:  # reported, not hidden
        return f"SPARK-ERROR {str(e)[:600]}"
    t1 = time.time()
    if q.sql is None:
        return f"rows-only {len(got)} rows {t1 - t0:.1f}s"
    try:
        want = con.cursor().execute(q.oracle()).df()
    except Exception as e:
        return f"SQL-ERROR {str(e)[:600]}"
    took = f"{len(got)} rows spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s"
    if len(got) == 0:
        took = "EMPTY " + took
    a, b = tidy(got), tidy(want)
    if a == b:
        return f"ok {took}"
    only_a, only_b = sorted(set(a) - set(b), key=str)[:3], sorted(set(b) - set(a), key=str)[:3]
    return (f"MISMATCH spark {len(a)} sql {len(b)} differing {len(set(a) - set(b))}/{len(set(b) - set(a))} {took}\n"
            f"   cols {sorted(got.columns)}\n   spark {only_a}\n   sql   {only_b}")


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    directory = f"/root/testdata/sf{sf}"
    chosen = [q for n, q in catalogue().items() if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark, con = local_session(), connect(directory)
    bad = 0
    with ThreadPoolExecutor(4) as pool:
        for q, verdict in zip(chosen, pool.map(lambda q: compare(spark, con, q, directory), chosen)):
            good = verdict.startswith(("ok", "rows-only"))
            bad += not good
            if not good or "EMPTY" in verdict or "-v" in argv or len(chosen) < 12:
                print(f"{q.name}: {verdict}", flush=True)
    print(f"{len(chosen)} checked, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main([a for a in sys.argv[1:]]) else 0)
