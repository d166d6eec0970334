"""Logistic, ridge and boosted-tree forecasts, fitted for all years and targets in the same passes over the rows.

Every pass is one job: tasks add up gradients of their rows for every (year, target) at once, and the sums, whose size does not depend on the
rows, are put together where the next step is decided.  Trees are grown level by level from histograms of binned features, so a round
of all trees costs as many passes as a tree has levels; margins are written back every ``REFRESH`` rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.sources.workspace import stored

BINS = 32
REFRESH = 25
#: Rows that a task works on in a pass.
TASK_ROWS = 6_000
# Settings of the boosted trees and penalties.
RATE, DEPTH, L2, ROUNDS = 0.05, 3, 1.0, 100
INNER, LEAVES = 2**DEPTH - 1, 2**DEPTH


@dataclass
class Job:
    """One (year, target) with the columns it may use, and what was fitted for it."""

    year: int
    target: int
    columns: np.ndarray
    rate: float = 0.0  # share of ones in training
    rows: int = 0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    weights: np.ndarray | None = None  # intercept first
    spread: float = 0.0

    @property
    def single(self) -> bool:
        return self.rate in (0.0, 1.0)

    @property
    def base(self) -> float:
        return float(np.log(self.rate / (1 - self.rate)))


def leaves_of(bins: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], levels: int = DEPTH) -> np.ndarray:
    """Number of the node of each row after so many levels, counted within the level."""
    feature, cut, _ = tree
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(levels):
        node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
    return node - (2**levels - 1)


def margins(bins: np.ndarray, trees: list, start: np.ndarray) -> np.ndarray:
    """``start`` and the leaves of all trees that each row falls into."""
    if not trees or not len(bins):
        return start.copy()
    feature, cut, leaf = (np.stack(c) for c in zip(*trees))
    tree, rows = np.arange(len(trees))[None, :], np.arange(len(bins))[:, None]
    node = np.zeros((len(bins), len(trees)), np.int64)
    for _ in range(DEPTH):
        node = 2 * node + 1 + (bins[rows, feature[tree, node]] > cut[tree, node])
    return start + leaf[tree, node - INNER].sum(axis=1)


class Rows:
    """A batch of ``year, test, x, bins, y, margin`` as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows
        get = lambda name: batch.column(batch.schema.get_field_index(name)) if name in batch.schema.names else pa.array([[]] * n, pa.list_(pa.float64()))
        self.year, self.test = get("test_year").to_numpy(zero_copy_only=False), get("test").to_numpy(zero_copy_only=False)
        wide = lambda name: np.asarray(get(name).flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, 1))
        self.x, self.y, self.margin = wide("x"), wide("y"), wide("margin")
        self.bins = np.frombuffer(b"".join(get("bins").to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)

    def of(self, job: Job, test: bool) -> np.ndarray:
        which = (self.year == job.year) & (self.test == test)
        return np.flatnonzero(which if test else which & ~np.isnan(self.y[:, job.target]))


def summed(table: DataFrame, shape: tuple[int, ...], add: Callable[[Rows, np.ndarray], None], short: bool = False) -> np.ndarray:
    """The sum over all rows of what ``add`` puts into an array; one array a task travels, ``short`` ones in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            add(Rows(b), total)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32 if short else np.float64).tobytes()], pa.binary())], ["total"])

    total = np.zeros(shape)
    for part in table.mapInArrow(run, "total binary").toArrow().column(0):
        total += np.frombuffer(part.as_buffer(), np.float32 if short else np.float64).reshape(shape)
    return total


def prepared(design: DataFrame, columns: list[str], targets: list[str]) -> DataFrame:
    """``test_year, test, ticker, date, x, bins, y, margin``: features without holes, their bins by training quantiles of the year, and labels."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    rows = design.select(F.col("test_year").cast("int").alias("test_year"), (F.col("part") == "test").alias("test"), "ticker", "date", F.array(*x).alias("x"), F.array(*[F.col(t).cast("double") for t in targets]).alias("y"))
    shares = [k / BINS for k in range(1, BINS)]
    cuts = rows.where("NOT test").groupBy("test_year").agg(*[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"c{i}") for i in range(len(columns))]).collect()
    edges = {r["test_year"]: [np.unique(r[f"c{i}"]) for i in range(len(columns))] for r in cuts}
    names = ["test_year", "test", "ticker", "date", "x", "y", "bins", "margin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = np.asarray(b.column(4).flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, len(columns)))
            year = b.column(0).to_numpy(zero_copy_only=False)
            bins = np.zeros(x.shape, np.uint8)
            for y in np.unique(year):
                mine = np.flatnonzero(year == y)
                for i, e in enumerate(edges.get(int(y), [])):
                    bins[mine, i] = np.searchsorted(e, x[mine, i])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([[0.0] * len(targets)] * n, pa.list_(pa.float64()))], names)

    return rows.mapInArrow(run, "test_year int, test boolean, ticker string, date date, x array<double>, y array<double>, bins binary, margin array<double>")


def count_classes(table: DataFrame, jobs: list[Job]) -> None:
    """Training rows and share of ones of each job."""

    def add(rows: Rows, total: np.ndarray) -> None:
        for k, job in enumerate(jobs):
            y = rows.y[rows.of(job, False), job.target]
            total[k] += len(y), y.sum()

    for job, (n, ones) in zip(jobs, summed(table, (len(jobs), 2), add)):
        job.rows, job.rate = int(n), ones / n if n else 0.0


def fit_logistic(table: DataFrame, jobs: list[Job], penalty: float = 1.0, steps: int = 50) -> None:
    """Newton steps on the log loss plus half the squared weights, without the intercept."""
    open_jobs = [j for j in jobs if not j.single]
    for job in open_jobs:
        job.weights = np.r_[job.base, np.zeros(len(job.columns))]
    width = 1 + max((len(j.columns) for j in open_jobs), default=0)
    while open_jobs and steps:
        steps -= 1

        def add(rows: Rows, total: np.ndarray, now: list[Job] = open_jobs) -> None:
            for k, job in enumerate(now):
                mine = rows.of(job, False)
                x = np.c_[np.ones(len(mine)), rows.x[np.ix_(mine, job.columns)]]
                p = 1 / (1 + np.exp(-x @ job.weights))
                n = x.shape[1]
                total[k, :n, 0] += x.T @ (p - rows.y[mine, job.target])
                total[k, :n, 1 : n + 1] += (x * (p * (1 - p))[:, None]).T @ x

        sums = summed(table, (len(open_jobs), width, width + 1), add)
        moved = []
        for job, s in zip(open_jobs, sums):
            n = len(job.weights)
            ridge = penalty * np.r_[0.0, np.ones(n - 1)]
            step = np.linalg.solve(s[:n, 1 : n + 1] + np.diag(ridge) + 1e-12 * np.eye(n), s[:n, 0] + ridge * job.weights)
            size = np.abs(step).max()
            job.weights = job.weights - step * min(1.0, 5.0 / size if size > 0 else 1.0)
            if size > 1e-7:
                moved.append(job)
        open_jobs = moved


def fit_ridge(table: DataFrame, jobs: list[Job], floor: float, penalty: float = 1.0) -> None:
    """Normal equations of the log target; ``spread`` is the variance of the training residuals."""
    width = 2 + max((len(j.columns) for j in jobs), default=0)

    def add(rows: Rows, total: np.ndarray) -> None:
        for k, job in enumerate(jobs):
            mine = rows.of(job, False)
            x = np.c_[np.ones(len(mine)), rows.x[np.ix_(mine, job.columns)], np.log(np.maximum(rows.y[mine, job.target], floor))]
            total[k, : x.shape[1], : x.shape[1]] += x.T @ x

    for job, s in zip(jobs, summed(table, (len(jobs), width, width), add)):
        n = len(job.columns) + 1
        a, b = s[:n, :n], s[:n, n]
        job.weights = np.linalg.solve(a + np.diag(penalty * np.r_[0.0, np.ones(n - 1)]) + 1e-12 * np.eye(n), b)
        job.spread = float(s[n, n] - 2 * b @ job.weights + job.weights @ a @ job.weights) / max(job.rows, 1)


def best_splits(hist: np.ndarray, columns: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and bin of the best cut of each node from its sums (gradient, curvature, rows) by feature and bin; bin BINS keeps all rows left."""
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + L2)
    gain = score(left) + score(right) - score(total)
    allowed = (left[..., 2] >= least) & (right[..., 2] >= least)
    gain = np.where(allowed, gain, 0.0)
    usable = np.zeros(hist.shape[1], bool)
    usable[columns] = True
    gain[:, ~usable] = 0.0
    flat = gain.reshape(len(hist), -1)
    best = flat.argmax(axis=1)
    none = flat[np.arange(len(hist)), best] <= 1e-12
    return np.where(none, 0, best // hist.shape[2]), np.where(none, BINS, best % hist.shape[2])


def fit_trees(table: DataFrame, jobs: list[Job], features: int, rounds: int = ROUNDS, least_leaf: int = 2000) -> DataFrame:
    """Boosted trees of all jobs, level by level; gives the table with the margins of the last refresh."""
    jobs = [j for j in jobs if not j.single]
    if not jobs:
        return table
    done = 0  # rounds that the margins hold already
    for r in range(rounds):
        learn = table.where("NOT test").select("test_year", "test", "y", "bins", "margin")
        active = [replace(j, trees=j.trees[done:]) for j in jobs]  # what travels to the tasks
        trees = [(np.zeros(INNER, np.int64), np.full(INNER, BINS), np.zeros(LEAVES)) for _ in jobs]
        for level in range(DEPTH):
            nodes = 2**level

            def add(rows: Rows, total: np.ndarray, level: int = level, trees: list = trees, active: list[Job] = active, nodes: int = nodes) -> None:
                for k, job in enumerate(active):
                    mine = rows.of(job, False)
                    if not len(mine):
                        continue
                    bins = rows.bins[mine]
                    p = 1 / (1 + np.exp(-margins(bins, job.trees, job.base + rows.margin[mine, job.target])))
                    node = leaves_of(bins, trees[k], level)
                    sums = (p - rows.y[mine, job.target], p * (1 - p), np.ones(len(mine)))
                    at = ((node[:, None] * features + np.arange(features)) * BINS + bins).ravel()
                    for c, s in enumerate(sums):
                        total[k, ..., c] += np.bincount(at, np.repeat(s, features), nodes * features * BINS).reshape(total.shape[1:-1])

            sums = summed(learn, (len(jobs), nodes, features, BINS, 3), add, short=True)
            for job, tree, s in zip(jobs, trees, sums):
                feature, cut = best_splits(s, job.columns, least_leaf)
                tree[0][nodes - 1 : 2 * nodes - 1], tree[1][nodes - 1 : 2 * nodes - 1] = feature, cut
                if level == DEPTH - 1:
                    below = s[np.arange(nodes), feature].cumsum(axis=1)
                    left, whole = below[np.arange(nodes), np.minimum(cut, BINS - 1)], below[:, -1]
                    both = np.stack([left, whole - left], axis=1).reshape(LEAVES, 3)
                    tree[2][:] = -RATE * both[:, 0] / (both[:, 1] + L2)
        for job, tree in zip(jobs, trees):
            job.trees.append(tree)
        if (r + 1) % REFRESH == 0 and r + 1 < rounds:
            table = with_margins(table, jobs, done)
            done = r + 1
    for job in jobs:
        job.trees = job.trees[done:]  # the table holds the others
    return table


def with_margins(table: DataFrame, jobs: list[Job], done: int) -> DataFrame:
    """The table with the sums of all trees fitted so far."""
    at = table.columns.index("margin")
    jobs = [replace(j, trees=j.trees[done:]) for j in jobs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = Rows(b)
            rows.margin = rows.margin.copy()
            for job in jobs:
                for test in (False, True):
                    mine = rows.of(job, test)
                    rows.margin[mine, job.target] = margins(rows.bins[mine], job.trees, rows.margin[mine, job.target])
            columns = list(b.columns)
            columns[at] = pa.array(rows.margin.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    new = kept(table.mapInArrow(run, table.schema))
    table.unpersist()
    return new


def kept(table: DataFrame) -> DataFrame:
    """Written once and spread evenly, since every pass reads all of it; a task gets ``TASK_ROWS`` rows, or an even share where there are more."""
    rows = stored(table, "model-rows")
    tasks = min(-(-rows.count() // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism * 4)
    return stored(rows.repartition(max(1, tasks)), "model-rows").persist()


def predicted(table: DataFrame, fits: list[tuple[str, str, Job]]) -> DataFrame:
    """``test_year, ticker, date, target, model, y, p_model`` of the test rows of every fitted ``(target, model, job)``."""
    names = ["test_year", "ticker", "date", "target", "model", "y", "p_model"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = Rows(b)
            for target, model, job in fits:
                mine = rows.of(job, True)
                if not len(mine):
                    continue
                if model == "ridge":
                    p = np.exp(np.c_[np.ones(len(mine)), rows.x[np.ix_(mine, job.columns)]] @ job.weights + job.spread / 2)
                elif job.single:
                    p = np.full(len(mine), job.rate)
                elif model == "logistic":
                    p = 1 / (1 + np.exp(-np.c_[np.ones(len(mine)), rows.x[np.ix_(mine, job.columns)]] @ job.weights))
                else:
                    p = 1 / (1 + np.exp(-margins(rows.bins[mine], job.trees, job.base + rows.margin[mine, job.target])))
                y = rows.y[mine, job.target]
                take = b.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([*(take.column(take.schema.get_field_index(c)) for c in names[:3]), pa.array([target] * len(mine)), pa.array([model] * len(mine)),
                                                  pa.array(y, mask=np.isnan(y)), pa.array(p)], names)

    return table.mapInArrow(run, "test_year int, ticker string, date date, target string, model string, y double, p_model double")


def walk_forward(design: DataFrame, columns: dict[str, list[str]], years: list[int], fits: list[tuple[str, str]], floor: float, rounds: int = ROUNDS, least_leaf: int = 2000) -> DataFrame:
    """Forecasts of each (target, model) for the test rows of each year, from that year's training rows; ``columns`` lists the features of a target."""
    every = sorted({c for cs in columns.values() for c in cs})
    targets = sorted({t for t, _ in fits})
    table = kept(prepared(design, every, targets))
    jobs = {(t, m): [Job(y, targets.index(t), np.array([every.index(c) for c in columns[t]])) for y in years] for t, m in fits}
    count_classes(table, [j for js in jobs.values() for j in js])
    jobs = {k: [j for j in js if j.rows] for k, js in jobs.items()}
    of = lambda model: [j for (_, m), js in jobs.items() if m == model for j in js]
    fit_logistic(table, of("logistic"))
    fit_ridge(table, of("ridge"), floor)
    table = fit_trees(table, of("gbm"), len(every), rounds, least_leaf)
    out = stored(predicted(table, [(t, m, j) for (t, m), js in jobs.items() for j in js]), "forecasts")
    table.unpersist()
    return out
