"""Repair of conversation structure by a parallel Viterbi search whose chunks converge in rank.

A conversation must read ``(s?(ua)+)?`` by the first letters of its roles.  Its rows are kept (0), get another role (2) or are deleted (3), and
rows without text may be inserted (2); blank and repeated rows must go, and a truncated row that stays costs 1.  Of the cheapest edits the
sequence of initials (D, I, K, R) that is least in ASCII order is taken.

1. *Chunks.*  Rows are range-partitioned and sorted by conversation and turn, so a conversation of any length lies in a row of tasks, and is cut
   into chunks of ``CHUNK`` rows.  Conversations that a task sees from first to last row, in one chunk, are finished there.
2. *Repeats* of a row in an earlier chunk are found by its digest.
3. *Speculation.*  Costs to the end, one for each of the four states, are carried backwards through a chunk from a guess of the costs behind it.
4. *Fix-up.*  Each chunk whose next one now begins with other costs runs again, old and new side by side, and stops as soon as both differ
   only by a constant: from there on everything differs by it, and no choice does.  Passes end when no chunk has other costs behind it.
5. *Stitching.*  Each chunk is traced forwards from every state it may be entered in, by the first letter that keeps the costs; the states
   are then chained over the chunks, and hashes and counts are taken chunk by chunk as a stream.

A null role or text is one space, as is a null id or turn in the checksum.  Rows without an id form one conversation, whose id is null.
Rows are ordered by turn (null first), then role, then text.  Empty texts are blank, and roles may be any string.  An empty table gives an
empty result; extra columns are not read.  A text of any length is held by one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import rows_per_batch
from tapeloom.sources.workspace import stored

#: Rows and bytes of text after which a chunk ends.
CHUNK, CHUNK_BYTES = 2048, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
#: A row's flags: the class of its role (other, s, u, a), and whether it is blank, repeated, without an end mark.
ROLE, BLANK, REPEATED, OPEN = 3, 4, 8, 16
_CLASS = {"s": 1, "u": 2, "a": 3}
#: States are what was read last: nothing, s, u, a.  Where a kept row leads, by state and class, and where a made one does.
_KEPT = ((None, 1, 2, None), (None, None, 2, None), (None, None, None, 3), (None, None, 2, None))
_MADE = (2, 2, 3, 2)
_NAMES = (None, None, "user", "assistant")
_LEGAL = {(1, 2), (2, 3), (3, 2)}
#: Costs behind the last row: what must be inserted to end well.
AT_END = (0, 4, 2, 0)
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_CHUNK = "conv_id long, solved boolean, part int, piece int, flags binary, digests binary, turns array<long>, roles array<string>, texts array<string>"


def step_back(flag: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row from those behind it."""
    late = 1 if flag & OPEN else 0
    here = [3 + c for c in after]
    if not flag & (BLANK | REPEATED):
        for q in range(4):
            to = _KEPT[q][flag & ROLE]
            if to is not None:
                here[q] = min(here[q], late + after[to])
            here[q] = min(here[q], 2 + late + after[_MADE[q]])
    return tuple(min(here[q], 2 + here[_MADE[q]], 4 + here[_MADE[_MADE[q]]]) for q in range(4))


def backward(flags: bytes, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs before each row and behind the last."""
    costs = [end]
    for flag in reversed(flags):
        costs.append(step_back(flag, costs[-1]))
    return costs[::-1]


def levelled(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs less their least: two vectors that differ by a constant become equal."""
    return tuple(c - min(costs) for c in costs)


def rerun(flags: bytes, old_end: tuple[int, ...], old_start: tuple[int, ...], new_end: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before the chunk for other costs behind it; stops where both runs differ only by a constant."""
    old, new = old_end, new_end
    for flag in reversed(flags):
        if levelled(old) == levelled(new):
            return tuple(c + new[0] - old[0] for c in old_start)
        old, new = step_back(flag, old), step_back(flag, new)
    return new


def trace(flags: bytes, costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int, int]:
    """Least initials of the cheapest edits from a state on, their cost, and the state behind them."""
    audit, spent, i = [], 0, 0
    while True:
        now = costs[i][state]
        if i == len(flags):
            if not last or now == 0:
                return "".join(audit), spent, state
            audit.append("I")
            spent, state = spent + 2, _MADE[state]
            continue
        flag, behind = flags[i], costs[i + 1]
        late = 1 if flag & OPEN else 0
        to = None if flag & (BLANK | REPEATED) else _KEPT[state][flag & ROLE]
        if 3 + behind[state] == now:
            edit, price, i = "D", 3, i + 1
        elif 2 + costs[i][_MADE[state]] == now:
            edit, price, state = "I", 2, _MADE[state]
        elif to is not None and late + behind[to] == now:
            edit, price, state, i = "K", late, to, i + 1
        else:
            edit, price, state, i = "R", 2 + late, _MADE[state], i + 1
        audit.append(edit)
        spent += price


def repaired(roles: list[str], texts: list[str], audit: str, state: int, flags: bytes) -> Iterator[str]:
    """``role:text`` of the rows that the edits leave or make."""
    i = 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        to = _KEPT[state][flags[i] & ROLE] if edit == "K" else _MADE[state]
        yield f"{roles[i] if edit == 'K' else _NAMES[to]}:{'' if edit == 'I' else texts[i]}"
        state = to
        i += edit != "I"


class Report:
    """Counts, costs, edits and hash of a conversation, chunk by chunk."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.distinct = 0
        self.first = self.turn = self.role = None
        self.audit: list[str] = []
        self.digest, self.written = hashlib.sha256(), False

    def add(self, flags: bytes, turns: list[int | None], roles: list[str], texts: list[str], audit: str, cost: int, state: int) -> None:
        for flag, turn in zip(flags, turns):
            if flag & BLANK:
                self.blank += 1
            elif flag & REPEATED:
                self.duplicate += 1
            elif flag & OPEN:
                self.truncated += 1
            if self.role is not None and (self.role, flag & ROLE) not in _LEGAL:
                self.illegal += 1
            self.role = flag & ROLE
            if turn is not None:
                if self.first is None:
                    self.first = turn
                self.distinct += turn != self.turn
                self.turn = turn
        for line in repaired(roles, texts, audit, state, flags):
            self.digest.update((("\n" if self.written else "") + line).encode())
            self.written = True
        self.audit.append(audit)
        self.cost += cost

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copies``: what is left of each row, dropped ones with no copy."""
    conv, turn = (F.col(f"`{c}`").cast("long") for c in (conv_col, turn_col))
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    named = F.concat(*(F.coalesce(x, F.lit(" ")) if not isinstance(x, str) else F.lit(x) for x in (conv.cast("string"), ":", turn.cast("string"))))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(named.cast("binary")) % 20).alias("code"))
    code = F.col("code")
    return rows.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code <= 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


class _Open:
    """Rows of a conversation that are still to be given out."""

    def __init__(self, conv_id: int | None, whole: bool):
        self.conv_id, self.whole, self.seen = conv_id, whole, set()
        self.clear()

    def clear(self) -> None:
        self.flags, self.digests, self.bytes = bytearray(), [], 0
        self.turns, self.roles, self.texts = [], [], []
        self.seen.clear()

    def add(self, turn: int | None, role: str, text: str, copies: int) -> None:
        bare = text.strip(SPACE)
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        for _ in range(copies):
            flag = _CLASS.get(role[:1], 0) | (0 if bare else BLANK) | (REPEATED if digest in self.seen else 0) | (0 if bare[-1:] in (".", "!", "?") else OPEN)
            self.seen.add(digest)
            self.flags.append(flag)
            self.digests.append(digest)
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)

    def solved(self) -> tuple:
        flags = bytes(self.flags)
        audit, cost, _ = trace(flags, backward(flags, AT_END), 0, True)
        report = Report()
        report.add(flags, self.turns, self.roles, self.texts, audit, cost, 0)
        return (self.conv_id, True, *[None] * 7, *report.row())

    def chunk(self, part: int, piece: int) -> tuple:
        return (self.conv_id, False, part, piece, bytes(self.flags), b"".join(self.digests), self.turns, self.roles, self.texts, *[None] * 8)


def _chunks(rows: DataFrame) -> DataFrame:
    """Finished conversations, and chunks of those that a task may not have seen as a whole."""
    schema = f"{_CHUNK}, {_COUNTS}"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 6, pa.string(), pa.string()]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, now = TaskContext.get().partitionId(), 0, None
        for b in batches:
            out: list[tuple] = []
            held = 0
            for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in b.columns)):
                if now is None:
                    now = _Open(conv_id, False)  # it may have begun in the task before
                elif conv_id != now.conv_id:
                    out.append(now.solved() if now.whole else now.chunk(part, piece))
                    piece += 1
                    now = _Open(conv_id, True)
                if len(now.flags) >= CHUNK or now.bytes >= CHUNK_BYTES:
                    now.whole = False
                    held += now.bytes
                    out.append(now.chunk(part, piece))
                    piece += 1
                    now.clear()
                    if held >= CHUNK_BYTES:
                        yield batch(out)
                        out, held = [], 0
                now.add(turn, role, text, copies)
            if out:
                yield batch(out)
        if now is not None:
            yield batch([now.chunk(part, piece)])  # it may go on in the next

    bounds = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    return rows_per_batch(bounds.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text", "copies")).mapInArrow(run, schema)


def _numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with the key of their conversation, their number there, and whether they are the last."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("conv")
    places = chunks.select(conv, "part", "piece")
    within = Window.partitionBy("conv").orderBy("part", "piece")
    numbers = places.select("conv", "part", "piece", F.row_number().over(within).alias("k"), F.lead("piece").over(within).isNull().alias("last"))
    return chunks.withColumn("conv", conv).join(numbers, ["conv", "part", "piece"])


def _with_repeats(chunks: DataFrame) -> DataFrame:
    """``conv, k, last, flags``: rows that an earlier chunk holds are marked as repeats."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, k, flags, digests in zip(*(c.to_pylist() for c in b.columns)):
                at = [i for i, f in enumerate(flags) if not f & (REPEATED | BLANK)]
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(at), pa.string()), pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([digests[16 * i : 16 * i + 16] for i in at], pa.binary())], ["conv", "k", "at", "digest"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for flags, again in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                flags = bytearray(flags)
                for i in again or []:
                    flags[i] |= REPEATED
                out.append(bytes(flags))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["conv", "k", "last", "flags"])

    rows = chunks.select("conv", "k", "flags", "digests").mapInArrow(firsts, "conv string, k int, at int, digest binary")
    first = rows.groupBy("conv", "digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = rows.join(first, ["conv", "digest"]).where("k > first").groupBy("conv", "k").agg(F.collect_list("at").alias("again"))
    return chunks.select("conv", "k", "last", "flags").join(again, ["conv", "k"], "left").mapInArrow(marked, "conv string, k int, last boolean, flags binary")


def _converged(flagged: DataFrame) -> DataFrame:
    """``conv, k, last, flags, end``: the costs behind each chunk, up to a constant."""
    guess = F.array(*(F.lit(c).cast("long") for c in AT_END))
    schema = "conv string, k int, last boolean, flags binary, end array<long>, start array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns: conv, k, last, flags, end, start, and the new end or null."""
        for b in batches:
            ends, starts = [], []
            for flags, end, start, new in zip(*(c.to_pylist() for c in b.columns[3:])):
                if start is None:
                    start = backward(flags, tuple(end))[0]
                elif new is not None:
                    start, end = rerun(flags, tuple(end), tuple(start), tuple(new)), new
                ends.append(list(end))
                starts.append(list(start))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ends, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))], ["conv", "k", "last", "flags", "end", "start"])

    nothing = F.lit(None).cast("array<long>")
    state = stored(flagged.select("conv", "k", "last", "flags", guess.alias("end"), nothing.alias("start"), nothing.alias("new")).mapInArrow(run, schema), "costs")

    def level(c: str):
        return F.transform(c, lambda x: x - F.array_min(c))

    while True:
        behind = state.select("conv", (F.col("k") - 1).alias("k"), level("start").alias("behind"))
        asked = state.join(behind, ["conv", "k"], "left").withColumn("new", F.when(F.col("behind") != level("end"), F.col("behind")))
        asked = asked.select("conv", "k", "last", "flags", "end", "start", "new")
        if asked.where("new IS NOT NULL").isEmpty():
            return state
        state = stored(asked.mapInArrow(run, schema), "costs")


def _stitched(costs: DataFrame) -> DataFrame:
    """``conv, k, flags, state, audit, cost``: the state each chunk is entered in and its edits."""
    ways = "array<struct<audit:string,cost:long,state:int>>"
    way = pa.list_(pa.struct([("audit", pa.string()), ("cost", pa.int64()), ("state", pa.int32())]))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for last, flags, end in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                known = backward(flags, tuple(end))
                out.append([dict(zip(("audit", "cost", "state"), trace(flags, known, q, last))) for q in range(4)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(out, way)], ["conv", "k", "flags", "ways"])

    every = stored(costs.select("conv", "k", "last", "flags", "end").mapInArrow(traced, f"conv string, k int, flags binary, ways {ways}"), "traces")
    steps = every.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("k", F.col("ways.state").alias("to")))).alias("steps"))
    entered = F.aggregate("steps", F.array(F.lit(0)), lambda states, s: F.concat(states, F.array(F.element_at(s["to"], F.element_at(states, -1) + 1))))
    states = steps.select("conv", F.posexplode(entered).alias("before", "state")).select("conv", (F.col("before") + 1).alias("k"), "state")
    chosen = F.element_at("ways", F.col("state") + 1)
    return every.join(states, ["conv", "k"]).select("conv", "k", "flags", "state", chosen["audit"].alias("audit"), chosen["cost"].alias("cost"))


def _reports(chunks: DataFrame, stitched: DataFrame) -> DataFrame:
    """Results of conversations whose chunks are joined with their edits."""
    names = ["conv_id", *(c.split()[0] for c in _COUNTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, conv_id, report = None, None, Report()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv_id, *report.row()), [*[pa.int64()] * 7, pa.string(), pa.string()])], names)

        for b in batches:
            for key, this, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if conv is not None and key != conv:
                    yield done()
                    report = Report()
                conv, conv_id = key, this
                report.add(*rest)
        if conv is not None:
            yield done()

    joined = chunks.select("conv", "k", "conv_id", "turns", "roles", "texts").join(stitched, ["conv", "k"])
    ordered = joined.repartition("conv").sortWithinPartitions("conv", "k").select("conv", "conv_id", "flags", "turns", "roles", "texts", "audit", "cost", "state")
    return rows_per_batch(ordered, 64).mapInArrow(run, f"conv_id long, {_COUNTS}")


def structure_repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of ``conv_id, turn, role, text, copies``."""
    found = stored(_chunks(rows), "conversations")
    solved = found.where("solved").select("conv_id", *(c.split()[0] for c in _COUNTS.split(", ")))
    chunks = stored(_numbered(found.where("NOT solved").select(*(c.split()[0] for c in _CHUNK.split(", ")))).drop("part", "piece", "solved"), "chunks")
    costs = _converged(_with_repeats(chunks))
    return solved.unionByName(_reports(chunks, _stitched(costs)))
