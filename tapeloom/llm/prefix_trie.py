"""A trie of conversations by their turns, built as z-fast tries.

A conversation is a sequence of turns, and the sequences of first turns that conversations share are the nodes of a trie.

1. *Sequences.*  A turn is the MD5 of its role and text and its size, so a conversation is one row of digests whatever the length of its texts.
   The key of a prefix is the digest of the key before it and the next turn, so equal keys mean equal prefixes.
2. *Z-fast tries.*  Each task inserts its conversations, batch by batch, into a compacted trie whose nodes are hashed at their handle: the
   prefix whose depth is divisible by the highest power of two among the depths of the node's edge.  The exit node of a conversation is
   located by fat binary search over these depths, a few look-ups whatever its length, and the edge it leaves is split there.  A trie of
   ``TRIE_TURNS`` turns is given out and begun anew.
3. *Expansion.*  The edges of a trie are expanded to one row a depth, already added up for all conversations of the task, and rows of one
   prefix are added up over the tasks.  A first turn that a third of all conversations share is one row a task.
4. *Subtrees.*  What a node's subtree holds is added up from conversations, not level by level.  Each node belongs to its smallest member,
   and a conversation's own nodes are those from some depth on.  Above it, the conversation adds its turns from there to its own nodes, and
   one leaf if its last own node has no child.  The sums are carried up through the same tries.
5. *Ends.*  Ids that end at a node are put in order by a range sort, joined piece by piece, and hashed as a stream.

``conv_id`` null belongs to no conversation and takes no part.  Turns are ordered by number, null first, and turns of one number by digest,
so rows that repeat count as turns of their own.  Null role or text counts as empty, and turns may be of any length.  An empty table has no
node at all.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import rows_per_batch
from tapeloom.sources.workspace import stored

#: Turns in a task's trie before it is given out.
TRIE_TURNS = 400_000
ROOT = b"\0" * 16
#: Turns that a conversation may take from the first one of its five, and how many conversations share that one.
HEAD, FAMILY = 8, 5


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


def prefix_keys(turns: list[bytes]) -> list[bytes]:
    """Keys of all prefixes, the empty one first."""
    keys = [ROOT]
    for t in turns:
        keys.append(hashlib.md5(keys[-1] + t).digest())
    return keys


class Node:
    """A compacted node: its edge runs from ``above`` (exclusive) to ``extent`` along ``path``, the keys of one of its conversations."""

    __slots__ = ("above", "extent", "path", "sizes", "children", "parent", "values")

    def __init__(self, above: int, extent: int, path: list[bytes], sizes: list[int], parent: Node | None):
        self.above, self.extent, self.path, self.sizes, self.parent = above, extent, path, sizes, parent
        self.children: dict[bytes, Node] = {}
        self.values: list[tuple] = []

    @property
    def handle(self) -> bytes:
        return self.path[two_fattest(self.above, self.extent)]


class ZFastTrie:
    """Compacted trie over prefix keys with a table of handles."""

    def __init__(self):
        self.root = Node(0, 0, [ROOT], [0], None)
        self.handles: dict[bytes, Node] = {}

    def exit_node(self, keys: list[bytes]) -> Node:
        """The deepest node whose extent is a prefix of the sequence, or the one whose edge the sequence leaves."""
        node, a, b = self.root, 0, len(keys) - 1
        while a < b:
            f = two_fattest(a, b)
            found = self.handles.get(keys[f])
            if found is None:
                b = f - 1
            elif found.extent < len(keys) and keys[found.extent] == found.path[found.extent]:
                node, a = found, found.extent
            else:
                return found
        return node.children.get(keys[node.extent + 1], node) if node.extent + 1 < len(keys) else node

    def insert(self, keys: list[bytes], sizes: list[int], value: tuple) -> None:
        node, n = self.exit_node(keys), len(keys) - 1
        apart = self._shared(node, keys)
        if apart < node.extent:
            node = self._split(node, apart)
        if apart < n:
            leaf = Node(apart, n, keys, sizes, node)
            node.children[keys[apart + 1]] = leaf
            self.handles[leaf.handle] = leaf
            node = leaf
        node.values.append(value)

    @staticmethod
    def _shared(node: Node, keys: list[bytes]) -> int:
        """How deep the sequence follows the node's edge."""
        lo, hi = node.above, min(node.extent, len(keys) - 1)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if keys[mid] == node.path[mid] else (lo, mid - 1)
        return lo

    def _split(self, low: Node, depth: int) -> Node:
        """A new node at ``depth`` of an edge; what was below keeps the rest of it."""
        del self.handles[low.handle]
        top = Node(low.above, depth, low.path, low.sizes, low.parent)
        low.parent.children[low.path[low.above + 1]] = top
        top.children[low.path[depth + 1]] = low
        low.above, low.parent = depth, top
        for n in (low, top):
            self.handles[n.handle] = n
        return top

    def bottom_up(self) -> list[Node]:
        """All nodes, children before parents."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(node.children.values())
        return order[::-1]


def _tries(batches: Iterator[pa.RecordBatch], inserts) -> Iterator[ZFastTrie]:
    """Tries of a task's conversations ``conv_id, turns, sizes, ...``; ``inserts(row)`` gives how deep a prefix to insert, with which value."""
    trie, held = ZFastTrie(), 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            keys, sizes = prefix_keys(row[1]), [0, *row[2]]
            for depth, value in inserts(row):
                trie.insert(keys[: depth + 1], sizes, value)
            held += len(keys)
        if held > TRIE_TURNS:
            yield trie
            trie, held = ZFastTrie(), 0
    if held:
        yield trie


def _in_batches(rows: list[tuple], types: list[pa.DataType], names: list[str], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), most):
        cols = zip(*rows[at : at + most])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _expanded(batches: Iterator[pa.RecordBatch], inserts, added, row_of, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows of every depth of every edge: ``added(values)`` adds up values of a node and its children, ``row_of(node, depth, total)`` makes a row and the total above it."""
    for trie in _tries(batches, inserts):
        total: dict[int, tuple] = {}
        rows: list[tuple] = []
        for node in trie.bottom_up():
            now = added([*node.values, *(total.pop(id(c)) for c in node.children.values())])
            for depth in range(node.extent, node.above if node is not trie.root else -1, -1):
                row, now = row_of(node, depth, now)
                rows.append(row)
            total[id(node)] = now
            if len(rows) > 50_000:
                yield from _in_batches(rows, types, names)
                rows = []
        yield from _in_batches(rows, types, names)


def nodes(sequences: DataFrame) -> DataFrame:
    """``key, parent, depth, bytes, n_convs, conv_id`` of every prefix of ``conv_id, turns, sizes``."""

    def added(values: list[tuple[int, int]]) -> tuple[int, int]:
        return min(v[0] for v in values), sum(v[1] for v in values)

    def row_of(node: Node, depth: int, now: tuple[int, int]) -> tuple[tuple, tuple]:
        return (node.path[depth], node.path[depth - 1] if depth else None, depth, node.sizes[depth], now[1], now[0]), now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda row: [(len(row[1]), (row[0], 1))]
        return _expanded(batches, whole, added, row_of, ["key", "parent", "depth", "bytes", "n_convs", "conv_id"], [pa.binary(), pa.binary(), *[pa.int64()] * 4])

    found = rows_per_batch(sequences.select("conv_id", "turns", "sizes")).mapInArrow(run, "key binary, parent binary, depth long, bytes long, n_convs long, conv_id long")
    return found.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def subtrees(sequences: DataFrame) -> DataFrame:
    """``key, n_leaves, saved_tokens`` from ``conv_id, turns, sizes, own_from, leaf``: the depth of a conversation's first own node (null: none)."""

    def inserts(row: tuple) -> list[tuple[int, tuple[int, int, int]]]:
        n, own_from = len(row[1]), row[3]
        shared = n if own_from is None else own_from - 1
        return [*([(shared, (1, 0, 0))] if shared >= 0 else []), *([(n, (0, 1, 0))] if row[4] else [])]

    def added(values: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        return tuple(map(sum, zip(*values)))

    def row_of(node: Node, depth: int, now: tuple[int, int, int]) -> tuple[tuple, tuple]:
        sharing, leaves, saved = now
        saved += sharing * node.sizes[depth]
        return (node.path[depth], leaves, saved), (sharing, leaves, saved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _expanded(batches, inserts, added, row_of, ["key", "n_leaves", "saved_tokens"], [pa.binary(), pa.int64(), pa.int64()])

    found = rows_per_batch(sequences.select("conv_id", "turns", "sizes", "own_from", "leaf")).mapInArrow(run, "key binary, n_leaves long, saved_tokens long")
    return found.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def ends(sequences: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the hash of the ordered ids that end at a prefix."""

    def last_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([prefix_keys(t)[-1] for t in b.column(1).to_pylist()], pa.binary())], ["conv_id", "key"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_key: dict[bytes, list[int]] = {}
            for conv_id, key in zip(*(c.to_pylist() for c in b.columns)):
                by_key.setdefault(key, []).append(conv_id)
            cols = zip(*((key, ids[0], ",".join(map(str, ids))) for key, ids in by_key.items()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string()))], ["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in batches:
            done = []
            for k, ids in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield from _in_batches(done, [pa.binary(), pa.string()], ["key", "ends_sha256"])
        if key is not None:
            yield from _in_batches([(key, digest.hexdigest())], [pa.binary(), pa.string()], ["key", "ends_sha256"])

    last = rows_per_batch(sequences.select("conv_id", "turns")).mapInArrow(last_keys, "conv_id long, key binary")
    joined = last.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(pieces, "key binary, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(hashed, "key binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie of ``conv_id, turns, sizes``, one row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    sequences = stored(sequences, "sequences")
    every = nodes(sequences)
    every = stored(every, "trie-nodes")
    children = every.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = stored(every.join(children, every["key"] == children["of"], "left").drop("of").fillna(0, ["n_children"]), "trie-nodes")
    owners = counted.groupBy(F.col("conv_id").alias("owner")).agg(F.min("depth").alias("own_from"), F.max(F.col("n_children") == 0).alias("leaf"))
    below = subtrees(sequences.join(owners, sequences["conv_id"] == owners["owner"], "left").drop("owner"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    whole = counted.join(below, "key", "left").join(ends(sequences), "key", "left")
    above = counted.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(above, whole["parent"] == above["above"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def turn_sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns, sizes``: digests and text sizes of each conversation's turns in order."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.col(f"`{turn_col}`").cast("long")
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.struct(turn.isNotNull().alias("known"), turn.alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    ordered = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.col("t.digest").alias("turns"), F.col("t.size").alias("sizes"))


def grafted(sequences: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of the first conversation of its family of five."""
    heads = sequences.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD).alias("head_turns"), F.slice("sizes", 1, HEAD).alias("head_sizes"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    asked = sequences.withColumns({"h": taken.cast("int"), "of": F.col("conv_id") - F.col("conv_id") % FAMILY})
    joined = asked.join(heads, asked["of"] == heads["base"], "left")

    def both(head: str, own: str):
        rest = F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))
        return F.concat(F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.slice(own, 1, 0)), rest).alias(own)

    return joined.select("conv_id", both("head_turns", "turns"), both("head_sizes", "sizes"))
