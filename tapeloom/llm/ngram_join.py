"""N-gram Jaccard join by a token-group matrix: exact links between documents whose shingle sets are similar, and their classes.

A document's set holds the hashes of its distinct ``width``-word shingles; ASCII capitals are folded and words are runs without ASCII white
space.  Two documents link when intersection / union reaches ``similar`` per cent.  At most m = n - ceil(similar n / 100) tokens of a set of n
can be missing from a partner, which gives every bound below.

1. *Prune.*  Documents with equal sets become one.  A set's index is the part of it below a fixed hash value, a quarter of all values, or the
   whole set where it is small or that part has not more than m tokens.  A set stays only if enough tokens of its index occur in other sets.
   Only (token, set) rows of the index are shuffled, and a token that many sets of one batch share is sent for two of them and counted for
   the rest on the spot, so a very frequent passage does not pile up anywhere.
2. *Group.*  A member that links to the leader of its family, the sets with the same smallest token under a second hash, takes the leader's class.
   Sets are partitioned by their most frequent index token, which similar sets share, and large parts are cut into groups of bounded size while
   small ones are put together.
3. *Bound.*  The matrix has a row for each token and group whose union holds it, with the range of classes of its holders.  A query must meet at
   least one of its m + 1 rarest index tokens in a group that has a partner: other groups stay closed, and so does a group whose holders of these
   tokens are all of the query's class.
4. *Open.*  The queries of a group, in chunks, are intersected with all of its members at once, and links between different classes are kept.
   Classes linked this way are joined to components.

No pairs of a group are listed: a group is read as one bitmap-like index per chunk of queries, and a query reports classes, not copies.

A document without words, or with a null text, has an empty set, links with nothing and is its own class; with fewer words than ``width`` the
whole sequence is its one shingle.  A null id is returned without a class.  Rows that repeat an id are one document: where their texts
differ, each text is searched for and the id has the links of all.  An empty table gives an empty result.

The sets that stay are broadcast to their texts while there are at most ``BROADCAST_IDS`` of them, and joined by a shuffle beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import REMEMBERED, balanced, rows_per_batch, texts_of
from tapeloom.llm.components import components
from tapeloom.sources.workspace import stored

#: Index tokens lie below this.
QUARTER = np.uint64(1 << 62)
#: Sets up to this size are indexed as a whole.
WHOLE = 100
#: Sets of one batch that may each send a token that they share.
SENDERS = 2
#: Sets that may be broadcast by number, first id, hash of its text and signature, 40 MB of them.
BROADCAST_IDS = 1 << 20
GROUP_SIZE = 256
QUERY_CHUNK = 1024


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    got = np.full(n, k, np.uint64)
    for i in range(k):
        got = _mixed(got * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(got)


def missing(n: int | np.ndarray, similar: int) -> int | np.ndarray:
    """How many tokens of a set of ``n`` a partner may lack."""
    return n - -(-n * similar // 100)


def index_of(tokens: np.ndarray, similar: int) -> np.ndarray:
    low = int(np.searchsorted(tokens, QUARTER))
    return tokens[:low] if len(tokens) > WHOLE and low > missing(len(tokens), similar) else tokens


def _needed(n: int, n_index: int, similar: int) -> int:
    """Index tokens of a set of ``n`` that must occur elsewhere.

    A partner of a set that is indexed as a whole may itself be indexed in part, and then one token in common is all that is sure.
    """
    if n_index < n or 100 * n <= WHOLE * similar:
        return n_index - missing(n, similar)
    return 1


def _signature(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in raw), np.int64).reshape(-1, 2)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, th, n, s1, s2``: sizes and 128-bit signatures of the sets, and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in balanced(batches):
            raw = [shingles(t, width, hashes).tobytes() for t in b.column(1).to_pylist()]
            s = _signature(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(r) // 8 for r in raw], pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1])], ["doc_id", "th", "n", "s1", "s2"])

    return rows_per_batch(docs.select("doc_id", "text", F.xxhash64("text").alias("th"))).mapInArrow(run, "doc_id long, th long, n long, s1 long, s2 long")


def _index_rows(docs: DataFrame, width: int, similar: int) -> DataFrame:
    """``s1, lack, tokens``: index tokens to look up, and how many of them must be found elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in balanced(batches):
            indexes: dict[int, np.ndarray] = {}  # equal sets of a batch once
            lacks = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = shingles(text, width, hashes)
                if doc_id is not None and len(tokens) and (s1 := int(_signature([tokens.tobytes()])[0, 0])) not in indexes:
                    indexes[s1] = index_of(tokens, similar)
                    lacks.append(_needed(len(tokens), len(indexes[s1]), similar))
            if not indexes:
                continue
            sizes = np.array(list(map(len, indexes.values())))
            flat, owner = np.concatenate(list(indexes.values())), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(flat[order].view(np.int64)) != 0])
            place = np.arange(len(flat)) - np.repeat(first, np.diff(np.r_[first, len(flat)]))
            sent = np.ones(len(flat), bool)
            sent[order[place >= SENDERS]] = False
            known = np.bincount(owner[~sent], minlength=len(sizes))
            kept = np.split(flat[sent].view(np.int64), np.cumsum(np.bincount(owner[sent], minlength=len(sizes)))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(list(indexes), pa.int64()), pa.array(np.array(lacks) - known, pa.int64()), pa.array(kept, pa.list_(pa.int64()))], ["s1", "lack", "tokens"])

    return rows_per_batch(docs).mapInArrow(run, "s1 long, lack long, tokens array<long>")


def survivors(docs: DataFrame, width: int, similar: int) -> DataFrame:
    """``s1`` of the sets that may have a partner."""
    rows = _index_rows(docs, width, similar)
    # a set whose tokens were all counted on the spot keeps one row of its own
    own = F.array(-F.abs(F.xxhash64("s1")) - 1)
    rows = rows.select("s1", "lack", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(own)).alias("token"))
    same = Window.partitionBy("token")
    found = rows.withColumn("low", F.min("s1").over(same)).withColumn("high", F.max("s1").over(same)).where("low < high OR lack <= 0")
    per_set = found.groupBy("s1").agg(F.size(F.collect_set(F.when(F.col("low") < F.col("high"), F.col("token")))).alias("n"), F.min("lack").alias("lack"))
    return per_set.where("lack <= 0 OR n >= lack").select("s1")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, first, n, family, tokens`` of rows ``node, first, text, s1, s2`` whose set has that signature, with the node as id.

    ``family`` is the smallest token under a second hash.  A task gives a node once, however often its row repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        given: set[int] = set()
        for b in balanced(batches):
            ids, firsts, n, family, raw = [], [], [], [], []
            for node, first, text, s1, s2 in zip(*(c.to_pylist() for c in b.columns)):
                if node in given:
                    continue
                tokens = shingles(text, width, hashes)
                if len(tokens) and _signature([tokens.tobytes()])[0].tolist() == [s1, s2]:
                    given.add(node)
                    ids.append(node)
                    firsts.append(first)
                    n.append(len(tokens))
                    family.append(int(_mixed(tokens + np.uint64(0x5851F42D4C957F2D)).min().view(np.int64)))
                    raw.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (ids, firsts, n, family)), pa.array(raw, pa.binary())], ["doc_id", "first", "n", "family", "tokens"])

    return rows_per_batch(docs.select("node", "first", "text", "s1", "s2")).mapInArrow(run, "doc_id long, first long, n long, family long, tokens binary")


def _linked(n_a: int | np.ndarray, n_b: int | np.ndarray, common: int | np.ndarray, similar: int):
    return 100 * common >= similar * (n_a + n_b - common)


def _stars(sets: DataFrame, similar: int) -> DataFrame:
    """``doc_id, class``: members that link to the leader of their family have the leader's id as class, others their own.

    The leader is the set of the smallest first id: where texts are changed copies of an earlier one, all of them link to that.  Only the sets of members of a family of two or more are moved.
    """
    narrow = sets.select("doc_id", "first", "family")
    leaders = narrow.groupBy("family").agg(F.min(F.struct("first", "doc_id"))["doc_id"].alias("leader"))
    assigned = narrow.join(leaders, "family").select("doc_id", "leader").distinct()
    follow = assigned.where("leader <> doc_id").join(sets.select("doc_id", "tokens"), "doc_id")
    lead = sets.select(F.col("doc_id").alias("leader"), F.col("tokens").alias("leader_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core = []
            for mine, theirs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a, c = np.frombuffer(mine, np.uint64), np.frombuffer(theirs, np.uint64)
                core.append(bool(_linked(len(a), len(c), len(np.intersect1d(a, c, assume_unique=True)), similar)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(core, pa.bool_())], ["of", "core"])

    linked = follow.join(lead, "leader").select("doc_id", "tokens", "leader_tokens").mapInArrow(run, "of long, core boolean").groupBy("of").agg(F.max("core").alias("core"))
    joined = assigned.join(linked, assigned["doc_id"] == linked["of"], "left")
    return joined.select("doc_id", F.when(F.coalesce("core", F.lit(False)), F.col("leader")).otherwise(F.col("doc_id")).alias("class"))


def _index_tokens(sets: DataFrame, similar: int) -> DataFrame:
    """``doc_id, token`` of each index token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([index_of(np.frombuffer(t, np.uint64), similar).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "index"])

    return sets.select("doc_id", "tokens").mapInArrow(run, "doc_id long, index array<long>").select("doc_id", F.explode("index").alias("token"))


def _shared_tokens(sets: DataFrame, stars: DataFrame, similar: int) -> DataFrame:
    """``doc_id, class, lost, n_index, shared, part``: each set's index tokens that others have too, the rarest first, and the most frequent one."""
    tokens = _index_tokens(sets, similar)
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = tokens.join(often, "token").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("f", "token"))).alias("shared"))
    return shared.join(stars, "doc_id").join(_probe_sizes(sets, similar), "doc_id").withColumn("part", F.element_at("shared", -1)["token"])


def _grouped(by_doc: DataFrame) -> DataFrame:
    """Add ``gid``: slots of a large part, or a bucket of small ones."""
    parts = by_doc.groupBy("part").agg(F.count(F.lit(1)).alias("members"))
    buckets = max(1, by_doc.count() // GROUP_SIZE)
    slot = F.xxhash64("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("members") / GROUP_SIZE)))
    bucket = F.pmod(F.xxhash64("part"), F.lit(buckets))
    return by_doc.join(parts, "part").withColumn("gid", F.when(F.col("members") * 2 > GROUP_SIZE, slot).otherwise(bucket)).drop("part", "members")


def _candidates(groups: DataFrame) -> DataFrame:
    """``doc_id, gid``: the groups that each query must open."""
    # tokens that no other set has come first among the rarest and find nothing
    wanted = F.greatest(F.col("lost") + 1 - (F.col("n_index") - F.size("shared")), F.lit(0)).cast("int")
    probes = groups.select("doc_id", "class", F.explode(F.slice("shared", F.lit(1), wanted)).alias("s")).select("doc_id", "class", "s.token")
    matrix = groups.select("gid", "class", F.explode("shared.token").alias("token")).groupBy("token", "gid").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    met = probes.join(matrix, "token").where((F.col("low") != F.col("class")) | (F.col("high") != F.col("class")))
    return met.select("doc_id", "gid").distinct()


def _probe_sizes(sets: DataFrame, similar: int) -> DataFrame:
    """``doc_id, lost, n_index``: the most tokens that a partner may lack, and the size of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.frombuffer(t, np.uint64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([missing(len(t), similar) for t in raw], pa.int64()), pa.array([len(index_of(t, similar)) for t in raw], pa.int64())], ["doc_id", "lost", "n_index"])

    return sets.select("doc_id", "tokens").mapInArrow(run, "doc_id long, lost long, n_index long").distinct()


def _open(sets: DataFrame, groups: DataFrame, candidates: DataFrame, similar: int) -> DataFrame:
    """``a, b``: classes that a query and a member of an opened group link."""
    whole = sets.select("doc_id", "tokens").join(groups.select("doc_id", "class"), "doc_id")
    per_group = candidates.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).alias("chunks"))
    asking = candidates.join(per_group, "gid").select("gid", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).alias("chunk"), "doc_id")
    held = groups.select("doc_id", "gid").join(per_group, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc_id")
    queries, members = (side.join(whole, "doc_id").select("gid", "chunk", "doc_id", "tokens", "class") for side in (asking, held))
    members = members.toDF("gid", "chunk", "doc_id", "tokens", "class")

    def run(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        sets = [np.frombuffer(t, np.uint64) for t in held["tokens"]]
        sizes, labels = np.array(list(map(len, sets))), held["class"].to_numpy()
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        values, start = np.unique(flat, return_index=True)
        stop = np.r_[start[1:], len(flat)]
        out: set[tuple[int, int]] = set()
        for tokens, label in zip(asking["tokens"], asking["class"]):
            a = np.frombuffer(tokens, np.uint64)
            at = np.searchsorted(values, a)
            at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == a)]
            n = stop[at] - start[at]
            spots = np.repeat(start[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(at) else at
            common = np.bincount(owner[spots], minlength=len(sets))
            for other in np.unique(labels[_linked(len(a), sizes, common, similar)]):
                if other != label:
                    out.add((int(label), int(other)))
        return pd.DataFrame(sorted(out), columns=["a", "b"]).astype("int64")

    return queries.groupBy("gid", "chunk").cogroup(members.groupBy("gid", "chunk")).applyInPandas(run, "a long, b long")


def _classes(texts: DataFrame, signed: DataFrame, width: int, similar: int) -> DataFrame:
    """``doc_id, component_id`` of ids with a partner.

    The nodes that are searched are sets, numbered as they are written: an id that stands for several texts has several.  Links between
    sets become links between the first ids that hold them.
    """
    held = signed.where("n > 0 AND doc_id IS NOT NULL")
    firsts = held.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "th")).alias("at")).select("s1", "s2", "n", F.col("at.doc_id").alias("first"), "at.th")
    copies = held.drop("th").join(firsts.drop("th"), ["s1", "s2", "n"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    searched = firsts.join(survivors(texts, width, similar), "s1", "left_semi")
    maybe = stored(searched.select(F.monotonically_increasing_id().alias("node"), "first", F.col("th").alias("first_th"), "s1", "s2"), "survivors")
    few = maybe.count() <= BROADCAST_IDS
    bounded = lambda df: F.broadcast(df) if few else df
    same_row = (F.col("doc_id") == F.col("first")) & (F.xxhash64("text") == F.col("first_th"))
    sets = stored(_sets(texts.join(bounded(maybe), same_row), width), "sets")
    stars = stored(_stars(sets, similar), "stars")
    groups = stored(_grouped(stored(_shared_tokens(sets, stars, similar), "shared-tokens")), "groups")
    found = _open(sets, groups, stored(_candidates(groups), "candidates"), similar)
    between_sets = stars.where("class <> doc_id").select(F.col("doc_id").alias("a"), F.col("class").alias("b")).union(found)
    for side in ("a", "b"):
        ids = maybe.select(F.col("node").alias(side), F.col("first").alias(f"{side}_id"))
        between_sets = between_sets.join(bounded(ids), side)
    edges = between_sets.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).union(copies)
    return components(edges).select(F.col("node").alias("doc_id"), F.col("label").alias("component_id"))


def classes(docs: DataFrame, width: int = 5, similar: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of the documents that have a partner; all others are alone."""
    texts = texts_of(docs, id_col, text_col)
    return _classes(texts, stored(signatures(texts, width), "signatures"), width, similar)


def ngram_jaccard_join(docs: DataFrame, width: int = 5, similar: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document."""
    texts = texts_of(docs, id_col, text_col)
    signed = stored(signatures(texts, width), "signatures")
    found = _classes(texts, signed, width, similar)
    alone = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return signed.select("doc_id", "n").join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
