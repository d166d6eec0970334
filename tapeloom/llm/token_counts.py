"""Token counts: how many tokens each text has, by the library, without keeping the ids.

Arrow batches are cut to about equal bytes, long texts are cut at white space, which no token crosses, and only lengths leave the
worker.  Null and empty texts have 0 tokens, and rows that repeat are counted one by one; nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tapeloom.llm.common import balanced, rows_per_batch, texts_of
from tapeloom.llm.token_ids import ChunkIds

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, tokens and whether there are more than ``limit``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ChunkIds(vocabulary, len)
        for b in balanced(batches):
            texts = b.column(1).to_pylist()
            n = [sum(x) for x in ids.batch(texts)]
            size = pc.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows_per_batch(texts_of(docs, id_col, text_col)).mapInArrow(count, SCHEMA)
