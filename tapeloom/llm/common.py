"""Shared pieces of the text operators.

A document is a row with an id and a text; other columns never enter an operator, so extra columns cannot clash.  A null text counts as
empty and a null id passes through.  Each operator states what else it does with odd rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a single longer text is still taken whole.
BATCH_BYTES = 8 << 20
#: Entries that a worker's word memory may hold before it is emptied.
REMEMBERED = 1_500_000
#: Characters after which a long text may be cut at the next white space.
LONG_TEXT = 1 << 20


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null texts as empty ones."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))


def held_out(doc_id: Column) -> Column:
    """The rows no model learns from: every fifth by checksum, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def balanced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of ``column``, or a single row."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        start, held = 0, 0
        for i, n in enumerate(lengths.to_pylist()):
            if held and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def rows_per_batch(df: DataFrame, rows: int = 4096) -> DataFrame:
    """Ask for Arrow batches of fewer rows, since texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def rewritten(docs: DataFrame, judge: Callable[[], Callable[[list[str]], list[str | None]]], text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with all their columns and another text; a row whose new text is None goes.

    ``judge()`` is called once a task and gives what turns texts into new ones.  The length column, where there is one, follows the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_texts = judge()
        for b in balanced(batches, text_col):
            at = b.schema.get_field_index(text_col)
            old = [t or "" for t in b.column(at).to_pylist()]
            new = new_texts(old)
            keep = [i for i, t in enumerate(new) if t is not None]
            kept = b.take(pa.array(keep, pa.int64()))
            columns = list(kept.columns)
            columns[at] = pa.array([new[i] for i in keep], b.schema.field(at).type)
            if (length := b.schema.get_field_index(length_col)) >= 0:
                same = [new[i] == old[i] for i in keep]
                counted = pa.array([len(new[i]) for i in keep], pa.int64()).cast(b.schema.field(length).type)
                columns[length] = pc.if_else(pa.array(same, pa.bool_()), columns[length], counted)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return rows_per_batch(docs).mapInArrow(run, docs.schema)
