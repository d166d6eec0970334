"""Running a stream over what is available now, with results in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.workspace import work_folder


def table_stream(spark: SparkSession, directory: str, table: str, files_per_batch: int = 1000) -> DataFrame:
    """A stored table, one file or a folder of part files, as a file stream."""
    path = f"{directory}/{table}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(directory)


def folder_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_append(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Append every result row to a table, exactly once per checkpoint, and read it back; a given folder goes on where it stopped."""
    spark = stream.sparkSession
    out = folder or work_folder(spark, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/checkpoint")
         .trigger(availableNow=True).start(f"{out}/rows"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int, str], None], mode: str = "append", folder: str | None = None) -> str:
    """Run ``each(batch, batch_id, folder)`` per micro-batch; returns the folder it writes to.

    ``each`` writes its result under the batch id, so a batch that is run again
    after a failure replaces its own output.  A given folder goes on where it stopped.
    """
    spark = stream.sparkSession
    out = folder or work_folder(spark, name)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
         .foreachBatch(lambda df, i: each(df, i, out)).start())
    q.awaitTermination()
    return out


def earlier(spark: SparkSession, folder: str, batch_id: int, schema: str, part: str = "rows") -> DataFrame:
    """What batches before this one wrote; never what an earlier attempt of this batch left."""
    if batch_id == 0:
        return spark.createDataFrame([], schema + ", batch int")
    return spark.read.schema(schema + ", batch int").parquet(f"{folder}/{part}").where(F.col("batch") < batch_id)


def write_version(df: DataFrame, batch_id: int, folder: str, part: str = "rows") -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{part}/batch={batch_id}")


def run_parts(stream: DataFrame, name: str, part: Callable[[DataFrame], DataFrame], whole: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """``whole`` of what ``part`` makes of each batch; no row is ever late, whatever the order of the files."""
    out = run_batches(stream, name, lambda df, i, at: write_version(part(df), i, at), folder=folder)
    return whole(stream.sparkSession.read.parquet(f"{out}/rows").drop("batch"))


def run_latest(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Newest version of every key of an update-mode stream."""
    from tapeloom.operators.scans import latest

    out = run_batches(stream, name, lambda df, i, folder: write_version(df, i, folder), mode="update")
    return latest(stream.sparkSession.read.parquet(f"{out}/rows"), keys, "batch").drop("batch")
