"""Incremental ingest (ING-4, ING-5, SNK-7): each new document is cleaned once.

Cleaning is stateless, so the batch and the stream share one expression. The
checkpoint remembers which files were taken; a second run takes only new ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from lexitally.functions.routing import processed_name
from lexitally.functions.text import clean_text
from lexitally.sources.readers import labelled_files


def cleaned_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """ING-5: the documents with cleaned text; the same for a batch and a stream."""
    return docs.withColumn(text, clean_text(F.col(text)))


def _bounded(reader: DataStreamReader, max_bytes: int | None) -> DataStreamReader:
    return reader if max_bytes is None else reader.option("maxBytesPerTrigger", max_bytes)


def stream_texts(spark: SparkSession, root: str, pattern: str = "*_raw.txt", max_bytes: int | None = None) -> DataFrame:
    """ING-4: a stream of ``<root>/<label>/<file>``, one row per new file.

    A batch takes files of about ``max_bytes`` bytes in all (at least one file), so a backlog of any
    size is worked off in batches that each commit, and a run that is stopped goes on after the last.

    As in the batch, files that are not UTF-8 are left out; ``readers.read_errors`` lists them.
    """
    reader = _bounded(spark.readStream, max_bytes)
    files = reader.text(f"{root.rstrip('/')}/*", wholetext=True, pathGlobFilter=pattern)
    return labelled_files(files, root).where(F.is_valid_utf8("value")).select(
        "emotion", processed_name(F.col("file_name")).alias("file_name"), F.col("value").alias("text")
    )


def stream_table(spark: SparkSession, folder: str, name: str, schema: StructType, max_bytes: int | None = None) -> DataFrame:
    """A stream over the Parquet files of one table, a directory or a single file, in batches as ``stream_texts`` has them."""
    # A stream refuses the plain path of a file; a pattern that fits one name takes either.
    place = f"{folder.rstrip('/')}/{name[:-1]}[{name[-1]}]"
    return _bounded(spark.readStream, max_bytes).schema(schema).parquet(place)


def run_available(stream: DataFrame, out: str, checkpoint: str, text: str = "text", partition_by: str | None = None) -> None:
    """Clean everything new, append it to the Parquet table ``out``, and stop."""
    writer = cleaned_documents(stream, text).writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    query = (
        writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_ledger(
    stream: DataFrame, to_ledger: Callable[[DataFrame, DataFrame | None], DataFrame], out: str, checkpoint: str
) -> None:
    """SNK-7: one ledger directory per batch, named by its number and overwritten on a retry.

    ``to_ledger`` gets a batch and the ledger of the batches before it (none for the
    first). A retried batch sees the same earlier ones, so it writes the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        earlier = batch.sparkSession.read.parquet(out).where(F.col("batch_id") < batch_id) if batch_id else None
        to_ledger(batch, earlier).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
