"""Sinks (SNK-1 to SNK-7).

Corpus-sized tables go to Parquet in parallel. Reports, whose size is a number
of labels times a fixed top-n, go to one CSV file each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    """SNK-1, SNK-4, SNK-5, SNK-6: a small result as one CSV with a header.

    One task writes it, so it is only for tables bounded by the number of labels.
    """
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_report_per_label(df: DataFrame, label: str, path: str) -> None:
    """SNK-2: one directory per label; the label stays in the files as well."""
    parts = df.withColumn("_label", F.col(label)).withColumnRenamed("_label", f"{label}_dir")
    parts.repartition(label).write.mode("overwrite").partitionBy(f"{label}_dir").csv(path, header=True, escape='"')


def write_corpus(docs: DataFrame, path: str, label: str = "emotion", mode: str = "overwrite") -> None:
    """SNK-3, SNK-4: documents as Parquet, one directory per label for partition pruning, in even files.

    Rows are brought together by label and a large label is cut into parts of the size that
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` names, so there are about as many files as
    the bytes need and one more per label, and no label is gathered in one task.
    """
    docs.hint("rebalance", F.col(label)).write.mode(mode).partitionBy(label).parquet(path)


def write_parted(checked: DataFrame, path: str) -> None:
    """SRC-9: good and bad texts of ``readers.checked_texts`` in one pass, ``outcome=good`` and ``outcome=bad``.

    Bad content is kept as bytes, since it is no text; good content is kept as text.
    """
    bad = F.col("reason").isNotNull()
    rows = checked.select(
        "emotion",
        "file_name",
        F.when(~bad, F.col("value")).alias("value"),
        F.when(bad, F.col("value").cast("binary")).alias("content"),
        "reason",
        "byte_position",
        F.when(bad, "bad").otherwise("good").alias("outcome"),
    )
    rows.write.mode("overwrite").partitionBy("outcome").parquet(path)


def write_files(files: DataFrame, root: str) -> None:
    """Binary ``content`` as one file each, ``<root>/<emotion>/<file_name>``: for corpora that other programs read.

    A table is the better store; a file costs the file system an entry. Tasks write through
    pyarrow's file systems, a retried one writes the same files again.
    """
    place = root if "://" in root or root.startswith("file:") else f"file://{root}"

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(place)
        for batch in batches:
            for label, name, content in zip(*(c.to_pylist() for c in batch.columns)):
                store.create_dir(f"{base}/{label}", recursive=True)
                with store.open_output_stream(f"{base}/{label}/{name}") as out:
                    out.write(content or b"")
            yield batch.slice(0, 0)

    files.select("emotion", "file_name", "content").mapInArrow(run, "emotion string, file_name string, content binary").write.format(
        "noop"
    ).mode("overwrite").save()


def write_ledger(ledger: DataFrame, path: str) -> None:
    """SNK-7: the status ledger of one batch, replaced as a whole, so a rerun is harmless.

    Booleans are written as ``True`` and ``False``.
    """
    flags = [name for name, kind in ledger.dtypes if kind == "boolean"]
    text = ledger.withColumns({c: F.initcap(F.col(c).cast("string")) for c in flags})
    text.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")
