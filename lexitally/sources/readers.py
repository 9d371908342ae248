"""Sources: manifest, labelled directories of texts, tables (SRC-1 to SRC-9)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.functions.routing import blank_to_null
from lexitally.functions.text import collapse_ends, is_blank, word_count
from lexitally.session import spread_single_file
from lexitally.sources import listing, sinks

# The columns of a manifest file.
MANIFEST_COLUMNS = ("id", "video", "emotion")


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """SRC-2: an error that names all missing columns, before any job runs."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")
    return df


def read_manifest(
    spark: SparkSession, path: str, blank_as_null: bool = False, multi_line: bool = True
) -> DataFrame:
    """SRC-1, SRC-7: all columns as text, with ``row_order`` for the order of the file.

    Quoted fields may hold line breaks. A file is then read by one task; without
    ``multi_line`` it can be split, but such a field would become two rows.
    """
    rows = spark.read.csv(path, header=True, escape='"', multiLine=multi_line)
    require_columns(rows, MANIFEST_COLUMNS)
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = rows.select(*MANIFEST_COLUMNS, order.alias("row_order"))
    return rows if blank_as_null else rows.na.fill("", subset=list(MANIFEST_COLUMNS))


def _decoded(path):
    """File paths come percent-encoded; a plus sign stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def labelled_files(files: DataFrame, root: str) -> DataFrame:
    """Label, file name and content of the files in the label folders under ``root``.

    ``files`` is a read or a stream of ``<root>/*``; files lying directly in
    ``root`` belong to no label and are left out.
    """
    path = _decoded(F.col("_metadata.file_path"))
    parts = r"([^/]+)/([^/]+)/([^/]+)$"
    return files.where(F.regexp_extract(path, parts, 1) == root.rstrip("/").rsplit("/", 1)[-1]).select(
        F.regexp_extract(path, parts, 2).alias("emotion"),
        F.regexp_extract(path, parts, 3).alias("file_name"),
        F.col("value"),
    )


def _texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    files = spark.read.text(f"{root.rstrip('/')}/*", wholetext=True, pathGlobFilter=pattern)
    return labelled_files(files, root)


def checked_texts(files: DataFrame) -> DataFrame:
    """SRC-9: label, file name and content, with what is wrong with it: ``reason`` and ``byte_position``, else null.

    ``files`` are those of ``labelled_files``, a read or a stream. The position counts the valid bytes before the first bad one.
    """
    # a replacement sign of the text itself must not be taken for one that stands for bad bytes; lengths stay
    own = F.replace("value", F.lit("\ufffd"), F.lit("???"))
    mended = F.make_valid_utf8(own)
    at = F.octet_length(mended.substr(F.lit(1), F.locate("\ufffd", mended) - 1)).cast("long")
    bad = ~F.is_valid_utf8("value")
    return files.select(
        "emotion", "file_name", "value", F.when(bad, "not valid UTF-8").alias("reason"), F.when(bad, at).alias("byte_position")
    )


def read_corpus(
    spark: SparkSession, root: str, pattern: str = "*_processed.txt", keep_empty: bool = False, quarantine: str | None = None
) -> DataFrame:
    """SRC-3, SRC-4, SRC-5: ``<root>/<label>/<file>``, one row per file, text without outer whitespace.

    Blank documents are left out unless ``keep_empty``; then files of no bytes are there too, and
    ``word_count`` is added, as the corpus statistics need it. Files that are not UTF-8 are left
    out; ``read_errors`` lists them. With a ``quarantine`` path all files are read once, and
    good and bad ones written there side by side: the result is the good part, ``read_quarantine``
    gives the bad one. A missing directory is Spark's own error.
    """
    files = _texts(spark, root, pattern)
    if quarantine is None:
        files = files.where(F.is_valid_utf8("value"))
    else:
        sinks.write_parted(checked_texts(files), quarantine)
        files = _parted(spark, quarantine, "good")
    docs = files.select(
        F.concat_ws("/", "emotion", "file_name").alias("doc_id"),
        "emotion",
        "file_name",
        collapse_ends(F.col("value")).alias("text"),
    )
    if keep_empty:
        empty = listing.empty_files(spark, root, pattern)
        empty = empty.select(F.concat_ws("/", "emotion", "file_name").alias("doc_id"), "*", F.lit("").alias("text"))
        return docs.unionByName(empty).withColumn("word_count", word_count(F.col("text")))
    return docs.where(F.col("text") != "")


def read_errors(spark: SparkSession, root: str, pattern: str = "*_processed.txt") -> DataFrame:
    """SRC-9: files that cannot be read as UTF-8, and where."""
    found = checked_texts(_texts(spark, root, pattern)).where("reason is not null")
    return found.select("emotion", "file_name", F.col("reason").alias("error"), "byte_position")


def _parted(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    schema = "emotion string, file_name string, value string, content binary, reason string, byte_position long, outcome string"
    return spark.read.schema(schema).parquet(path).where(F.col("outcome") == outcome)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: what ``read_corpus`` set aside: label, file name, reason, byte position and the bytes."""
    return _parted(spark, path, "bad").select("emotion", "file_name", "reason", "byte_position", "content")


def drop_blank(docs: DataFrame, text: str = "text") -> DataFrame:
    """FIL-1."""
    return docs.where(~is_blank(F.col(text)))


def require_rows(docs: DataFrame, message: str = "no documents found") -> DataFrame:
    """SRC-8: an error for an empty corpus, where training would be pointless."""
    if docs.isEmpty():
        raise ValueError(message)
    return docs


def existing_transcripts(spark: SparkSession, root: str, pattern: str = "*_raw.txt") -> DataFrame:
    """JOIN-4: ``(emotion, video_id)`` of the raw texts present, empty ones too; only file names are read."""
    files = listing.list_files(spark, root, pattern)
    vid = blank_to_null(F.regexp_extract("file_name", r"^(.*)_raw\.txt$", 1))
    return files.select("emotion", vid.alias("video_id"))


def read_table(spark: SparkSession, path: str, id_col: str, *columns: str) -> DataFrame:
    """A corpus kept as Parquet; a table of one file is spread over all cores by id."""
    return spread_single_file(spark.read.parquet(path).select(id_col, *columns), id_col)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-6: a result table written as CSV, with a given schema instead of a guessed one."""
    return spark.read.schema(schema).csv(path, header=True, escape='"')
