"""Manifest rows, status routing and the ledger (SCA-3 to SCA-8, WIN-1, JOIN-3, ING-1 to ING-3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.functions.defaults import (
    HOST_RULES,
    LABEL_CODES,
    LEDGER_COLUMNS,
    NO_DRIVE_ID_NOTE,
    UNSUPPORTED,
    UNSUPPORTED_NOTE,
)
from lexitally.functions.routing import classify_error, drive_file_id, raw_path, source_type, video_id
from lexitally.functions.text import light_clean
from lexitally.operators.ranking import first_rows, number_within


def manifest_rows(
    manifest: DataFrame,
    order: str = "row_order",
    dataset_id: str = "id",
    url: str = "video",
    label: str = "emotion",
    rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    codes: Mapping[str, str] = LABEL_CODES,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """SRC-1: cleaned, routed and numbered rows; rows of unsupported sources are numbered too.

    The number counts the rows of a label in the order of ``order``, from where the
    label's rows of an ``earlier`` ledger end.
    """
    rows = manifest.select(
        order,
        light_clean(F.col(dataset_id).cast("string")).alias("dataset_id"),
        light_clean(F.col(url)).alias("url"),
        light_clean(F.col(label)).alias("emotion"),
    )
    rows = rows.withColumn("source_type", source_type(F.col("url"), rules))
    numbered = number_within(rows, "emotion", [order])
    if earlier is not None:  # one row per label
        done = earlier.groupBy(F.col("emotion").alias("_emotion")).agg(F.count(F.lit(1)).alias("_done"))
        numbered = numbered.join(done, F.col("emotion").eqNullSafe(F.col("_emotion")), "left")
        numbered = numbered.withColumn("sequence", F.col("sequence") + F.coalesce("_done", F.lit(0))).drop("_emotion", "_done")
    vid = video_id(F.col("emotion"), F.col("sequence"), F.col("source_type"), codes)
    return numbered.withColumn("video_id", vid)


def outcomes_from_attempts(attempts: DataFrame) -> DataFrame:
    """Outcomes of download attempts ``(video_id, source_type, return_code, message)`` (SCA-8).

    ``error_class`` is null for success and ``unavailable`` for a failed download. The
    label ``emotion`` and the order ``attempt`` are carried along where they are given.
    """
    note = F.when(F.col("source_type") == "GD", classify_error(F.col("message"), "GD")).otherwise(
        classify_error(F.col("message"), "IG")
    )
    bad = F.col("return_code") != 0
    return attempts.select(
        *[c for c in ("emotion", "attempt") if c in attempts.columns],
        "video_id",
        F.when(bad, F.lit("unavailable")).alias("error_class"),
        F.when(bad, note).otherwise(F.lit("")).alias("message"),
    )


def ingest_status(
    rows: DataFrame,
    existing: DataFrame,
    outcomes: DataFrame | None = None,
    skip_existing: bool = True,
    dry_run: bool = False,
    limit: int | None = None,
    order: str = "row_order",
    method: str = "whisper:small",
    raw_root: str = "data/1_raw/transcripts",
) -> DataFrame:
    """ING-1, ING-2, ING-3: the ledger of a batch; of several reasons the first counts.

    ``rows`` is ``manifest_rows``, ``existing`` names the raw texts present as
    ``(emotion, video_id)``, ``outcomes`` holds ``(video_id, error_class,
    message)`` of what was attempted: no class is success, ``unavailable`` is a
    file that is gone, any other class a failure. Labels can share a code, so give
    ``emotion`` with the outcomes; of several attempts the last by ``attempt`` counts
    (without that column the largest note), and every row of the manifest has one row
    in the ledger. A row nobody attempted keeps an empty status. ``limit`` takes the first rows after numbering.
    """
    batch = rows if limit is None else first_rows(rows, [order], limit)
    present = existing.select("emotion", "video_id").distinct().withColumn("_present", F.lit(True))
    ledger = batch.join(present, ["emotion", "video_id"], "left").withColumn(
        "_present", F.coalesce("_present", F.lit(False))
    )
    if outcomes is None:
        ledger = ledger.withColumns({"_class": F.lit(None).cast("string"), "_note": F.lit("")}).withColumn(
            "_tried", F.lit(False)
        )
    else:
        keys = [c for c in ("emotion", "video_id") if c in outcomes.columns]
        found = F.struct(F.col("error_class").alias("_class"), F.coalesce("message", F.lit("")).alias("_note"))
        last = F.col("attempt") if "attempt" in outcomes.columns else found["_note"]
        tried = outcomes.groupBy(*keys).agg(F.max(F.struct(last.alias("_last"), found.alias("_found"))).alias("_best"))
        tried = tried.select(*keys, "_best._found.*", F.lit(True).alias("_tried"))
        ledger = ledger.join(tried, keys, "left").withColumn("_tried", F.coalesce("_tried", F.lit(False)))

    unsupported = F.col("source_type") == UNSUPPORTED
    no_id = (F.col("source_type") == "GD") & drive_file_id(F.col("url")).isNull()
    skipped = F.col("_present") & F.lit(skip_existing)
    tried, error = F.col("_tried"), F.col("_class")
    status = (
        F.when(unsupported, "unsupported_source")
        .when(skipped, "skipped_existing")
        .when(F.lit(dry_run), "dry_run")
        .when(no_id, "deleted_or_unavailable")
        .when(tried & error.isNull(), "transcribed")
        .when(tried & (error == "unavailable"), "deleted_or_unavailable")
        .when(tried, "failed")
        .otherwise("")
    )
    notes = (
        F.when(unsupported, UNSUPPORTED_NOTE)
        .when(skipped | F.lit(dry_run), "")
        .when(no_id, NO_DRIVE_ID_NOTE)
        .when(tried & error.isNotNull(), F.col("_note"))
        .otherwise("")
    )
    return ledger.select(
        "*",
        status.alias("status"),
        notes.alias("notes"),
        F.when(unsupported, "").otherwise(F.lit(method)).alias("transcription_method"),
        F.lit(False).alias("has_cleaned_transcript"),
        raw_path(F.col("emotion"), F.col("video_id"), raw_root).alias("raw_transcript_path"),
        F.lit("").alias("cleaned_transcript_path"),
    ).select(
        *[
            (F.col("_present") | (F.col("status") == "transcribed")).alias(c) if c == "has_raw_transcript" else c
            for c in LEDGER_COLUMNS
        ]
    )


def pending_rows(rows: DataFrame, existing: DataFrame, keys: Sequence[str] = ("emotion", "video_id")) -> DataFrame:
    """JOIN-4, ING-4: rows whose output is not there yet."""
    return rows.join(existing.select(*keys), list(keys), "left_anti")


def status_counts(ledger: DataFrame) -> DataFrame:
    """AGG-13."""
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("count"))
