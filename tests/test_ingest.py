import random

import pytest
from pyspark.sql import functions as F

from lexitally.functions import routing
from lexitally.operators import ingest, ranking

MANIFEST = [
    (1, "a", "https://www.instagram.com/reel/x", "Joy"),
    (2, "b", "http://user@Drive.Google.com:80/file/d/AbC/view", "﻿Joy"),
    (3, "c", "nope", " Joy "),
    (4, "d", "https://x.cdninstagram.com/v.mp4", "Joy"),
    (5, "e", "https://drive.google.com/open?id=Q9&x=1", "Be-rani"),
    (6, "f", "https://drive.google.com/drive/folders", "Be-rani"),
    (7, "g", "https://instagram.example/p", "Be-rani"),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(MANIFEST, "row_order long, id string, video string, emotion string")
    return ingest.manifest_rows(df.repartition(4)).cache()


def test_manifest_rows(rows):
    got = {r.dataset_id: (r.emotion, r.source_type, r.video_id) for r in rows.collect()}
    assert got == {
        "a": ("Joy", "IG", "JOY_001_IG"),
        "b": ("Joy", "GD", "JOY_002_GD"),
        "c": ("Joy", "UNSUPPORTED", "JOY_003_UNSUPPORTED"),
        "d": ("Joy", "IG", "JOY_004_IG"),
        "e": ("Be-rani", "GD", "BER_001_GD"),
        "f": ("Be-rani", "GD", "BER_002_GD"),
        "g": ("Be-rani", "IG", "BER_003_IG"),
    }


def test_url_parts(rows):
    got = {r[0]: r[1:] for r in rows.select("dataset_id", routing.drive_file_id(F.col("url")), routing.url_host(F.col("url"))).collect()}
    assert got["b"] == ("AbC", "user@Drive.Google.com:80")
    assert got["e"] == ("Q9", "drive.google.com")
    assert got["c"] == (None, None)


def test_paths_and_long_numbers(spark):
    row = spark.range(1).select(
        routing.raw_path(F.lit("Joy"), F.lit("JOY_001_IG")),
        routing.processed_path(F.lit("Joy"), F.lit("JOY_001_IG")),
        routing.processed_name(F.lit("x_raw.txt")),
        routing.video_id(F.lit("Joy"), F.lit(12345), F.lit("IG")),
    )
    assert tuple(row.first()) == (
        "data/1_raw/transcripts/Joy/JOY_001_IG_raw.txt",
        "data/2_processed/transcripts/Joy/JOY_001_IG_processed.txt",
        "x_processed.txt",
        "JOY_12345_IG",
    )


def test_error_notes(spark):
    tries = [
        ("1", "GD", 1, "Quota exceeded"),
        ("2", "GD", 1, "  odd \n"),
        ("3", "GD", 1, " "),
        ("4", "IG", 1, "Video is PRIVATE"),
        ("5", "IG", 1, ""),
        ("6", "IG", 0, "warning 404"),
    ]
    df = spark.createDataFrame(tries, "video_id string, source_type string, return_code int, message string")
    got = {r.video_id: (r.error_class, r.message) for r in ingest.outcomes_from_attempts(df).collect()}
    assert got == {
        "1": ("unavailable", "google drive file deleted/unavailable/private"),
        "2": ("unavailable", "odd"),
        "3": ("unavailable", "gdown failed"),
        "4": ("unavailable", "instagram video deleted/unavailable/private"),
        "5": ("unavailable", "yt-dlp failed"),
        "6": (None, ""),
    }


def statuses(df):
    return {r.dataset_id: (r.status, r.has_raw_transcript, r.notes) for r in df.collect()}


def test_status_rules(spark, rows):
    existing = spark.createDataFrame([("Joy", "JOY_001_IG"), ("Joy", "JOY_003_UNSUPPORTED")], "emotion string, video_id string")
    outcomes = spark.createDataFrame(
        [("JOY_001_IG", None, ""), ("JOY_002_GD", None, ""), ("JOY_004_IG", "unavailable", "gone"), ("BER_001_GD", "OSError", "disk")],
        "video_id string, error_class string, message string",
    )
    ledger = ingest.ingest_status(rows, existing, outcomes)
    assert tuple(ledger.columns) == ingest.LEDGER_COLUMNS
    assert statuses(ledger) == {
        "a": ("skipped_existing", True, ""),
        "b": ("transcribed", True, ""),
        "c": ("unsupported_source", True, "Only Instagram and Google Drive sources are allowed"),
        "d": ("deleted_or_unavailable", False, "gone"),
        "e": ("failed", False, "disk"),
        "f": ("deleted_or_unavailable", False, "google drive file id could not be parsed"),
        "g": ("", False, ""),
    }
    methods = {r.dataset_id: r.transcription_method for r in ledger.collect()}
    assert methods["c"] == "" and methods["a"] == "whisper:small"
    redo = statuses(ingest.ingest_status(rows, existing, outcomes, skip_existing=False))
    assert redo["a"] == ("transcribed", True, "")
    dry = statuses(ingest.ingest_status(rows, existing, dry_run=True, limit=3))
    assert dry == {
        "a": ("skipped_existing", True, ""),
        "b": ("dry_run", False, ""),
        "c": ("unsupported_source", True, "Only Instagram and Google Drive sources are allowed"),
    }
    counts = {r.status: r["count"] for r in ingest.status_counts(ledger).collect()}
    assert counts["deleted_or_unavailable"] == 2 and sum(counts.values()) == 7
    pending = ingest.pending_rows(rows, existing)
    assert {r.dataset_id for r in pending.collect()} == {"b", "d", "e", "f", "g"}


def test_numbering_a_label_that_holds_most_rows(spark):
    rng = random.Random(3)
    values = [(i, "hot" if rng.random() < 0.9 else rng.choice("ab")) for i in range(5000)]
    rng.shuffle(values)
    df = spark.createDataFrame(values, "i long, g string").repartition(7)
    got = {r.i: r.n for r in ranking.number_within(df, "g", ["i"], "n").collect()}
    seen = {}
    for i, g in sorted(values):
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]


@pytest.mark.parametrize("top_n", [3, 1500])
def test_rank_within_large_groups(spark, top_n):
    df = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"))
    got = ranking.rank_within(df.repartition(6), "g", [F.col("id").desc()], top_n).collect()
    for g in "ab":
        ids = sorted((i for i in range(6000) if (i % 3 == 0) == (g == "b")), reverse=True)[:top_n]
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == ids


def test_one_ledger_row_per_manifest_row(spark):
    """Labels that share a code share ids; attempts repeat."""
    df = spark.createDataFrame(
        [(1, "a", "https://www.instagram.com/1", "Happy"), (2, "b", "https://www.instagram.com/2", "Hapless")],
        "row_order long, id string, video string, emotion string",
    )
    rows = ingest.manifest_rows(df)
    assert {r.video_id for r in rows.collect()} == {"HAP_001_IG"}
    tries = [("Happy", "HAP_001_IG", "IG", 1, "", 1), ("Happy", "HAP_001_IG", "IG", 0, "", 2), ("Hapless", "HAP_001_IG", "IG", 0, "", 1), ("Hapless", "HAP_001_IG", "IG", 1, "gone", 2)]
    attempts = spark.createDataFrame(tries, "emotion string, video_id string, source_type string, return_code int, message string, attempt int")
    existing = rows.select("emotion", "video_id").limit(0)
    ledger = ingest.ingest_status(rows, existing, ingest.outcomes_from_attempts(attempts))
    assert statuses(ledger) == {"a": ("transcribed", True, ""), "b": ("deleted_or_unavailable", False, "gone")}
    assert ingest.ingest_status(rows, existing, ingest.outcomes_from_attempts(attempts).drop("emotion")).count() == 2
