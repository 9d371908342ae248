"""Every query next to its SQL twin, on whole tables."""

import pytest
from compare import difference, oracle

from __spark_entry__ import entry, oracle_sql, queries
from lexitally.plans.oracles import ORACLES
from lexitally.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 120


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert difference(queries()[name](spark, FOLDER), con, oracle_sql()[name]) is None


def test_streamed_equals_batch(spark):
    from lexitally.plans.queries import documents
    from lexitally.streaming.ingest import cleaned_documents

    streamed = queries()["stream_clean_ingest"](spark, FOLDER).select("doc_id", "lang", "text")
    batch = cleaned_documents(documents(spark, FOLDER, "lang", "text"))
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_streams_take_whole_directory_tables_and_number_on(spark, con, tmp_path):
    """Tables of several files, and a ledger over two batches whose second is retried."""
    for name in ("documents", "pages", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_clean_ingest", "stream_ledger"):
        assert difference(queries()[name](spark, str(tmp_path)), con, oracle_sql()[name]) is None

    from pyspark.sql import functions as F

    from lexitally.operators import ingest
    from lexitally.plans.queries import PAGE_CODES, PAGE_RULES, attempts, existing_pages, manifest_ids
    from lexitally.streaming.ingest import run_ledger, stream_table

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    middle = pages.count() // 2
    source, out = tmp_path / "in", str(tmp_path / "out")
    label = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1).alias("label")

    def to_ledger(batch, earlier):
        rows = ingest.manifest_rows(batch.select("page_id", "url", label), "page_id", "page_id", "url", "label", PAGE_RULES, PAGE_CODES, earlier)
        return ingest.ingest_status(rows, existing_pages(spark, FOLDER, rows), attempts(rows), order="page_id")

    for k, part in enumerate((pages.where(F.col("page_id") < middle), pages.where(F.col("page_id") >= middle))):
        part.coalesce(1).write.mode("append").parquet(str(source / "t.parquet"))
        run_ledger(stream_table(spark, str(source), "t.parquet", pages.schema), to_ledger, out, str(tmp_path / "check"))
    ledger = spark.read.parquet(out)
    ids = {r.video_id for r in manifest_ids(spark, FOLDER).collect()}
    assert ledger.select("batch_id").distinct().count() == 2
    assert sorted(r.video_id for r in ledger.collect()) == sorted(ids)
    second = ledger.where("batch_id = 1").drop("batch_id")
    again = to_ledger(pages.where(F.col("page_id") >= middle), ledger.where("batch_id < 1"))
    assert second.exceptAll(again).isEmpty() and again.exceptAll(second).isEmpty()
