import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lexitally import session
from lexitally.operators import ingest
from lexitally.sources import listing, readers, sinks
from lexitally.streaming import ingest as streaming


@pytest.fixture()
def corpus(tmp_path):
    root = tmp_path / "transcripts"
    for label, name, data in [
        ("Joy", "JOY_001_IG_processed.txt", b" dua\nbaris \n"),
        ("Joy", "JOY_002_IG_processed.txt", b"\n"),
        ("Joy", "JOY_003_IG_processed.txt", b""),
        ("Joy", "notes.txt", b"not part of it"),
        ("Sad one+two", "SAD_001_GD_processed.txt", "sedih ½".encode()),
        ("Sad one+two", "SAD_002_GD_processed.txt", b"\xff\xfe bad"),
    ]:
        (root / label).mkdir(parents=True, exist_ok=True)
        (root / label / name).write_bytes(data)
    (root / "loose_processed.txt").write_text("not in a label")
    (root / "Joy" / "deep").mkdir()
    (root / "Joy" / "deep" / "x_processed.txt").write_text("too deep")
    return str(root)


def test_labelled_directories(spark, corpus):
    got = {(r.emotion, r.file_name, r.text) for r in readers.read_corpus(spark, corpus).collect()}
    assert got == {
        ("Joy", "JOY_001_IG_processed.txt", "dua\nbaris"),
        ("Sad one+two", "SAD_001_GD_processed.txt", "sedih ½"),
    }
    kept = {r.file_name: r.word_count for r in readers.read_corpus(spark, corpus, keep_empty=True).collect()}
    assert kept == {
        "JOY_001_IG_processed.txt": 2, "JOY_002_IG_processed.txt": 0, "JOY_003_IG_processed.txt": 0, "SAD_001_GD_processed.txt": 2,
    }
    bad = [tuple(r) for r in readers.read_errors(spark, corpus).collect()]
    assert bad == [("Sad one+two", "SAD_002_GD_processed.txt", "not valid UTF-8", 0)]


def test_listing_has_empty_files_and_sizes(spark, corpus, tmp_path):
    got = {tuple(r) for r in listing.list_files(spark, corpus).collect()}
    assert got == {
        ("Joy", "JOY_001_IG_processed.txt", 12), ("Joy", "JOY_002_IG_processed.txt", 1), ("Joy", "JOY_003_IG_processed.txt", 0),
        ("Joy", "notes.txt", 14), ("Sad one+two", "SAD_001_GD_processed.txt", 8), ("Sad one+two", "SAD_002_GD_processed.txt", 6),
    }
    assert listing.list_files(spark, corpus).rdd.getNumPartitions() == 2
    assert [tuple(r) for r in listing.empty_files(spark, corpus, "*_processed.txt").collect()] == [("Joy", "JOY_003_IG_processed.txt")]
    (tmp_path / "none").mkdir()
    assert listing.list_files(spark, str(tmp_path / "none")).isEmpty()
    with pytest.raises(AnalysisException):
        listing.list_files(spark, str(tmp_path / "nowhere")).collect()


def test_quarantine_parts_texts_in_one_pass(spark, tmp_path):
    """Positions against Python's decoder, a text's own replacement signs included."""
    data = {"a": b"ok", "b": b"ab\xffcd", "c": "é\ufffd".encode() + b"\xc3", "d": b"\xed\xa0\x80", "e": "\ufffd fine".encode(), "f": b"x\xe2\x82"}
    for name, content in data.items():
        (tmp_path / "in" / "L").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "L" / f"{name}_processed.txt").write_bytes(content)
    out = str(tmp_path / "out")
    good = readers.read_corpus(spark, str(tmp_path / "in"), quarantine=out)
    assert {r.file_name[0]: r.text for r in good.collect()} == {"a": "ok", "e": "\ufffd fine"}
    want = {}
    for name, content in data.items():
        try:
            content.decode()
        except UnicodeDecodeError as error:
            want[name] = (error.start, content)
    bad = readers.read_quarantine(spark, out).collect()
    assert {r.file_name[0]: (r.byte_position, bytes(r.content)) for r in bad} == want
    assert all(r.reason == "not valid UTF-8" and r.emotion == "L" for r in bad)


def test_corpus_files_are_even_and_few(spark, tmp_path):
    """A label with nearly all rows over many tasks: files by bytes and labels, not by tasks times labels."""
    docs = spark.range(6000, numPartitions=60).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("l"), F.col("id") % 7)).otherwise("hot").alias("emotion"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
        sinks.write_corpus(docs, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = list((tmp_path / "out").rglob("*.parquet"))
    labels = {f.parent.name for f in files}
    assert len(labels) == 8 and len(labels) <= len(files) <= 2 * 6000 * 140 // 200_000 + 2 * len(labels)
    assert len([f for f in files if f.parent.name == "emotion=hot"]) >= 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6000


def test_a_backlog_is_worked_off_in_bounded_batches(spark, tmp_path):
    """Several batches, stopped between them and gone on with: every file once."""
    for i in range(12):
        (tmp_path / "raw" / "Joy").mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / "Joy" / f"J_{i:03d}_raw.txt").write_text(f"Text {i}! " * 20)
    stream = streaming.stream_texts(spark, str(tmp_path / "raw"), max_bytes=500).withColumn("doc_id", F.col("file_name"))
    seen, stops = [], [2]

    class Killed(Exception):
        pass

    def write(batch, number):
        if number in stops:
            stops.remove(number)
            raise Killed
        seen.append(number)
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))

    def run():
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="Killed"):
        run()
    assert seen == [0, 1]
    run()
    assert seen == list(range(len(seen))) and len(seen) >= 4
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.file_name for r in got) == [f"J_{i:03d}_processed.txt" for i in range(12)]


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_corpus(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError, match="no documents"):
        readers.require_rows(spark.createDataFrame([], "text string"))
    full = spark.createDataFrame([("a",), (" \n",)], "text string")
    assert readers.drop_blank(readers.require_rows(full)).count() == 1


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿id,extra,video,emotion\n1,x,"https://a.b/""q"",1",Joy\n2,,,Joy\n', encoding="utf-8")
    rows = readers.read_manifest(spark, str(path)).orderBy("row_order").collect()
    assert [(r.id, r.video, r.emotion) for r in rows] == [("1", 'https://a.b/"q",1', "Joy"), ("2", "", "Joy")]
    assert readers.read_manifest(spark, str(path), blank_as_null=True).where("video is null").count() == 1
    numbered = ingest.manifest_rows(readers.read_manifest(spark, str(path)))
    assert {r.dataset_id: r.video_id for r in numbered.collect()} == {"1": "JOY_001_UNSUPPORTED", "2": "JOY_002_UNSUPPORTED"}
    path.write_text("id\n1\n")
    with pytest.raises(ValueError, match=r"lacks the columns \['emotion', 'video'\]"):
        readers.read_manifest(spark, str(path))


def test_existing(spark, tmp_path):
    (tmp_path / "raw" / "Joy").mkdir(parents=True)
    (tmp_path / "raw" / "Joy" / "JOY_001_IG_raw.txt").write_text("x")
    (tmp_path / "raw" / "Joy" / "JOY_002_IG_raw.txt").write_text("")
    got = readers.existing_transcripts(spark, str(tmp_path / "raw")).collect()
    assert sorted(map(tuple, got)) == [("Joy", "JOY_001_IG"), ("Joy", "JOY_002_IG")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("X", 1, 'a "q", b', 0.5), ("Y", 1, "null", 0.25)], "emotion string, rank int, word string, mean_tfidf double")
    schema = "emotion string, rank int, word string, mean_tfidf double"
    sinks.write_report(df, str(tmp_path / "all"))
    back = readers.read_results(spark, str(tmp_path / "all"), schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_report_per_label(df, "emotion", str(tmp_path / "each"))
    only_x = readers.read_results(spark, str(tmp_path / "each" / "emotion_dir=X"), schema)
    assert [tuple(r) for r in only_x.collect()] == [("X", 1, 'a "q", b', 0.5)]


def test_corpus_table(spark, tmp_path):
    docs = spark.createDataFrame([("1", "X", "a"), ("2", "Y", "b")], "doc_id string, emotion string, text string")
    sinks.write_corpus(docs, str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"emotion=X", "emotion=Y"}
    got = readers.read_table(spark, str(tmp_path / "t"), "doc_id", "emotion", "text").collect()
    assert sorted(map(tuple, got)) == [("1", "X", "a"), ("2", "Y", "b")]


def test_stage_reports_metrics_and_cuts_lineage(spark):
    table, seen = session.stage(spark.range(10), n=F.count("id"), top=F.max("id"))
    assert seen == {"n": 10, "top": 9}
    assert table.count() == 10 and table.inputFiles()
    assert session.stage_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_shuffles_are_sized_for_the_input():
    assert session.shuffle_partitions(10) == 200
    assert session.shuffle_partitions(1 << 40) == 8192
    assert session.shuffle_partitions(100 << 40) == 20_000


def test_large_scans_are_left_alone(spark, tmp_path):
    spark.range(40).repartition(40).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert session.spread_single_file(many, "id") is many
    spark.range(40).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread_single_file(one, "id").count() == 40


def test_staged_tables_go_at_the_end(spark):
    from pyspark.errors import AnalysisException

    table, _ = session.stage(spark.range(3))
    session.drop_staged(spark)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        spark.read.parquet(*table.inputFiles())
    assert session.input_bytes(spark, "/root/testdata/sf0.001/region.parquet") > 0


def test_stream_takes_each_file_once(spark, tmp_path):
    root, out, check = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "check")
    (root / "Joy").mkdir(parents=True)
    (root / "Joy" / "JOY_001_IG_raw.txt").write_text("Halo,\nDUNIA!\n")
    (root / "Joy" / "other.txt").write_text("no")
    (root / "loose_raw.txt").write_text("no label")
    streaming.run_available(streaming.stream_texts(spark, str(root)), out, check, partition_by="emotion")
    (root / "Joy" / "JOY_002_IG_raw.txt").write_text("Baru www.x.id")
    streaming.run_available(streaming.stream_texts(spark, str(root)), out, check, partition_by="emotion")
    got = spark.read.parquet(out).collect()
    assert sorted((r.emotion, r.file_name, r.text) for r in got) == [
        ("Joy", "JOY_001_IG_processed.txt", "halo dunia"),
        ("Joy", "JOY_002_IG_processed.txt", "baru"),
    ]
    batch = streaming.cleaned_documents(readers.read_corpus(spark, str(root), "*_raw.txt")).collect()
    assert sorted(r.text for r in batch) == ["baru", "halo dunia"]


def test_ledger_batches(spark, tmp_path):
    source, out = tmp_path / "src", str(tmp_path / "ledger")
    one = spark.createDataFrame([(1,)], "id long")
    one.write.parquet(str(source / "a"))
    stream = lambda: spark.readStream.schema("id long").option("recursiveFileLookup", True).parquet(str(source))
    mark = lambda batch, earlier: batch.withColumn("status", F.lit("done"))
    streaming.run_ledger(stream(), mark, out, str(tmp_path / "c"))
    spark.createDataFrame([(2,)], "id long").write.parquet(str(source / "b"))
    streaming.run_ledger(stream(), mark, out, str(tmp_path / "c"))
    got = spark.read.parquet(out).collect()
    assert sorted((r.id, r.batch_id, r.status) for r in got) == [(1, 0, "done"), (2, 1, "done")]
