"""The runs end to end on a small tree of files."""

import random

import pytest

from lexitally.__main__ import main
from lexitally.plans import runs
from lexitally.sources import readers

VOICES = {"Joy": "senang tawa riang ceria", "Sad": "tangis duka sepi sunyi"}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    rng = random.Random(9)
    root = tmp_path_factory.mktemp("tree")
    for label, words in VOICES.items():
        (root / "raw" / label).mkdir(parents=True)
        for i in range(1, 16):
            some = rng.choices(words.split(), k=8) + ["yang", "dan"]
            text = f"{', '.join(some).upper()}! http://x.id/{i}\n"
            (root / "raw" / label / f"{label[:3].upper()}_{i:03d}_IG_raw.txt").write_text(text)
    (root / "raw" / "Joy" / "JOY_900_IG_raw.txt").write_bytes(b"\xff\xfe")
    (root / "raw" / "Joy" / "JOY_901_IG_raw.txt").write_text("...\n")
    return root


def test_all_runs(spark, tree):
    raw, corpus = str(tree / "raw"), str(tree / "corpus")
    outcome = {r.status: r["count"] for r in runs.clean(spark, raw, corpus).collect()}
    assert outcome == {"ok": 31, "failed": 1}
    docs = runs.load(spark, corpus)
    assert docs.count() == 30 and runs.load(spark, corpus, keep_empty=True).count() == 31
    assert docs.where("text like '%http%' or text <> lower(text)").isEmpty()

    runs.describe(spark, corpus, str(tree / "eda"))
    lengths = spark.read.csv(str(tree / "eda" / "text_length_by_emotion"), header=True, inferSchema=True).collect()
    assert [(r.emotion, r.transcript_count, r.max_words) for r in lengths] == [("Joy", 16, 10), ("Sad", 15, 10)]

    runs.rank(spark, corpus, str(tree / "rank"))
    schema = "emotion string, rank int, word string, mean_tfidf double"
    ranked = readers.read_results(spark, str(tree / "rank" / "tfidf_by_emotion_stopwords_removed"), schema).collect()
    assert {r.word for r in ranked if r.emotion == "Joy"} == set(VOICES["Joy"].split())
    everything = readers.read_results(spark, str(tree / "rank" / "tfidf_by_emotion"), schema).collect()
    assert {"yang", "dan"} <= {r.word for r in everything}

    runs.contrast(spark, str(tree / "rank"), str(tree / "contrast"))
    top = spark.read.csv(str(tree / "contrast" / "filtered" / "distinctive_words"), header=True, inferSchema=True)
    assert {r.word for r in top.where("emotion = 'Sad'").collect()} == set(VOICES["Sad"].split())

    compared = runs.classify(spark, corpus, str(tree / "model")).collect()
    assert {r.experiment for r in compared} == {"unigram", "stopwords", "bigram", "trigram"}
    assert all(r.accuracy == 1.0 for r in compared)


def test_clean_new_equals_clean(spark, tree, tmp_path):
    runs.clean(spark, str(tree / "raw"), str(tmp_path / "batch"))
    runs.clean_new(spark, str(tree / "raw"), str(tmp_path / "stream"), str(tmp_path / "check"))
    key = ["emotion", "file_name", "text"]
    batch = spark.read.parquet(str(tmp_path / "batch")).select(key)
    stream = spark.read.parquet(str(tmp_path / "stream")).select(key)
    assert batch.exceptAll(stream).isEmpty() and stream.exceptAll(batch).isEmpty()


def test_ingest_from_the_command_line(spark, tree, tmp_path, capsys):
    (tmp_path / "m.csv").write_text(
        "id,video,emotion\n1,https://www.instagram.com/a,Joy\n2,https://x.org/b,Joy\n3,https://www.instagram.com/c,Love\n"
    )
    main(["ingest_manifest", str(tmp_path / "m.csv"), str(tmp_path / "ledger"), "--raw", str(tree / "raw"), "--dry-run"])
    rows = spark.read.csv(str(tmp_path / "ledger"), header=True).collect()
    assert {(r.video_id, r.status, r.has_raw_transcript) for r in rows} == {
        ("JOY_001_IG", "skipped_existing", "True"),
        ("JOY_002_UNSUPPORTED", "unsupported_source", "False"),
        ("LOV_001_IG", "dry_run", "False"),
    }
    assert "skipped_existing" in capsys.readouterr().out
