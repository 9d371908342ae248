import hashlib
import math
import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from lexitally.functions.text import whitespace_tokens
from lexitally.operators import eda, metrics, sampling


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        label = "hot" if rng.random() < 0.7 else rng.choice("ab")
        rows.append((i, label, " ".join(rng.choice("p q r s t u".split()) for _ in range(rng.randint(0, 9)))))
    rows.append((400, "empty", ""))
    df = spark.createDataFrame(rows, "id long, label string, text string").repartition(5)
    df = df.withColumn("words", whitespace_tokens(F.col("text"))).withColumn("word_count", F.size("words").cast("long"))
    return rows, df.cache()


def by_label(rows):
    groups = {}
    for _, label, text in rows:
        groups.setdefault(label, []).append(text.split())
    return groups


def test_length_summary(docs):
    rows, df = docs
    got = {r.label: r for r in eda.length_summary(df, "label").collect()}
    for label, texts in by_label(rows).items():
        lengths = [len(t) for t in texts]
        r = got[label]
        assert (r.transcript_count, r.total_words, r.min_words, r.max_words) == (len(lengths), sum(lengths), min(lengths), max(lengths))
        assert r.median_words == median(lengths)
        assert r.average_words == pytest.approx(sum(lengths) / len(lengths), abs=0.00501)


def test_vocabulary_and_top_words(docs):
    rows, df = docs
    sizes = {r.label: r.vocabulary_size for r in eda.vocabulary_size(df, "label").collect()}
    close = {r.label: r.vocabulary_size for r in eda.vocabulary_size(df, "label", approximate=True).collect()}
    by_word = {(r.label, r["rank"]): (r.word, r["count"]) for r in eda.top_words(df, "label", top_n=3).collect()}
    seen = {(r.label, r["rank"]): (r.word, r["count"]) for r in eda.top_words(df, "label", top_n=3, first_seen="id").collect()}
    assert sizes["empty"] == 0 and close == sizes
    for label, texts in by_label(rows).items():
        counts = Counter(w for t in texts for w in t)
        assert sizes[label] == len(counts)
        expected = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [by_word[label, i + 1] for i in range(len(expected))] == expected
        assert [seen[label, i + 1] for i in range(len(expected))] == counts.most_common(3)


def test_counts(spark, docs):
    rows, df = docs
    assert tuple(eda.corpus_summary(df).first()) == (len(rows), sum(not t.strip() for _, _, t in rows))
    some = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "x string")
    assert [tuple(r) for r in eda.value_counts(some, "x").collect()] == [("a", 2), ("b", 1)]
    assert eda.null_counts(some, "x").first()[0] == 1
    assert {r.x for r in eda.distinct_labels(some, "x").collect()} == {"a", "b", None}
    assert [tuple(r) for r in sampling.rare_labels(some, "x").collect()] == [("b", 1)]
    total = eda.length_histogram(df, "label", width=4).agg(F.sum("documents")).first()[0]
    assert total == len(rows)
    raw = spark.createDataFrame([("x", "a!!b!"), ("x", ""), ("y", "-")], "label string, text string")
    assert {tuple(r) for r in eda.exclamations(raw, "label").collect()} == {("x", 3, 1), ("y", 0, 0)}
    wide = {r.word: (r.hot, r.a) for r in eda.word_comparison(df, "label", labels=["hot", "a"]).collect()}
    counts = {l: Counter(w for t in texts for w in t) for l, texts in by_label(rows).items()}
    assert wide == {w: (counts["hot"][w], counts["a"][w]) for w in wide}


def test_sample_per_label(docs):
    rows, df = docs
    got = sampling.sample_per_label(df, "label", "id", 5).collect()
    again = sampling.sample_per_label(df.repartition(2), "label", "id", 5).collect()
    assert sorted((r.label, r.sample_no, r.id) for r in got) == sorted((r.label, r.sample_no, r.id) for r in again)
    counts = Counter(r.label for r in got)
    assert counts == {l: min(5, len(t)) for l, t in by_label(rows).items()}


@pytest.mark.parametrize("n,size", [(1, 0.2), (5, 0.2), (7, 0.2), (607, 0.2), (401, 0.5), (10, 1.0)])
def test_split_size_and_order(spark, n, size):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r.k: r.split for r in sampling.train_test_split(df, "k", size).collect()}
    order = sorted(range(n), key=lambda k: (hashlib.md5(f"{k}#42".encode()).hexdigest(), k))
    test = set(order[: math.ceil(size * n)])
    assert {k for k, s in got.items() if s == "test"} == test
    assert len(got) == n


def test_split_distribution(docs):
    rows, df = docs
    split = sampling.train_test_split(df, "id")
    assert sum(r["count"] for r in sampling.split_distribution(split, "label").collect()) == len(rows)


PAIRS = list(zip("AAABBC", "AABBBB"))


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "truth string, guess string").repartition(3).cache()


def test_class_metrics(pairs):
    got = {r.label: tuple(round(x, 6) for x in r[1:]) for r in metrics.class_report(pairs, "truth", "guess").collect()}
    assert got["A"] == (1.0, 0.666667, 0.8, 3.0)
    assert got["B"] == (0.5, 1.0, 0.666667, 2.0)
    assert got["C"] == (0.0, 0.0, 0.0, 1.0)
    assert got["accuracy"] == (0.666667,) * 4
    assert got["macro avg"] == (0.5, 0.555556, 0.488889, 6.0)
    assert got["weighted avg"][2] == 0.622222
    summary = metrics.metrics_summary(pairs, "truth", "guess").first()
    assert [round(x, 6) for x in summary] == [0.666667, 0.5, 0.555556, 0.488889, 0.622222]


def test_confusion(pairs):
    got = {(r.truth, r.prediction): r["count"] for r in metrics.confusion_counts(pairs, "truth", "guess").collect()}
    assert len(got) == 9 and sum(got.values()) == 6
    assert [got["A", x] for x in "ABC"] == [2, 1, 0]
    wide = {r.truth: (r.A, r.B, r.C) for r in metrics.confusion_matrix(pairs, "truth", "guess", "ABC").collect()}
    assert wide == {"A": (2, 1, 0), "B": (0, 2, 0), "C": (0, 1, 0)}


def test_a_label_that_is_only_predicted(spark):
    df = spark.createDataFrame([("A", "Z"), ("A", "A")], "truth string, guess string")
    got = {r.label: tuple(r[1:5]) for r in metrics.class_metrics(df, "truth", "guess").collect()}
    assert got["Z"] == (0.0, 0.0, 0.0, 0)
    assert len(metrics.confusion_counts(df, "truth", "guess").collect()) == 4


def test_class_weights(pairs):
    got = {r.truth: r.class_weight for r in metrics.class_weights(pairs, "truth").collect()}
    assert got == pytest.approx({"A": 6 / 9, "B": 1.0, "C": 2.0})
    assert sum(got[t] for t, _ in PAIRS) == pytest.approx(6)


def test_samples_come_in_label_order(spark):
    from lexitally.operators import sampling

    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "id long, g string").repartition(4)
    rows = sampling.in_label_order(sampling.sample_per_label(df, "g", "id"), "g").collect()
    assert [(r.g, r.sample_no) for r in rows] == [(g, n) for g in "ab" for n in range(1, 6)]


def test_sketches_of_batches_add_up(spark, tmp_path):
    """Batches written one by one and merged equal one pass; the estimate is within its bound."""
    rows = [(i, "ab"[i % 2], [f"w{(i * 37 + k) % 5000}" for k in range(30)]) for i in range(600)] + [(600, "a", []), (601, None, ["x"])]
    docs = spark.createDataFrame(rows, "id int, label string, words array<string>").repartition(4)
    for batch in range(3):
        eda.vocabulary_sketches(docs.where(F.col("id") % 3 == batch), "label").write.parquet(str(tmp_path / f"batch={batch}"))
    merged = eda.merge_sketches(spark.read.parquet(str(tmp_path)), "label")
    got = {r.label: r.vocabulary_size for r in eda.vocabulary_estimate(merged, "label").collect()}
    once = {r.label: r.vocabulary_size for r in eda.vocabulary_estimate(eda.vocabulary_sketches(docs, "label"), "label").collect()}
    exact = {r.label: r.vocabulary_size for r in eda.vocabulary_size(docs, "label").collect()}
    assert got == once and set(got) == set(exact)
    assert all(abs(got[x] - exact[x]) <= max(1, 0.02 * exact[x]) for x in exact)
