import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexitally.operators import distinct, tfidf

DOCS = [("d1", "X", "a a b"), ("d2", "X", "b c"), ("d3", "Y", "c c c"), ("d4", "Y", "")]
SCHEMA = "id string, label string, text string"


def frame(spark, docs, **options):
    return tfidf.with_terms(spark.createDataFrame(docs, SCHEMA).repartition(3), **options)


def brute(docs, grams=(1, 1), stop=(), min_df=1, sublinear=False):
    """Weights per document and mean scores per label, straight from the formulas."""
    kept = [(i, l, t.split()) for i, l, t in docs if t.strip()]
    terms = {}
    for i, _, words in kept:
        words = [w for w in words if w not in stop]
        terms[i] = Counter(
            " ".join(words[k : k + n]) for n in range(grams[0], grams[1] + 1) for k in range(len(words) - n + 1)
        )
    df = Counter(t for c in terms.values() for t in c)
    idf = {t: math.log((1 + len(kept)) / (1 + n)) + 1 for t, n in df.items() if n >= min_df}
    weights, sums = {}, defaultdict(float)
    sizes = Counter(l for _, l, _ in kept)
    for i, l, _ in kept:
        raw = {t: ((1 + math.log(n)) if sublinear else n) * idf[t] for t, n in terms[i].items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        for t, x in raw.items():
            weights[i, t] = x / norm
            sums[l, t] += x / norm / sizes[l]
    return weights, dict(sums)


def test_published_example(spark):
    docs = frame(spark, DOCS)
    vocab = tfidf.fit_vocabulary(docs, "label")
    assert (vocab.n_docs, vocab.n_terms, vocab.n_postings) == (3, 3, 5)
    weights = {(r.id, r.term): round(r.weight, 6) for r in tfidf.document_weights(docs, vocab, "id").collect()}
    assert weights == {
        ("d1", "a"): 0.934702,
        ("d1", "b"): 0.355432,
        ("d2", "b"): 0.707107,
        ("d2", "c"): 0.707107,
        ("d3", "c"): 1.0,
    }
    ranked = tfidf.tfidf_ranking(spark.createDataFrame(DOCS, SCHEMA), "id", "label")
    assert sorted(map(tuple, ranked.collect())) == [
        ("X", 1, "b", 0.53127),
        ("X", 2, "a", 0.467351),
        ("X", 3, "c", 0.353553),
        ("Y", 1, "c", 1.0),
    ]


def test_a_document_emptied_by_stopwords_still_counts(spark):
    docs = DOCS[:3] + [("d4", "Y", "stop")]
    vocab = tfidf.fit_vocabulary(frame(spark, docs, stopwords=["stop"]), "label")
    assert vocab.n_docs == 4
    ranked = tfidf.tfidf_ranking(spark.createDataFrame(docs, SCHEMA), "id", "label", stopwords=["stop"])
    assert [tuple(r) for r in ranked.where("label = 'Y'").collect()] == [("Y", 1, "c", 0.5)]


def skewed_docs(n=120):
    """One label with most documents, one word in all of them, many rare words."""
    rng = random.Random(11)
    docs = []
    for i in range(n):
        label = "hot" if rng.random() < 0.8 else rng.choice(["x", "y"])
        words = ["common"] * rng.randint(1, 4) + [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 30))]
        rng.shuffle(words)
        docs.append((f"d{i}", label, " ".join(words)))
    return docs + [("blank", "hot", " "), ("long", "x", "z" * 400 + " common")]


@pytest.mark.parametrize("limit", [1_000_000, 40, 5, 1])
@pytest.mark.parametrize("options", [{}, {"grams": (2, 2), "min_df": 2}, {"grams": (1, 3), "sublinear": True, "stop": ("w1",)}])
def test_scores_against_brute_force_on_every_join_path(spark, limit, options):
    docs = skewed_docs()
    weights, scores = brute(docs, **options)
    corpus = frame(spark, docs, ngrams=options.get("grams", (1, 1)), stopwords=options.get("stop", ()))
    vocab = tfidf.fit_vocabulary(corpus, "label", options.get("min_df", 1), options.get("sublinear", False))
    got = {(r.label, r.term): r.score for r in tfidf.label_scores(corpus, vocab, "id", "label", limit=limit).collect()}
    assert got == pytest.approx(scores)
    rows = tfidf.document_weights(corpus, vocab, "id", limit=limit).collect()
    assert {(r.id, r.term): r.weight for r in rows} == pytest.approx(weights)
    squares = defaultdict(float)
    for r in rows:
        squares[r.id] += r.weight**2
    assert all(x == pytest.approx(1) for x in squares.values())


def test_head_is_bounded_and_rest_has_no_hot_term(spark):
    vocab = tfidf.fit_vocabulary(frame(spark, skewed_docs()), "label")
    for limit in (1, 5, 40):
        head, rest = tfidf.split_head(vocab, limit)
        assert head.count() <= limit
        assert (head.agg(F.sum(F.octet_length("term"))).first()[0] or 0) <= limit * tfidf.TERM_BYTES
        assert head.count() + rest.count() == vocab.n_terms
        least = -(-vocab.n_postings // limit)
        for r in rest.collect():
            assert r.df < least * max(1, len(r.term) / tfidf.TERM_BYTES)


def test_frozen_vocabulary(spark):
    train, test = frame(spark, DOCS), frame(spark, [("t1", "X", "a new c"), ("t2", "X", "new")])
    vocab = tfidf.fit_vocabulary(train, "label")
    got = {(r.id, r.term): r.weight for r in tfidf.document_weights(test, vocab, "id").collect()}
    a, c = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    norm = math.hypot(a, c)
    assert got == pytest.approx({("t1", "a"): a / norm, ("t1", "c"): c / norm})


SCORES = [("b", "X", 0.531270), ("a", "X", 0.467351), ("c", "X", 0.353553), ("c", "Y", 1.0)]


def table(spark, rows=SCORES, **options):
    df = spark.createDataFrame(rows, "word string, emotion string, mean_tfidf double")
    return {(r.emotion, r.word): r for r in distinct.distinctiveness(df, **options).collect()}


def test_distinctiveness(spark):
    got = {k: round(r.distinctiveness, 6) for k, r in table(spark).items()}
    assert got == {
        ("X", "b"): 0.53127,
        ("X", "a"): 0.467351,
        ("X", "c"): -0.646447,
        ("Y", "c"): 0.646447,
        ("Y", "a"): -0.467351,
        ("Y", "b"): -0.53127,
    }


def test_carryover_follows_the_growing_pivot(spark):
    rng = random.Random(5)
    labels, words = list("ABCDE"), [f"w{i}" for i in range(12)]
    rows = [(w, l, rng.random()) for w in words for l in labels if rng.random() < 0.6]
    got = table(spark, rows, carryover=True)
    present = sorted({l for _, l, _ in rows})
    for w in {w for w, _, _ in rows}:
        line = {l: sum(s for a, b, s in rows if (a, b) == (w, l)) for l in present}
        extra = {}
        for l in present:
            others = [s for k, s in line.items() if k != l] + list(extra.values())
            mean = sum(others) / len(others)
            extra = {"mean": mean, "difference": line[l] - mean}
            assert got[l, w].distinctiveness == pytest.approx(line[l] - mean)
            assert got[l, w].score == pytest.approx(line[l])


def test_single_label_has_no_others(spark):
    assert table(spark, [("a", "X", 0.5)])["X", "a"].other_mean is None


def test_filter_and_top(spark):
    rows = [("12", "X", 0.9), ("ai", "X", 0.8), ("bi", "X", 0.7), ("bi", "Y", 0.7), ("ci", "Y", 0.2)]
    df = distinct.distinctiveness(spark.createDataFrame(rows, "word string, emotion string, mean_tfidf double"))
    kept = distinct.published_order(distinct.valid_patterns(df)).collect()
    assert [(r.emotion, r.word) for r in kept] == [("X", "ai"), ("Y", "ci")]
    top = distinct.top_patterns(df, top_n=1).collect()
    assert sorted((r.emotion, r.word, r["rank"]) for r in top) == [("X", "12", 1), ("Y", "ci", 1)]
    everything = distinct.top_patterns(df, top_n=15, positive_only=False)
    assert everything.count() == 2 * 4
    wide = distinct.score_pivot(spark.createDataFrame(rows, "word string, emotion string, mean_tfidf double"), "word", "emotion", ["X", "Y"])
    assert {r.word: (r.X, r.Y) for r in wide.collect()}["ai"] == (0.8, 0.0)


def test_empty_corpus(spark):
    for docs in ([], [("d", "X", " ... ")]):
        assert tfidf.tfidf_ranking(spark.createDataFrame(docs, SCHEMA), "id", "label").isEmpty()


def test_processed_texts_are_taken_as_they_are(spark):
    """Stopwords go by whitespace, tokens by word characters, case stays, "..." is not blank."""
    docs = [("1", "X", "Aku, suka aku"), ("2", "X", "..."), ("3", "X", " ")]
    got = {r.id: r.terms for r in frame(spark, docs, stopwords=["aku"], raw=False).collect()}
    assert got == {"1": ["Aku", "suka"], "2": []}
