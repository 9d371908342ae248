"""Rankings and feature counts over blocks of numbered words."""

import math
import os
import random

import pytest
from test_tfidf import SCHEMA, brute, skewed_docs

from lexitally.operators import linear, phrase_blocks, tfidf
from lexitally.session import stage_root


def expected(docs, grams, min_df, sublinear, stop, top_n):
    """Top terms by the formulas; documents that share an id are normed together."""
    _, scores = brute(docs, grams, stop, min_df, sublinear)
    out = []
    for label in {label for label, _ in scores}:
        own = sorted((-round(s, 12), t) for (name, t), s in scores.items() if name == label)
        out += [(label, k, t, -s) for k, (s, t) in enumerate(own[:top_n], 1)]
    return {(label, k): (t, s) for label, k, t, s in out}


@pytest.mark.parametrize("key_bits", [62, 9])
@pytest.mark.parametrize("options", [((1, 1), 1, False, ()), ((2, 2), 2, False, ()), ((1, 4), 1, True, ("w1", "common"))])
def test_ranking_over_many_blocks_and_ranges(spark, monkeypatch, options, key_bits):
    monkeypatch.setattr(phrase_blocks, "BLOCK_BYTES", 300)
    monkeypatch.setattr(phrase_blocks, "RANGE_ENTRIES", 100)
    monkeypatch.setattr(phrase_blocks, "KEY_BITS", key_bits)
    docs, (grams, min_df, sublinear, stop) = skewed_docs(), options
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    for limit in (1_000_000, 1):
        got = tfidf.tfidf_ranking(df, "id", "label", "text", grams, stop, min_df, sublinear, 25, limit=limit).collect()
        want = expected(docs, grams, min_df, sublinear, stop, 25)
        assert {(r.label, r["rank"]): r.word for r in got} == {at: t for at, (t, _) in want.items()}
        assert {(r.label, r["rank"]): r.mean_tfidf for r in got} == pytest.approx({at: s for at, (_, s) in want.items()}, abs=1e-6)
    blocks = phrase_blocks.phrase_blocks(df, "id", "label", "text", stop)
    assert blocks.n_blocks > 8
    counts = blocks.feature_counts([(1, 1, 1), (1, 2, 1), (2, 3, 2)])
    assert counts == [len({t for _, t in brute(docs, g, stop, m)[1]}) for g, m in (((1, 1), 1), ((1, 2), 1), ((2, 3), 2))]


def test_shared_and_null_ids_and_null_labels(spark):
    """Rows of one id share a norm, rows of no id too; rows without a label count as documents and are not ranked."""
    docs = [("1", "X", "a"), ("1", "X", "b"), (None, "Y", "c"), (None, "Y", "d"), ("2", None, "a"), ("3", "Y", None)]
    got = tfidf.tfidf_ranking(spark.createDataFrame(docs, SCHEMA), "id", "label").collect()
    a, b = 1 + math.log(6 / 3), 1 + math.log(6 / 2)
    norm = (a * a + b * b) ** 0.5
    half = round(2**-0.5 / 2, 6)
    assert sorted(map(tuple, got)) == [
        ("X", 1, "b", round(b / norm / 2, 6)), ("X", 2, "a", round(a / norm / 2, 6)), ("Y", 1, "c", half), ("Y", 2, "d", half)
    ]


@pytest.mark.parametrize("key_bits", [62, 9])
@pytest.mark.parametrize("options", [((3, 3), 2, False, ()), ((3, 4), 3, True, ("w1",))])
def test_phrases_of_too_few_documents_do_not_travel(spark, monkeypatch, options, key_bits):
    """every phrase was sent whole, though most are in one document."""
    monkeypatch.setattr(phrase_blocks, "BLOCK_BYTES", 600)
    monkeypatch.setattr(phrase_blocks, "RANGE_ENTRIES", 400)
    monkeypatch.setattr(phrase_blocks, "KEY_BITS", key_bits)
    rng, (grams, min_df, sublinear, stop) = random.Random(5), options
    docs = [(str(i), "XY"[i % 2], " ".join(rng.choice(["a b c", "c a b d", f"u{i}", f"w{rng.randrange(9)}"]) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = tfidf.tfidf_ranking(df, "id", "label", "text", grams, stop, min_df, sublinear, 25).collect()
    want = expected(docs, grams, min_df, sublinear, stop, 25)
    assert {(r.label, r["rank"]): r.word for r in got} == {at: t for at, (t, _) in want.items()}
    blocks = phrase_blocks.phrase_blocks(df, "id", "label", "text", stop)
    keys, n = blocks._keys(grams[1]), 4
    thinned = blocks._thinned(keys, grams[0], n, min_df)
    sent, all_sent = (
        sum(len(r["keys"]) for r in blocks._sent(keys, grams[0], n, x).select("keys").collect()) for x in (thinned, blocks.blocks)
    )
    assert 0 < sent < 0.7 * all_sent
    assert phrase_blocks._unpacked(phrase_blocks._packed(linear.np.array([0, 300]))).tolist() == [0, 300]


def test_a_ranking_writes_less_than_its_text(spark):
    """the table of counted phrases was some times the text."""
    rng = random.Random(3)
    docs = [(str(i), "X", " ".join(f"word{rng.randrange(500)}" for _ in range(300))) for i in range(300)]
    size = sum(len(t) for *_, t in docs)

    def written():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(stage_root(spark)) for f in files)

    before = written()
    tfidf.tfidf_ranking(spark.createDataFrame(docs, SCHEMA), "id", "label", ngrams=(1, 3)).collect()
    assert written() - before < size


def test_blocks_of_the_solver_grow_before_their_number():
    """F2 to F7: what blocks exchange grows with their number times their terms."""
    assert linear.block_count(100, 8) == 1
    assert linear.block_count(10 * linear.BLOCK_ENTRIES, 8) == 10
    assert linear.block_count(200 * linear.BLOCK_ENTRIES, 8) == 16
    assert linear.block_count(1600 * linear.BLOCK_ENTRIES, 8) == 100


def test_sums_of_phrases_of_one_block_stay_there_unless_they_lead(spark, monkeypatch, tmp_path):
    """F8: every phrase's sum travelled, though most phrases are in one document and cannot be among the first."""
    monkeypatch.setattr(phrase_blocks, "BLOCK_BYTES", 1000)
    place, first = tmp_path / "sums", phrase_blocks._best

    def best(*options):
        def run(batches):
            def seen():
                for batch in batches:
                    with open(place, "a") as file:
                        file.write(f"{sum(len(x) for x in batch.column('sums').to_pylist()) // 8}\n")
                    yield batch

            yield from first(*options)(seen())

        return run

    monkeypatch.setattr(phrase_blocks, "_best", best)
    docs = [(str(i), "XY"[i % 2], " ".join([f"u{i}x{k}" for k in range(8) for _ in range(k + 1)] + ["common words"] * (i % 3))) for i in range(60)]
    got = tfidf.tfidf_ranking(spark.createDataFrame(docs, SCHEMA).repartition(3), "id", "label", ngrams=(1, 2), top_n=2).collect()
    want = expected(docs, (1, 2), 1, False, (), 2)
    assert {(r.label, r["rank"]): (r.word, r.mean_tfidf) for r in got} == {at: (t, pytest.approx(s, abs=1e-6)) for at, (t, s) in want.items()}
    assert sum(map(int, place.read_text().split())) < 0.3 * 60 * (8 + 15)  # eight words and fifteen pairs of their own


def test_keys_are_sent_by_planes_of_bytes():
    """F8, F10: bytes of keys that neighbours share lie together, and all keys come back."""
    keys = linear.np.array([[5, 5, 1 << 61], [0, 7 << 40, 3]])
    assert phrase_blocks._keys_of(phrase_blocks._planes(keys), 2).tolist() == keys.tolist()
    assert phrase_blocks._planes(keys[:, :0]) == b"" and phrase_blocks._planes(keys)[:4] == bytes([5, 5, 0, 0])
    assert phrase_blocks._keys_of(b"", 2).shape == (2, 0)
