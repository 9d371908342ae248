import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexitally.functions import text
from lexitally.functions.defaults import STOPWORDS

CLEANING = [
    ("Halo, DUNIA!!! 5.30", "halo dunia 5 30"),
    ("lihat https://a.id/x?y=1 ya", "lihat ya"),
    ("buka www.contoh.id/p sekarang", "buka sekarang"),
    ("jalan-jalan – yuk — ayo", "jalan jalan yuk ayo"),
    ("snake_case tetap_sama", "snake_case tetap_sama"),
    ("", ""),
    ("  ...  ", ""),
    ("a b c\u001cd", "a b c d"),
    ("ÉCOLE über ½ كتاب 화장", "école über ½ كتاب 화장"),
    ("teks\nbaris\tdua", "teks baris dua"),
    ("HTTP://X.id,abc def", "def"),
    ("abchttps://x y", "abc y"),
    ("https:// a", "https a"),
]


def column(spark, values, *exprs):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(3)
    return [r[1:] for r in sorted(map(tuple, df.select("i", *exprs).collect()))]


def walked(t):
    """Words of a text, character by character: a link runs up to the next white space."""
    t, words, word, i = t.lower(), [], "", 0
    while i <= len(t):
        link = next((p for p in ("https://", "http://", "www.") if t.startswith(p, i)), None)
        if link and i + len(link) < len(t) and not t[i + len(link)].isspace():
            while i < len(t) and not t[i].isspace():
                i += 1
            c = " "
        else:
            c = t[i] if i < len(t) else " "
            i += 1
        if c.isalnum() or c == "_":
            word += c
        elif word:
            words.append(word)
            word = ""
    return words


def random_texts(n):
    rng = random.Random(7)
    # characters whose class no Unicode version since Java 17's has changed
    old = [chr(c) for c in range(1, 0x3100) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs")]
    pieces = ["http://", "https://", "www.", " ", "\n", "-", "–", "_", "a", "B", "7", ".", "\u0085", "　"]
    return ["".join(rng.choice(pieces) if rng.random() < 0.6 else rng.choice(old) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_cleaning(spark):
    got = column(spark, [a for a, _ in CLEANING], text.clean_text(F.col("t")))
    assert [g[0] for g in got] == [b for _, b in CLEANING]


def test_cleaning_equals_a_walk_over_the_characters(spark):
    texts = [t for t in random_texts(3000) if "İ" not in t]
    low = text.lower_case(F.col("t"))
    steps = text.collapse_space(text.punctuation_to_space(text.dashes_to_space(text.strip_urls(low))))
    got = column(spark, texts, text.clean_text(F.col("t")), steps, text.clean_words(F.col("t")))
    for t, (fused, stepwise, words) in zip(texts, got):
        expected = walked(t)
        assert fused == stepwise == " ".join(expected), repr(t)
        assert words == expected


def test_light_clean(spark):
    got = column(spark, ["﻿Joy ", " a﻿  b\n"], text.light_clean(F.col("t")))
    assert got == [("Joy",), ("a b",)]


def test_tokens(spark):
    values = ["", "  ", "a", " a_b c½ 7,x "]
    got = column(
        spark,
        values,
        text.whitespace_tokens(F.col("t")),
        text.word_count(F.col("t")),
        text.word_tokens(F.col("t")),
        text.is_blank(F.col("t")),
    )
    assert got == [
        ([], 0, [], True),
        ([], 0, [], True),
        (["a"], 1, ["a"], False),
        (["a_b", "c½", "7,x"], 3, ["a_b", "c½", "7", "x"], False),
    ]


def test_stopwords_go_before_phrases(spark):
    tokens = text.remove_words(text.whitespace_tokens(F.col("t")), STOPWORDS)
    got = column(spark, ["aku tidak suka kopi suka", "yang"], tokens, text.ngrams(tokens, 2), text.remove_stopwords(F.col("t"), STOPWORDS))
    assert got == [(["suka", "kopi", "suka"], ["suka kopi", "kopi suka"], "suka kopi suka"), ([], [], "")]
    assert len(set(STOPWORDS)) == len(STOPWORDS) == 91


@pytest.mark.parametrize("shortest,longest", [(1, 1), (1, 2), (1, 3), (2, 2), (3, 3)])
def test_ngrams(spark, shortest, longest):
    values = ["", "a", "a b", "a b c", "a b c d a b"]
    got = column(spark, values, text.ngram_range(text.whitespace_tokens(F.col("t")), shortest, longest))
    for value, (phrases,) in zip(values, got):
        w = value.split()
        assert phrases == [" ".join(w[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]


def test_valid_patterns(spark):
    values = ["7", "12", "a", "½", "كتاب", "3 kilo", "ai", "b2", " A ", "٣"]
    got = column(spark, values, text.is_valid_pattern(F.col("t")))
    assert [v for v, (ok,) in zip(values, got) if ok] == ["3 kilo", "ai", "b2"]


def test_rounding_is_half_to_even(spark):
    row = spark.range(1).select(
        *[text.round_half_even(F.lit(x), 2).alias(str(i)) for i, x in enumerate((0.125, 221.125, 2.675, 0.375))]
    )
    assert tuple(row.first()) == (0.12, 221.12, 2.68, 0.38)
