"""Corpus statistics per label (AGG-1 to AGG-7, TOP-1, FIL-8) and the planned extras (OPT-1 to OPT-3).

Word-level statistics take ``words``, an array column such as
``whitespace_tokens(text)``. Nothing here gathers the rows of one label in a
task: counts, histograms and distinct words are all partly aggregated first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.functions.text import is_blank, round_half_even
from lexitally.operators.ranking import exploded, rank_within

def rows() -> Column:
    return F.count(F.lit(1))


def label_counts(df: DataFrame, label: str, out: str = "count") -> DataFrame:
    """AGG-1, AGG-2: rows per label, rows without a label left out."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(rows().alias(out))


def value_counts(df: DataFrame, value: str, out: str = "count") -> DataFrame:
    """AGG-2 in its published order: most frequent first, equal counts by value."""
    return label_counts(df, value, out).orderBy(F.col(out).desc(), value)


def corpus_summary(docs: DataFrame, text: str = "text") -> DataFrame:
    """AGG-3: number of documents and of blank ones."""
    return docs.agg(
        rows().alias("documents"),
        F.count_if(is_blank(F.col(text))).alias("blank_documents"),
    )


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    """FIL-8: nulls in each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """AGG-7."""
    return df.select(label).distinct()


def length_summary(docs: DataFrame, label: str, words: str = "word_count") -> DataFrame:
    """AGG-4: count, sum, mean, exact interpolated median, minimum and maximum of a length.

    The lengths are counted first, so a label is summarised from its histogram:
    one row per distinct length instead of one per document.
    """
    lengths = docs.groupBy(label, F.col(words).alias("_len")).agg(rows().alias("_n"))
    total = F.sum(F.col("_len") * F.col("_n"))
    return lengths.groupBy(label).agg(
        F.sum("_n").alias("transcript_count"),
        total.alias("total_words"),
        round_half_even(total / F.sum("_n"), 2).alias("average_words"),
        round_half_even(F.percentile("_len", 0.5, F.col("_n")), 2).alias("median_words"),
        F.min("_len").alias("min_words"),
        F.max("_len").alias("max_words"),
    )


def word_counts(docs: DataFrame, label: str, words: str = "words") -> DataFrame:
    """AGG-5: occurrences of each word in each label."""
    return exploded(docs, F.col(words), "word", label).groupBy(label, "word").agg(rows().alias("count"))


def vocabulary_size(docs: DataFrame, label: str, words: str = "words", approximate: bool = False) -> DataFrame:
    """AGG-6: distinct words per label, zero for a label without any.

    The exact count first makes (label, word) pairs distinct, spread over both
    columns, so a large label is shared by many tasks.
    """
    held = docs.select(label, F.explode_outer(F.array_distinct(words)).alias("word"))
    count = F.approx_count_distinct("word") if approximate else F.count_distinct("word")
    return held.groupBy(label).agg(count.alias("vocabulary_size"))


def top_words(
    docs: DataFrame, label: str, words: str = "words", top_n: int = 20, first_seen: str | None = None
) -> DataFrame:
    """TOP-1: the most frequent words of each label.

    Equal counts rank by word, or, when ``first_seen`` names the column that
    orders the documents, by first appearance.
    """
    if first_seen is None:
        counts = word_counts(docs, label, words)
        order = [F.col("count").desc(), F.col("word")]
    else:
        seen = docs.select(label, first_seen, F.posexplode_outer(words).alias("_pos", "word"))
        seen = seen.where(F.col("word").isNotNull())
        counts = seen.groupBy(label, "word").agg(
            rows().alias("count"), F.min(F.struct(first_seen, "_pos")).alias("_first")
        )
        order = [F.col("count").desc(), F.col("_first")]
    return rank_within(counts, label, order, top_n).select(label, "rank", "word", "count")


def length_histogram(docs: DataFrame, label: str, words: str = "word_count", width: int = 50) -> DataFrame:
    """OPT-1: documents per label in length classes of ``width`` words."""
    start = (F.floor(F.col(words) / width) * width).cast("long")
    return docs.groupBy(label, start.alias("length_from")).agg(rows().alias("documents"))


def exclamations(docs: DataFrame, label: str, text: str = "text") -> DataFrame:
    """OPT-2: exclamation marks per label in the raw text, and documents with any."""
    marks = F.regexp_count(F.col(text), F.lit("!")).cast("long")
    return (
        docs.select(label, marks.alias("_marks"))
        .groupBy(label)
        .agg(F.sum("_marks").alias("exclamations"), F.count_if(F.col("_marks") > 0).alias("documents_with_any"))
    )


def word_comparison(docs: DataFrame, label: str, words: str = "words", *, labels: Sequence[str] | None = None) -> DataFrame:
    """OPT-3: one row per word, its occurrences in every label of the data, or in those asked for.

    Labels of the data become columns, so there may be at most ``spark.sql.pivotMaxValues`` of them.
    """
    if labels is not None:
        docs = docs.where(F.col(label).isin(list(labels)))
    counts = word_counts(docs, label, words)
    return counts.groupBy("word").pivot(label, None if labels is None else list(labels)).agg(F.sum("count")).na.fill(0)


#: Digits of a sketch: its error is about 0.8 / sqrt(2 ** digits), 0.6 % here.
SKETCH_DIGITS = 14


def vocabulary_sketches(docs: DataFrame, label: str, words: str = "words", digits: int = SKETCH_DIGITS) -> DataFrame:
    """AGG-6 for growing corpora: ``sketch`` of the distinct words per label, of a bounded size whatever the words are.

    Sketches of batches add up (``merge_sketches``) to the sketch of all of them, so a new batch is
    read alone. Only the sketches are shuffled. Blank labels' documents have a null label and a sketch too.
    """
    held = exploded(docs, F.array_distinct(words), "_word", label)
    return held.groupBy(label).agg(F.hll_sketch_agg("_word", F.lit(digits)).alias("sketch"))


def merge_sketches(sketches: DataFrame, label: str) -> DataFrame:
    """One sketch per label of the sketches of several batches."""
    return sketches.groupBy(label).agg(F.hll_union_agg("sketch").alias("sketch"))


def vocabulary_estimate(sketches: DataFrame, label: str) -> DataFrame:
    """AGG-6, about: distinct words per label from their sketch."""
    return sketches.select(label, F.hll_sketch_estimate("sketch").alias("vocabulary_size"))
