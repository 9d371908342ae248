"""TF-IDF over a labelled corpus (TXT-1 to TXT-11, AGG-9, AGG-10).

A corpus is a DataFrame with one row per document. ``with_terms`` adds the
document's terms as an array, and from there a document stays one row until its
terms have been counted, so no shuffle is needed to count them.

The work is two passes over the documents:

1. ``fit_vocabulary`` counts, for every term, the documents that hold it, and
   writes that table. Nothing larger than the vocabulary is shuffled.
2. ``label_scores`` (or ``document_weights``) weighs every term of a document.
   Given documents hashed by id while they were still text, as ``hashed_terms``
   does, counting, weighing and the document norm all happen in place: the text
   is the largest thing that is ever shuffled, and only once.

The vocabulary is broadcast only while it is small (``MAX_BROADCAST_TERMS``).
Beyond that the frequent head of it is broadcast, whose size has a proven bound
(see ``split_head``), and only the postings of rare terms are shuffled to them.
Frequent terms, the ones that would make a hot key, never are.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexitally.functions.text import (
    clean_words,
    is_blank,
    ngram_range,
    remove_stopwords,
    remove_words,
    word_tokens,
)
from lexitally.operators.ranking import exploded, rank_within
from lexitally.session import stage

MAX_BROADCAST_TERMS = 1_000_000
TERM_BYTES = 256


def with_terms(
    docs: DataFrame,
    text: str = "text",
    ngrams: tuple[int, int] = (1, 1),
    stopwords: Iterable[str] = (),
    raw: bool = True,
) -> DataFrame:
    """Replace ``text`` by the array ``terms`` and drop blank documents (FIL-1, FIL-9, SCA-13 to SCA-15).

    ``raw`` texts are cleaned on the way. Others are taken as they are: stopwords
    go by whitespace, the rest is tokenised by word characters. A document that
    only loses its words to the stopwords stays, with no terms.

    Blank documents are dropped by a generator of no or one row. A plain filter
    would be pushed down to the scan and tokenise every text a second time.
    """
    keep = [c for c in docs.columns if c != text]
    stopwords = tuple(stopwords)
    if raw:
        held = docs.select(*keep, clean_words(F.col(text)).alias("_all"))
        held = exploded(held, F.when(F.size("_all") > 0, F.array("_all")), "_words", *keep)
        words = remove_words(F.col("_words"), stopwords)
    else:
        held = docs.where(~is_blank(F.col(text)))
        words = word_tokens(remove_stopwords(F.col(text), stopwords) if stopwords else F.col(text))
    out = held.select(*keep, words.alias("_tokens"))
    return out.select(*keep, ngram_range(F.col("_tokens"), *ngrams).alias("terms"))


def hashed_terms(docs: DataFrame, id_col: str, *args, **options) -> DataFrame:
    """``with_terms`` on documents hashed by id, for the steps that need a document in one place.

    The text is smaller than its terms, so it is the text that is moved.
    """
    return with_terms(docs.repartition(id_col), *args, **options)


def runs_of(t: Column) -> Column:
    """The distinct values of a sorted array with their counts, as structs (``term``, ``tf``)."""
    n = F.size(t)
    starts = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))
    return F.zip_with(starts, ends, lambda at, end: F.struct(F.get(t, at).alias("term"), (end - at).alias("tf")))


def counted_terms(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """TXT-2: one row per document and distinct term, with its count ``tf``.

    The array is sorted and its runs measured, all within the row: memory is
    bounded by one document and nothing is shuffled.
    """
    keep = [c for c in docs.columns if c != terms]
    return docs.select(*keep, F.sort_array(terms).alias("_sorted")).select(*keep, F.inline(runs_of(F.col("_sorted"))))


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary: ``terms(term, df, idf)`` and ``label_sizes(label, n_docs)``."""

    terms: DataFrame
    label_sizes: DataFrame
    n_docs: int
    n_terms: int
    n_postings: int
    n_bytes: int
    n_labels: int
    sublinear: bool = False
    #: how many numbers the terms are numbered with, if with more than there are terms
    n_features: int | None = None

    def tf(self) -> Column:
        """TXT-2 or TXT-3: the raw count or its damped form."""
        tf = F.col("tf").cast("double")
        return F.lit(1.0) + F.log(tf) if self.sublinear else tf


def document_frequencies(docs: DataFrame, terms: str = "terms", min_df: int = 1) -> DataFrame:
    """AGG-9: documents per term, terms in fewer than ``min_df`` left out."""
    held = exploded(docs, F.array_distinct(terms), "term")
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)


def fit_vocabulary(
    docs: DataFrame,
    label: str,
    min_df: int = 1,
    sublinear: bool = False,
    terms: str = "terms",
) -> Vocabulary:
    """TXT-1, TXT-4: one pass that counts documents per term and per label.

    Every document emits its distinct terms and one null; the nulls, kept apart
    by label, count the documents, including those without any term left.
    """
    held = docs.select(
        F.col(label).alias("_label"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(terms))).alias("term"),
    )
    is_doc = F.col("term").isNull()
    counted = (
        held.select(F.when(is_doc, F.col("_label")).alias("label"), "term")
        .groupBy("label", "term")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(is_doc | (F.col("n") >= min_df))
    )
    table, seen = stage(
        counted,
        n_docs=F.sum(F.when(is_doc, F.col("n"))),
        n_terms=F.count("term"),
        n_postings=F.sum(F.when(~is_doc, F.col("n"))),
        n_bytes=F.sum(F.octet_length("term")),
        n_labels=F.count_if(is_doc),
    )
    n_docs = seen["n_docs"] or 0
    idf = F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("n"))) + F.lit(1.0)
    return Vocabulary(
        terms=table.where(~is_doc).select("term", F.col("n").alias("df"), idf.alias("idf")),
        label_sizes=table.where(is_doc).select(F.col("label").alias(label), F.col("n").alias("n_docs")),
        n_docs=n_docs,
        n_terms=seen["n_terms"] or 0,
        n_postings=seen["n_postings"] or 0,
        n_bytes=seen["n_bytes"] or 0,
        n_labels=seen["n_labels"] or 0,
        sublinear=sublinear,
    )


def fits_broadcast(vocab: Vocabulary, limit: int) -> bool:
    return vocab.n_terms <= limit and vocab.n_bytes <= limit * TERM_BYTES


def split_head(vocab: Vocabulary, limit: int) -> tuple[DataFrame, DataFrame]:
    """The frequent terms, at most ``limit`` of them and ``limit * TERM_BYTES`` bytes, and the rest.

    With P postings in all, at most P / m terms can be in m documents or more, so
    asking for m = P / limit documents bounds the head whatever the data is. A
    term longer than ``TERM_BYTES`` must be in more documents, in proportion to
    its length, which bounds the bytes the same way. No term of the rest can be
    a hot key: it is in fewer than that many documents.
    """
    least = max(1, -(-vocab.n_postings // limit))
    size = F.greatest(F.octet_length("term"), F.lit(TERM_BYTES))
    in_head = F.col("df") * TERM_BYTES >= size * F.lit(least)
    return vocab.terms.where(in_head), vocab.terms.where(~in_head)


def known_terms(counted: DataFrame, vocab: Vocabulary, limit: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """JOIN-3: counted terms with their ``idf``; unknown terms vanish."""
    cols = [c for c in vocab.terms.columns if c != "df"]
    if fits_broadcast(vocab, limit):
        return counted.join(F.broadcast(vocab.terms.select(*cols)), "term")
    head, rest = split_head(vocab, limit)
    frequent = counted.join(F.broadcast(head.select(*cols)), "term")
    rare = counted.join(F.broadcast(head.select("term")), "term", "left_anti").join(
        rest.select(*cols), "term"
    )
    return frequent.unionByName(rare)


def document_weights(
    docs: DataFrame,
    vocab: Vocabulary,
    id_col: str,
    terms: str = "terms",
    limit: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """TXT-5, TXT-6, TXT-10: ``weight`` of every known term in every document.

    The other columns of ``docs`` and of the vocabulary are carried along.
    """
    return weigh(counted_terms(docs, terms), vocab, id_col, limit)


def weigh(counted: DataFrame, vocab: Vocabulary, id_col: str, limit: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """``document_weights`` of terms that are counted already."""
    tfidf = known_terms(counted, vocab, limit).withColumn("_w", vocab.tf() * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return tfidf.withColumn("weight", F.col("_w") / norm).drop("_w", "idf")


def label_scores(
    hashed: DataFrame,
    vocab: Vocabulary,
    id_col: str,
    label: str,
    terms: str = "terms",
    limit: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """AGG-10: mean weight of a term over all documents of a label, zeros included.

    ``hashed`` are the documents from ``hashed_terms``.
    """
    return score_labels(counted_terms(hashed.select(id_col, label, terms), terms), vocab, id_col, label, limit)


def score_labels(counted: DataFrame, vocab: Vocabulary, id_col: str, label: str, limit: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """``label_scores`` of terms that are counted already, a document's in one place."""
    if fits_broadcast(vocab, limit):
        sums = weigh(counted, vocab, id_col, limit).groupBy(label, "term").agg(F.sum("weight").alias("_sum"))
    else:
        sums = _label_sums_by_norm(counted, vocab, id_col, label, limit)
    sizes = F.broadcast(vocab.label_sizes) if vocab.n_labels <= limit else vocab.label_sizes
    return sums.join(sizes, label).select(
        label, "term", (F.col("_sum") / F.col("n_docs")).alias("score")
    )


def _label_sums_by_norm(counted: DataFrame, vocab: Vocabulary, id_col: str, label: str, limit: int) -> DataFrame:
    """Sum of weights per label and term when the vocabulary is too large to broadcast.

    A weight is tf * idf / norm, and idf is the same for all documents, so the
    norms come first (partial sums shrink every document to one row before the
    shuffle), tf / norm is summed per label and term, and idf is applied to the
    sums. Only the postings of rare terms are ever shuffled.
    """
    w = vocab.tf() * F.col("idf")
    norms = known_terms(counted.select(id_col, "term", "tf"), vocab, limit).groupBy(id_col).agg(F.sqrt(F.sum(w * w)).alias("_norm"))
    return (
        counted.join(norms.hint("shuffle_hash"), id_col)
        .groupBy(label, "term")
        .agg(F.sum(vocab.tf() / F.col("_norm")).alias("_sum"))
        .join(vocab.terms.select("term", "idf"), "term")
        .select(label, "term", (F.col("_sum") * F.col("idf")).alias("_sum"))
    )


def tfidf_ranking(
    docs: DataFrame,
    id_col: str,
    label: str,
    text: str = "text",
    ngrams: tuple[int, int] = (1, 1),
    stopwords: Iterable[str] = (),
    min_df: int = 1,
    sublinear: bool = False,
    top_n: int = 30,
    term: str = "word",
    raw: bool = True,
    limit: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """TXT-7, TXT-8, TXT-9, TXT-11: the top terms of every label by mean TF-IDF.

    Scores that are equal to 12 places rank in the order of the term.
    """
    from lexitally.operators.phrase_blocks import phrase_blocks

    blocks = phrase_blocks(docs, id_col, label, text, stopwords, raw, limit)
    return blocks.ranking(ngrams, min_df, sublinear, top_n, term)


def rank_labels(
    counted: DataFrame, vocab: Vocabulary, id_col: str, label: str, top_n: int = 30, term: str = "word", limit: int = MAX_BROADCAST_TERMS
) -> DataFrame:
    """The top terms of every label, from counted terms and their vocabulary."""
    scores = score_labels(counted, vocab, id_col, label, limit).where(F.col("score") > 0)
    order = [F.round("score", 12).desc(), F.col("term")]
    return rank_within(scores, label, order, top_n).select(
        label, "rank", F.col("term").alias(term), F.bround("score", 6).alias("mean_tfidf")
    )
