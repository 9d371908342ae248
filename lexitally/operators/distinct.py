"""What sets one label apart from the others (TXT-12, TXT-13, RSH-1, RSH-2, WIN-4, WIN-5, TOP-3, TOP-4).

The input is a ranking with at most n terms per label, so everything here is
small next to the corpus; it still runs as one grouped job per term.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.functions.text import is_valid_pattern
from lexitally.operators.ranking import rank_within


def mean_scores(ranking: DataFrame, term: str, label: str, score: str = "mean_tfidf") -> DataFrame:
    """AGG-8: one score per term and label; repeated pairs are averaged."""
    return ranking.where(F.col(term).isNotNull()).groupBy(term, label).agg(F.avg(score).alias("score"))


def score_pivot(
    ranking: DataFrame, term: str, label: str, labels: Sequence[str] | None = None, score: str = "mean_tfidf"
) -> DataFrame:
    """RSH-1: one row per term, one column per label of the data (or given), zero where the term is not ranked."""
    wide = ranking.groupBy(term).pivot(label, None if labels is None else list(labels)).agg(F.avg(score))
    return wide.na.fill(0.0, subset=[c for c in wide.columns if c != term])


def distinctiveness(
    ranking: DataFrame,
    term: str = "word",
    label: str = "emotion",
    score: str = "mean_tfidf",
    carryover: bool = False,
) -> DataFrame:
    """TXT-12: score of a term in a label minus its mean over the other labels.

    There is a row for every ranked term and every label (RSH-2); a term outside
    the ranking of a label scores 0 there. All scores of a term sit in one map of
    at most one entry per label, so the rows of a term are made from one row.

    ``carryover`` gives the published variant (WIN-5): from the second label on,
    in sorted order, the mean also takes in the previous label's two helper
    columns, which add up to the previous label's score.
    """
    labels = ranking.agg(F.sort_array(F.collect_set(label)).alias("labels")).scalar()
    per_term = (
        mean_scores(ranking, term, label, score)
        .groupBy(term)
        .agg(
            F.map_from_entries(F.collect_list(F.struct(label, "score"))).alias("_by_label"),
            F.sum("score").alias("_total"),
        )
        .withColumn("_labels", labels)
    )
    rows = per_term.select("*", F.posexplode("_labels").alias("_k", label))

    def of(name):
        return F.coalesce(F.try_element_at("_by_label", name), F.lit(0.0))

    own, n = of(F.col(label)), F.size("_labels")
    others = F.try_divide(F.col("_total") - own, n - 1)
    if carryover:
        previous = of(F.get("_labels", F.col("_k") - 1))
        others = F.when(F.col("_k") == 0, others).otherwise((F.col("_total") - own + previous) / (n + 1))
    return rows.select(label, term, own.alias("score"), others.alias("other_mean")).withColumn(
        "distinctiveness", F.col("score") - F.col("other_mean")
    )


def is_positive(column: str = "distinctiveness"):
    """FIL-5, with the rounding noise of a sum taken out."""
    return F.round(column, 12) > 0


def valid_patterns(distinct: DataFrame, term: str = "word") -> DataFrame:
    """TXT-13: positive rows with a valid pattern (FIL-5, FIL-6)."""
    return distinct.where(is_positive() & is_valid_pattern(F.col(term)))


def published_order(distinct: DataFrame, term: str = "word", label: str = "emotion") -> DataFrame:
    """SORT-1: by label, most distinctive first."""
    return distinct.orderBy(label, F.col("distinctiveness").desc(), term)


def top_patterns(
    distinct: DataFrame,
    term: str = "word",
    label: str = "emotion",
    top_n: int = 10,
    positive_only: bool = True,
) -> DataFrame:
    """TOP-3 (all rows) and TOP-4 (positive rows): the most distinctive terms of each label."""
    rows = distinct.where(is_positive()) if positive_only else distinct
    order = [F.round("distinctiveness", 12).desc(), F.col(term)]
    return rank_within(rows, label, order, top_n)
