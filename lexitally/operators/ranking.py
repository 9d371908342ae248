"""Ranking inside groups and numbering in file order (WIN-1 to WIN-3, TOP-1 to TOP-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexitally.session import stage

PLANNED_TOP_N = 1_000  # default of spark.sql.optimizer.windowGroupLimitThreshold
SHARES = 64


def exploded(df: DataFrame, array: Column, out: str, *keep: str) -> DataFrame:
    """One row per element of an array column, the given columns kept; nulls vanish.

    The plain ``explode`` makes the planner test the array for emptiness as early
    as it can, which for a computed array means computing it twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(out)).where(F.col(out).isNotNull())


def rank_within(
    df: DataFrame, group: str, order: Sequence[Column], top_n: int | None = None, out: str = "rank"
) -> DataFrame:
    """WIN-3: 1, 2, 3, ... inside each group; with ``top_n`` only those rows.

    With ``top_n`` every task first keeps its own best rows of a group, so one
    task sees at most ``top_n`` rows per upstream task, however large the group.
    The planner does that up to ``PLANNED_TOP_N`` rows; beyond, a group is first
    ranked in ``SHARES`` shares, and the best of each share are ranked together.
    """
    if top_n is not None and top_n > PLANNED_TOP_N:
        share = F.pmod(F.hash(*df.columns), F.lit(SHARES))
        in_share = F.row_number().over(Window.partitionBy(group, "_share").orderBy(*order))
        df = (
            df.withColumn("_share", share)
            .withColumn("_in_share", in_share)
            .where(F.col("_in_share") <= top_n)
            .drop("_share", "_in_share")
        )
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = df.withColumn(out, rank)
    return ranked if top_n is None else ranked.where(F.col(out) <= top_n)


def number_within(df: DataFrame, group: str, order: Sequence[str], out: str = "sequence") -> DataFrame:
    """WIN-1, WIN-2: number all rows of a group in a given order, for groups of any size.

    A group can hold most of the table, so it must not end up in one task. The
    rows are cut into ranges of the order and written; each range is numbered by
    itself and starts where the counts of the ranges before it end.
    """
    # a text key that is never null: the window and the join then share one shuffle
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    ranged, _ = stage(
        df.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_group": key})
    )
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_group", "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_group", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy("_group", "_range").orderBy(*order))
    return (
        ranged.withColumn("_inside", inside)
        .join(starts, ["_group", "_range"])
        .select(*df.columns, (F.col("_start") + F.col("_inside")).cast("long").alias(out))
    )


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """TOP-5, TOP-6: the first rows of the whole table in a given order."""
    return df.orderBy(*order).limit(n)
