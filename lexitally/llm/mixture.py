"""Mixing sources to target weights by a hierarchical token budget.

Levels of a tree (domain, language, source) share a budget from the root down. Siblings get
tokens by weight; one that cannot fill its share gives the rest to its siblings, and only
what a whole group of siblings cannot take is left to the level above. A leaf's share is
filled from seeded epochs: all documents once per whole epoch, and of the last epoch those
that come first in its seeded order.

Only counts per leaf and per slice of the seeded order are gathered; the documents
themselves are read in place and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitally.session import stage

#: Leaves whose plan is sent to all tasks; beyond that it is joined by key.
BROADCAST_LEAVES = 200_000
#: Hexadecimal digits of the seeded order that cut a leaf into slices.
SLICE = 3


def token_count(text: str):
    """Runs of characters other than the six ASCII white spaces; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _share(nodes: DataFrame, above: list[str], name: str) -> DataFrame:
    """``given`` for nodes with ``cap``, ``weight`` and their group's ``budget``.

    Nodes in the order of cap per weight: as long as a node's cap is at most its weighted
    share of what is left, it is full. The others share the rest by weight, rounded so that
    the shares add up.
    """
    big = "decimal(38,0)"
    group = Window.partitionBy(*above)
    order = group.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns(
        {
            "full_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_left": F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    rest = F.greatest(F.col("budget") - F.col("full_before"), F.lit(0))
    fits = F.col("cap").cast("decimal(20,0)") * F.col("weight_left") <= F.col("weight").cast("decimal(18,0)") * rest
    nodes = nodes.withColumn("open", F.max(F.when(fits, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The first open node fixes the rest and the weights that share it.
    first = group.orderBy(F.desc("open"), (F.col("cap") / F.col("weight")).asc(), F.col(name).asc_nulls_first())
    nodes = nodes.withColumns({"rest": F.first(rest).over(first), "weights": F.first("weight_left").over(first)})
    upto = F.sum(F.when(F.col("open") == 1, F.col("weight")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    nodes = nodes.withColumn("upto", upto)
    part = "cast(rest as decimal(20,0)) * cast({} as decimal(18,0)) div cast(weights as decimal(18,0))"
    given = F.expr(part.format("upto")) - F.expr(part.format("upto - weight"))
    return nodes.withColumn("given", F.when(F.col("open") == 0, F.col("cap")).otherwise(given).cast("long")).select(
        *above, name, "cap", "given"
    )


def plan(leaves: DataFrame, levels: list[str], weights: dict[str, dict], share: tuple[int, int], epochs: int) -> DataFrame:
    """Tokens ``given`` to every leaf; ``leaves`` has the levels and its ``tokens``.

    ``weights`` holds, per level, weights of its values; others weigh 1, as does null. The
    budget is ``share`` (a fraction of whole numbers) of all tokens, and at most what all
    epochs hold.
    """
    caps = leaves.select(*levels, (F.col("tokens") * epochs).alias("cap"), "tokens")
    total = caps.agg(
        F.least(F.expr(f"cast(sum(tokens) as decimal(20,0)) * {share[0]} div {share[1]}"), F.sum("cap")).cast("long").alias("budget")
    )
    above: list[str] = ["__root"]
    caps, groups = caps.withColumn("__root", F.lit(0)), total.withColumn("__root", F.lit(0))
    for name in levels:
        weight = F.lit(1)
        for value, w in weights.get(name, {}).items():
            weight = F.when(F.col(name) == value, w).otherwise(weight)
        nodes = caps.groupBy(*above, name).agg(F.sum("cap").alias("cap")).withColumn("weight", weight.cast("long"))
        same = F.lit(True)
        for a in above:
            same = same & F.col(f"n.{a}").eqNullSafe(F.col(f"g.{a}"))
        joined = nodes.alias("n").join(groups.alias("g"), same).select("n.*", "g.budget")
        shared = _share(joined, above, name)
        above = [*above, name]
        groups = shared.select(*above, F.col("given").alias("budget"))
    return shared.drop("__root", "cap")


def mix(
    docs: DataFrame,
    levels: dict[str, F.Column],
    weights: dict[str, dict] | None = None,
    share: tuple[int, int] = (1, 2),
    epochs: int = 2,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Selected rows with all their columns, plus ``mix_tokens`` and ``mix_epoch`` (from 0).

    A row comes once for every epoch that takes it. In the last epoch of a leaf, documents
    are taken in seeded order as long as those before them leave budget, so a leaf exceeds
    its share by less than one document. A null level value is a leaf of its own; a null or
    empty text has no tokens, costs nothing, and comes with the epochs its leaf takes
    in whole and with its place in the last one. Rows that share an id share their place.
    Columns of the input with the two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("mix_tokens", "mix_epoch")]
    level = {f"__l{i}": column.cast("string") for i, column in enumerate(levels.values())}
    keys = list(level)
    rows = docs.select(*names).withColumns({**level, "__id": F.coalesce(F.col(id_col).cast("string"), F.lit(""))})
    counted, _ = stage(rows.select(*keys, "__id", token_count(text_col).alias("tokens")))
    leaves = counted.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    named = {f"__l{i}": (weights or {}).get(name, {}) for i, name in enumerate(levels)}
    given = plan(leaves, keys, named, share, epochs)
    tree, size = stage(
        _by_leaf(given, leaves, keys, "inner").select(
            *keys,
            F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens"))).otherwise(0).cast("long").alias("whole"),
            F.when(F.col("tokens") > 0, F.col("given") % F.col("tokens")).otherwise(0).alias("need"),
        ),
        leaves=F.count(F.lit(1)),
    )
    small = (size.get("leaves") or 0) <= BROADCAST_LEAVES

    def with_leaf(df: DataFrame, of_leaf: DataFrame) -> DataFrame:
        return _by_leaf(df, F.broadcast(of_leaf) if small else of_leaf, keys, "left")

    placed = with_leaf(counted, tree).where("need > 0").withColumn("place", _place(seed))
    # Tokens per slice of the order, then documents of the slice in which a leaf's budget ends.
    slices = placed.groupBy(*keys, F.substring("place", 1, SLICE).alias("slice")).agg(F.sum("tokens").alias("n"), F.first("need").alias("need"))
    by_slice = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("upto", F.sum("n").over(by_slice))
    ends = slices.where("upto >= need and upto - n < need").select(*keys, "slice", (F.col("need") - (F.col("upto") - F.col("n"))).alias("left"))
    last = with_leaf(placed, ends.withColumnRenamed("slice", "__slice")).where(F.substring("place", 1, SLICE) == F.col("__slice"))
    last = last.groupBy(*keys, "place", "left").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    cut = last.withColumn("before", upto - F.col("n")).where("before < left").groupBy(*keys).agg(F.max("place").alias("cut"))
    ended = _by_leaf(tree, cut, keys, "left").select(*keys, F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    plans, _ = stage(ended)
    rows = with_leaf(rows, plans)
    in_last = F.when(F.col("__cut").isNotNull() & (_place(seed, "__whole") <= F.col("__cut")), 1).otherwise(0)
    times = (F.col("__whole") + in_last).cast("int")
    rows = rows.withColumn("__times", times).where("__times > 0")
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    return rows.withColumn("mix_tokens", token_count(text_col)).select(*names, "mix_tokens", "mix_epoch")


def _place(seed: int, whole: str = "whole"):
    """A document's place in the last epoch of its leaf, the one after its whole epochs."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(whole).cast("string"), F.col("__id")))


def _by_leaf(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on the leaf's levels, nulls equal."""
    renamed = right.select(*[F.col(k).alias(f"__r{k}") if k in keys else F.col(k) for k in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r{k}"))
    return left.join(renamed, same, how).drop(*[f"__r{k}" for k in keys])
