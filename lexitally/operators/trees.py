"""A forest of decision trees over the terms of documents (OPT-4).

A split asks whether a document contains a term. Trees grow level by level, all nodes of a level
in one job: the weights of the rows are summed by tree, node and term, pre-aggregated in the
tasks, and the best term of every node is the maximum of a gain. Rows are not moved: the node of
a row follows from its own terms and the splits so far. The driver holds the splits and the label
weights of the nodes, ``trees * 2 ** (depth + 1)`` rows at most, whatever the vocabulary is.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.session import stage

#: Nodes of a forest at most: its splits travel inside the plan.
MOST_NODES = 1 << 14
#: Cumulated chances of being drawn 0, 1, ... 6 times when rows are drawn with replacement.
DRAWN = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759)
_UNIT = 1 << 30


def _unit(*parts: Column) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(_UNIT)) / F.lit(float(_UNIT))


def _strings(values: list[str | None]) -> Column:
    """A constant array, made in one call."""
    made = ["cast(null as string)" if x is None else f"decode(X'{x.encode().hex()}', 'UTF-8')" for x in values]
    return F.expr(f"array({', '.join(made)})")


def _doubles(values: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{x!r}D' for x in values)})")


def _sum_of(places: str, table: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda total, place: total + F.get(table, place))


@dataclass(frozen=True)
class Forest:
    """``splits``: (tree, node) -> (term, gain); ``masses``: (tree, node) -> weight of every label.

    Nodes are numbered from 1; the rows of node n without its term go to 2 n, the others to 2 n + 1.
    """

    labels: list
    trees: int
    depth: int
    splits: dict[tuple[int, int], tuple[str, float]]
    masses: dict[tuple[int, int], list[float]]

    def node(self, tree: Column, terms: Column, levels: int) -> Column:
        """The node of a row after so many levels."""
        if not levels:
            return F.lit(1)
        width = 1 << levels
        asked = [self.splits.get((t, n), (None,))[0] for t in range(self.trees) for n in range(width)]
        table = _strings(asked)

        def step(node: Column, _: Column) -> Column:
            term = F.get(table, tree * width + node)
            below = 2 * node + F.array_contains(terms, term).cast("int")
            return F.when(term.isNull(), node).otherwise(below)

        return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), step)

    def predict(self, docs: DataFrame, terms: str = "terms") -> DataFrame:
        """The documents with a ``prediction``: the label of the largest mean share over the trees; of ties, the first."""
        width = 1 << (self.depth + 1)
        sums = {at: sum(mass) or 1.0 for at, mass in self.masses.items()}
        own = F.coalesce(F.col(terms), F.array().cast("array<string>"))
        nodes = F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: t * width + self.node(t, own, self.depth))
        named = [c for c in docs.columns if c not in (terms, "prediction")]
        rows = docs.select(*named, nodes.alias("_nodes"))
        scores = []
        for k in range(len(self.labels)):
            cells = [(t, n) for t in range(self.trees) for n in range(width)]
            shares = _doubles([self.masses[at][k] / sums[at] if at in self.masses else 0.0 for at in cells])
            scores.append(_sum_of("_nodes", shares))
        rows = rows.withColumn("_scores", F.transform(F.array(*scores), lambda x: F.round(x, 9)))
        best = F.array_position("_scores", F.array_max("_scores")).cast("int") - 1
        return rows.select(*named, F.get(F.array(*[F.lit(x) for x in self.labels]), best).alias("prediction"))

    def table(self, spark) -> DataFrame:
        """``tree``, ``node``, ``term`` (null in leaves), ``gain`` and the ``mass`` of its rows."""
        rows = [(t, n, *self.splits.get((t, n), (None, None)), float(sum(m))) for (t, n), m in sorted(self.masses.items())]
        return spark.createDataFrame(rows, "tree int, node int, term string, gain double, mass double")


def fit_forest(
    train: DataFrame,
    id_col: str,
    label: str,
    terms: str = "terms",
    trees: int = 10,
    depth: int = 6,
    term_share: float = 0.1,
    bootstrap: bool = True,
    balanced: bool = True,
    min_rows: int = 1,
    seed: int = 42,
) -> Forest:
    """Grow trees on the documents whose ``label`` is not null.

    A node may ask for a share of all terms, drawn anew for every node, and takes the one that
    lowers the Gini impurity most; of gains equal to nine decimals, the first term. Each side of a
    split keeps ``min_rows`` rows. With ``bootstrap`` every tree draws its rows with replacement;
    ``balanced`` weighs labels so that all have the same mass. Draws follow from hashes of the id,
    the term and ``seed``. Rows that share an id are drawn together. A table without labels gives
    an error, as there is nothing to learn from.
    """
    if trees < 1 or depth < 0 or trees << (depth + 1) > MOST_NODES:
        raise ValueError(f"trees * 2 ** (depth + 1) must be at most {MOST_NODES}")
    own = F.array_distinct(F.coalesce(F.col(terms), F.array().cast("array<string>")))
    rows = train.where(F.col(label).isNotNull()).select(F.xxhash64(id_col).alias("key"), F.col(label).alias("label"), own.alias("terms"))
    rows, _ = stage(rows)
    sizes = sorted((r["label"], r["n"]) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect())  # one per label
    if not sizes:
        raise ValueError("no document to learn from")
    labels, n_rows = [name for name, _ in sizes], sum(n for _, n in sizes)
    factors = [n_rows / (len(sizes) * n) if balanced else 1.0 for _, n in sizes]
    forest = Forest(labels, trees, depth, {}, {})
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    if bootstrap:
        drawn = _unit(F.lit(seed), F.col("key"), F.col("tree"))
        dealt = dealt.withColumn("times", sum(((drawn >= x).cast("long") for x in DRAWN), F.lit(0).cast("long"))).where("times > 0")
    else:
        dealt = dealt.withColumn("times", F.lit(1).cast("long"))
    roots = dealt.groupBy("tree").agg(*_per_label(labels)).collect()  # one row per tree
    nodes = {(r.tree, 1): [r[f"n{k}"] for k in range(len(labels))] for r in roots}
    for level in range(depth + 1):
        nodes = _grow(forest, dealt, level, nodes, factors, term_share, min_rows, seed)
        if not nodes:
            break
    return forest


def _per_label(labels: Iterable) -> list[Column]:
    return [F.sum(F.when(F.col("label") == name, F.col("times")).otherwise(0)).alias(f"n{k}") for k, name in enumerate(labels)]


def _grow(
    forest: Forest, dealt: DataFrame, level: int, found: dict, factors: list[float], term_share: float, min_rows: int, seed: int
) -> dict[tuple[int, int], list[int]]:
    """Add the masses of a level's nodes and their splits; the nodes of the next level.

    Nodes come with the draws of every label in them. Those of the next level follow from the
    rows with the term of a split, so a level takes one pass over the documents.
    """
    labels = range(len(factors))
    for (tree, node), counts in found.items():
        forest.masses[tree, node] = [counts[k] * factors[k] for k in labels]
    mixed = {at: counts for at, counts in found.items() if sum(n > 0 for n in counts) > 1}
    if level == forest.depth or not mixed:
        return {}
    placed = dealt.withColumn("node", forest.node(F.col("tree"), F.col("terms"), level)).where(F.col("node") >= 1 << level)
    names = ", ".join(f"t{k} long" for k in labels)
    nodes = F.broadcast(placed.sparkSession.createDataFrame([(*at, *n) for at, n in mixed.items()], f"tree int, node int, {names}"))
    asked = placed.join(nodes, ["tree", "node"]).select("tree", "node", "label", "times", F.explode("terms").alias("term"))
    if term_share < 1:
        asked = asked.where(_unit(F.lit(seed + 1), F.col("tree"), F.col("node"), F.col("term")) < term_share)
    counts = asked.groupBy("tree", "node", "term").agg(*_per_label(forest.labels)).join(nodes, ["tree", "node"])

    def add(columns: list[Column]) -> Column:
        return sum(columns[1:], columns[0])

    with_it = [F.col(f"n{k}") * F.lit(factors[k]) for k in labels]
    all_of = [F.col(f"t{k}") * F.lit(factors[k]) for k in labels]
    without = [(F.col(f"t{k}") - F.col(f"n{k}")) * F.lit(factors[k]) for k in labels]

    def pure(masses: list[Column]) -> Column:
        return add([m * m for m in masses]) / add(masses)

    gain = (pure(with_it) + pure(without) - pure(all_of)) / add(all_of)
    inside, every = add([F.col(f"n{k}") for k in labels]), add([F.col(f"t{k}") for k in labels])
    counts = counts.where((inside >= min_rows) & (every - inside >= max(min_rows, 1))).withColumn("gain", F.round(gain, 9))
    first = F.min(F.struct((-F.col("gain")).alias("less"), "term", F.array(*[f"n{k}" for k in labels]).alias("inside")))
    best = counts.where("gain > 0").groupBy("tree", "node").agg(first.alias("best"))
    below = {}
    for row in best.select("tree", "node", "best.*").collect():  # the nodes of a level
        forest.splits[row.tree, row.node] = (row.term, -row.less)
        if row.term is not None:
            below[row.tree, 2 * row.node] = [n - x for n, x in zip(mixed[row.tree, row.node], row.inside)]
            below[row.tree, 2 * row.node + 1] = list(row.inside)
    return below
