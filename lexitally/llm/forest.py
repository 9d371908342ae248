"""Nearest neighbours by inner product: a forest of random-projection trees.

Every tree halves the space level by level along random directions, at medians of a
bounded sample. All vectors lie in one leaf of every tree. A query walks all trees through
one priority queue, which gives the leaf whose worst crossed boundary is nearest next,
until the leaves it has met hold enough candidates; these are ranked exactly. How many are
enough is measured: a sample of queries is compared with brute force, and the smallest
number that finds the wanted share of its true neighbours is taken.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitally.llm.vectors import KIND, inner_products, matrix, valid_vectors
from lexitally.session import stage

#: Vectors that directions and medians are fitted on at most, and queries that are audited.
SAMPLE, AUDIT = 16_384, 96
#: Vectors that a leaf should hold; vectors, and queries, of neighbouring leaves that share a task.
LEAF, BLOCK, QUERY_BLOCK = 512, 16_384, 4096


class Forest:
    """Directions and medians of all trees; levels of a tree share a direction.

    Largest inner products become smallest distances with one more component, the root of
    the largest squared norm less a vector's own; a query has 0 there.
    """

    def __init__(self, sample: np.ndarray, norm: float, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1] + 1
        self.norm, self.trees, self.depth = norm, trees, depth
        self.directions = rng.standard_normal((trees, depth, dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.medians = np.zeros((trees, 1 << depth))  # by node: 1 is the root, 2 n and 2 n + 1 are below n
        lifted = self.lift(sample)
        for t in range(trees):
            node = np.ones(len(lifted), np.int64)
            for level in range(depth):
                at = lifted @ self.directions[t, level]
                for n in range(1 << level, 2 << level):
                    inside = at[node == n]
                    self.medians[t, n] = np.median(inside) if len(inside) else 0.0
                node = 2 * node + (at > self.medians[t, node])

    def lift(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.norm**2 - np.einsum("nd,nd->n", x, x), 0))
        return np.column_stack((x, last))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree, numbered through all trees."""
        lifted, out = self.lift(x), np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.ones(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + (lifted @ self.directions[t, level] > self.medians[t, node])
            out[:, t] = node + (t - 1 << self.depth)
        return out

    def walk(self, query: np.ndarray):
        """Leaves in the order of the shared queue."""
        at = self.directions[:, :, :-1] @ query
        heap = [(0.0, t, 1, 0) for t in range(self.trees)]
        while heap:
            far, t, node, level = heapq.heappop(heap)
            while level < self.depth:
                gap = at[t, level] - self.medians[t, node]
                near = 2 * node + (gap > 0)
                heapq.heappush(heap, (max(far, abs(gap)), t, near ^ 1, level + 1))
                node, level = near, level + 1
            yield node + (t - 1 << self.depth)


def bundles_of(counts: np.ndarray, leaves_per_tree: int) -> np.ndarray:
    """The bundle of every leaf: neighbours of one tree, up to a block of vectors together.

    A query's best of a bundle leave its task, not its best of every leaf.
    """
    out, bundle, held = np.zeros(len(counts), np.int64), -1, 0
    for leaf, n in enumerate(counts.tolist()):
        if leaf % leaves_per_tree == 0 or held + n > BLOCK:
            bundle, held = bundle + 1, 0
        out[leaf] = bundle
        held += n
    return out


def _counted(forest, dim: int) -> Callable:
    def run(batches):
        for batch in batches:
            leaf, n = np.unique(forest.value.leaves(matrix(batch.column(1), dim)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], names=["leaf", "rows"])

    return run


def _routed(forest, bundles, dim: int) -> Callable:
    def run(batches):
        for batch in batches:
            leaf = forest.value.leaves(matrix(batch.column(1), dim)).ravel()
            each = batch.take(pa.array(np.repeat(np.arange(len(batch)), forest.value.trees)))
            cols = [*each.columns, pa.array(bundles.value[leaf]), pa.array(leaf)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "vec", "bundle", "leaf"])

    return run


def _searched(forest, counts, bundles, enough: float, dim: int) -> Callable:
    def run(batches):
        sizes = counts.value
        for batch in batches:
            rows, of, lists = [], [], []
            for i, query in enumerate(matrix(batch.column(1), dim)):
                met, held = [], 0
                for leaf in forest.value.walk(query):
                    if sizes[leaf]:
                        met.append(leaf)
                        held += int(sizes[leaf])
                    if held >= enough:
                        break
                met = np.sort(np.array(met, np.int64))
                bundle, first = np.unique(bundles.value[met], return_index=True)
                rows += [i] * len(bundle)
                of += bundle.tolist()
                lists += np.split(met, first[1:]) if len(met) else []
            each = batch.take(pa.array(rows, pa.int64()))
            cols = [*each.columns, pa.array(of, pa.int64()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "vec", "bundle", "leaves"])

    return run


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


def _ranked(queries: np.ndarray, of: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best candidates of a block for each of its queries."""
    out = []
    for lo in range(0, len(queries), 64):
        scores = inner_products(queries[lo : lo + 64], x)
        for query, row in zip(of[lo : lo + 64], scores):
            row[ids == query] = -np.inf
            best = top_of(row, ids, k)
            best = best[row[best] > -np.inf]
            out.append((np.full(len(best), query), ids[best], row[best]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))


def exact_neighbours(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[tuple[int, bytes]]]:
    """True neighbours of a bounded set of queries, by brute force over all rows."""
    dim = queries.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches):
        of, q = shared.value
        for batch in batches:
            x, own = matrix(batch.column(1), dim), batch.column(0).to_numpy()
            for lo in range(0, len(own), 4096):
                best = _ranked(q, of, x[lo : lo + 4096], own[lo : lo + 4096], k)
                at = np.searchsorted(np.sort(own[lo : lo + 4096]), best["vec_id"])
                at = np.argsort(own[lo : lo + 4096], kind="stable")[at] + lo
                best["vec"] = [x[i].tobytes() for i in at]
                yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double, vec binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out: dict[int, list] = {int(i): [] for i in ids}
    for r in found.withColumn("rank", rank).where(F.col("rank") <= k).collect():
        out[r.query_id].append((r.vec_id, bytes(r.vec)))
    return out


def enough_candidates(forest: Forest, counts: np.ndarray, queries: dict[int, np.ndarray], truth: dict, recall: float) -> float:
    """Candidates after which the walk has met the wanted share of the true neighbours."""
    dim = forest.directions.shape[2] - 1
    needed: list[float] = []
    for i, near in truth.items():
        if not near:
            continue
        leaves = forest.leaves(np.frombuffer(b"".join(v for _, v in near), KIND).reshape(len(near), dim))
        held, at = 0.0, {}
        for leaf in forest.walk(queries[i]):
            at[leaf] = held
            held += float(counts[leaf])
        needed += [min(at[leaf] for leaf in own) for own in leaves]
    return float(np.quantile(needed, recall, method="higher")) + 1 if needed else 1.0


def neighbours(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    trees: int = 4,
    recall: float = 0.97,
    seed: int = 1,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the nearest rows of every query row.

    Nearest is the largest inner product in double precision, ties to the smaller id;
    candidates are all rows but the query's own. Rows whose vector takes no part (see
    ``valid_vectors``) are neither. Ids are unique; of rows that share one, a query ranks
    each vector's best. Fewer rows than ``k`` give all of them; an empty table gives none.
    """
    spark = df.sparkSession
    flagged = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows, n, dim = valid_vectors(flagged, "id", "vec")
    queries = rows.join(df.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def largest(batches):
        top = 0.0
        for batch in batches:
            x = matrix(batch.column(1), dim)
            top = max([top, *np.einsum("nd,nd->n", x, x)])
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["top"])

    norm = float(rows.mapInArrow(largest, "top double").agg(F.max("top")).first()[0]) ** 0.5
    # A sample by a hash of the id; the threshold bounds what reaches the driver.
    def some(frame: DataFrame, most: int, total: int, salt: int) -> pd.DataFrame:
        share = min(1.0, 1.2 * most / max(total, 1))
        near = frame.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))
        return near.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(most).toPandas()

    sample = matrix(some(rows, SAMPLE, n, 1)["vec"], dim)
    depth = max(0, min(int(np.log2(max(1, n / LEAF))), int(np.log2(max(1, len(sample) / 16)))))
    forest = Forest(sample, norm, trees, depth, seed)
    shared = spark.sparkContext.broadcast(forest)
    counts = np.zeros(trees << depth, np.int64)
    for r in rows.mapInArrow(_counted(shared, dim), "leaf long, rows long").groupBy("leaf").agg(F.sum("rows").alias("rows")).collect():
        counts[r["leaf"]] = r["rows"]
    bundle = bundles_of(counts, 1 << depth)
    audit = some(queries, AUDIT, max(1, queries.count()), 2)
    held = dict(zip(audit["id"].tolist(), matrix(audit["vec"], dim)))
    truth = exact_neighbours(rows, np.array(list(held), np.int64), np.array(list(held.values())).reshape(len(held), dim), k) if held else {}
    enough = max(enough_candidates(forest, counts, held, truth, recall), float(trees * k))
    sizes, bundles = spark.sparkContext.broadcast(counts), spark.sparkContext.broadcast(bundle)
    searched = queries.mapInArrow(_searched(shared, sizes, bundles, enough, dim), "id long, vec binary, bundle long, leaves array<long>")
    searched, _ = stage(searched)
    by_leaf = rows.mapInArrow(_routed(shared, bundles, dim), "id long, vec binary, bundle long, leaf long")
    # Blocks of a bundle's rows and queries: a leaf that holds a third of all is many tasks.
    held = pd.DataFrame({"bundle": bundle, "rows": counts}).groupby("bundle", as_index=False).sum()
    met = searched.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("query_blocks"))
    met = met.join(spark.createDataFrame(held).select("bundle", F.ceil(F.col("rows") / BLOCK).alias("row_blocks")), "bundle")

    def numbers(upto: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1))

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(of))

    by_query = searched.join(met, "bundle").select("id", "vec", "leaves", "bundle", block("query_blocks").alias("q"), numbers("row_blocks").alias("b"))
    by_row = by_leaf.join(met, "bundle").select("id", "vec", "leaf", "bundle", numbers("query_blocks").alias("q"), block("row_blocks").alias("b"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        q, of, x, ids = matrix(left["vec"], dim), left["id"].to_numpy(), matrix(right["vec"], dim), right["id"].to_numpy()
        asked = pd.DataFrame({"row": np.repeat(np.arange(len(left)), left["leaves"].map(len)), "leaf": np.concatenate(left["leaves"].to_list())})
        asked = {leaf: part.to_numpy() for leaf, part in asked.groupby("leaf")["row"]}
        best = [
            _ranked(q[asked[leaf]], of[asked[leaf]], x[part], ids[part], k)
            for leaf, part in right.groupby("leaf").indices.items() if leaf in asked
        ]
        if not best:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        best = pd.concat(best).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return best.groupby("query_id").head(k)

    found = by_query.groupBy("bundle", "q", "b").cogroup(by_row.groupBy("bundle", "q", "b")).applyInPandas(
        rank, "query_id long, vec_id long, score double"
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
