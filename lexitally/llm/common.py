"""Helpers shared by the operators: texts of an Arrow batch as bytes, staged tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.session import stage

#: Bytes of text that a task turns into numbers at once; eight-byte copies of it are made.
SLICE_BYTES = 1 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named(name: str) -> Column:
    """The column of that name, whatever signs the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *new: str) -> list[Column]:
    """All columns but those to be replaced."""
    return [named(c) for c in df.columns if c not in new]


def unused(df: DataFrame, name: str) -> str:
    """An inner name like ``name`` that no column of the input has."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def mapped(df: DataFrame, inner: list[Column], kept: list[str], run: Callable, new: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` over inner columns and then kept ones; the result has the kept ones and then the new ones.

    Kept columns travel under numbers, so no name of theirs, dots included, meets an inner one.
    """
    inner = [c.alias(f"in_{i}") for i, c in enumerate(inner)]
    short = [f"kept_{i}" for i in range(len(kept))]
    rows = df.select(*inner, *[named(c).alias(s) for c, s in zip(kept, short)])
    fields = [T.StructField(s, df.schema[c].dataType) for c, s in zip(kept, short)]
    fields += [T.StructField(f"new_{i}", f.dataType) for i, f in enumerate(new)]
    out = rows.mapInArrow(run, T.StructType(fields))
    names = [*kept, *[f.name for f in new]]
    return out.select(*[F.col(f.name).alias(name) for f, name in zip(fields, names)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text makes a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


_MEMORY: list = [None, {}]


def worker_memory(owner: str) -> dict:
    """What a Python worker keeps of a task's work for the next ones.

    It keeps one operator's at a time: a worker that goes on with another gives the room back.
    """
    if _MEMORY[0] != owner:
        _MEMORY[1].clear()
        _MEMORY[0] = owner
        pa.default_memory_pool().release_unused()
    return _MEMORY[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x9E3779B97F4A7C15)
    h = h ^ (h >> U64(29))
    h = h * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


def byte_codes(seed: int) -> np.ndarray:
    """256 random 64-bit codes from a seed."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


def _union_find(edges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by stars: each node with the smallest of its part."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in edges:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id reachable) of every node of ``edges`` (two long columns).

    Each partition first keeps a spanning star of its own edges. Then large-star and
    small-star rounds hang every node below the smallest neighbour until nothing
    changes; minima are pre-aggregated, so a hub costs no more than its edges. Every
    round is a written table; the driver sees a count and a checksum of it. Nodes
    without a link to another node have no row.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = edges.where("a != b").mapInArrow(_union_find, "a long, b long")
    state = {"rows": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges, seen = stage(edges.distinct(), **state)
    while seen["rows"]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges, now = stage(small.where("a != b").distinct(), **state)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
