"""Vectors of a table as rows of one matrix; which of them take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.session import stage

KIND = np.dtype("<f8")


def _pack(batches):
    for batch in batches:
        column = batch.column(1)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(KIND)
        ends = np.cumsum([len(x) for x in column]) if len(batch) else np.zeros(0, int)
        rows = [x.tobytes() for x in np.split(flat, ends[:-1])] if len(batch) else []
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "vec"])


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """``id`` and ``vec`` (doubles as bytes) of the vectors that take part, how many, and their length.

    Null vectors, zero vectors, those holding null or non-finite components, rows with a null
    id, and vectors of another length than the most frequent one (the shorter of two) take no part.
    """
    v = F.col(vec_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.where(v.isNotNull() & F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (top[0].dim, top[0].n) if top else (0, 0)
    packed, _ = stage(rows.where(F.size("vec") == dim).mapInArrow(_pack, "id long, vec binary"))
    return packed, n, dim


def matrix(column, dim: int) -> np.ndarray:
    """Packed vectors as rows of a matrix."""
    rows = [bytes(x) for x in (column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column)]
    return np.frombuffer(b"".join(rows), KIND).reshape(len(rows), dim)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two small blocks, added up in the order of the components.

    So a pair's value does not depend on the block it is in, and equal vectors tie.
    """
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += a[:, k, None] * b[None, :, k]
    return out
