"""Sharding by histogram sort: shards of near equal bytes, whose rows move once.

Rows are ordered by a hash of their text and then by id, so that equal texts lie together.
Exact bytes below a few candidate boundaries are counted over all partitions; the
boundaries close in on each splitter until one leaves the wanted bytes below it within the
tolerance. Then every row's shard is known and one exchange brings the rows there. All of
it is DataFrame operations; the driver sees some hundred sums per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitally.session import stage

#: Candidate boundaries per splitter and round.
PROBES = 256
#: Bytes by which a boundary may miss its place, as a fraction of a shard.
TOLERANCE = 1 / 200
LOW, HIGH = -(1 << 63), 1 << 63


def row_size(text: str) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _count(rows: DataFrame, of: str, spans: list[tuple[int, int, int]]) -> dict[tuple[int, int], tuple]:
    """Of every probe interval of disjoint spans (from, to, step) of a key, exactly: bytes, rows, first and last key."""
    key = f"cast({of} as decimal(20,0))"
    inside = [f"{key} >= {lo} and {key} < {hi}" for lo, hi, _ in spans]
    which = "case " + " ".join(f"when {x} then {i}" for i, x in enumerate(inside)) + " end"
    step = "case " + " ".join(f"when {x} then ({key} - ({lo})) div {s}" for x, (lo, _, s) in zip(inside, spans)) + " end"
    found = rows.where(" or ".join(f"({x})" for x in inside))
    found = found.groupBy(F.expr(which).alias("span"), F.expr(step).alias("step")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(of).alias("first"), F.max(of).alias("last")
    )
    return {(r.span, r.step): (r.bytes, r.n, r.first, r["last"]) for r in found.collect()}


def splitters(rows: DataFrame, total: int, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int | None]]:
    """Boundaries (hash, id) of the shards: rows before one, in this order, lie below it.

    ``rows`` has ``key`` (the text's hash), ``id`` and ``size``. A boundary without an id
    lies between texts. Only where one text's copies are more than the tolerance allows to
    move does a boundary fall between copies, and then by id.
    """
    allowed = total / shards * tolerance
    targets = {j: total * j // shards for j in range(1, shards)}
    done: dict[int, tuple[int, int | None]] = {}
    found, rest = _narrow(rows, "key", {j: (LOW, HIGH, 0) for j in targets}, targets, allowed)
    done |= {j: (bound, None) for j, bound in found.items()}
    # Places that fall among the copies of one text: the same rounds over their ids.
    for key in sorted({k for k, _ in rest.values()}):
        spans = {j: (LOW, HIGH, below) for j, (k, below) in rest.items() if k == key}
        found, same = _narrow(rows.where(F.col("key") == key), "id", spans, targets, allowed)
        found |= {j: bound for j, (bound, _) in same.items()}
        done |= {j: (key, bound) for j, bound in found.items()}
    return [done[j] for j in sorted(done)]


def _narrow(
    rows: DataFrame, of: str, spans: dict[int, tuple[int, int, int]], targets: dict[int, int], allowed: float
) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Boundaries on ``of``, and the splitters whose place lies among several rows of one key.

    ``spans`` has, per splitter, the keys its place lies in and the bytes below them. A
    round counts all spans at once and keeps, per splitter, the probe interval that holds
    its place, cut to the keys that occur there.
    """
    found, among = {}, {}
    while spans:
        wanted = sorted({(lo, hi) for lo, hi, _ in spans.values()})
        parts = [(lo, hi, -(-(hi - lo) // PROBES)) for lo, hi in wanted]
        seen = _count(rows, of, parts)
        left = {}
        for j, (lo, hi, below) in spans.items():
            i = wanted.index((lo, hi))
            step, best = parts[i][2], (abs(below - targets[j]), lo)
            for k in range(-(-(hi - lo) // step)):
                size, n, first, last = seen.get((i, k), (0, 0, 0, 0))
                best = min(best, (abs(below + size - targets[j]), min(lo + (k + 1) * step, hi)))
                if below <= targets[j] < below + size and n > 1:
                    if first == last:
                        among[j] = (first, below)
                    else:
                        left[j] = (first, last + 1, below)
                below += size
            if best[0] <= allowed or (j not in left and j not in among):
                found[j] = best[1]
                left.pop(j, None)
                among.pop(j, None)
        spans = left
    return found, among


def shard(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE
) -> DataFrame:
    """All columns with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    Sizes of shards are near equal (law ``bytes``): each boundary misses its place by at
    most the tolerance or by one row. Slots count from 0 without gaps in every shard. Null
    texts have size 1 and the checksum of no bytes; a null id comes before all others, and
    rows without any difference may lie on either side of a boundary only together. The
    input's columns with these names are replaced.
    """
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    names = [c for c in docs.columns if c not in new]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*names, row_size(text_col).alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64(text).alias("__key"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("__id"))
    measured, totals = stage(rows.select(F.col("__key").alias("key"), F.col("__id").alias("id"), "size"), total=F.sum("size"))
    total = int(totals.get("total") or 0)
    bounds = splitters(measured, total, shards, tolerance) if total else []
    at = F.lit(0)
    for key, row in bounds:
        if row is None:
            above = F.col("__key") >= F.lit(key) if key < HIGH else F.lit(False)
        else:
            past = F.col("__id") >= F.lit(row) if row < HIGH else F.lit(False)
            above = (F.col("__key") > F.lit(key)) | ((F.col("__key") == F.lit(key)) & past)
        at = at + F.when(above, 1).otherwise(0)
    # The one exchange of the rows: by shard and a slice of it, so that a shard is not one task.
    part = F.pmod(F.xxhash64("__id", "__key"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumns({"shard": at.cast("int"), "__part": part})
    counted = rows.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    place = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__key", "__id")) - 1
    out = rows.withColumn("__place", place).join(offsets, ["shard", "__part"])
    return out.select(*names, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      (F.col("__from") + F.col("__place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
