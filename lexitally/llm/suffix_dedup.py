"""Repeated passages by suffix arrays: every byte of a long enough string that occurs twice.

Where the corpus is cut. Each window of ``length`` bytes picks its anchor, the smallest
hash of a shorter string inside it; equal windows pick the same anchor at the same place,
so a neighbourhood (the windows of one anchor, as one stretch of bytes) can be compared
with those of equal anchors alone. That deals the corpus to shards by anchor: equal windows
always meet, and no shard needs another. Neighbourhoods that are equal byte for byte are
counted instead of copied.

What a shard does. It joins its neighbourhoods into one text and builds its suffix array by
induced sorting: suffixes are classified, the substrings between leftmost-smaller suffixes
are sorted and named, the string of names is sorted recursively, and the whole array is
induced from it in one pass each way. Permuted common prefixes then tell which windows
share ``length`` bytes with a neighbour in the array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.common import U64, byte_codes, mix, slices, utf8
from lexitally.session import stage

LENGTH = 400
#: Bytes of neighbourhoods that a shard should hold; a suffix array takes some 40 times that while it is made.
SHARD_BYTES = 2 << 20
#: Different neighbourhoods of one anchor that may meet in a shard; beyond that each
#: window is dealt by its own content.
MOST_VARIANTS = 4096
#: Buckets that a scan goes through one after the other.
MOST_SYMBOLS = 2048
#: Names at which the recursion ends.
SHORT = 1 << 18
_CODES = byte_codes(5)


# --- suffix arrays -----------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the end is smaller than all)."""
    n = len(s)
    smaller = np.zeros(n, bool)
    if n > 1:
        # Within a run of equal symbols the step after the run decides.
        at = np.where(s[1:] != s[:-1], np.arange(n - 1, dtype=np.int32), np.int32(n))
        decides = np.minimum.accumulate(at[::-1])[::-1]
        known = decides < n
        smaller[:-1][known] = (s[1:] > s[:-1])[decides[known]]
    return smaller


def _lms(smaller: np.ndarray) -> np.ndarray:
    return (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix order that follows from an order of the leftmost-smaller suffixes.

    Each bucket is scanned in waves, a wave being all entries that the one before it put into
    the same bucket, so that numpy moves many suffixes at once.
    """
    n = len(s)
    size = np.bincount(s, minlength=symbols)
    head = np.concatenate(([0], np.cumsum(size)))
    by_symbol = np.argsort(s[lms], kind="stable")
    lms, cut = lms[by_symbol], np.searchsorted(s[lms[by_symbol]], np.arange(symbols + 1))
    sa = np.full(n, -1, np.int32)
    larger = np.bincount(s[~smaller], minlength=symbols)
    fill = head[:-1].copy()

    def put(found: np.ndarray, ahead: bool) -> None:
        """Append suffixes to their buckets, keeping their order."""
        symbol = s[found]
        order = np.argsort(symbol, kind="stable")
        found, symbol = found[order], symbol[order]
        starts = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
        count = np.diff(np.append(starts, len(symbol)))
        within = np.arange(len(symbol)) - np.repeat(starts, count)
        if ahead:
            sa[fill[symbol] + within] = found
            fill[symbol[starts]] += count
        else:
            sa[fill[symbol] - 1 - within] = found
            fill[symbol[starts]] -= count

    # The last suffix is larger than the empty one and comes first of its symbol.
    put(np.array([n - 1]), True)
    for c in range(symbols):
        done = head[c]
        while done < fill[c]:
            wave = sa[done : fill[c]]
            done = fill[c]
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                put(before, True)
        before = lms[cut[c] : cut[c + 1]] - 1
        before = before[~smaller[before]]
        if len(before):
            put(before, True)
    fill = head[1:].copy()
    for c in range(symbols - 1, -1, -1):
        done = head[c + 1]
        while done > fill[c]:
            wave = sa[fill[c] : done][::-1]
            done = fill[c]
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                put(before, False)
        wave = sa[head[c] : head[c] + larger[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        if len(before):
            put(before, False)
    return sa


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in text order: equal ones share a name."""
    ends = np.append(lms[1:] + 1, len(s))
    size = np.zeros(len(s), np.int32)
    size[lms] = ends - lms
    a, b = ordered[:-1], ordered[1:]
    differ = size[a] != size[b]
    # The last one runs to the end of the text, which is no symbol, so it equals none.
    differ |= (a == lms[-1]) | (b == lms[-1])
    same = np.flatnonzero(~differ)
    k = 0
    while len(same):
        unequal = s[a[same] + k] != s[b[same] + k]
        differ[same[unequal]] = True
        k += 1
        same = same[~unequal]
        same = same[size[a[same]] > k]
    name = np.zeros(len(s), np.int32)
    name[ordered] = np.concatenate(([0], np.cumsum(differ)))
    return name[lms], int(differ.sum()) + 1


def _digits(name: np.ndarray, many: int) -> tuple[np.ndarray, int, int]:
    """Names written as numbers of equally many digits of a base that is not too large."""
    width = 1
    while MOST_SYMBOLS**width < many:
        width += 1
    base = next(b for b in range(max(2, int(many ** (1 / width))), many + 2) if b**width >= many)
    return np.stack([name // base**k % base for k in range(width - 1, -1, -1)], axis=1).ravel().astype(np.uint16), base, width


def _double(s: np.ndarray) -> np.ndarray:
    """The suffix array of a short string, by ranks of twice as many symbols each round."""
    n = len(s)
    live = np.argsort(s, kind="stable")
    rank, reach, key = np.zeros(n, np.int64), 0, s[live].astype(np.int64)
    group = np.zeros(n, np.int64)
    while True:
        place = np.arange(len(live))
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        old = np.concatenate(([True], group[1:] != group[:-1]))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[live] = group + first - np.maximum.accumulate(np.where(old, place, 0))
        alone = new & np.append(new[1:], True)
        live = live[~alone]
        if not len(live):
            break
        reach = max(1, 2 * reach)
        after = np.where(live + reach < n, rank[np.minimum(live + reach, n - 1)] + 1, 0)
        order = np.argsort(rank[live] * (n + 1) + after, kind="stable")
        live, key = live[order], after[order]
        group = rank[live]
    sa = np.zeros(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes in order; the end of the text is smaller than any symbol.

    Names are sorted as a text of their own. As there are many different ones, each is
    written as a few digits, and the suffixes that begin with a first digit are taken. A
    short text of names ends the recursion.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    smaller = _types(s)
    lms = _lms(smaller)
    if not len(lms):
        return _induce(s, smaller, lms, symbols)
    rough = _induce(s, smaller, lms, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    name, many = _names(s, lms, ordered)
    if many < len(lms):
        if len(name) <= SHORT:
            order = _double(name)
        else:
            digits, base, width = _digits(name, many)
            order = suffix_array(digits, base)
            order = order[order % width == 0] // width
        ordered = lms[order]
    return _induce(s, smaller, ordered, symbols)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int, fresh: np.ndarray) -> np.ndarray:
    """By text position: symbols that a suffix shares with the one before it in the array.

    Where a suffix and its neighbour in the array follow equal symbols, its value is one
    less than that of the position before; only the other positions, and those in ``fresh``, are compared
    symbol by symbol, up to ``most``. Values are exact up to ``most`` less the distance to
    the last compared position, and never too large.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    compare = np.ones(n, bool)
    compare[1:] = (before[1:] < 1) | (s[:-1] != s[np.maximum(before[1:], 1) - 1])
    compare[fresh] = True
    at = np.flatnonzero(compare)
    value = np.zeros(len(at), np.int64)
    # Symbols are compared four at once, as one number.
    pad = np.concatenate((s.astype("<u2"), np.zeros(4, "<u2")))
    four = np.ndarray((n,), "<u8", pad, strides=(2,))
    live = np.flatnonzero(before[at] >= 0)
    room = n - np.maximum(at, before[at])
    k = 0
    while len(live):
        i, j = at[live] + k, before[at[live]] + k
        unlike = four[np.minimum(i, n - 1)] ^ four[np.minimum(j, n - 1)]
        lowest = (unlike & (~unlike + U64(1))).astype(np.float64)
        same = np.where(unlike == 0, 4, np.log2(np.maximum(lowest, 1)).astype(np.int64) >> 4)
        value[live] = np.minimum(k + same, room[live])
        k += 4
        live = live[(same == 4) & (k < room[live])] if k < most else live[:0]
    place = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(compare, place, np.int32(0)))
    full = np.zeros(n, np.int32)
    full[at] = value
    return np.maximum(full[last] - (place - last), 0)


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part: the starts of its ``length``-byte windows that occur elsewhere in the parts."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    # Parts end in symbol 0; byte values move up by one where 0 itself occurs in a text.
    joined = b"\0".join(parts) + b"\0"
    text = np.frombuffer(joined, np.uint8)
    symbols = 256
    if int(np.count_nonzero(text == 0)) > len(parts):
        text = text.astype(np.uint16) + np.uint16(1)
        text[ends - 1] = 0
        symbols = 257
    sa = suffix_array(text, symbols)
    shared = common_prefixes(text, sa, length + int(sizes.max()) + 8, starts)
    # A window lies in one part: a zero at a part's end is shared as well, so lengths are cut there.
    left = np.repeat((ends - 1).astype(np.int32), sizes + 1) - np.arange(len(text), dtype=np.int32)
    hit = np.zeros(len(text), bool)
    good = (shared >= length) & (left >= length)
    hit[good] = True
    before = np.full(len(text), -1, np.int32)
    before[sa[1:]] = sa[:-1]
    hit[before[np.flatnonzero(good)]] = True
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(starts, sizes)]


# --- neighbourhoods ----------------------------------------------------------------------


def neighbourhoods(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of every neighbourhood of a text.

    The anchor is the leftmost smallest hash of a string of ``gram`` bytes, the largest power
    of two up to a third of the length.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty
    gram = 1 << ((length // 3).bit_length() - 1) if length >= 6 else 1
    h, size, k = _CODES[data], 1, 0
    while size < gram:
        h = mix(h[:-size]) + h[size:] if size < 8 else h[:-size] * U64(0x9E3779B97F4A7C15 + 2 * k) + h[size:]
        size, k = size * 2, k + 1
    h = mix(h)
    wide = length - gram + 1
    # The upper bits order, the lower ones hold the place, which breaks ties to the left.
    bits = max(1, int(len(h)).bit_length())
    low = U64((1 << bits) - 1)
    best, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * size <= wide:
        best, size = np.minimum(best[:-size], best[size:]), size * 2
    if size < wide:
        best = np.minimum(best[: -(wide - size)], best[wide - size :])
    place = (best & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return first, np.diff(np.append(first, len(place))), h[place[first]].view(np.int64)


def _digest(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def _cut(length: int) -> Callable:
    """Neighbourhoods of every text, each with a hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            view = memoryview(data.tobytes())
            for lo, hi in slices(offsets, 8 << 20):
                rows, starts, counts, anchors, seen = [], [], [], [], []
                for r in range(lo, hi):
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    first, many, anchor = neighbourhoods(data[a:b], length)
                    rows.append(np.full(len(first), r))
                    starts.append(first)
                    counts.append(many)
                    anchors.append(anchor)
                    seen += [_digest(view[a + i : a + i + n + length - 1]) for i, n in zip(first.tolist(), many.tolist())]
                at = np.concatenate(rows).astype(np.int64)
                cols = [batch.column(0).take(pa.array(at)), pa.array(np.concatenate(starts).astype(np.int32)),
                        pa.array(np.concatenate(counts).astype(np.int32)), pa.array(np.concatenate(anchors).astype(np.int64)),
                        pa.array(seen, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "first", "many", "anchor", "content"])

    return run


def _fetch(length: int) -> Callable:
    """Bytes of the wanted neighbourhoods; those of a crowded anchor as single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "first", "many", "anchor", "times", "alone", "bytes"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out, held = [], 0
            for r in range(len(batch)):
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                for w in batch.column(2)[r].as_py():
                    if w["crowded"]:
                        for k in range(w["many"]):
                            window = text[w["first"] + k : w["first"] + k + length]
                            out.append((batch.column(0)[r].as_py(), w["first"] + k, 1, None, w["times"], False, window))
                            held += length
                    else:
                        piece = text[w["first"] : w["first"] + w["many"] + length - 1]
                        out.append((batch.column(0)[r].as_py(), w["first"], w["many"], w["anchor"], w["times"], w["alone"], piece))
                        held += len(piece)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged byte ranges that windows from these sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first = np.concatenate(([0], cut + 1))
    last = np.concatenate((cut, [len(starts) - 1]))
    return [(int(starts[a]), int(starts[b]) + length) for a, b in zip(first, last)]


def _shard(length: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        found = repeated_starts([bytes(x) for x in pdf["bytes"]], length)
        for i, first, times, hit in zip(pdf["id"], pdf["first"], pdf["times"], found):
            if times == 1:  # where it occurs more often, all of it repeats anyway
                out += [(i, first + a, first + b) for a, b in _spans(hit, length)]
        return pd.DataFrame(out, columns=["id", "a", "b"]).astype("int64")

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, most_variants: int = MOST_VARIANTS) -> DataFrame:
    """``id``, ``a``, ``b``: byte ranges that repeated strings of ``length`` bytes cover.

    ``docs`` has a unique long ``id`` and ``text``. Ranges of one text may overlap.
    """
    cuts, _ = stage(docs.mapInArrow(_cut(length), "id long, first int, many int, anchor long, content long"))
    kinds = cuts.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "first", "many")).alias("one")
    )
    kinds, _ = stage(kinds)
    per_anchor = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"), F.sum(F.col("one.many") + (length - 1)).alias("size"))
    differ = kinds.join(per_anchor.where("variants > 1"), "anchor")
    crowded, alone = F.col("variants") > most_variants, F.col("size") > SHARD_BYTES // 4
    wanted = differ.select(
        "one.id", F.struct("one.first", "one.many", "anchor", "times", crowded.alias("crowded"), alone.alias("alone")).alias("w")
    )
    wanted = wanted.groupBy("id").agg(F.collect_list("w").alias("wanted"))
    fetched, totals = stage(
        docs.join(wanted, "id").mapInArrow(_fetch(length), "id long, first int, many int, anchor long, times long, alone boolean, bytes binary"),
        size=F.coalesce(F.sum(F.length("bytes")), F.lit(0)),
    )
    shards = max(1, -(-int(totals.get("size") or 0) // SHARD_BYTES))
    # An anchor with much to compare has a shard of its own, so that no two of them meet in one.
    dealt = fetched.where("anchor is not null").select(
        F.when(F.col("alone"), F.col("anchor")).alias("own"),
        F.when(~F.col("alone"), F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard"), "id", "first", "times", "bytes",
    )
    by_shard = dealt.groupBy("own", "shard").applyInPandas(_shard(length), "id long, a long, b long")
    # Windows of crowded anchors: equal ones are counted by content, wherever they are.
    single = fetched.where("anchor is null").select("id", "first", "times", F.md5("bytes").alias("window"))
    again = single.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1")
    by_window = single.join(again, "window").select("id", F.col("first").cast("long").alias("a"), (F.col("first") + length).cast("long").alias("b"))
    # Neighbourhoods that occur several times repeat as a whole, in all their places.
    copied = cuts.join(kinds.where("times > 1").select("anchor", "content"), ["anchor", "content"]).select(
        "id", F.col("first").cast("long").alias("a"), (F.col("first") + F.col("many") + length - 1).cast("long").alias("b")
    )
    return copied.union(by_shard).union(by_window)


def _remove(as_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "n_removed", "n_spans", "kept"]
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("__text")))
            spans = batch.column(batch.schema.get_field_index("__spans"))
            removed, runs, kept = [], [], []
            for r in range(len(batch)):
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                pieces, end, n, k = [], 0, 0, 0
                for a, b in sorted((s["a"], s["b"]) for s in (spans[r].as_py() or ())):
                    if a > end or not k:
                        pieces.append(text[end:a])
                        k += 1
                        end = a
                    if b > end:
                        n += b - end
                        end = b
                pieces.append(text[end:])
                removed.append(n)
                runs.append(k)
                kept.append("".join(p.decode("utf-8", "ignore") for p in pieces) if as_text else b"".join(pieces))
            others = [i for i, c in enumerate(batch.schema.names) if c not in ("__text", "__spans")]
            cols = [batch.column(i) for i in others]
            cols += [pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())]
            cols.append(pa.array(kept, pa.string() if as_text else pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[*(batch.schema.names[i] for i in others), *names])

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    most_variants: int = MOST_VARIANTS,
    as_text: bool = False,
) -> DataFrame:
    """All columns but the text, with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in the
    same text or another, is removed; strings are judged on the input. ``kept`` is what is
    left, as bytes that may end inside a character at a cut, or with ``as_text`` as text
    without such halves. A null text counts as empty. Rows are told apart by a number of
    their own where ids are null or repeat, so repeated rows are rows like others. Columns
    of the input with the four names are replaced.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    names = [c for c in docs.columns if c != text_col and c not in new]
    text = docs.select(*names, F.col(text_col).cast("string").alias("__text"))
    key = F.col(id_col).cast("long")
    ids = text.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 or k is null").isEmpty():
        numbered = text.withColumn("__row", key)
    else:
        numbered, _ = stage(text.withColumn("__row", F.monotonically_increasing_id()))
    found = repeated_spans(numbered.select(F.col("__row").alias("id"), F.col("__text").alias("text")), length, most_variants)
    spans = found.groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("__spans")).withColumnRenamed("id", "__row")
    rows = numbered.join(spans, "__row", "left").drop("__row")
    fields = [rows.schema[c] for c in names]
    fields += [T.StructField(c, T.LongType()) for c in new[:3]] + [T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    return rows.mapInArrow(_remove(as_text), T.StructType(fields))
