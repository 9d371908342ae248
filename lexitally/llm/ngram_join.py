"""N-gram Jaccard join: documents whose word shingle sets are alike, by a prefix-tree join.

1. A fixed-size table of counts over all documents (one slot per hash range) gives a global
   order of n-grams: rare ones first, then by hash.
2. Documents with equal sets become one class. A class with n n-grams posts its first
   ``n - ceil(t n) + 1`` of them; two sets as alike as ``t`` share one of these.
3. Per posted n-gram, every class is compared with one hub. The hub's candidates are stored
   as a trie of their ordered sets; one traversal with the hub's set shares the overlaps of
   common beginnings and prunes subtrees whose remaining lengths cannot reach the bound.
4. Links are joined into components. Classes that share a posted n-gram but still lie in
   different components are met where that n-gram's classes are, block by block and sorted by
   component, so members of one component are passed over as a whole. A parity map of each
   set bounds how far two sets differ from below; only pairs that could be alike leave the
   block and are compared the same way. So no link between components is lost, and neither
   groups of copies nor groups of unlike classes make rows of all their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import SLICE_BYTES, U64, byte_codes, connected_components, mix, slices, utf8
from lexitally.session import stage

SLOTS = 1 << 18
#: Bits of the map of wanted classes.
WANTED = 1 << 24
#: Words of 64 bits of a set's parity map.
MAP_WORDS = 8
#: Classes of one n-gram that are met at once, and pairs looked at together.
MEET, PAIRS = 1 << 14, 1 << 17
#: Texts whose sets are made and sent together.
TEXTS = 1024
#: Candidates of one hub that share a task; more are dealt to several.
CHUNK = 256
_CODES = byte_codes(9)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U64(_BASE)), np.full(n, U64(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams of lower-cased words.

    A text with fewer words gives its whole sequence as one n-gram, one without words none.
    """
    n = len(data)
    if not n:
        yield from (np.zeros(0, np.uint64) for _ in offsets[1:])
        return
    folded = _FOLD[data]
    word = ~_SPACE[folded]
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1]] = True  # a text's first byte starts a word even if the one before is no space
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])) | np.isin(np.arange(1, n + 1), offsets[1:])))
    up, down = _powers(n)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[folded] * up)))
    h = mix((run[ends + 1] - run[starts]) * down[starts])
    of_text = np.searchsorted(starts, offsets)
    gram = h.copy()
    for k in range(1, words):
        gram[:-k or None] = mix(gram[:-k]) + h[k:] if len(h) > k else gram[: len(h)]
    for lo, hi in zip(of_text[:-1], of_text[1:]):
        if hi == lo:
            yield np.zeros(0, np.uint64)
        elif hi - lo < words:
            whole = h[lo : lo + 1]
            for k in range(lo + 1, hi):
                whole = mix(whole) + h[k : k + 1]
            yield mix(whole + U64(int(hi - lo)))
        else:
            yield np.unique(gram[lo : hi - words + 1])


def _texts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    for batch in (large.slice(k, TEXTS) for large in batches for k in range(0, large.num_rows, TEXTS)):
        data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))

        def sets(data=data, offsets=offsets):
            for lo, hi in slices(offsets, SLICE_BYTES // 2):
                yield from shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)

        yield batch, sets()


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams % U64(SLOTS)).astype(np.int64)


def _count(words: int) -> Callable:
    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for _, sets in _texts(batches, words):
            held, size = [], 0
            for grams in sets:
                held.append(grams)
                size += len(grams)
                if size > SLOTS:
                    counts += np.bincount(_slot(np.concatenate(held)), minlength=SLOTS)
                    held, size = [], 0
            if held:
                counts += np.bincount(_slot(np.concatenate(held)), minlength=SLOTS)
        used = counts.reshape(-1, 4096)
        for k in np.flatnonzero(used.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([used[k].tobytes()])], names=["part", "counts"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [total.tobytes()]})


def gram_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents hold an n-gram of each slot; of fixed size whatever the corpus is."""
    parts = docs.select("text").mapInArrow(_count(words), "part long, counts binary")
    counts = np.zeros((SLOTS // 4096, 4096), np.int64)
    for row in parts.groupBy("part").applyInPandas(_add, "part long, counts binary").collect():
        counts[row.part] = np.frombuffer(row.counts, np.int64)
    return counts.ravel()


def _ordered(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: rare slots first, then by hash."""
    return grams[np.argsort(counts[_slot(grams)], kind="stable")]


def parity_map(grams: np.ndarray) -> np.ndarray:
    """For each of some hash ranges whether an odd number of the n-grams is in it, as bits.

    The maps of two sets differ in at most as many bits as the sets differ in n-grams.
    """
    odd = np.bincount((grams >> U64(64 - 9)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(bool))


def _prefixes(words: int, percent: int, counts) -> Callable:
    def run(batches):
        order = counts.value
        for batch, sets in _texts(batches, words):
            n, which, heads, maps = [], [], [], []
            for grams in sets:
                maps.append(parity_map(grams).tobytes())
                n.append(len(grams))
                which.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                keep = len(grams) - -(-percent * len(grams) // 100) + 1 if len(grams) else 0
                heads.append(_ordered(grams, order)[:keep].view(np.int64))
            edge = np.concatenate(([0], np.cumsum([len(x) for x in heads], dtype=np.int64))).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            head = pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))
            cols = [batch.column(0), pa.array(n, pa.int32()), pa.array(which, pa.binary()), head, pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "which", "head", "map"])

    return run


def _full(words: int, counts, wanted) -> Callable:
    def run(batches):
        order, bits = counts.value, wanted.value
        for batch in batches:
            at = id_slots(batch.column(0).fill_null(0).to_numpy())
            hit = (bits[at >> U64(6)] >> (at & U64(63)) & U64(1)).astype(bool) & ~np.asarray(batch.column(0).is_null())
            batch = batch.filter(pa.array(hit))
            for batch, sets in _texts(iter([batch]), words):
                full = [_ordered(grams, order).tobytes() for grams in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(full, pa.binary())], names=["rep", "grams"])

    return run


def id_slots(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) % U64(WANTED)


def _mark(batches):
    for batch in batches:
        at = np.unique(id_slots(batch.column(0).to_numpy()))
        word, first = np.unique(at >> U64(6), return_index=True)
        bits = np.bitwise_or.reduceat(U64(1) << (at & U64(63)), first) if len(at) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _sets(docs: DataFrame, pairs: DataFrame, words: int, counts) -> DataFrame:
    """Ordered sets of the classes in ``pairs``, made where the texts are read.

    A bitmap of fixed size tells tasks which texts to take; a few too many are taken, which
    the join with the pairs leaves out, so no text is shuffled.
    """
    reps, _ = stage(pairs.select(F.explode(F.array("hub", "member")).alias("rep")).distinct())
    bits = np.zeros(WANTED // 64, np.uint64)
    for row in reps.mapInArrow(_mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        bits[row.word] = np.int64(row.bits).view(np.uint64)
    wanted = docs.sparkSession.sparkContext.broadcast(bits)
    full = docs.mapInArrow(_full(words, counts, wanted), "rep long, grams binary")
    return stage(full)[0]


class Trie:
    """Ordered sets as a trie with merged edges; every node knows the lengths below it."""

    def __init__(self, sets: list[np.ndarray], rank: Callable[[np.ndarray], list]):
        self.sets = sets
        keys = [rank(s) for s in sets]
        by_key = sorted(range(len(sets)), key=keys.__getitem__)
        self.nodes: list[tuple] = []  # label's set, from, to, shortest, longest, sets that end here, children
        todo = [(by_key, 0, None)] if by_key else []
        while todo:
            group, depth, above = todo.pop()
            first, last = sets[group[0]], sets[group[-1]]
            most = min(len(sets[i]) for i in group)
            differ = np.flatnonzero(first[depth:most] != last[depth:most])
            end = depth + int(differ[0]) if len(differ) else most
            sizes = [len(sets[i]) for i in group]
            here = [i for i in group if len(sets[i]) == end]
            node = (group[0], depth, end, min(sizes), max(sizes), here, [])
            self.nodes.append(node)
            if above is not None:
                above.append(len(self.nodes) - 1)
            rest = [i for i in group if len(sets[i]) > end]
            cut = 0
            for k in range(1, len(rest) + 1):
                if k == len(rest) or sets[rest[k]][end] != sets[rest[cut]][end]:
                    todo.append((rest[cut:k], end, node[6]))
                    cut = k

    def alike(self, probe: np.ndarray, percent: int) -> list[int]:
        """Sets whose Jaccard similarity with the probe is at least ``percent`` hundredths."""
        have = np.sort(probe)
        n, found = len(probe), []
        todo = [(0, 0)] if self.nodes else []
        while todo:
            k, overlap = todo.pop()
            of, start, end, shortest, longest, here, below = self.nodes[k]
            label = self.sets[of][start:end]
            at = np.searchsorted(have, label)
            at[at == n] = 0
            overlap += int(np.count_nonzero(have[at] == label)) if n else 0
            # Even if all that remains of the longest set matched, against the smallest union.
            best = min(overlap + longest - end, n)
            if (100 + percent) * best < percent * (n + shortest):
                continue
            for i in here:
                if (100 + percent) * overlap >= percent * (n + len(self.sets[i])):
                    found.append(i)
            todo += [(c, overlap) for c in below]
        return found


def _verify(percent: int, counts) -> Callable:
    """Members alike to the hub, of the rows of one hub and chunk; one row is the hub's own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = counts.value

        def rank(grams: np.ndarray) -> list:
            return list(zip(order[_slot(grams)].tolist(), grams.tolist()))

        of_hub = pdf["of_hub"].to_numpy(bool)
        probe = np.frombuffer(pdf["grams"][of_hub].iloc[0], np.uint64)
        trie = Trie([np.frombuffer(x, np.uint64) for x in pdf["grams"][~of_hub]], rank)
        found = pdf["rep"].to_numpy()[~of_hub][trie.alike(probe, percent)]
        return pd.DataFrame({"a": np.full(len(found), pdf["hub"].iloc[0]), "b": found})

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int, counts) -> DataFrame:
    """The pairs (hub, member) that are alike, by a trie per hub and chunk of members."""
    sized = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.join(sized, "hub").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")))
    parts = dealt.select("hub", "chunk", F.col("member").alias("rep"), F.lit(False).alias("of_hub"))
    hubs = dealt.select("hub", "chunk").distinct().select("hub", "chunk", F.col("hub").alias("rep"), F.lit(True).alias("of_hub"))
    # members and hubs ask for their sets in one join
    asked = parts.union(hubs).join(sets, "rep")
    return asked.groupBy("hub", "chunk").applyInPandas(_verify(percent, counts), "a long, b long")


def _met(percent: int, rows: list[np.ndarray], maps: np.ndarray) -> np.ndarray:
    """Pairs of classes of different components that could be alike, of sorted rows of whole cells.

    A row of the result is a pair, the sizes of its sets, and under how many n-grams it met. Rows are (gram, i, j, side, component, rep, n). A cell's rows of side 0 meet those of side 1,
    or, where it has none, each other.
    """
    gram, i, j, side, component, rep, n = rows
    total = len(gram)
    edge = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    end = np.append(edge[1:], total)
    cell = np.repeat(np.arange(len(edge)), end - edge)
    first = end - np.add.reduceat(side, edge)  # where side 1 begins
    alone = (first == end)[cell]
    # Rows are in the order of cell, side and component; of a component, a key of the other side's rows.
    part = np.unique(component, return_inverse=True)[1]
    key = (cell * 2 + side) * (part.max() + 1) + part
    left = np.flatnonzero(side == 0)
    want = (cell[left] * 2 + ~alone[left]) * (part.max() + 1) + part[left]
    own = [np.searchsorted(key, want, at) for at in ("left", "right")]
    begin = np.where(alone[left], own[0], first[cell[left]])  # alone: only components behind the own one
    found = [np.zeros((0, 4), np.int64)]
    for lo, hi in ((begin, own[0]), (own[1], end[cell[left]])):
        many = hi - lo
        upto = np.cumsum(many)
        at = 0
        while at < len(left):
            done = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
            size = many[at:to]
            a = np.repeat(left[at:to], size)
            b = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[at:to], size)
            at = to
            near = percent * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b])
            a, b = a[near], b[near]
            differ = np.bitwise_count(maps[a] ^ maps[b]).sum(axis=1, dtype=np.int64)
            near = (100 + percent) * differ <= (100 - percent) * (n[a] + n[b])
            a, b = a[near], b[near]
            turn = rep[a] > rep[b]
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            found.append(np.stack([rep[a], rep[b], n[a], n[b]], 1))
    pairs, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
    return np.column_stack([pairs, times])


def _across(percent: int) -> Callable:
    def run(batches):
        held: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
                if held.num_rows < 1 << 14:
                    continue
            if held is None or not held.num_rows:
                continue
            cols = [held.column(k).to_numpy() for k in range(7)]
            whole = held.num_rows
            if batch is not None:  # the last cell may go on
                same = np.ones(whole, bool)
                for k in range(3):
                    same &= cols[k] == cols[k][-1]
                whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if not whole:
                continue
            data, _ = utf8(held.column(7).slice(0, whole))
            found = _met(percent, [c[:whole].astype(np.int64) for c in cols], data.view(np.uint64).reshape(whole, MAP_WORDS))
            held = held.slice(whole).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in found.T], names=["hub", "member", "n", "m", "c"])

    return run


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _meetings(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, member, their sizes n and m, n-grams they met under c) of ``posts`` (gram, many, rep, n, component, map) that could be alike.

    The classes of an n-gram are dealt to chunks; every two chunks, and each with itself, are a cell.
    """
    chunks = F.ceil(F.col("many") / MEET)
    dealt = posts.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        "component", "rep", "n", "map",
    )
    placed = cells.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "side", "component")
    met = placed.mapInArrow(_across(percent), "hub long, member long, n long, m long, c long")
    return met.groupBy("hub", "member").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum("c").alias("c"))


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` for every row: components of alike documents.

    Two rows link when ``100 * intersection >= percent * union`` of their distinct word
    n-grams; ``component_id`` is the smallest id reachable by links, itself included. A
    null or empty text has no n-grams and links with nothing. Ids are integers; where one
    repeats, with the same text or another, its rows are rows of their own, and rows of
    equal text have equal results. A row whose id is null takes part in nothing and gets a
    null component.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if docs.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return _classes(docs, words, percent)
    # Rows are joined by numbers of their own; the smallest id of a component names it at the end.
    numbered, _ = stage(docs.withColumn("row", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())))
    found, _ = stage(_classes(numbered.select(F.col("row").alias("id"), "text"), words, percent).withColumnsRenamed({"id": "row", "component_id": "part"}))
    of_row = found.join(numbered.where("row is not null").select("row", "id"), "row")
    least = of_row.groupBy("part").agg(F.min("id").alias("component_id"))
    named = of_row.join(least, "part").select("id", "n_shingles", "component_id")
    without = found.where("row is null").select(F.col("row").alias("id"), "n_shingles", F.col("part").alias("component_id"))
    return named.union(without)


def _marked(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows whose id is that of a class, by a bitmap of fixed size, so that the rows stay where they are.

    A few copies may pass as classes of their own; they are linked with their class like any other.
    """
    place = F.pmod(F.xxhash64("rep"), F.lit(WANTED))
    bits = classes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
    bits = bits.agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    # at most WANTED / 64 rows
    place = F.pmod(F.xxhash64("id"), F.lit(WANTED))
    found = rows.withColumn("place", place).withColumn("word", F.shiftright("place", 6)).join(F.broadcast(bits), "word")
    return found.where("shiftright(bits, cast(place & 63 as int)) & 1 = 1")


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``jaccard_classes`` of rows whose ids are unique or null."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(gram_counts(docs, words))
    rows, _ = stage(docs.mapInArrow(_prefixes(words, percent, counts), "id long, n int, which binary, head array<long>, map binary"))
    named = rows.where("n > 0 and id is not null")
    classes = named.groupBy("which", "n").agg(F.min("id").alias("rep"))
    heads = _marked(named, classes).select("id", "n", "head")
    # Dealt by n-gram once, for the count of an n-gram's classes and for the join with it.
    posts = heads.select(F.col("id").alias("rep"), "n", F.explode("head").alias("gram")).repartition("gram")
    groups = posts.groupBy("gram").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1")
    # Postings of n-grams that several classes post: all that later steps need.
    shared, _ = stage(posts.join(groups.select("gram", "hub"), "gram"))
    at_hub = shared.where("rep = hub").select("gram", F.col("n").alias("hub_n"))

    def sizes(n: str, m: str):
        return percent * F.greatest(n, m) <= 100 * F.least(n, m)

    def enough(shared_grams: str, n: str, m: str):
        """Whether so many n-grams in both prefixes, and all after one prefix, could reach the overlap.

        Of two prefixes one ends first; shared n-grams up to there are posted by both sets.
        """
        rest = [F.ceil(percent * F.col(c) / 100) - 1 for c in (n, m)]
        return (F.col(shared_grams) + F.greatest(*rest)) * (100 + percent) >= percent * (F.col(n) + F.col(m))

    def pairs_of(rows: DataFrame, hub: str, member: str, n: str, m: str) -> DataFrame:
        found = rows.groupBy(F.col(hub).alias("hub"), F.col(member).alias("member")).agg(
            F.count(F.lit(1)).alias("c"), F.first(n).alias("n"), F.first(m).alias("m")
        )
        return found.where(enough("c", "n", "m")).select("hub", "member")

    # A pair's n-grams may have other hubs, so some alike pairs are left to the second round.
    near = shared.where("rep != hub").join(at_hub, "gram").where(sizes("n", "hub_n"))
    tested, _ = stage(pairs_of(near, "hub", "rep", "hub_n", "n"))
    sets = _sets(docs, tested, words, counts)
    links, _ = stage(_links(tested, sets, percent, counts))

    parts = connected_components(links)
    placed = shared.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "gram", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    ends = [F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("many")]
    split = placed.groupBy("gram").agg(*ends).where("x < y").select("gram", "many")
    # Every n-gram that two classes of different components share is open, so counts are whole.
    open_posts, _ = stage(placed.join(split, "gram"))
    met = _meetings(open_posts.join(rows.select(F.col("id").alias("rep"), "map"), "rep"), percent)
    met = met.where(enough("c", "n", "m")).select("hub", "member")
    more, _ = stage(met.join(tested, ["hub", "member"], "left_anti"))
    last = links.union(_links(more, _sets(docs, more, words, counts), percent, counts))
    of_rep = connected_components(last).select(F.col("id").alias("rep"), "component")
    found = classes.join(of_rep, "rep", "left").select("which", F.coalesce("component", "rep").alias("component"))
    out = rows.join(found, "which", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
