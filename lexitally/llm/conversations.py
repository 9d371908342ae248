"""Repair of conversation structure: cost DP, then the least path by prefix doubling.

A repaired conversation is empty, or a system turn at most and then user and assistant in turns.
A node is a place between rows and what was written last (nothing, system, user, assistant);
arcs delete, keep or rerole the next row or insert an empty turn. The cost DP gives the cost to
go of every node; arcs that lose nothing are optimal. Their nodes are ranked by the first 1, 2,
4, ... letters of their least audit, each round from the ranks and pointers of the one
before, and the ranks pick the path, which is laid out through the doubled pointers.

Rows are numbered in order side by side, and a conversation is cut into chunks of its numbers,
so one of any length is solved by many tasks. A chunk's costs are a matrix by the states at its
two ends; such matrices are combined in groups of groups, and back down each chunk gets the
cost to go at its end. The states in which paths enter the chunks are found in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.common import named
from lexitally.operators.ranking import number_within
from lexitally.session import stage

#: Rows of a chunk, and chunks (or groups) of a group.
CHUNK, GROUP = 1024, 256
#: Rows that a task solves at once.
AT_ONCE = 1 << 16

INSERT, REROLE, DELETE, CUT_OFF = 3, 3, 4, 3
INF = 1 << 40
#: States: nothing written yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
LETTERS = "DIKR"
BLANK = r"[^\x20\x09-\x0D]"
WHOLE, TRUNCATED, EMPTY, REPEATED = range(4)
#: What an inserted or reroled turn leads to.
TURN = np.array([USER, USER, ASSISTANT, USER])


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By kind of row (initial s, u, a or another, plus 4 times its fault) and state: where keeping leads, what keeping
    and reroling cost; and the costs of taking the row from state to state."""
    kept, own = np.full((16, 4), -1), np.full(16, INF)
    taken = np.full((16, 4, 4), INF)
    for kind in range(16):
        initial, fault = kind % 4, kind // 4
        if fault in (WHOLE, TRUNCATED):
            own[kind] = CUT_OFF if fault == TRUNCATED else 0
            for state, to in ((START, SYSTEM),) if initial == 0 else ():
                kept[kind, state] = to
            for state in (START, SYSTEM, ASSISTANT) if initial == 1 else ():
                kept[kind, state] = USER
            if initial == 2:
                kept[kind, USER] = ASSISTANT
        for state in range(4):
            taken[kind, state, state] = DELETE
            if own[kind] < INF:
                to = TURN[state]
                taken[kind, state, to] = min(taken[kind, state, to], own[kind] + REROLE)
                if kept[kind, state] >= 0:
                    to = kept[kind, state]
                    taken[kind, state, to] = min(taken[kind, state, to], own[kind])
    return kept, own, taken


KEPT, OWN, TAKEN = _tables()


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs to go (rows, state, ...) where turns may be inserted first; a third insertion is never cheaper."""
    return np.minimum(np.minimum(cost, cost[:, TURN] + INSERT), cost[:, TURN[TURN]] + 2 * INSERT)


#: Cost to go at the end of a conversation.
CLOSING = _inserted(np.array([[0, INF, INF, 0]]))[0]


def costs(kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cost to go of every node (place, state, ...), chunk after chunk; ``ends`` (chunk, state, ...) are those at chunk ends.

    ``starts`` are the chunks' first rows in ``kinds``, and the number of all rows. Chunk k's
    place i is row ``starts[k] + k + i`` of the result. All chunks are gone through together.
    """
    size = np.diff(starts)
    first = starts[:-1] + np.arange(len(size))
    out = np.empty((starts[-1] + len(size), *ends.shape[1:]), np.int64)
    out[first + size] = ends
    order = np.argsort(-size, kind="stable")
    longer = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")
    for back, n in enumerate(longer, 1):
        chunk = order[:n]
        at = first[chunk] + size[chunk] - back
        step = TAKEN[kinds[starts[chunk] + size[chunk] - back]]
        after = out[at + 1]
        step = step.reshape(*step.shape, *[1] * (after.ndim - 2))
        out[at] = np.minimum(_inserted((step + after[:, None]).min(axis=2)), INF)
    return out


def optimal_arcs(kinds: np.ndarray, starts: np.ndarray, cost: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The node that each optimal arc (node, letter in the order of ``LETTERS``) leads to, or -1.

    The end of a chunk has arcs only in the last chunk of a conversation: elsewhere they
    belong to the next chunk. Different arcs of a node have different letters.
    """
    chunks = len(starts) - 1
    places, state = len(cost), np.arange(4)
    is_end = np.zeros(places, bool)
    is_end[starts[1:] + np.arange(chunks)] = True
    kind = np.zeros(places, np.int64)
    kind[~is_end] = kinds
    after = np.full((places, 4), INF)
    after[:-1] = cost[1:]
    after[is_end] = INF
    own, keeps = OWN[kind][:, None], KEPT[kind]
    known = cost < INF
    to = np.full((places, 4, 4), -1)
    here, there = 4 * np.arange(places)[:, None], 4 * np.arange(1, places + 1)[:, None]
    to[..., 0] = np.where(known & (cost == DELETE + after), there + state, -1)
    to[..., 1] = np.where(known & (cost == INSERT + cost[:, TURN]), here + TURN, -1)
    kept = np.take_along_axis(after, np.maximum(keeps, 0), 1)
    to[..., 2] = np.where(known & (keeps >= 0) & (cost == own + kept), there + keeps, -1)
    to[..., 3] = np.where(known & (cost == own + REROLE + after[:, TURN]), there + TURN, -1)
    to[is_end & ~_of_chunk(last, starts)] = -1
    return to.reshape(-1, 4)


def _of_chunk(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A chunk's value at each of its places."""
    return np.repeat(value, np.diff(starts) + 1)


@dataclass
class Ranked:
    """Least paths from every node: the letter it begins with (0: it ends), pointers 1, 2, 4, ... letters ahead, its length."""

    letter: np.ndarray
    jumps: list[np.ndarray]
    length: np.ndarray
    rank: np.ndarray


def rank_paths(to: np.ndarray) -> Ranked:
    """Rank nodes by the least audits that their optimal arcs spell, over 1, 2, 4, ... letters.

    A node's rank over 2m letters follows from its own over m letters and that of the node m
    letters ahead. An end ranks before every letter, as a string's end does. Each letter
    leads to one node only, so the least m letters from a node end in one node.
    """
    node = np.arange(len(to))
    ends = (to < 0).all(axis=1)
    first = np.where(ends, 0, (to >= 0).argmax(axis=1) + 1)
    rank, jump = first, np.where(ends, node, to[node, np.maximum(first - 1, 0)])
    length, jumps = (~ends).astype(np.int64), []
    while True:
        jumps.append(jump)
        if ends[jump].all():
            break
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        length = length + length[jump]
        jump = jump[jump]
    # the arc of the least audit: by its letter, then by the rank of where it leads
    by = np.where(to >= 0, np.arange(1, 5) * (rank.max() + 1) + rank[np.maximum(to, 0)], np.iinfo(np.int64).max)
    letter = np.where(ends, 0, by.argmin(axis=1) + 1)
    return Ranked(letter, jumps, length, rank)


def lay_out(ranked: Ranked, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the paths from some nodes, one path after the other, and where each path's begin.

    The node m letters into a path, m = 2^k + less, is 2^k letters ahead of the one less than 2^k letters in.
    """
    size = ranked.length[begin]
    starts = np.concatenate(([0], np.cumsum(size)))
    path = np.repeat(begin, size)
    step = np.arange(starts[-1]) - np.repeat(starts[:-1], size)
    for k in range(len(ranked.jumps) - 1, -1, -1):
        at = np.flatnonzero((step >> k & 1 == 1) & (step & ((1 << k) - 1) == 0))
        path[at] = ranked.jumps[k][path[at - (1 << k)]]
    return path, starts


# --- groups of chunks --------------------------------------------------------------------


def join_costs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Costs through two stretches (state, middle) and (middle, ...)."""
    return np.minimum((first[:, :, None] + second[None]).min(axis=1), INF)


def _all_costs(parts: np.ndarray) -> np.ndarray:
    out = parts[0].reshape(4, 4)
    for part in parts[1:]:
        out = join_costs(out, part.reshape(4, 4))
    return out.ravel()


def _cost_at_ends(parts: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = [end]
    for part in parts[:0:-1]:
        out.append(join_costs(part.reshape(4, 4), out[-1][:, None])[:, 0])
    return np.array(out[::-1])


def _all_exits(parts: np.ndarray) -> np.ndarray:
    out = parts[0]
    for part in parts[1:]:
        out = part[out]
    return out


def _entries(parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
    out = [entry]
    for part in parts[:-1]:
        out.append(part[out[-1]])
    return np.array(out)


KEY = [T.StructField("key", T.StringType()), T.StructField("idx", T.LongType())]
VALUE = T.ArrayType(T.LongType())
LONGS = pa.list_(pa.int64())


def _rows(name: str, found: Iterator[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    keys, idx, values = list(zip(*found)) or ((), (), ())
    values = pa.array([np.asarray(v).tolist() for v in values], LONGS)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(idx, pa.int64()), values], names=["key", "idx", name])


def sweep(leaves: DataFrame, combine: Callable, spread: Callable, top: np.ndarray) -> DataFrame:
    """Give every leaf (``key``, ``idx``, ``value``) its ``context`` within the ordered values of its key.

    ``combine`` is an associative product of consecutive values, ``spread`` gives the contexts
    of consecutive values from that of all of them, and ``top`` is the context of a whole key.
    Leaves are combined in groups, these in groups again, until a key is one group, and
    contexts go down the same way, so no task sees more than a group of a key at once.
    """

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, idx, parts = (c.to_pylist() for c in batch.columns)
            yield _rows("value", [(k, i, combine(np.array([p["value"] for p in x]))) for k, i, x in zip(keys, idx, parts)])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, x, given in zip(*(c.to_pylist() for c in batch.columns)):
                own = spread(np.array([p["value"] for p in x]), np.array(given))
                found += [(k, p["idx"], c) for p, c in zip(x, own)]
            yield _rows("context", found)

    groups, level = [], leaves
    while True:
        children = F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("parts")
        grouped = level.groupBy("key", F.expr(f"idx div {GROUP}").alias("idx")).agg(children)
        grouped, seen = stage(grouped, most=F.max("idx"))
        groups.append(grouped)
        if not seen["most"]:
            break
        level = grouped.mapInArrow(product, T.StructType([*KEY, T.StructField("value", VALUE)]))
    schema = T.StructType([*KEY, T.StructField("context", VALUE)])
    given = groups[-1].select("key", "parts", F.lit(top.tolist()).cast(VALUE).alias("context")).mapInArrow(contexts, schema)
    for grouped in groups[-2::-1]:
        given = grouped.join(given, ["key", "idx"]).select("key", "parts", "context").mapInArrow(contexts, schema)
    return given


# --- rows --------------------------------------------------------------------------------


def fault(text: Column) -> Column:
    """Blank or truncated, looking at one row."""
    ended = text.rlike(rf"[.!?][\x20\x09-\x0D]*\z")
    return F.when(~text.rlike(BLANK), EMPTY).when(~ended, TRUNCATED).otherwise(WHOLE)


def initial_code(role: Column) -> Column:
    initial = role.substr(1, 1)
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


@dataclass(frozen=True)
class Repaired:
    """``conversations``: one row each; ``lines``: the repaired turns (``key``, id, ``chunk``, ``step``, ``role``, ``text``, ``edit``)."""

    conversations: DataFrame
    lines: DataFrame


def _batches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of chunks of about ``AT_ONCE`` rows."""
    upto, first = np.concatenate(([0], np.cumsum(sizes))), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + AT_ONCE, "right")) - 1)
        yield first, last
        first = last


def _kinds(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.frombuffer("".join(strings).encode(), np.uint8).astype(np.int64) - 97,
        np.concatenate(([0], np.cumsum([len(x) for x in strings]))).astype(np.int64),
    )


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (key, idx, kinds) to their cost matrices."""
    for batch in batches:
        keys, idx, strings = (c.to_pylist() for c in batch.columns)
        found = []
        for a, b in _batches(np.array([len(x) for x in strings])):
            kinds, starts = _kinds(strings[a:b])
            ends = np.where(np.eye(4, dtype=bool), 0, INF)[None].repeat(b - a, 0)
            cost = costs(kinds, starts, ends)
            found += zip(keys[a:b], idx[a:b], cost[starts[:-1] + np.arange(b - a)].reshape(-1, 16))
        yield _rows("value", found)


def _solve(strings: list[str], ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Ranked]:
    kinds, starts = _kinds(strings)
    cost = costs(kinds, starts, ends)
    return kinds, starts, cost, rank_paths(optimal_arcs(kinds, starts, cost, last))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (key, idx, kinds, whether last, costs at the end) to the states in which paths from each state leave."""
    for batch in batches:
        keys, idx, strings, last, ends = (c.to_pylist() for c in batch.columns)
        found = []
        for a, b in _batches(np.array([len(x) for x in strings])):
            _, starts, _, ranked = _solve(strings[a:b], np.array(ends[a:b]), np.array(last[a:b]))
            begin = (4 * (starts[:-1] + np.arange(b - a))[:, None] + np.arange(4)).ravel()
            path = ranked.jumps[-1][begin]  # ahead by more letters than there are: the end
            found += zip(keys[a:b], idx[a:b], (path % 4).reshape(-1, 4))
        yield _rows("value", found)


LINE = [("step", pa.int32()), ("id", pa.int64()), ("edit", pa.string()), ("role", pa.string())]
SOLVED = (
    "key string, chunk long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "lines array<struct<step: int, id: long, edit: string, role: string>>"
)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (key, idx, kinds, ids, first kind of the next chunk, costs at the end, state at the start) to their edits."""
    letters = np.array(["", *LETTERS])
    for batch in batches:
        keys, idx, strings, ids, ahead, ends, entry = (c.to_pylist() for c in batch.columns)
        out, lines = [[] for _ in range(6)], []
        for a, b in _batches(np.array([len(x) for x in strings])):
            last = np.array([x is None for x in ahead[a:b]])
            kinds, starts, cost, ranked = _solve(strings[a:b], np.array(ends[a:b]), last)
            begin = 4 * (starts[:-1] + np.arange(b - a)) + np.array(entry[a:b])
            path, cut = lay_out(ranked, begin)
            letter = ranked.letter[path]
            place, after = path // 4, ranked.jumps[0][path] % 4
            chunk_of = np.repeat(np.arange(b - a), np.diff(cut))
            row = place - chunk_of  # of the row that the step takes, among all rows of this range
            role = np.where(np.isin(letter, (2, 4)), after, 0)
            of = kinds // 4
            sums = [np.add.reduceat(np.append(of == f, 0), starts[:-1]) for f in (EMPTY, REPEATED, TRUNCATED)]
            who = kinds % 4
            for k in range(b - a):
                turns = who[starts[k] : starts[k + 1]].tolist() + ([] if last[k] else [(ord(ahead[a + k]) - 97) % 4])
                illegal = sum((x, y) not in LEGAL for x, y in zip(turns, turns[1:]))
                span = slice(cut[k], cut[k + 1])
                total = int(cost[starts[k] + k, entry[a + k]]) if idx[a + k] == 0 else None
                for column, value in zip(out, (*[int(x[k]) for x in sums], illegal, total, "".join(letters[letter[span]]))):
                    column.append(value)
                own = ids[a + k]
                lines.append(
                    [
                        {"step": s, "id": None if x == 2 else own[r - starts[k]], "edit": LETTERS[x - 1], "role": ROLES[q] or None}
                        for s, (x, r, q) in enumerate(zip(letter[span].tolist(), row[span].tolist(), role[span].tolist()))
                        if x != 1
                    ]
                )
        columns = [pa.array(keys, pa.string()), pa.array(idx, pa.int64())]
        columns += [pa.array(x, pa.string() if k == 5 else pa.int64()) for k, x in enumerate(out)]
        columns.append(pa.array(lines, pa.list_(pa.struct(LINE))))
        names = "key chunk blank duplicate truncated illegal cost audit lines".split()
        yield pa.RecordBatch.from_arrays(columns, names=names)


#: Neighbouring initials that are legal: system and user, user and assistant, assistant and user.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """The cheapest repair of every conversation; of several, the one whose audit comes first in ASCII order.

    Rows of a conversation are taken by turn (nulls first), those of one turn by role and then by
    a digest of the text, so repeated rows lie side by side. A row is blank, or a duplicate of an
    earlier role and text, or truncated (its last sign ends no sentence); the first of
    these counts. Keeping costs 0, another role (user or assistant) 3, deleting 4, an inserted empty turn
    3, and truncated rows that stay 3 more; blank and duplicate rows must go. A row whose role is not
    system, user or assistant by its first letter cannot be kept as it is, nor one with an empty role.
    Null roles and texts are read as one space, and a null conversation id is a conversation of
    its own. No rows give no conversations. Other columns are left out, whatever their names are.

    ``conversations`` has ``key`` (the id as text, never null), the id, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal`` (neighbours other than system-user, user-assistant and
    assistant-user), ``cost`` and ``audit``, a letter per edit: Delete, Insert, Keep, Rerole.
    """
    some = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    rows = rows.select(
        F.monotonically_increasing_id().alias("id"),
        F.coalesce(F.concat(F.lit("="), named(conv).cast("string")), F.lit("")).alias("key"),
        named(conv).alias("conv"),
        named(turn).alias("turn"),
        some(role).alias("role"),
        some(text).alias("text"),
    )
    rows, _ = stage(rows)
    facts = rows.select(
        "id", "key", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), fault(F.col("text")).alias("fault")
    )
    facts, _ = stage(number_within(facts, "key", ["turn", "role", "digest", "id"], "pos"))
    firsts = facts.groupBy("key", "role", "digest").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    own = F.when(F.col("first").isNull() & (F.col("fault") != EMPTY), REPEATED).otherwise(F.col("fault"))
    kind = F.char(97 + initial_code(F.col("role")) + 4 * own)
    chunk = F.expr(f"(pos - 1) div {CHUNK}")
    numbered = facts.join(firsts, ["key", "pos"], "left").select("key", "pos", "id", kind.alias("kind"), chunk.alias("chunk"))
    # the first row of a chunk is also seen by the chunk before, as its neighbour
    seen_by = F.when((F.col("pos") > 1) & ((F.col("pos") - 1) % CHUNK == 0), F.array(F.col("chunk") - 1, F.col("chunk")))
    numbered = numbered.withColumn("idx", F.explode(F.coalesce(seen_by, F.array("chunk"))))
    mine = F.col("idx") == F.col("chunk")
    chunks = numbered.groupBy("key", "idx").agg(
        F.sort_array(F.collect_list(F.when(mine, F.struct("pos", "kind", "id")))).alias("rows"),
        F.max(F.when(~mine, F.col("kind"))).alias("ahead"),
    )
    chunks = chunks.select("key", "idx", F.array_join("rows.kind", "").alias("kinds"), F.col("rows.id").alias("ids"), "ahead")
    of_many = (F.col("idx") > 0) | F.col("ahead").isNotNull()
    chunks, seen = stage(chunks, many=F.count_if(of_many))
    ready = chunks.where(~of_many).withColumns({"ends": F.lit(CLOSING.tolist()).cast(VALUE), "entry": F.lit(0).cast("long")})
    if seen["many"]:
        ready = ready.unionByName(_contexts(chunks.where(of_many)))
    solved, _ = stage(ready.select("key", "idx", "kinds", "ids", "ahead", "ends", "entry").mapInArrow(_edits, SOLVED))
    pieces = F.sort_array(F.collect_list(F.struct("chunk", "audit")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    found = solved.groupBy("key").agg(*sums, F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("key").agg(F.min("conv").alias(conv), F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"))
    lines = solved.select("key", "chunk", F.inline("lines"))
    taken = lines.where("id is not null").join(rows.select("id", F.col("role").alias("was"), "text"), "id")
    taken = taken.select("key", "chunk", "step", F.coalesce("role", "was").alias("role"), "text", "edit")
    added = lines.where("id is null").select("key", "chunk", "step", "role", F.lit("").alias("text"), "edit")
    return Repaired(gaps.join(found, "key"), taken.union(added))


def _contexts(chunks: DataFrame) -> DataFrame:
    """Chunks of long conversations with the costs at their ends and the states that paths enter them in."""
    value = T.StructType([*KEY, T.StructField("value", VALUE)])
    matrices, _ = stage(chunks.select("key", "idx", "kinds").mapInArrow(_matrices, value))
    ends = sweep(matrices, _all_costs, _cost_at_ends, CLOSING).withColumnRenamed("context", "ends")
    chunks, _ = stage(chunks.join(ends, ["key", "idx"]))
    last = F.col("ahead").isNull()
    exits, _ = stage(chunks.select("key", "idx", "kinds", last, "ends").mapInArrow(_exits, value))
    entries = sweep(exits, _all_exits, _entries, np.array([START]))
    return chunks.join(entries.select("key", "idx", F.col("context")[0].alias("entry")), ["key", "idx"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines (key, line) to a digest of each key's lines, joined by line ends."""
    now, digest = None, None

    def row(found: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["key", "sha256"])

    for batch in batches:
        done = []
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield row(done)
    if now is not None:
        yield row([(now, digest.hexdigest())])


def line_digests(lines: DataFrame) -> DataFrame:
    """``key`` and the ``sha256`` of its ``role:text`` lines in order, for keys that have lines.

    A digest has to read a conversation from its beginning to its end, so its lines pass one
    task, one after the other and sorted on disk where they are many; none are held.
    """
    line = F.concat_ws(":", "role", "text").alias("line")
    ordered = lines.repartition("key").sortWithinPartitions("key", "chunk", "step")
    return ordered.select("key", line).mapInArrow(_hashed, "key string, sha256 string")
