"""Byte-level BPE encoding and decoding with a lexicon automaton for frequent words.

A tokenizer's words (its pre-tokenizer's pieces) are counted over the corpus; the frequent
ones are merged once and compiled into a minimal acyclic transducer: words share beginnings
and endings, and the outputs along a word's arcs add up to its number, which points to its
ids. Tasks memory-map the automaton and look new words up in it; words it does not hold are
merged by the tokenizer's rules, so ids are exact for every text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.common import mapped, named, slices, utf8, worker_memory

#: Words of the lexicon at most; a bound of what is collected and broadcast.
LEXICON = 1 << 18
#: Words beside those of the lexicon that a worker remembers.
MEMORY = 150_000
#: Bytes of a word at most that is merged together with others of its length.
SIDE_BY_SIDE = 32
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


# --- words -------------------------------------------------------------------------------


#: Letters and numbers of Unicode 16, which the tokenizer's library follows and
#: Python's own table may lack.
LATE_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATE_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)


@lru_cache
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    # White space as Unicode's property of that name has it. Fixed values.
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    out[0x2000:0x200B] = SPACE
    for kind, ranges in ((LETTER, LATE_LETTERS), (NUMBER, LATE_NUMBERS)):
        for first, last in ranges:
            out[first : last + 1] = kind
    return out


#: Endings that split from the word before them. Fixed values.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


def words(text: str) -> list[str]:
    """The pieces of a text that are merged one by one.

    Runs of letters, of numbers and of other signs, each with one blank before it; an
    apostrophe that begins a piece takes one of the short endings with it; the rest of a
    run of white space is a piece, less its last character if something follows.
    """
    n = len(text)
    if not n:
        return []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[code]
    starts = np.ones(n + 1, bool)
    starts[1:n] = kind[1:] != kind[:-1]
    run = np.flatnonzero(starts[:-1])
    blank = np.zeros(n, bool)  # a blank that goes with what follows it
    after_space = run[(run > 0) & (kind[run] != SPACE) & (kind[run - 1] == SPACE)]
    starts[after_space - 1] = True
    joined = after_space[code[after_space - 1] == 32]
    starts[joined] = False
    blank[joined - 1] = True
    signs = run[(code[run] == 39) & (run < n - 1)]
    for i in signs[(kind[signs + 1] == LETTER) & ((signs == 0) | ~blank[signs - 1])].tolist():
        if text[i + 1] in SHORT_ENDINGS:
            end = i + 2
        elif text[i + 1 : i + 3] in LONG_ENDINGS:
            end = i + 3
        else:
            continue
        starts[i + 1] = False
        starts[end] = True
    edge = np.flatnonzero(starts).tolist()
    return [text[a:b] for a, b in zip(edge, edge[1:])]


# --- merging -----------------------------------------------------------------------------


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others follow from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Vocabulary, merge rules and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = _byte_signs()
        vocab = spec["model"]["vocab"]
        self.piece = {i: bytes(signs[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece |= {i: content.encode() for content, i in self.special.items()}
        self.of_byte = [0] * 256
        for i, piece in self.piece.items():
            if len(piece) == 1:
                self.of_byte[piece[0]] = i
        # Rank of a pair, two ids as one number, and the id that it becomes.
        self.rank, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.by_name = {str(i): piece for i, piece in self.piece.items()}
        # The same as arrays, for many words at once: pairs in ascending order, and no pair beyond the last.
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(pairs)
        self._pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self._ranks = np.append(np.fromiter(self.rank.values(), np.int32, len(pairs))[order], np.int32(len(self.made)))
        self._made, self._of_byte = np.array(self.made, np.int64), np.array(self.of_byte, np.int64)
        two = self._of_byte[:, None] << 32 | self._of_byte[None, :]
        self._of_two = self._rank_of(two)

    def _rank_of(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of rules for those that no rule merges."""
        at = np.searchsorted(self._pairs, pairs)
        return np.where(self._pairs[at] == pairs, self._ranks[at], np.int32(len(self.made)))

    def merge(self, word: str) -> list[int]:
        """Ids of a word: the pair of lowest rank is merged, the leftmost first, until none is left."""
        ids = [self.of_byte[b] for b in word.encode("utf-8", "surrogatepass")]
        if len(ids) > 256:
            return self._merge_long(ids)
        rank, none = self.rank.get, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [self.made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | ids[at], none)
            if at < len(ranks):
                ranks[at] = rank(ids[at] << 32 | ids[at + 1], none)
        return ids

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """``merge`` of every word; words of equally many bytes are merged side by side.

        Each round merges one pair of every word that is not finished, so all of them stay equally long.
        """
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        out: list = [None] * len(coded)
        for length in np.unique(size).tolist():
            own = np.flatnonzero(size == length)
            if not 2 <= length <= SIDE_BY_SIDE:
                for k in own.tolist():
                    out[k] = self.merge(words[k])
                continue
            for lo in range(0, len(own), 4096):
                self._merge_equal(own[lo : lo + 4096], coded, length, out)
        return out

    def _merge_equal(self, which: np.ndarray, coded: list[bytes], length: int, out: list) -> None:
        signs = np.frombuffer(b"".join([coded[k] for k in which.tolist()]), np.uint8).reshape(-1, length)
        ids, ranks, none = self._of_byte[signs], self._of_two[signs[:, :-1], signs[:, 1:]], len(self.made)
        while len(which):
            row = np.arange(len(which))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(which), np.int64)
            best = ranks[row, at] if ranks.shape[1] else np.full(len(which), none)
            ended = best == none
            if ended.any():
                for k, found in zip(which[ended].tolist(), ids[ended].tolist()):
                    out[k] = found
                live = ~ended
                which, ids, ranks, at, best = which[live], ids[live], ranks[live], at[live], best[live]
                row = np.arange(len(which))
            if not len(which):
                break
            ids[row, at] = self._made[best]
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(which), -1)
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(which), -1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < ranks.shape[1])
            for some, first in ((before, at[before] - 1), (after, at[after])):
                ranks[some, first] = self._rank_of(ids[some, first] << 32 | ids[some, first + 1])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words whose pairs are too many to scan each time."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and right[k] >= 0:
                pair = ids[k] << 32 | ids[right[k]]
                if pair in self.rank:
                    heapq.heappush(heap, (self.rank[pair], k, pair))

        for k in range(n):
            offer(k)
        gone = [False] * n
        while heap:
            best, k, pair = heapq.heappop(heap)
            r = right[k]
            if gone[k] or r < 0 or ids[k] << 32 | ids[r] != pair:
                continue
            ids[k], gone[r], right[k] = self.made[best], True, right[r]
            if right[r] >= 0:
                left[right[r]] = k
            offer(left[k])
            offer(k)
        return [x for x, out in zip(ids, gone) if not out]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


# --- the lexicon -------------------------------------------------------------------------


#: An arc as bytes: its label and its target.
ARC = np.dtype([("label", "u1"), ("target", "<i4")])


def lexicon_table(entries: Iterable[tuple[bytes, list[int]]]) -> pa.Table:
    """Words and their ids as the table that ``compile_lexicon`` takes."""
    entries = list(entries)
    words, ids = pa.array([w for w, _ in entries], pa.binary()), pa.array([i for _, i in entries], pa.list_(pa.int32()))
    return pa.table({"word": words, "ids": ids})


def compile_lexicon(entries: pa.Table | Iterable[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic transducer of distinct non-empty words, as one block of bytes.

    Words come in byte order; a branch that no later word can reach is replaced by an equal
    one if there is one. An arc's output is the number of words before it in its state, so
    the outputs along a word add up to its number in order. States are held as bytes and
    numbers as flat arrays, since the driver compiles beside what else it holds.
    """
    table = (entries if isinstance(entries, pa.Table) else lexicon_table(entries)).sort_by("word").combine_chunks()
    arcs, first, final, below = bytearray(), array("q", [0]), bytearray(), array("q")  # by state; targets come first
    skip = array("i")
    known: dict[bytes, int] = {}
    path: list[bytearray] = [bytearray(1)]  # open states of the word before, root first: final, then arcs
    before = b""

    def add(state: bytes) -> int:
        own = np.frombuffer(state, ARC, offset=1)
        arcs.extend(memoryview(state)[1:])
        final.append(state[0])
        seen = state[0]
        for to in own["target"].tolist():
            skip.append(seen)
            seen += below[to]
        below.append(seen)
        first.append(len(skip))
        return len(final) - 1

    def close(down_to: int) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            state = bytes(path.pop())
            number = known.get(state)
            if number is None:
                number = known[state] = add(state)
            path[-1].append(before[depth - 1])
            path[-1].extend(number.to_bytes(4, "little"))

    for word in table["word"].to_pylist():
        shared = len(os.path.commonprefix([before, word]))
        close(shared)
        path += [bytearray(1) for _ in word[shared:]]
        path[-1][0] = 1
        before = word
    close(0)
    add(bytes(path[0]))
    known.clear()
    own = np.frombuffer(arcs, ARC)
    state = np.repeat(np.arange(len(final)), np.diff(np.frombuffer(first, np.int64)))
    sizes = pc.list_value_length(table["ids"]).to_numpy()
    arrays = [
        state.astype(np.int64) * 256 + own["label"], own["target"].astype(np.int32), np.frombuffer(skip, np.int32),
        np.frombuffer(final, np.uint8), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32),
        pc.list_flatten(table["ids"]).to_numpy().astype(np.int32),
    ]
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)


class Lexicon:
    """A memory-mapped transducer; looks many words up at once."""

    def __init__(self, block: bytes):
        # The mapping keeps the file; its name goes at once.
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at = np.frombuffer(self.map, np.int64, 6), 48
        arrays = []
        for n, kind in zip(sizes.tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)):
            arrays.append(np.frombuffer(self.map, kind, n, at))
            at += -(-arrays[-1].nbytes // 8) * 8
        self.arc, self.target, self.skip, self.final, self.ends, self.ids = arrays

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Number of every word, -1 for those it does not hold."""
        if not keys or not len(self.arc):
            return np.full(len(keys), -1)
        size = np.array([len(k) for k in keys])
        text = np.frombuffer(b"".join(keys), np.uint8)
        start = np.cumsum(size) - size
        state, number = np.full(len(keys), len(self.final) - 1), np.zeros(len(keys), np.int64)
        live, depth = np.flatnonzero(size > 0), 0
        found = np.full(len(keys), -1)
        while len(live):
            want = state[live] * 256 + text[start[live] + depth]
            at = np.minimum(np.searchsorted(self.arc, want), len(self.arc) - 1)
            hit = self.arc[at] == want
            live, at = live[hit], at[hit]
            number[live] += self.skip[at]
            state[live] = self.target[at]
            depth += 1
            ended = size[live] == depth
            done = live[ended]
            done = done[self.final[state[done]] == 1]
            found[done] = number[done]
            live = live[~ended]
        return found

    def output(self, number: int) -> list[int]:
        return self.ids[self.ends[number] : self.ends[number + 1]].tolist()


class _Handle:
    """A broadcast block, equal to others by its digest so that a worker maps it once."""

    def __init__(self, digest: str, block):
        self.digest, self.block = digest, block

    def open(self) -> Lexicon:
        return _open_once(self.digest, self.block)


_OPEN: dict[str, Lexicon] = {}


def _open_once(digest: str, block) -> Lexicon:
    if digest not in _OPEN:
        _OPEN.clear()
        _OPEN[digest] = Lexicon(block.value)
    return _OPEN[digest]


# --- Spark jobs --------------------------------------------------------------------------


def _pieces(text: str, special: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    """Plain stretches of a text, each with the special token after it."""
    done, ahead = 0, {s: at for s in special if (at := text.find(s)) >= 0}
    while ahead:
        at, _, name = min((at, -len(s), s) for s, at in ahead.items())
        yield text[done:at], special[name]
        done = at + len(name)
        for s in [s for s, at in ahead.items() if at < done]:
            ahead[s] = text.find(s, done)
        ahead = {s: at for s, at in ahead.items() if at >= 0}
    yield text[done:], None


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = merges(path).special
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for plain, _ in _pieces(text or "", special):
                    seen.update(words(plain))
                if len(seen) > 1 << 18:
                    yield flush()
        yield flush()

    return run


def _merge_all(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge_many = merges(path).merge_many
        for batch in batches:
            ids = merge_many(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def frequent_words(texts: DataFrame, path: str, most: int = LEXICON) -> pa.Table:
    """The words (as bytes) of the highest counts over the whole column, at most ``most``, with their ids.

    All words from a count on are taken, so no order among equal counts matters.
    """
    counts = texts.mapInArrow(_count(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    from lexitally.session import stage

    counts, _ = stage(counts)
    # Words per power of a fine base: a list of fixed length, whatever the corpus is.
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    levels = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)
    least, total = None, 0
    for level in levels:
        total += level.words
        if total > most:
            break
        least = level.step
    if least is None:
        return lexicon_table([])
    top = counts.where(step >= least).select("word").mapInArrow(_merge_all(path), "word string, ids array<int>")
    return top.select(F.col("word").cast("binary").alias("word"), "ids").toArrow()


def _encode(path: str, handle: _Handle, decode: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, lexicon = merges(path), handle.open()
        # words met so far, with their ids written with commas and what these decode to; kept for the worker's next task
        kept = worker_memory(f"bpe {path} {handle.digest} {decode}")
        memory, decoded, rare = kept.setdefault("words", {}), kept.setdefault("decoded", {}), kept.setdefault("rare", [])

        def learn(new: list[str]) -> None:
            numbers = lexicon.find([w.encode("utf-8") for w in new]).tolist()
            others = [w for w, number in zip(new, numbers) if number < 0]
            rare.extend(others)
            merged = iter(rules.merge_many(others))
            for word, number in zip(new, numbers):
                ids = lexicon.output(number) if number >= 0 else next(merged)
                names = list(map(str, ids))
                memory[word] = ",".join(names)
                if decode:
                    decoded[word] = b"".join(map(rules.piece.__getitem__, ids))

        for batch in batches:
            _, offsets = utf8(batch.column(0))
            # results leave slice by slice, so no batch's texts, ids and pieces are held together
            for lo, hi in slices(offsets):
                held = batch.slice(lo, hi - lo)
                texts = [[(words(p), s) for p, s in _pieces(t or "", rules.special)] for t in held.column(0).to_pylist()]
                new = set().union(*[ws for text in texts for ws, _ in text])
                if len(rare) > MEMORY:
                    for word in rare:
                        del memory[word]
                        decoded.pop(word, None)
                    rare.clear()
                learn(list(new.difference(memory)))
                lines, pieces = [], []
                for text in texts:
                    parts: list[str] = []
                    raw: list[bytes] = []
                    for ws, special in text:
                        parts += map(memory.__getitem__, ws)
                        if decode:
                            raw += map(decoded.__getitem__, ws)
                        if special is not None:
                            parts.append(str(special))
                            if decode:
                                raw.append(rules.by_name[str(special)])
                    lines.append(",".join(parts))
                    if decode:
                        pieces.append(b"".join(raw).decode("utf-8", "replace"))
                cols = [*held.columns[1:], pa.array(lines, pa.string())]
                if decode:
                    cols.append(pa.array(pieces, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[1:], *["new_0", "new_1"][: 1 + decode]])

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", decode: bool = False, most: int = LEXICON) -> DataFrame:
    """All other columns, with ``ids`` (decimal numbers joined by commas) and, if asked, ``decoded``.

    Ids equal those of the tokenizer file's own library without added special tokens,
    truncation or padding; a special token's string in a text is that token. A null or
    empty text has no ids. Columns of the input called ``ids`` or ``decoded`` are replaced.
    """
    spark = docs.sparkSession
    text = docs.select(named(text_col).cast("string").alias("text"))
    block = compile_lexicon(frequent_words(text, path, most))
    handle = _Handle(hashlib.sha256(block).hexdigest(), spark.sparkContext.broadcast(block))
    new = [T.StructField(c, T.StringType()) for c in ["ids", *["decoded"] * decode]]
    kept = [c for c in docs.columns if c not in (text_col, *[f.name for f in new])]
    return mapped(docs, [named(text_col).cast("string")], kept, _encode(path, handle, decode), new)


def decode_ids(ids: Iterable[int], path: str) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become the replacement sign."""
    piece = merges(path).piece
    return b"".join(piece[i] for i in ids if i in piece).decode("utf-8", "replace")


def digests() -> list:
    """Columns ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of an encoded and decoded table."""
    n = F.when(F.col("ids") == "", F.lit(0)).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(","), F.lit(""))) + 1)
    return [
        n.cast("long").alias("n_tokens"),
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]
