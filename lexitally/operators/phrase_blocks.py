"""Rankings and feature counts of phrases over blocks of documents (TXT-1 to TXT-11, AGG-9, AGG-10).

Words of a corpus are numbered once, in their order. A block holds some documents as numbers: their
tokens, where each ends, which share an id, and their labels. A phrase is the numbers of its words
side by side in as few 64-bit keys as they need, so phrases are told apart exactly, and keys are in
the order of the phrases. Blocks count their own phrases and send each once, with its documents, to
the range its hash names; ranges add up and send every block the documents of its phrases. With
these a block knows its idf and norms and sends each phrase once per label, with its sum of
weights. So what travels are a block's distinct phrases, as numbers, and a task holds one block
or one range, both of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StringType, StructField, StructType

from lexitally.functions.text import clean_text, is_blank, remove_stopwords, word_tokens
from lexitally.operators.ranking import number_within, rank_within
from lexitally.session import stage, stage_buckets

#: Bytes of text in a block, about, and phrases a range is sent, about.
BLOCK_BYTES = 8 << 20
RANGE_ENTRIES = 1 << 21
MOST_RANGES = 20_000
#: Bits of a key that hold numbers of words.
KEY_BITS = 62


def _cut(raw: bool, stopwords: Sequence[str], names: Sequence[str], block_bytes: int) -> Callable:
    """Texts (words with a space between, sorted by id) to blocks; a block ends where an id does."""
    stop = pa.array(["", *stopwords], pa.string())

    def pack(number: int, texts: list[pa.Array], labels: list[pa.Array], groups: list[int]) -> pa.RecordBatch:
        listed = pc.split_pattern(pa.concat_arrays(texts), " ")
        found = pc.dictionary_encode(listed.flatten())
        kept = ~pc.is_in(found.dictionary, value_set=stop).to_numpy(zero_copy_only=False)
        codes = found.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False))
        inside = kept[codes]
        ends = np.concatenate(([0], np.cumsum(inside)))[ends]
        codes = (np.cumsum(kept) - 1)[codes[inside]]
        label, words = pa.concat_arrays(labels), found.dictionary.filter(pa.array(kept))
        columns = {
            "block": pa.array([number], pa.int64()),
            "tokens": pa.array([codes.astype(np.int32).tobytes()], pa.binary()),
            "ends": pa.array([ends.astype(np.int64).tobytes()], pa.binary()),
            "groups": pa.array([np.array(groups, np.int32).tobytes()], pa.binary()),
            "labels": pa.ListArray.from_arrays(pa.array([0, len(label)], pa.int32()), label),
            "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
        }
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = TaskContext.get().partitionId() << 32, 0
        texts, labels, groups, size, group, last = [], [], [], 0, 0, None
        for batch in batches:
            if raw:
                batch = batch.filter(pc.fill_null(pc.not_equal(batch.column(2), ""), False))
            if not batch.num_rows:
                continue
            text = pc.fill_null(batch.column(2), "")
            sizes, start = pc.binary_length(text).to_pylist(), 0
            for r, own in enumerate(batch.column(0).to_pylist()):
                if last is None or not (own == last[0] or (own != own and last[0] != last[0])):
                    if size >= block_bytes:
                        texts.append(text.slice(start, r - start))
                        labels.append(batch.column(1).slice(start, r - start))
                        yield pack(at + made, texts, labels, groups)
                        texts, labels, groups, size, group, start, made = [], [], [], 0, -1, r, made + 1
                    group += last is not None
                    last = (own,)
                groups.append(group)
                size += sizes[r] + 1
            texts.append(text.slice(start))
            labels.append(batch.column(1).slice(start))
        if groups:
            yield pack(at + made, texts, labels, groups)

    return run


@dataclass(frozen=True)
class Keys:
    """How the numbers of a phrase's words lie in its keys, the first word highest; 0 where it has no more words."""

    bits: int
    longest: int
    each: int  # words in a key

    @property
    def columns(self) -> int:
        return -(-self.longest // self.each)

    def place(self, word: int) -> tuple[int, int]:
        """The key of a word by its position in the phrase, and how far it is shifted there."""
        return word // self.each, self.bits * (self.each - 1 - word % self.each)

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(keys.shape[1], np.int64)
        for word in range(self.longest):
            column, shift = self.place(word)
            found += (keys[column] >> shift) & ((1 << self.bits) - 1) > 0
        return found

    def places(self, row, shortest: int) -> tuple[np.ndarray, np.ndarray]:
        """The phrase at every place of a block and its document; only places marked ``alive``, if the block has marks."""
        numbers = np.asarray(row["numbers"], np.int64)
        words = numbers[np.frombuffer(row["tokens"], np.int32)]
        ends = np.frombuffer(row["ends"], np.int64)
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        room, keys, docs = ends[doc] - np.arange(len(words)), [], []
        for length in range(shortest, self.longest + 1):
            at = np.flatnonzero(room >= length)
            key = np.zeros((self.columns, len(at)), np.int64)
            for word in range(length):
                column, shift = self.place(word)
                key[column] |= words[at + word] << shift
            keys.append(key)
            docs.append(doc[at])
        keys, docs = np.concatenate(keys, 1), np.concatenate(docs)
        if row.get("alive") is None:
            return keys, docs
        alive = np.unpackbits(np.frombuffer(row["alive"], np.uint8), count=len(docs)).view(bool)
        return keys[:, alive], docs[alive]

    def phrases(self, row, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct phrases of a block, and of every document and its phrase: document, phrase, count."""
        keys, docs = self.places(row, shortest)
        phrases, of = distinct(keys)
        pairs, count = np.unique(docs * max(1, phrases.shape[1]) + of, return_counts=True)
        return phrases, *np.divmod(pairs, max(1, phrases.shape[1])), count

    def mixed(self, phrases: np.ndarray) -> np.ndarray:
        mixed = np.zeros(phrases.shape[1], np.uint64)
        for key in phrases:
            mixed = (mixed ^ key.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return mixed

    def ranges(self, phrases: np.ndarray, n: int) -> np.ndarray:
        return (self.mixed(phrases) >> np.uint64(20)) % np.uint64(n)

    def codes(self, row, shortest: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes of a block, a phrase's range above 32 bits of its hash; the code at every place; its document."""
        keys, docs = self.places(row, shortest)
        mixed = self.mixed(keys)
        low = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
        found, of = np.unique((mixed >> np.uint64(20)) % np.uint64(n) << np.uint64(32) | low, return_inverse=True)
        return found, of, docs


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``keys`` in ascending order, and which of them each column is."""
    _, first, of = np.unique(keys[0], return_index=True, return_inverse=True)
    for more in keys[1:]:
        values, then = np.unique(more, return_inverse=True)
        _, first, of = np.unique(of * max(1, len(values)) + then, return_index=True, return_inverse=True)
    return keys[:, first], of


def _per_range(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order that brings ranges together, and where each lies in it."""
    order = np.argsort(part, kind="stable")
    held = part[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(held, prepend=-1)).tolist() + [len(held)]
    return order, [(int(held[lo]), slice(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs, which the first byte says."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def _planes(keys: np.ndarray) -> bytes:
    """Rows of keys by the place of a byte: bytes that neighbours share, or that no key needs, lie together and compress."""
    return np.ascontiguousarray(keys, np.int64).view(np.uint8).reshape(len(keys), -1, 8).transpose(0, 2, 1).tobytes()


def _keys_of(data: bytes, columns: int) -> np.ndarray:
    """The rows of keys that ``_planes`` made."""
    planes = np.frombuffer(data, np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64)[:, :, 0]


SENT = "part long, block long, keys binary, docs binary"
BACK = "block long, part long, docs binary"
SUMS = "part long, block long, keys binary, sums binary"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in map(str.split, ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            cells = {n: batch.column(n)[r] for n in batch.schema.names}
            yield {n: c.values.to_numpy(zero_copy_only=False) if isinstance(c, pa.ListScalar) else c.as_py() for n, c in cells.items()}


def _ask(keys: Keys, shortest: int, n_ranges: int) -> Callable:
    """The code of every phrase of a block, once, with how many of its documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            codes, of, doc = keys.codes(row, shortest, n_ranges)
            docs = np.bincount(of, minlength=len(codes))
            several = docs[of] > 1
            pairs = np.sort(of[several] * max(1, row["n_docs"]) + doc[several])
            pairs = pairs[np.diff(pairs, prepend=-1) > 0]
            docs = np.where(docs > 1, np.bincount(pairs // max(1, row["n_docs"]), minlength=len(codes)), docs)
            _, cuts = _per_range(codes >> np.uint64(32))
            low = codes.astype(np.uint32)
            sent = [{"part": p, "block": row["block"], "keys": low[at].tobytes(), "docs": _packed(docs[at])} for p, at in cuts]
            if sent:
                yield pa.RecordBatch.from_pylist(sent, _arrow(SENT))

    return run


def _answer(min_df: int) -> Callable:
    """Every block gets a bit per code it sent: whether enough documents have it. Codes that meet only add to the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _ranges(batches):
            codes = [np.frombuffer(row["keys"], np.uint32) for row in held]
            found, of = np.unique(np.concatenate(codes), return_inverse=True)
            enough = np.bincount(of, np.concatenate([_unpacked(row["docs"]) for row in held]), len(found)) >= min_df
            back = np.split(enough[of], np.cumsum([len(c) for c in codes])[:-1].tolist())
            rows = [{"block": row["block"], "part": part, "docs": np.packbits(x).tobytes()} for row, x in zip(held, back)]
            yield pa.RecordBatch.from_pylist(rows, _arrow(BACK))

    return run


def _mark(keys: Keys, shortest: int, n_ranges: int) -> Callable:
    """A bit for every place of a block: whether its phrase can be in enough documents."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        codes, of, _ = keys.codes(row, shortest, n_ranges)
        _, cuts = _per_range(codes >> np.uint64(32))
        bits = dict(zip(right["part"], right["docs"]))
        enough = [np.unpackbits(np.frombuffer(bits[p], np.uint8), count=at.stop - at.start) for p, at in cuts]
        alive = np.concatenate([np.zeros(0, np.uint8), *enough])[of]
        return pd.DataFrame([(row["block"], np.packbits(alive).tobytes())], columns=["block", "alive"])

    return run


def _send(keys: Keys, shortest: int, n_ranges: int) -> Callable:
    """Every phrase of a block, once, with how many of its documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            phrases, _, of, _ = keys.phrases(row, shortest)
            order, cuts = _per_range(keys.ranges(phrases, n_ranges))
            docs = np.bincount(of, minlength=phrases.shape[1]).astype(np.int64)[order]
            phrases = phrases[:, order]
            sent = [{"part": p, "block": row["block"], "keys": _planes(phrases[:, at]), "docs": _packed(docs[at])} for p, at in cuts]
            if sent:
                yield pa.RecordBatch.from_pylist(sent, _arrow(SENT))

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of every range, sorted by it."""
    part, held = None, []
    for row in _rows(batches):
        if row["part"] != part and held:
            yield part, held
            held = []
        part = row["part"]
        held.append(row)
    if held:
        yield part, held


def _joined_keys(held: list[dict], columns: int) -> tuple[np.ndarray, list[int]]:
    keys = [_keys_of(row["keys"], columns) for row in held]
    return np.concatenate(keys, 1), np.cumsum([k.shape[1] for k in keys])[:-1].tolist()


def _documents(held: list[dict], columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Phrases of a range with their documents, which phrase each sent entry is, and where senders begin."""
    keys, cuts = _joined_keys(held, columns)
    phrases, of = distinct(keys)
    docs = np.concatenate([_unpacked(row["docs"]) for row in held])
    return phrases, np.bincount(of, docs, phrases.shape[1]).astype(np.int64), of, cuts


def _return(keys: Keys) -> Callable:
    """Every block gets the documents of its phrases, in the order it sent them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _ranges(batches):
            _, docs, of, cuts = _documents(held, keys.columns)
            back = np.split(docs[of], cuts)
            rows = [{"block": row["block"], "part": part, "docs": _packed(d)} for row, d in zip(held, back)]
            yield pa.RecordBatch.from_pylist(rows, _arrow(BACK))

    return run


def _count(keys: Keys, slices: Sequence[tuple[int, int, int]]) -> Callable:
    """How many phrases of a range every slice (from, to, least documents) has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _ranges(batches):
            phrases, docs, _, _ = _documents(held, keys.columns)
            length = keys.lengths(phrases)
            found = [int(np.sum((length >= lo) & (length <= hi) & (docs >= least))) for lo, hi, least in slices]
            rows = [{"slice": k, "n": n} for k, n in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, _arrow("slice long, n long"))

    return run


def _can_lead(scores: np.ndarray, label: np.ndarray, top_n: int) -> np.ndarray:
    """Scores that can be among the ``top_n`` of their label, those equal to 11 places included."""
    kept = scores > 0
    for one in np.unique(label):
        own = np.flatnonzero(label == one)
        if len(own) > top_n:
            least = np.partition(scores[own], len(own) - top_n)[len(own) - top_n]
            kept[own] &= scores[own] >= least - 1e-11
    return kept


def _weigh(keys: Keys, shortest: int, n_ranges: int, n_docs: int, min_df: int, sublinear: bool, sizes: Sequence[int], top_n: int) -> Callable:
    """The sum of a phrase's weights in a block, per label, once its documents are known.

    A phrase whose documents are all in the block has its whole sum there: only those that lead in the block travel.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        phrases, doc, of, count = keys.phrases(row, shortest)
        order, _ = _per_range(keys.ranges(phrases, n_ranges))
        docs = np.zeros(phrases.shape[1], np.int64)
        docs[order] = np.concatenate([np.zeros(0, np.int64), *map(_unpacked, right.sort_values("part")["docs"])])
        idf = np.where(docs >= min_df, np.log((1.0 + n_docs) / (1.0 + docs)) + 1.0, 0.0)
        weight = (1.0 + np.log(count) if sublinear else count.astype(np.float64)) * idf[of]
        group = np.frombuffer(row["groups"], np.int32)[doc]
        norm = np.sqrt(np.bincount(group, weight * weight))[group] if len(group) else weight
        label = np.asarray(row["labels"], np.int64)[doc]
        held = (label >= 0) & (weight > 0)
        cells, at = np.unique(label[held] * max(1, phrases.shape[1]) + of[held], return_inverse=True)
        sums = np.bincount(at, weight[held] / norm[held], len(cells))
        whole = docs == np.bincount(of, minlength=len(docs))
        label, of = np.divmod(cells, max(1, phrases.shape[1]))
        whole = np.flatnonzero(whole[of])
        leads = np.ones(len(cells), bool)
        leads[whole] = _can_lead(sums[whole] / np.asarray(sizes, np.float64)[label[whole]], label[whole], top_n)
        label, of, sums = label[leads], of[leads], sums[leads]
        sent = np.concatenate([label[None], phrases[:, of]])
        order, cuts = _per_range(keys.ranges(phrases[:, of], n_ranges))
        sent, sums = sent[:, order], sums[order]
        out = [(p, row["block"], _planes(sent[:, x]), sums[x].tobytes()) for p, x in cuts]
        return pd.DataFrame(out, columns=["part", "block", "keys", "sums"])

    return run


def _best(keys: Keys, sizes: Sequence[int], top_n: int) -> Callable:
    """The mean weights of a range that can be among the ``top_n`` of their label, those equal to 11 places included."""
    names = ["_label", *[f"_k{k}" for k in range(keys.columns)], "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _ranges(batches):
            sent, _ = _joined_keys(held, keys.columns + 1)
            cells, of = distinct(sent)
            sums = np.bincount(of, np.concatenate([np.frombuffer(row["sums"]) for row in held]), cells.shape[1])
            scores = sums / np.asarray(sizes, np.float64)[cells[0]]
            kept = _can_lead(scores, cells[0], top_n)
            yield pa.RecordBatch.from_arrays([*map(pa.array, cells[:, kept]), pa.array(scores[kept])], names=names)

    return run


@dataclass(frozen=True)
class PhraseBlocks:
    """``blocks`` (block, tokens, ends, groups, labels, numbers) and ``words`` (word, number), numbers from 1.

    ``sizes``: the labels, each with its number of documents.
    """

    blocks: DataFrame
    words: DataFrame
    sizes: list[tuple]
    label: str
    kind: DataType
    n_docs: int
    n_words: int
    n_tokens: int
    n_blocks: int

    def _keys(self, longest: int) -> Keys:
        bits = max(1, self.n_words.bit_length())
        return Keys(bits, longest, max(1, KEY_BITS // bits))

    def _ranges(self, shortest: int, longest: int) -> int:
        cores = self.blocks.sparkSession.sparkContext.defaultParallelism
        entries = self.n_tokens * (longest - shortest + 1)
        return min(MOST_RANGES, max(1, min(cores, entries // 4096), -(-entries // RANGE_ENTRIES)))

    def _sent(self, keys: Keys, shortest: int, n: int, blocks: DataFrame) -> DataFrame:
        return blocks.mapInArrow(_send(keys, shortest, n), SENT).repartition(n, "part").sortWithinPartitions("part", "block")

    def _thinned(self, keys: Keys, shortest: int, n: int, min_df: int) -> DataFrame:
        """The blocks with marks at the places whose phrases can be in ``min_df`` documents.

        Most long phrases are in one document only. Blocks ask with 32 bits of a phrase's hash, within its range, and
        get a bit back, so only phrases that may count travel whole; a phrase whose bits meet others' is told apart then.
        """
        asked = self.blocks.withColumn("n_docs", F.size("labels")).mapInArrow(_ask(keys, shortest, n), SENT)
        back = asked.repartition(n, "part").sortWithinPartitions("part", "block").mapInArrow(_answer(min_df), BACK)
        back = back.repartition(self.n_blocks, "block")
        marks = self.blocks.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(_mark(keys, shortest, n), "block long, alive binary")
        marks, _ = stage(marks)
        return self.blocks.join(marks.repartition(self.n_blocks, "block"), "block")

    def feature_counts(self, slices: Sequence[tuple[int, int, int]]) -> list[int]:
        """How many phrases of these lengths (from, to) are in as many documents, for every slice."""
        if not self.n_tokens:
            return [0] * len(slices)
        shortest, keys = min(s[0] for s in slices), self._keys(max(s[1] for s in slices))
        counted = self._sent(keys, shortest, self._ranges(shortest, keys.longest), self.blocks).mapInArrow(_count(keys, slices), "slice long, n long")
        found = {r["slice"]: r["n"] for r in counted.groupBy("slice").agg(F.sum("n").alias("n")).collect()}
        return [found.get(k, 0) for k in range(len(slices))]

    def ranking(self, ngrams: tuple[int, int], min_df: int, sublinear: bool, top_n: int, term: str) -> DataFrame:
        """TXT-7 to TXT-9, TXT-11: the top phrases of every label by mean TF-IDF, written once."""
        spark, shortest, keys = self.blocks.sparkSession, ngrams[0], self._keys(ngrams[1])
        names = [f"_k{k}" for k in range(keys.columns)]
        kind = StructType([StructField(self.label, self.kind), StructField("_label", LongType())])
        if not self.n_tokens or not self.sizes:
            return spark.createDataFrame([], kind).select(
                self.label, F.lit(0).alias("rank"), F.lit("").alias(term), F.lit(0.0).alias("mean_tfidf")
            )
        n = self._ranges(shortest, keys.longest)
        # words and pairs of words are often shared: asking first would cost more time than it saves
        thin = min_df > 1 and shortest > 2 and self.n_blocks > 1
        blocks = self._thinned(keys, shortest, n, min_df) if thin else self.blocks
        back = self._sent(keys, shortest, n, blocks).mapInArrow(_return(keys), BACK).repartition(self.n_blocks, "block")
        weigh = _weigh(keys, shortest, n, self.n_docs, min_df, sublinear, [size for _, size in self.sizes], top_n)
        sums = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(weigh, SUMS)
        sums = sums.repartition(n, "part").sortWithinPartitions("part", "block")
        schema = ", ".join(f"{x} long" for x in ("_label", *names)) + ", score double"
        best = sums.mapInArrow(_best(keys, [size for _, size in self.sizes], top_n), schema)
        order = [F.round("score", 12).desc(), *map(F.col, names)]
        ranked, _ = stage(rank_within(best, "_label", order, top_n))
        places = [keys.place(word) for word in range(keys.longest)]
        numbers = [F.shiftright(names[c], shift).bitwiseAND(F.lit((1 << keys.bits) - 1)) for c, shift in places]
        asked = ranked.select("_label", "rank", "score", F.posexplode(F.array(*numbers)).alias("_at", "number"))
        spelt = asked.join(self.words, "number").groupBy("_label", "rank", "score")
        spelt = spelt.agg(F.array_join(F.sort_array(F.collect_list(F.struct("_at", "word"))).getField("word"), " ").alias(term))
        labels = spark.createDataFrame([(name, k) for k, (name, _) in enumerate(self.sizes)], kind)
        rows = spelt.join(F.broadcast(labels), "_label")
        return stage(rows.select(self.label, "rank", term, F.bround("score", 6).alias("mean_tfidf")))[0]


def phrase_blocks(
    docs: DataFrame, id_col: str, label: str, text: str = "text", stopwords: Iterable[str] = (), raw: bool = True, limit: int = 1_000_000
) -> PhraseBlocks:
    """Tokenise once, number the words and write the documents as blocks; blank documents are left out.

    ``raw`` texts are cleaned; others are taken as they are, and lose their stopwords by whitespace. Documents
    that share an id are normed together. Up to ``limit`` words are broadcast to the blocks.
    """
    stopwords = tuple(sorted(set(stopwords)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = docs.select(F.col(id_col).alias("_id"), F.col(label).alias("_label"), F.col(text).alias("_text"))
    held = held.repartition(n, "_id").sortWithinPartitions("_id")
    if raw:
        held = held.withColumn("_text", clean_text(F.col("_text")))
    else:
        words = word_tokens(remove_stopwords(F.col("_text"), stopwords) if stopwords else F.col("_text"))
        held = held.where(~is_blank(F.col("_text"))).withColumn("_text", F.array_join(words, " "))
    kind = held.schema["_label"].dataType
    names = ("block", "tokens", "ends", "groups", "labels", "words")
    kinds = (LongType(), BinaryType(), BinaryType(), BinaryType(), ArrayType(kind), ArrayType(StringType()))
    cut = _cut(raw, stopwords if raw else (), names, BLOCK_BYTES)
    cut_blocks = held.mapInArrow(cut, StructType([StructField(x, k) for x, k in zip(names, kinds)]))
    blocks, seen = stage(
        cut_blocks,
        n_docs=F.sum(F.size("labels")),
        n_tokens=F.sum(F.octet_length("tokens") / 4),
        n_blocks=F.count(F.lit(1)),
    )
    n_blocks = max(1, seen["n_blocks"] or 0)
    counts = blocks.select(F.explode("labels").alias("label")).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sizes = [(r["label"], r["n"]) for r in counts.orderBy("label").collect()]  # one row per label
    words = blocks.select(F.explode("words").alias("word")).distinct().withColumn("_all", F.lit(""))
    words, of_words = stage(number_within(words, "_all", ["word"], "number").drop("_all"), n=F.count(F.lit(1)))
    n_words = of_words["n"] or 0
    known = F.broadcast(words) if n_words <= limit else words.hint("shuffle_merge")
    own = blocks.select("block", F.posexplode("words").alias("_at", "word")).join(known, "word").groupBy("block")
    own = own.agg(F.sort_array(F.collect_list(F.struct("_at", "number"))).alias("_own"))
    if sizes:
        table = F.create_map(*[x for k, (name, _) in enumerate(sizes) for x in (F.lit(name), F.lit(k).cast("long"))])
        numbers = F.transform("labels", lambda x: F.coalesce(F.try_element_at(table, x), F.lit(-1).cast("long")))
    else:
        numbers = F.transform("labels", lambda x: F.lit(-1).cast("long"))
    full = blocks.drop("words").repartition(n_blocks, "block").join(own.repartition(n_blocks, "block"), "block", "left")
    full = full.select(
        "block", "tokens", "ends", "groups", numbers.alias("labels"),
        F.coalesce("_own.number", F.array().cast("array<bigint>")).alias("numbers"),
    )
    # read by block again and again, without another exchange of all tokens
    full = stage_buckets(full, n_blocks, "block", "block")
    return PhraseBlocks(full, words, sizes, label, kind, seen["n_docs"] or 0, n_words, int(seen["n_tokens"] or 0), n_blocks)
