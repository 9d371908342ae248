"""Token-id files: one zstandard frame per document, under a dictionary that all share.

File format, all numbers little-endian:

    8 bytes   magic ``LXTOKEN1``
    32 bytes  SHA-256 of the dictionary (see ``DICTIONARY``, a file beside them)
    8 bytes   number of documents, n
    8 n       document ids, ascending over all files in order of their numbers
    8 n       ids of all documents before each one in this file
    8 (n+1)   offsets of the frames, counted from the end of this index
    ...       frames: unsigned 32-bit ids, compressed one document at a time

A short document is read by its offsets alone: one frame and the dictionary. The list of
files, a table, holds for each file the ids of all files before it.
"""

from __future__ import annotations

import hashlib
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitally.llm.common import partitions, slices, utf8
from lexitally.session import stage, stage_path

MAGIC = b"LXTOKEN1"
DICTIONARY = "dictionary.bin"
#: Documents that the dictionary is trained on (about), and bytes of ids taken of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16 << 10, 64 << 10
LEVEL = 3
#: Runs of characters, and parts of them, that a worker remembers.
RUNS, PARTS = 400_000, 700_000
#: Bytes of text that are split into runs at once.
SPLIT_BYTES = 4 << 20
#: Compressed bytes that a file should hold.
FILE_BYTES = 64 << 20


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


#: ASCII signs that are neither letters nor digits, nor begin an ending or a special token.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>")


class Known:
    """Ids of numbered byte strings, in one growing array, and how often each was asked for."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes, self.asked = (np.zeros(1 << 16, kind) for kind in (np.uint32, np.int64, np.int64, np.int64))
        self.used = 0

    def add(self, new: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, total = len(self.number), len(ids)
        self.flat = _room(self.flat, self.used + total)
        self.starts, self.sizes, self.asked = (_room(x, first + len(new)) for x in (self.starts, self.sizes, self.asked))
        self.flat[self.used : self.used + total] = ids
        self.starts[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(new)] = sizes
        self.asked[first : first + len(new)] = 0
        self.number.update(zip(new, range(first, first + len(new))))
        self.used += total

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        which = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        self.asked[which] += 1
        return which

    def ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the numbered strings, one after the other, and how many each has."""
        size = self.sizes[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[which] - (ends - size), size) + np.arange(total)], size

    def oftenest(self, most: int) -> Known:
        """What was asked for most often, at most so many strings, counts halved."""
        n, kept = len(self.number), Known()
        least = np.partition(self.asked[:n], n - most)[n - most] if n > most else 0
        chosen = np.flatnonzero(self.asked[:n] > least)
        names = list(self.number)
        kept.add([names[k] for k in chosen.tolist()], *self.ids(chosen))
        kept.asked[: len(chosen)] = self.asked[chosen] // 2
        return kept


class Encoder:
    """Ids of texts by the tokenizers library, which sees every new word once.

    For tokenizers whose pieces never cross white space, that drop it, and whose pieces are
    runs of letters or of other signs. A text is split at the six ASCII white spaces; any
    other stays inside a run. A run that is letters between ASCII signs is put together
    from these parts; every other run goes to the library as it is.
    """

    def __init__(self, path: str):
        self.library = _tokenizer(path)
        self.parts, self.runs = Known(), Known()

    def _ask(self, new: list[bytes]) -> None:
        """Ids of parts, all in one call; the library tells the part of each id."""
        made = self.library.encode([x.decode() for x in new], is_pretokenized=True, add_special_tokens=False)
        self.parts.add(new, np.array(made.ids, np.uint32), np.bincount(np.array(made.word_ids, np.int64), minlength=len(new)))

    def _learn(self, new: list[bytes]) -> None:
        parts, many = [], []
        for run in new:
            core = run.strip(_SIGNS)
            if core and (core.isalpha() or _letters(core.decode())):
                before, n = run.index(core), len(parts)
                if before:
                    parts.append(run[:before])
                parts.append(core.lower())
                if before + len(core) < len(run):
                    parts.append(run[before + len(core) :])
                many.append(len(parts) - n)
            else:
                parts.append(run)
                many.append(1)
        if len(self.parts.number) > PARTS:
            self.parts = self.parts.oftenest(PARTS // 2)
        ask = set(parts).difference(self.parts.number)
        if ask:
            self._ask(list(ask))
        ids, sizes = self.parts.ids(self.parts.numbers(parts))
        many = np.array(many, np.int64)
        self.runs.add(new, ids, np.add.reduceat(sizes, np.cumsum(many) - many))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin, with the end of the last."""
        runs = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = runs.flatten().dictionary_encode()
        names = words.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.runs.number) > RUNS:
            self.runs = self.runs.oftenest(RUNS // 2)
        if b"" not in self.runs.number:  # what is before or after the outer white space
            self.runs.add([b""], np.zeros(0, np.uint32), np.zeros(1, np.int64))
        new = [x for x in names if x not in self.runs.number]
        if new:
            self._learn(new)
        which = self.runs.numbers(names)[words.indices.to_numpy()] if names else np.zeros(0, np.int64)
        ids, sizes = self.runs.ids(which)
        offsets = runs.offsets.to_numpy().astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(sizes)))[offsets - offsets[0]]


def _letters(core: str) -> bool:
    """Whether a text is letters, and still is once composed and lower-cased."""
    return core.isalpha() and unicodedata.normalize("NFC", core).lower().isalpha()


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One per worker, so that its next task knows the words of the last."""
    return Encoder(path)


def encode_texts(path: str, column: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    encoder = _encoder(path)
    _, offsets = utf8(column)
    column = column.fill_null("")
    for lo, hi in slices(offsets, SPLIT_BYTES):
        ids, at = encoder.encode(column.slice(lo, hi - lo))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.append(ids[a:b], np.uint32(end_id)).astype("<u4")


def _train(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from a bounded sample of documents, by a hash of the id."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    rows = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE_ROWS).select("text")

    def run(batches):
        for batch in batches:
            made = [ids[: SAMPLE_BYTES // 4].tobytes() for ids in encode_texts(path, batch.column(0), end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["ids"])

    samples = sorted(bytes(r.ids) for r in rows.mapInArrow(run, "ids binary").collect())
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples
        return b""


def _frames(path: str, end_id: int, dictionary) -> Callable:
    def run(batches):
        shared = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False)
        for batch in batches:
            sizes, frames = [], []
            for ids in encode_texts(path, batch.column(1), end_id):
                sizes.append(len(ids))
                frames.append(pack.compress(ids.tobytes()))
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "frame"])

    return run


def _files(folder: str, digest: bytes) -> Callable:
    def run(batches):
        ids, sizes, frames = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
            frames += batch.column(2).to_pylist()
        if not ids:
            return
        before = np.cumsum(sizes) - sizes
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in frames])))
        head = MAGIC + digest + len(ids).to_bytes(8, "little")
        head += b"".join(np.asarray(x).astype("<i8").tobytes() for x in (ids, before, offsets))
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        write(folder, name, [head, *frames])
        cols = [pa.array([x]) for x in (name, ids[0], len(ids), int(sum(sizes)))]
        yield pa.RecordBatch.from_arrays(cols, names=["file", "first_id", "documents", "tokens"])

    return run


def write(folder: str, name: str, parts: list[bytes]) -> None:
    """Write a file under another name and move it, so that a repeated task leaves one whole file."""
    system, root = fs.FileSystem.from_uri(folder)
    draft = f"{root}/_{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
    system.move(draft, f"{root}/{name}")


def uri(path: str) -> str:
    return path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write token files of all rows under ``folder`` (shared) and return the list of them.

    A null or empty text has the end id alone. Null ids come first, as the smallest
    long; rows that share an id follow each other by length and content. Fewer than 8
    documents, or too few or uniform ids to train on, give an empty dictionary.
    """
    folder = uri(folder)
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).cast("string").alias("text"))
    dictionary = _train(docs, path, end_id)
    write(folder, DICTIONARY, [dictionary])
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    frames, seen = stage(
        docs.mapInArrow(_frames(path, end_id, shared), "id long, n long, frame binary"),
        size=F.sum(F.length("frame")),
    )
    # Each range of ids becomes a file; the range partitioner keeps equal ids together.
    many = max(partitions(docs.sparkSession), -(-int(seen.get("size") or 0) // FILE_BYTES))
    ranges = frames.repartitionByRange(many, "id").sortWithinPartitions("id", "n", F.crc32("frame"))
    digest = hashlib.sha256(dictionary).digest()
    files, _ = stage(ranges.mapInArrow(_files(folder, digest), "file string, first_id long, documents long, tokens long"))
    # One row per file.
    before = F.sum("tokens").over(Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1))
    return files.select("file", "first_id", "documents", "tokens", F.coalesce(before, F.lit(0)).alias("start"))


class TokenFile:
    """Reads documents of one file by the index."""

    def __init__(self, folder: str, name: str):
        self.system, root = fs.FileSystem.from_uri(uri(folder))
        self.file = self.system.open_input_file(f"{root}/{name}")
        head = self.file.read_at(48, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{name} is no token file")
        with self.system.open_input_stream(f"{root}/{DICTIONARY}", compression=None) as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != head[8:40]:
            raise ValueError(f"{name} was written with another dictionary")
        n = int(np.frombuffer(head, "<i8", 1, 40)[0])
        index = np.frombuffer(self.file.read_at(8 * (3 * n + 1), 48), "<i8")
        self.ids, self.starts, self.offsets = index[:n], index[n : 2 * n], index[2 * n :]
        self.data = 48 + 8 * (3 * n + 1)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared)

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return np.frombuffer(self.unpack.decompress(self.file.read_at(b - a, self.data + a)), "<u4")


def _read(folder: str) -> Callable:
    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                opened = TokenFile(folder, name)
                for lo in range(0, len(opened), 4096):
                    rows = range(lo, min(lo + 4096, len(opened)))
                    docs = [opened.document(k) for k in rows]
                    cols = [
                        pa.array(opened.ids[lo : rows.stop]), pa.array(opened.starts[lo : rows.stop] + start),
                        pa.array([len(d) for d in docs], pa.int64()), pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document of the files."""
    dealt = files.select("file", "start").repartition(partitions(files.sparkSession), "file")
    return dealt.mapInArrow(_read(uri(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, folder: str | None = None, **how) -> DataFrame:
    """Write files (under the session's shared folder unless named) and read them back."""
    folder = folder or stage_path(docs.sparkSession)
    return read_tokens(write_tokens(docs, folder, path, **how), folder)
