"""Language identification: averaged hashed subword embeddings with a linear softmax.

The features of a text are the byte n-grams of its letter words (a word is written with
a mark at both ends), hashed into a fixed number of buckets. A text's vector is the mean
of its buckets' embeddings; a linear softmax on it gives the language. Embeddings and
softmax are trained together by stochastic gradient descent in numpy, with a temperature
fitted on rows held out of training, and two rejection bounds that keep all but a documented
share of those rows: the likeliest of L languages never scores below 1 / L, so texts unlike
all of them are known by the share of their n-grams that training never met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.common import U64, byte_codes, mapped, mix, named, slices, utf8, worker_memory

SIZES = (2, 3)
BUCKETS = 1 << 16
UNKNOWN = "und"
#: Share of unmet n-grams that is never held against a text: a few hundred rows cannot bound less.
FEW_UNMET = 0.1

_CODES = byte_codes(6)
# Upper-case ASCII counts as lower-case; ASCII other than letters separates words. Bytes above
# 127 belong to words: whether one is a letter is asked of the characters, in has_letter.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[97:123] = _IN_WORD[128:] = True


def subwords(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the buckets in text order, and where each text's begin.

    ``buckets`` is a power of two.
    """
    n, shift = len(data), U64(64 - (buckets.bit_length() - 1))
    if n < 2:
        return
    folded = _FOLD[data]
    word = _IN_WORD[folded]
    # Anything outside words reads as one mark, so that word ends are part of the n-grams.
    codes = _CODES[np.where(word, folded, 32)]
    last = np.zeros(n + 1, bool)
    last[offsets[1:]] = True
    h, crossing, inner = codes, np.zeros(n, bool), np.ones(n, bool)
    for size in range(2, max(SIZES) + 1):
        m = n - size + 1
        if m <= 0:
            return
        h = (h[:m] * U64(0x9E3779B97F4A7C15)) ^ codes[size - 1 :]
        # An n-gram lies in one text and touches marks at its ends only.
        crossing = crossing[:m] | last[size - 1 : size - 1 + m]
        inner = inner[:m] & word[size - 2 : size - 2 + m] if size > 2 else inner[:m]
        if size in SIZES:
            pos = np.flatnonzero(~crossing & inner & (word[:m] | word[size - 1 :]))
            yield ((h[pos] * U64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64), np.searchsorted(pos, offsets)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive starts; zero for empty ranges."""
    out = np.zeros(len(starts) - 1, np.float64)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], dtype=np.float64)
    return out


def _bags(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares of every text, some texts at a time."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    bags = []
    for lo, hi in slices(offsets):
        parts = list(subwords(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], buckets))
        for i in range(hi - lo):
            ids, n = np.unique(np.concatenate([w[s[i] : s[i + 1]] for w, s in parts] or [np.zeros(0, int)]), return_counts=True)
            bags.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return bags


@dataclass
class LanguageModel:
    """Scores of every bucket per language, a temperature and the rejection bounds."""

    languages: list[str]
    scores: np.ndarray  # softmax weights times embeddings, languages x buckets
    bias: np.ndarray
    temperature: float
    reject_below: float
    met: np.ndarray | None = None  # whether training met a bucket
    most_unmet: float = 1.0

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.judge(data, offsets)[0]

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the languages, and the share of n-grams that training never met."""
        z, n, unmet = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for which, starts in subwords(data, offsets, self.scores.shape[1]):
            n += np.diff(starts)
            if self.met is not None:
                unmet += _sums(~self.met[which], starts)
            for k, of_language in enumerate(self.scores):
                z[:, k] += _sums(of_language[which], starts)
        z = (z / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), unmet / np.maximum(n, 1)


def train(
    texts: list[str],
    labels: list[str],
    dim: int = 16,
    buckets: int = BUCKETS,
    epochs: int = 6,
    rate: float = 0.5,
    keep: float = 0.999,
    seed: int = 6,
) -> LanguageModel:
    """Fit embeddings and softmax by SGD; a fifth of the rows calibrates.

    The temperature minimises the log loss of those rows. ``reject_below`` is half the
    probability that all but ``1 - keep`` of those that are right exceed, and ``most_unmet``
    the share of n-grams unmet in training that all but ``1 - keep`` of them stay within,
    ``FEW_UNMET`` at least, so that texts like the labelled ones stay and unlike ones go.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.searchsorted(languages, labels)
    bags = _bags(texts, buckets)
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    weight, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    order = rng.permutation(len(y))
    hold, chosen = order[: len(y) // 5], order[len(y) // 5 :]
    steps, step = epochs * len(chosen), 0
    for _ in range(epochs):
        for row in rng.permutation(chosen):
            eta = rate * (1 - step / steps)
            step += 1
            ids, share = bags[row]
            mean = share @ emb[ids]
            z = mean @ weight + bias
            z = np.exp(z - z.max())
            z /= z.sum()
            z[y[row]] -= 1
            back = weight @ z
            weight -= eta * np.outer(mean, z)
            bias -= 0.1 * eta * z
            emb[ids] -= (eta * share / max(1e-6, float(share @ share)) ** 0.5)[:, None] * back
    met = np.zeros(buckets, bool)
    for row in chosen:
        met[bags[row][0]] = True
    model = LanguageModel(languages, np.ascontiguousarray((emb @ weight).T, np.float32), bias, 1.0, 0.0, met)
    held = hold if len(hold) else order
    data, offsets = utf8(pa.array([texts[i] for i in held], pa.large_string()))
    plain = np.log(np.maximum(model.probabilities(data, offsets), 1e-30))

    def loss(t: float) -> float:
        z = plain / t
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(held)), y[held]]))

    model.temperature = min((2.0**k for k in np.arange(-4, 4.25, 0.25)), key=loss)
    p, unmet = model.judge(data, offsets)
    right = p[np.arange(len(held)), y[held]][p.argmax(axis=1) == y[held]]
    model.reject_below = float(np.quantile(right, 1 - keep)) / 2 if len(right) else 0.0
    model.most_unmet = max(FEW_UNMET, float(np.quantile(unmet, keep)))
    return model


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    where=None,
    rows_per_label: int = 600,
    bytes_per_label: int = 8 << 20,
    **how,
) -> LanguageModel:
    """Train on at most ``rows_per_label`` labelled rows of each label, taken by a hash of the id.

    The bound is what reaches the driver; rows beyond ``bytes_per_label`` bytes of whole texts go
    too, but for a label's first row. Rows with a null label, a null text or no letter are no
    examples. An empty table gives a model without languages.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.select(
        named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("text"), named(label_col).cast("string").alias("label")
    )
    rows = rows.where("label is not null and text is not null").where(has_letter("text"))
    # The smallest hashes of each label: counts per hash prefix bound the rows before any text moves.
    h = F.crc32(F.coalesce("id", F.lit("")))
    step = rows.groupBy("label", F.shiftrightunsigned(h, 18).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("label").orderBy("slot"))
    bound = step.select("label", "slot", (so_far - F.col("n")).alias("before")).where(F.col("before") < rows_per_label)
    # a row per label, as the model has: it is sent to the rows, of which only those within it are dealt by label
    bound = F.broadcast(bound.groupBy("label").agg(F.max("slot").alias("last")))
    near = rows.withColumn("h", h).join(bound, "label").where(F.shiftrightunsigned("h", 18) <= F.col("last"))
    order = Window.partitionBy("label").orderBy("h", "id", "text")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows_per_label)
    size = F.octet_length("text").cast("long")
    ranked = ranked.withColumn("before", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    picked = ranked.where(F.col("before").isNull() | (F.col("before") + size <= bytes_per_label)).select("id", "label", "text")
    got = sorted((r.id or "", r.label, r.text) for r in picked.collect())
    return train([t for _, _, t in got], [x for _, x, _ in got], **how)


def has_letter(text: str):
    """Whether a text has a letter of any script; null has none."""
    return F.coalesce(named(text).cast("string").rlike(r"\p{L}"), F.lit(False))


def _predict(model: LanguageModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("language")
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            text, letters = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = utf8(text)
            best, score, unmet = np.full(len(letters), len(model.languages)), np.zeros(len(letters)), np.zeros(len(letters))
            if model.languages:
                for lo, hi in slices(offsets, 1 << 20):
                    p, unmet[lo:hi] = model.judge(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    best[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            best[~letters], score[~letters] = len(model.languages), 0.0
            keep = letters & (score >= model.reject_below) & (unmet <= model.most_unmet) & (best < len(model.languages))
            out = [*batch.columns[2:], pa.array(names[best], pa.string()), pa.array(score), pa.array(keep)]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[2:], "new_0", "new_1", "new_2"])

    return run


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) with ``lang_pred``, ``score`` and ``accepted`` for every row.

    A null text, or one without a letter, is ``und`` with score 0 and not accepted, and so
    is any text if no language was learned. Other texts get the likeliest language, and
    are accepted within the calibrated bounds. Whole texts are read. Columns of the input
    called like the three results are replaced.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    names = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in new}]
    return mapped(docs, [named(text_col).cast("string"), has_letter(text_col)], names, _predict(model), new)
