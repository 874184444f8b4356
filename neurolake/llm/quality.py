"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse scores (operator 4)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.llm import _frames, _text

BITS = 20
THRESHOLD = 0.7
#: labelled documents that a fit reads at most: those of the smallest hash of the id
MAX_TRAIN_DOCS = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.02
#: bytes of texts whose features a fit makes at once
PORTION = 1 << 18
#: a text's features are its n-gram counts over its number of words, times this
SCALE = 24.0

_UPPER = _text.byte_class(lambda b: 65 <= b <= 90)
_DIGIT = _text.byte_class(lambda b: 48 <= b <= 57)
_KIND = np.where(_text.ALNUM, 1, np.where(_text.NONSPACE, 2, 0)).astype(np.uint8)


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of letters, digits and non-ASCII bytes, and runs of other symbols."""
    kind = _KIND[buf]
    n = len(buf)
    start, end = kind > 0, kind > 0
    start, end = start.copy(), end.copy()
    same = kind[1:] == kind[:-1]
    start[1:] &= ~same
    end[:-1] &= ~same
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = kind[inner] > 0
    end[inner - 1] = kind[inner - 1] > 0
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def features(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashed features, word by word in columns, first word of each row, columns).

    For each word: its unigram and bigram by surface (lower case), and unigram, bigram and trigram by form: letter case,
    digits, length class, the symbols themselves, and whether it repeats the word before. Rows don't run into each other.
    """
    starts, ends, first = _tokens(buf, offsets)
    m = len(starts)
    low = _text.LOWER[buf]
    surface = _text.word_hashes(low, starts, ends)
    size = ends - starts

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[buf])])
        return total[ends] - total[starts]

    upper, digits = inside(_UPPER), inside(_DIGIT)
    word = _KIND[buf[starts]] == 1 if m else np.zeros(0, bool)
    repeats = np.zeros(m, np.uint64)
    repeats[1:] = surface[1:] == surface[:-1]
    if m > 2:
        repeats[2:] |= (surface[2:] == surface[:-2]).astype(np.uint64)
    edge = np.unique(first[:-1])
    edge = edge[edge < m]
    repeats[edge] = 0
    # the second word of a row has one word before it
    second = edge + 1
    second = second[second < m]
    second = second[~np.isin(second, edge)]
    repeats[second] = surface[second] == surface[second - 1]
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(2 * upper > size, 2, 3))).astype(np.uint64)
    form = np.where(word, _text.mix(case * np.uint64(64) + (digits > 0).astype(np.uint64) * np.uint64(32) + np.minimum(size, 16).astype(np.uint64) // np.uint64(4) * np.uint64(2) + repeats + np.uint64(1)), surface * np.uint64(2) + repeats)

    def before(h: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(h)
        out[k:] = h[:-k]
        for j in reversed(range(k)):  # what is first in a row has the last say
            at = edge + j
            out[at[at < m]] = np.uint64(j + 1)
        return out

    shape2 = _text.combine(before(form, 1), form)
    columns = [surface, _text.combine(before(surface, 1), surface), form, shape2, _text.combine(before(form, 2), shape2)]
    mask = np.uint64((1 << bits) - 1)
    out = np.stack([(_text.mix(c + np.uint64(i * 0x51ED27)) & mask).astype(np.int32) for i, c in enumerate(columns)], axis=1) if m else np.zeros((0, 5), np.int32)
    return out, first, len(columns)


@dataclass
class Model:
    """Weights of the hashed features and the bias."""

    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 of every text: the dot product of its sparse features with the weights. An empty text is scored by the bias."""
        out = [np.zeros(0)]
        for _, _, buf, offsets in _text.chunks(texts):
            f, first, _ = features(buf, offsets, self.bits)
            sums = _text.row_sums(self.weights[f].sum(axis=1, dtype=np.float64), first)
            z = self.bias + SCALE * sums / np.maximum(np.diff(first), 1)
            out.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        return np.concatenate(out)


class Ftrl:
    """Per-coordinate FTRL-Proximal for logistic loss."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2, self.bits = alpha, beta, l1, l2, bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0
        return w

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One example: distinct coordinates (the last is the bias) and their values."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def model(self) -> Model:
        n = len(self.z) - 1
        w = np.empty(n, np.float32)
        for k in range(0, n, 1 << 16):
            w[k : k + (1 << 16)] = self.weights(np.arange(k, min(k + (1 << 16), n)))
        return Model(w, float(self.weights(np.array([n]))[0]), self.bits)


def train(examples: Iterable[tuple[str | None, int]], epochs: int = EPOCHS, bits: int = BITS) -> Model:
    """Fits in the order given; every text whole. Features wait in a file without a name, which each epoch reads, and not in memory."""
    learner = Ftrl(bits)
    rows: list[tuple[int, np.dtype, int, int]] = []
    with tempfile.TemporaryFile() as file:
        for some in _portions(examples):
            label = iter([y for _, y in some])
            for _, _, buf, offsets in _text.chunks(pa.array([t for t, _ in some], pa.string()), PORTION):
                f, first, _ = features(buf, offsets, bits)
                for r in range(len(first) - 1):
                    at, count = np.unique(f[first[r] : first[r + 1]], return_counts=True)
                    # counts are small numbers and written as such
                    count = count.astype(np.min_scalar_type(int(count.max(initial=0))))
                    file.write(at.tobytes())
                    file.write(count.tobytes())
                    rows.append((len(at), count.dtype, max(1, int(first[r + 1] - first[r])), next(label)))
        for _ in range(epochs):
            file.seek(0)
            for n, kind, n_words, y in rows:
                at, count = np.frombuffer(file.read(4 * n), np.int32), np.frombuffer(file.read(kind.itemsize * n), kind)
                learner.learn(np.append(at, np.int32(1 << bits)), np.append(SCALE * count.astype(np.int64) / n_words, 1.0).astype(np.float32), y)
    return learner.model()


def _portions(examples: Iterable[tuple[str | None, int]]) -> Iterator[list[tuple[str | None, int]]]:
    """Runs of examples of about PORTION letters."""
    held: list[tuple[str | None, int]] = []
    size = 0
    for text, label in examples:
        held.append((text, label))
        size += len(text or "")
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Learns labels.quality from at most max_docs labelled documents whose crc32(doc_id as text) mod 4 is not 2.

    A document labelled more than once takes the majority, a tie or a null label none. Only texts enter the features. Without
    labelled documents the model scores 0.5. The examples, bounded, meet in one task of an executor.
    """
    spark = _frames.ready(docs.sparkSession)
    mean = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("m")).where("m <> 0.5")
    chosen = mean.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", (F.col("m") > 0.5).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    @_frames.trimmed
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train((t, y) for b in batches for k in range(0, b.num_rows, 256) for t, y in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    inorder = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "label")
    row = inorder.mapInArrow(learn, "weights binary, bias double").head()
    if row is None:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    assert spark is not None
    return Model(np.frombuffer(bytes(row["weights"]), np.float32), row["bias"])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1); null and empty texts are scored too, by the bias alone."""
    shared = _frames.ready(docs.sparkSession).sparkContext.broadcast(model)
    return _frames.add_columns(docs, [("score", "double")], lambda b: {"score": pa.array(shared.value.score(_frames.text_column(b)))}, keep)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score under the threshold. The model learns from docs and their labels."""
    made = score(docs, fit(docs, labels)).where(F.col("score") >= threshold)
    return made.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; learnt from labels of the documents that aren't held out."""
    docs = _frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, _frames.table(spark, sf_dir, "labels")), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
