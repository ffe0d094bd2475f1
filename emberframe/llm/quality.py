"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

Every word (hashed to one of `words` rows) has a sparse random index vector; its word vector is the sum of the index vectors of its
neighbours over the whole corpus. A document's mean and spread of word vectors, with its length, its share of distinct words
and of immediate repeats, feed the network, which is trained in numpy on a bounded sample of labelled documents; a temperature
fitted on a part left out of training calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import parallelism, raw_text, slices
from emberframe.llm.langid import remainder
from emberframe.session import cut_lineage

TOKENS = re.compile(r"\w+|[^\w\s]+")
CACHED_WORDS = 400_000
RANGE = 64  # rows of the vector table that travel together


@dataclass(frozen=True)
class Space:
    """Sizes of the word vectors."""

    words: int = 1 << 14
    size: int = 32
    ones: int = 2
    reach: int = 2

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of each row's index vector."""
        draw = np.random.Generator(np.random.PCG64(10))
        return draw.integers(0, self.size, (self.words, self.ones)), draw.choice([-1.0, 1.0], (self.words, self.ones))


class WordRows(dict):
    """Rows of the words and signs in a run of bytes between white space, packed."""

    def __init__(self, words: int):
        super().__init__()
        self.words = words

    def __missing__(self, run: bytes) -> bytes:
        found = TOKENS.findall(run.decode("utf-8", "replace"))
        rows = b"".join([(zlib.crc32(t.encode()) % self.words).to_bytes(4, "little") for t in found])
        if len(run) <= 64:
            self[run] = rows
        return rows

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u4").astype(np.int64)


_ROWS: dict[int, WordRows] = {}


def word_rows(words: int) -> WordRows:
    return _ROWS.setdefault(words, WordRows(words))


def context_sums(space: Space, documents: list[np.ndarray], table: np.ndarray) -> None:
    """Adds each neighbour's index vector to each word's row of the table."""
    rows = np.concatenate([*documents, np.empty(0, np.int64)])
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    places, signs = space.index()
    for reach in range(1, space.reach + 1):
        same = np.flatnonzero(owner[reach:] == owner[: len(owner) - reach])
        for word, other in ((rows[same], rows[same + reach]), (rows[same + reach], rows[same])):
            for k in range(space.ones):
                table += np.bincount(word * space.size + places[other, k], signs[other, k], space.words * space.size)


def word_vectors(docs: DataFrame, space: Space) -> np.ndarray:
    """(words, size) unit word vectors, summed over all documents; the table's size is a parameter."""
    ranges = space.words // RANGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = word_rows(space.words), np.zeros(space.words * space.size)
        for batch in batches:
            for part in slices([batch], "text", 4 << 20):
                context_sums(space, [known.of(t.as_buffer().to_pybytes()) for t in part.column("text")], table)
        parts = table.astype("<f4").reshape(ranges, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([parts[r].tobytes() for r in used], pa.binary())], names=["range", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, sums in zip(batch.column("range").to_pylist(), batch.column("sums")):
                held.setdefault(r, np.zeros(RANGE * space.size))
                held[r] += np.frombuffer(sums.as_buffer(), "<f4")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.astype("<f8").tobytes() for v in held.values()], pa.binary())], names=["range", "sums"])

    schema = "range long, sums binary"
    partial = raw_text(docs).select("text").mapInArrow(run, schema)
    summed = partial.repartition(min(ranges, parallelism(docs.sparkSession)), "range").mapInArrow(add, schema)
    table = np.zeros((ranges, RANGE * space.size))
    for row in summed.collect():  # the table, whose size is a parameter
        table[row["range"]] += np.frombuffer(row["sums"], "<f8")
    table = table.reshape(space.words, space.size)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A document's features; without words all are zero."""
    out = np.zeros(2 * vectors.shape[1] + 3)
    if not len(rows):
        return out
    distinct, times = np.unique(rows, return_counts=True)
    weight, own = times / len(rows), vectors[distinct].astype(np.float64)
    mean = weight @ own
    out[: len(mean)] = mean
    out[len(mean) : 2 * len(mean)] = np.sqrt(np.maximum(weight @ np.square(own) - np.square(mean), 0))
    out[-3:] = np.log1p(len(rows)), len(distinct) / len(rows), np.mean(rows[1:] == rows[:-1]) if len(rows) > 1 else 0.0
    return out


@dataclass
class Network:
    """Standardised features, a hidden layer of rectifiers, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return (np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, apart: float = 0.2) -> Network:
    """Adam on the log loss; the last `apart` of the rows only pick the epoch and the temperature."""
    draw = np.random.Generator(np.random.PCG64(5))
    net = Network(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6))
    net.layers = [draw.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), draw.standard_normal((hidden, 1)) * np.sqrt(1 / hidden), np.zeros(1)]
    order = draw.permutation(len(x))
    fit, held = order[: max(1, int(len(x) * (1 - apart)))], order[int(len(x) * (1 - apart)) :]
    held = held if len(held) else fit
    z, moments = (x - net.mean) / net.scale, [(np.zeros_like(w), np.zeros_like(w)) for w in net.layers]
    best, kept, step = np.inf, [w.copy() for w in net.layers], 0
    for _ in range(epochs):
        draw.shuffle(fit)
        for lo in range(0, len(fit), batch):
            part = fit[lo : lo + batch]
            a, b, c, d = net.layers
            h = np.maximum(z[part] @ a + b, 0)
            error = (1 / (1 + np.exp(-np.clip(h @ c + d, -30, 30))) - y[part, None]) / len(part)
            back = error @ c.T * (h > 0)
            step += 1
            for k, slope in enumerate((z[part].T @ back + decay * a, back.sum(axis=0), h.T @ error + decay * c, error.sum(axis=0))):
                m, v = moments[k]
                m += 0.1 * (slope - m)
                v += 0.001 * (np.square(slope) - v)
                net.layers[k] = net.layers[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if (now := loss(net.logits(x[held]), y[held])) < best:
            best, kept = now, [w.copy() for w in net.layers]
    net.layers = kept
    logits = net.logits(x[held])
    net.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: loss(logits / t, y[held]))
    return net


@dataclass
class Model:
    space: Space
    vectors: np.ndarray
    network: Network | None
    prior: float  # the score where there is no network: one class, or no labels

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        known = word_rows(self.space.words)
        return self.network.scores(np.array([pooled(known.of(t), self.vectors) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "quality", most: int = 20_000, space: Space = Space()) -> Model:
    """Word vectors from all documents, the network from about `most` labelled rows where `learn` holds, picked by a hash of their id.

    Rows without label or id are not learned from; a document with several labels counts with each.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, space)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("y")).where(learn).where("y is not null and doc_id is not null")
    count = usable.count()
    unit = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = cut_lineage(usable.where(unit < most / max(count, 1)))
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_rows(space.words)
        for batch in batches:
            x = [pooled(known.of(t.as_buffer().to_pybytes()), shared.value).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("doc_id"), pa.array(x, pa.binary())], names=["y", "doc_id", "x"])

    rows = raw_text(docs).join(picked, "doc_id").select("doc_id", "y", "text").mapInArrow(run, "y double, doc_id long, x binary")
    sample = sorted((r["doc_id"], r["y"], bytes(r["x"])) for r in rows.collect())  # about `most` rows
    y = np.array([float(r[1] > 0) for r in sample])
    if not len(y) or y.min() == y.max():
        return Model(space, vectors, None, float(y.mean()) if len(y) else 0.5)
    return Model(space, vectors, train(np.array([np.frombuffer(r[2]) for r in sample]), y), float(y.mean()))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row, from the whole text alone; null and empty texts are scored as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            scores = shared.value.scores([t.as_buffer().to_pybytes() for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return raw_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels of the other folds are learned, all documents are scored.

    A row with null doc_id counts as held out. Without labels the score is 0.5, with one class only its share.
    """
    model = fit(docs, labels, remainder(folds) != fold)
    scored = score(docs, model)
    return scored.withColumn("held_out", F.coalesce(remainder(folds) == fold, F.lit(True))).select("doc_id", "held_out", "score", "predicted")
