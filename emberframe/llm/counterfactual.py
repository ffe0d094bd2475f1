"""Toxicity scores from a classifier that is held to the same score when identity terms are exchanged.

Features are words and their beginnings. Those that tell the labels apart on a bounded sample of labelled documents make the
vocabulary; a document is the set of its features there. In every sentence of a labelled document that names a group, the name is
exchanged for others of its kind; the classifier minimises log loss plus `even` times the squared change of the logit between a
document and its exchanged versions. Neutral mentions of a group thus carry no weight of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import lean_batches, raw_text, slices
from emberframe.llm.langid import remainder
from emberframe.session import cut_lineage

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
BEGINNINGS = (3, 4, 5, 6)
CACHED_WORDS = 400_000

# Names of groups, by kind: a name is exchanged for others of its kind.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("transgender", "cisgender"), ("immigrants", "refugees", "natives", "citizens"), ("immigrant", "refugee", "native", "citizen"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
)


def names(word: str) -> list[str]:
    """A word's features: itself and its beginnings."""
    return [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def key(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode(), 11) - (1 << 63)


def words(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def exchanged(text: str, nth: int, kinds: dict[str, tuple[str, ...]]) -> str:
    """The lower-cased text with each sentence's group names moved on within their kind, by a step drawn from the sentence and `nth`."""

    def one(sentence: re.Match) -> str:
        step = zlib.crc32(f"{nth} {sentence[0]}".encode())

        def other(word: re.Match) -> str:
            kind = kinds.get(word[0])
            return word[0] if kind is None else kind[(kind.index(word[0]) + 1 + (step + nth) % (len(kind) - 1)) % len(kind)]

        return WORD.sub(other, sentence[0])

    return SENTENCE.sub(one, text.lower())


def by_name(identities: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    return {name: kind for kind in identities if len(kind) > 1 for name in kind}


class Places(dict):
    """A word's places in the vocabulary, packed; words are remembered up to a limit."""

    def __init__(self, vocabulary: dict[int, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        found = (self.vocabulary.get(key(n)) for n in names(word))
        packed = b"".join(p.to_bytes(4, "little") for p in found if p is not None)
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = packed
        return packed

    def of(self, found: list[str]) -> np.ndarray:
        """Distinct places of the words' features."""
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(found))), "<u4")).astype(np.int64)


@dataclass
class Model:
    vocabulary: dict[int, int]
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes], places: Places) -> np.ndarray:
        logits = np.array([self.bias + self.weight[places.of(words(t))].sum() for t in texts])
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def objective(weight: np.ndarray, bias: float, rows: list[np.ndarray], y: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], even: float, decay: float) -> tuple[float, np.ndarray, float]:
    """Loss and its slopes. `pairs` are positions of documents and of their exchanged versions among `rows`; y covers the first rows."""
    at, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    logits = np.bincount(at, weight[flat], len(rows)) + bias
    own, (left, right) = logits[: len(y)], pairs
    gap = logits[left] - logits[right]
    loss = float(np.mean(np.logaddexp(0, own) - y * own)) + decay / 2 * float(weight @ weight) + even * float(gap @ gap) / max(len(gap), 1)
    slope = np.zeros(len(rows))
    slope[: len(y)] = (1 / (1 + np.exp(-np.clip(own, -30, 30))) - y) / len(y)
    bias_slope = float(slope.sum())
    np.add.at(slope, left, 2 * even * gap / max(len(gap), 1))
    np.add.at(slope, right, -2 * even * gap / max(len(gap), 1))
    return loss, np.bincount(flat, slope[at], len(weight)) + decay * weight, bias_slope


def train(size: int, rows: list[np.ndarray], y: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], even: float, decay: float = 1e-5, steps: int = 250, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam over the whole sample."""
    weight, bias = np.zeros(size), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        _, slope, bias_slope = objective(weight, bias, rows, y, pairs, even, decay)
        g = np.r_[slope, bias_slope]
        m += 0.1 * (g - m)
        v += 0.01 * (np.square(g) - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, target: str, most: int) -> DataFrame:
    """(doc_id, y, text): about `most` distinct labelled texts, picked by a hash of id and text.

    Rows that repeat id and text count once, so a document that a third of all rows repeat is still one; a document with several
    labels counts with each.
    """
    texts = raw_text(docs).withColumn("h", F.xxhash64("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("y")).where(learn).where("y is not null and doc_id is not null").distinct()
    known = cut_lineage(texts.select("doc_id", "h").distinct().join(marked, "doc_id"))
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "h"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(unit < most / max(known.count(), 1))  # about `most` rows
    return cut_lineage(texts.join(F.broadcast(picked.select("doc_id", "h").distinct()), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).join(picked, ["doc_id", "h"]).select("doc_id", "y", "text"))


def telling_features(sample: DataFrame, most: int, least: int = 3, telling: float = 3.3) -> list[int]:
    """The features, at most `most`, whose share of documents differs most between the labels: z above `telling`, in `least` documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            for text, y in zip(part.column("text"), part.column("y").to_pylist()):
                held = np.array(list({key(n) for w in set(words(text.as_buffer().to_pybytes())) for n in names(w)}), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), float(y > 0)))], names=["feature", "y"])

    classes = sample.agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") <= 0).alias("n")).first()
    p, n = max(classes["p"], 1), max(classes["n"], 1)
    counts = sample.select("text", "y").mapInArrow(run, "feature long, y double").groupBy("feature").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    share = (F.col("p") + F.col("n")) / float(p + n)
    z = F.abs(F.col("p") / float(p) - F.col("n") / float(n)) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1.0 / p + 1.0 / n))
    top = counts.where(F.col("p") + F.col("n") >= least).select("feature", z.alias("z")).where(F.col("z") > telling).orderBy(F.desc("z"), "feature").limit(most)
    return sorted(r["feature"] for r in top.collect())  # at most `most` rows


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, target: str = "toxic", most: int = 20_000, features: int = 8_192,
    identities: tuple[tuple[str, ...], ...] = IDENTITIES, versions: int = 2, even: float = 1.0,
) -> Model | float:
    """The classifier, or the share of positive labels where there are not both classes (0.5 without labels)."""
    sample = labelled_sample(docs, labels, learn, target, most)
    vocabulary = {f: k for k, f in enumerate(telling_features(sample, features))}
    shared, kinds = docs.sparkSession.sparkContext.broadcast(vocabulary), by_name(identities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value)
        for part in slices(batches, "text"):
            out = []
            for doc, y, text in zip(part.column("doc_id").to_pylist(), part.column("y").to_pylist(), part.column("text")):
                raw = text.as_buffer().to_pybytes()
                found = words(raw)
                out.append((doc, y, 0, places.of(found), xxhash.xxh64_intdigest(raw)))
                if not kinds.keys().isdisjoint(found):
                    for nth in range(versions):
                        swapped = WORD.findall(exchanged(raw.decode("utf-8", "replace"), nth, kinds))
                        out.append((doc, y, nth + 1, places.of(swapped), xxhash.xxh64_intdigest(raw)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([float(r[1] > 0) for r in out]), pa.array([r[2] for r in out], pa.int32()),
                 pa.array([r[3].astype("<u4").tobytes() for r in out], pa.binary()), pa.array([r[4] - (1 << 63) for r in out], pa.int64())],
                names=["doc_id", "y", "version", "places", "text_key"],
            )

    found = sample.mapInArrow(run, "doc_id long, y double, version int, places binary, text_key long").collect()  # about `most` documents and their versions
    found.sort(key=lambda r: (r["version"] > 0, r["doc_id"], r["text_key"], r["y"], r["version"]))
    y = np.array([r["y"] for r in found if not r["version"]])
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    first = {(r["doc_id"], r["text_key"], r["y"]): k for k, r in enumerate(found[: len(y)])}
    right = np.arange(len(y), len(found))
    left = np.array([first[r["doc_id"], r["text_key"], r["y"]] for r in found[len(y) :]], np.int64)
    rows = [np.frombuffer(r["places"], "<u4").astype(np.int64) if r["places"] else np.empty(0, np.int64) for r in found]
    return Model(vocabulary, *train(len(vocabulary), rows, y, (left, right), even))


def score(docs: DataFrame, model: Model | float, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row, from the whole text alone; null and empty texts are scored as texts without words."""
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        places = None if isinstance(model, float) else Places(model.vocabulary)
        for part in slices(batches, "text", 4 << 20):
            scores = np.full(part.num_rows, model) if places is None else model.scores([t.as_buffer().to_pybytes() for t in part.column("text")], places)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return raw_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels of the other folds are learned, all documents are scored.

    A row with null doc_id counts as held out. Without labels the score is 0.5, with one class only its share.
    """
    model = fit(docs, labels, remainder(folds) != fold)
    return score(docs, model).withColumn("held_out", F.coalesce(remainder(folds) == fold, F.lit(True))).select("doc_id", "held_out", "score", "predicted")
