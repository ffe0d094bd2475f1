"""Masked pseudo-likelihood: every token is predicted from its neighbours on both sides, and the log-probabilities add up.

Tokens are words in classes: the most frequent ones of the corpus by themselves, the others by a hash. A window network embeds
the classes before and after a token, and a hidden layer predicts the token's group and then its class within the group, which
is a proper distribution over all classes. It is trained in numpy by rounds of averaged descent: in each round every task takes the
current network through its share of documents, and the tasks' networks are averaged by their number of tokens. A hash deals the
documents over the rounds, so each enters training once. Counting covers all documents, and so does scoring.

What a document is scored by is its words: a word in a hashed class adds the share that its own count has in the class. Counts of all
words are a table in the shared folder. Words that are at least one in `COMMON` tokens, so `COMMON` at most, are looked up in the
tasks; a document's other words meet the table in a join, summed by document first. None of those is a hot key, being rarer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import isqrt, log
from struct import pack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import parallelism, raw_text, slices
from emberframe.session import cut_lineage

CACHED_WORDS = 400_000
PIECES = 16
COMMON = 1 << 20
#: Batches grow with the tokens that a task has seen, up to so many times the first: large ones cost less a token.
GROWTH, LARGEST = 64, 16


@dataclass(frozen=True)
class Shape:
    frequent: int = 767  # classes of their own; class 0 stands beyond a text's ends
    hashed: int = 256
    groups: int = 32
    reach: int = 2
    size: int = 12
    hidden: int = 24

    @property
    def classes(self) -> int:
        return 1 + self.frequent + self.hashed

    @property
    def members(self) -> int:
        return -(-self.classes // self.groups)

    def grown(self, distinct: int) -> "Shape":
        """For a corpus of so many distinct words: frequent ones grow with their root, groups with the root of the classes."""
        larger = replace(self, frequent=max(self.frequent, 2 * isqrt(distinct)))
        return replace(larger, groups=max(self.groups, isqrt(larger.classes)))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.lower(), 6) >> 1


#: A word's class, its own term in a hashed class, and its hash if that term lacks the word's count, else -1.
CODE = np.dtype([("class", "<u4"), ("term", "<f4"), ("rare", "<i8")])


class WordClasses(dict):
    """The code of each word, as packed bytes."""

    def __init__(self, shape: Shape, frequent: dict[int, int], words: "Words | None" = None):
        super().__init__()
        self.shape, self.frequent, self.words = shape, frequent, words

    def __missing__(self, word: bytes) -> bytes:
        h = word_hash(word)
        own, term, rare = self.frequent.get(h), 0.0, -1
        if own is None:
            own = 1 + self.shape.frequent + h % self.shape.hashed
            if self.words:
                times = self.words.times(h)
                term, rare = log((times or 1) / (int(self.words.by_class[h % self.shape.hashed]) + 1)), -1 if times else h
        packed = pack("<Ifq", own, term, rare)
        if len(word) <= 64:
            self[word] = packed
        return packed

    def codes(self, text: bytes) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), CODE)

    def of(self, text: bytes) -> np.ndarray:
        return self.codes(text)["class"].astype(np.int64)


@dataclass
class Words:
    """Counts of the common words, by sorted hash, and the tokens of each hashed class."""

    common: np.ndarray
    counts: np.ndarray
    by_class: np.ndarray

    def times(self, h: int) -> int:
        k = int(np.searchsorted(self.common, h))
        return int(self.counts[k]) if k < len(self.common) and self.common[k] == h else 0


@dataclass
class Network:
    shape: Shape
    weights: list[np.ndarray]  # embeddings, hidden, its bias, groups, their bias, members by group, their bias

    @classmethod
    def start(cls, shape: Shape, counts: np.ndarray) -> "Network":
        """Small random weights; the biases alone give the corpus frequencies."""
        draw = np.random.Generator(np.random.PCG64(6))
        s, width = shape, 2 * shape.reach * shape.size
        share = np.full(s.groups * s.members, 1e-9)
        share[: s.classes] = (counts + 0.5) / (counts + 0.5).sum()
        by_group = share.reshape(s.groups, s.members)
        weights = [
            draw.standard_normal((s.classes, s.size)) * 0.3, draw.standard_normal((width, s.hidden)) / np.sqrt(width), np.zeros(s.hidden),
            draw.standard_normal((s.hidden, s.groups)) * 0.1, np.log(by_group.sum(axis=1)),
            draw.standard_normal((s.groups, s.hidden, s.members)) * 0.1, np.log(by_group / by_group.sum(axis=1, keepdims=True)),
        ]
        return cls(shape, [w.astype(np.float32) for w in weights])

    def windows(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Targets, their context classes and the document of each; beyond a document's ends stands class 0."""
        pad = np.zeros(self.shape.reach, np.int64)
        rows = np.concatenate([pad, *(x for d in documents for x in (d, pad))])
        owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        at = np.arange(len(owner)) + self.shape.reach * (owner + 1)
        context = np.stack([rows[at + o] for o in range(-self.shape.reach, self.shape.reach + 1) if o], axis=1)
        return rows[at], context, owner

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, w, b, g, c, _, _ = self.weights
        x = e[context].reshape(len(context), w.shape[0])
        h = np.tanh(x @ w + b)
        return x, h, log_softmax(h @ g + c)

    def log_probabilities(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        m, d = self.weights[5:]
        _, h, by_group = self.forward(context)
        group, member = target // self.shape.members, target % self.shape.members
        out = by_group[np.arange(len(target)), group]
        order, runs = _runs(group)
        h, member, inner = h[order], member[order], np.empty(len(target), np.float32)
        for k, lo, hi in runs:
            inner[lo:hi] = log_softmax(h[lo:hi] @ m[k] + d[k])[np.arange(hi - lo), member[lo:hi]]
        out[order] += inner
        return out

    def learn(self, target: np.ndarray, context: np.ndarray, rate: float) -> None:
        """One step of descent on the mean loss of a batch."""
        e, w, b, g, c, m, d = self.weights
        order, runs = _runs(target // self.shape.members)
        target, context = target[order], context[order]
        x, h, by_group = self.forward(context)
        n, group, member = len(target), target // self.shape.members, target % self.shape.members
        error = np.exp(by_group)
        error[np.arange(n), group] -= 1
        back = error @ g.T
        g -= rate / n * (h.T @ error)
        c -= rate / n * error.sum(axis=0)
        for k, lo, hi in runs:
            inner = np.exp(log_softmax(h[lo:hi] @ m[k] + d[k]))
            inner[np.arange(hi - lo), member[lo:hi]] -= 1
            back[lo:hi] += inner @ m[k].T
            m[k] -= rate / n * (h[lo:hi].T @ inner)
            d[k] -= rate / n * inner.sum(axis=0)
        back *= 1 - np.square(h)
        far = (back @ w.T).reshape(-1, e.shape[1])
        w -= rate / n * (x.T @ back)
        b -= rate / n * back.sum(axis=0)
        near = context.ravel()
        for k in range(e.shape[1]):
            e[:, k] -= rate / n * np.bincount(near, far[:, k], len(e))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _runs(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts each group's rows together, and where those of each group that occurs then stand."""
    order = np.argsort(group.astype(np.uint16), kind="stable")
    ends = np.cumsum(np.bincount(group)).tolist()
    return order, [(k, lo, hi) for k, (lo, hi) in enumerate(zip([0, *ends], ends)) if lo < hi]


@dataclass
class Model:
    network: Network
    frequent: dict[int, int]
    words: Words


_CLASSES: dict[int, WordClasses] = {}


def word_classes(model: Model) -> WordClasses:
    """The classes of a model, kept from task to task in a worker."""
    key = hash((model.network.shape, tuple(model.frequent), model.words.common.tobytes(), model.words.counts.tobytes(), model.words.by_class.tobytes()))
    if key not in _CLASSES:
        _CLASSES.clear()
        _CLASSES[key] = WordClasses(model.network.shape, model.frequent, model.words)
    return _CLASSES[key]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, times): hashes of all words of all documents, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = np.fromiter(map(word_hash, held), np.int64, len(held))
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["word", "times"])

        for batch in batches:
            for text in batch.column("text"):
                held.update(text.as_buffer().to_pybytes().split())
                if len(held) > CACHED_WORDS:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))


def train(docs: DataFrame, shape: Shape | None = None, rounds: int = 2, one_in: int | None = None, batch: int = 256, rate: float = 2.0, counts: DataFrame | None = None) -> Model:
    """Counts all words, then `rounds` rounds, each over one part of `one_in` by hash; every part has its turn (`rounds` parts if not given).

    Without a shape, the usual one grown to the distinct words. `counts` are the documents' `word_counts`, if they are known.
    """
    one_in = one_in or max(rounds, 1)
    if rounds and one_in > rounds:
        raise ValueError(f"{rounds} rounds over one document in {one_in} leave documents out")
    spark, texts = docs.sparkSession, raw_text(docs)
    counts = cut_lineage(word_counts(texts)) if counts is None else counts
    total, distinct = counts.agg(F.sum("times"), F.count("*")).first()
    shape = shape or Shape().grown(distinct)
    common = counts.where(F.col("times") * COMMON >= (total or 0)).toArrow()  # COMMON rows at most
    word, often = (common.column(c).to_numpy() for c in ("word", "times"))
    order = np.lexsort((word, -often))
    word, often = word[order], often[order]
    frequent = {int(h): 1 + k for k, h in enumerate(word[: shape.frequent])}
    by_class = np.zeros(shape.hashed, np.int64)
    for r in counts.groupBy((F.col("word") % shape.hashed).alias("k")).agg(F.sum("times").alias("times")).collect():  # the shape's number of rows
        by_class[r["k"]] = r["times"]
    np.subtract.at(by_class, word[: shape.frequent] % shape.hashed, often[: shape.frequent])
    times = np.zeros(shape.classes)
    times[1 : 1 + len(frequent)] = often[: shape.frequent]
    times[1 + shape.frequent :] = by_class
    order = np.argsort(word)
    words = Words(word[order], often[order], by_class)
    model = Model(Network.start(shape, times), frequent, words)
    for turn in range(rounds):
        chosen = texts.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.crc32("text"))), F.lit(one_in)) == turn % one_in)
        model = Model(_averaged(spark, chosen, model, batch, rate / (1 + turn)), frequent, words)
    return model


def _averaged(spark, texts: DataFrame, model: Model, batch: int, rate: float) -> Network:
    """The mean of the tasks' networks after their documents, by tokens."""
    shared = spark.sparkContext.broadcast(model)
    sizes = [w.size for w in model.network.weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        net, known, seen = Network(model.network.shape, [w.copy() for w in model.network.weights]), word_classes(model), 0
        draw = np.random.Generator(np.random.PCG64(7))
        for part in slices(batches, "text", 2 << 20):
            target, context, _ = net.windows([known.of(t.as_buffer().to_pybytes()) for t in part.column("text")])
            order, lo = draw.permutation(len(target)), 0
            while lo < len(order):
                rows = order[lo : lo + min(max(batch, (seen + lo) // GROWTH), LARGEST * batch)]
                net.learn(target[rows], context[rows], rate * min(1, len(rows) / batch))
                lo += len(rows)
            seen += len(target)
        flat = np.concatenate([w.ravel() for w in net.weights]).astype(np.float64) * seen
        pieces = np.array_split(flat, PIECES)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int64()), pa.array([seen] * PIECES, pa.int64()), pa.array([p.astype("<f8").tobytes() for p in pieces], pa.binary())], names=["piece", "seen", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for piece, seen, sums in zip(*(batch.column(n).to_pylist() for n in ("piece", "seen", "sums"))):
                before = held.get(piece, (0, 0.0))
                held[piece] = before[0] + seen, before[1] + np.frombuffer(sums, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].tobytes() for v in held.values()], pa.binary())], names=["piece", "seen", "sums"])

    schema = "piece long, seen long, sums binary"
    summed = texts.select("text").mapInArrow(run, schema).repartition(min(PIECES, parallelism(spark)), "piece").mapInArrow(add, schema)
    rows = sorted((r["piece"], r["seen"], bytes(r["sums"])) for r in summed.collect())  # the network, whose size is a parameter
    if not rows:
        return model.network
    flat = np.concatenate([np.frombuffer(sums, "<f8") for _, _, sums in rows]) / rows[0][1]
    parts = np.split(flat.astype(np.float32), np.cumsum(sizes)[:-1])
    return Network(model.network.shape, [p.reshape(w.shape) for p, w in zip(parts, model.network.weights)])


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, n_tokens, of_classes, of_words, rare, times) of every row.

    `of_words` has all of the words' own terms but the logs of the counts of rare ones, which come with their times in the row. `row`
    holds only in a copy, as tasks number their rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = shared.value, TaskContext.get().partitionId() << 40
        net, known = model.network, word_classes(model)
        for part in slices(batches, "text", 1 << 18):
            codes = [known.codes(t.as_buffer().to_pybytes()) for t in part.column("text")]
            target, context, owner = net.windows([c["class"].astype(np.int64) for c in codes])
            flat = np.concatenate([np.empty(0, CODE), *codes])
            logs = np.concatenate([np.empty(0), *(net.log_probabilities(target[lo : lo + (1 << 15)], context[lo : lo + (1 << 15)]) for lo in range(0, len(target), 1 << 15))])
            count = np.bincount(owner, minlength=part.num_rows)
            at = np.flatnonzero(flat["rare"] >= 0)
            at = at[np.lexsort((flat["rare"][at], owner[at]))]
            word, whose = flat["rare"][at], owner[at]
            first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (whose[1:] != whose[:-1])][: len(at)])
            ends = np.searchsorted(whose[first], np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (word[first], np.diff(np.r_[first, len(at)]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id"), pa.array(count), pa.array(np.bincount(owner, logs, part.num_rows)), pa.array(np.bincount(owner, flat["term"], part.num_rows)), *lists],
                names=["row", "doc_id", "n_tokens", "of_classes", "of_words", "rare", "times"],
            )
            row += part.num_rows

    return raw_text(docs).mapInArrow(run, "row long, doc_id long, n_tokens long, of_classes double, of_words double, rare array<long>, times array<long>")


def _summed(scored: DataFrame, total) -> DataFrame:
    return scored.select("doc_id", "n_tokens", total.alias("log_likelihood"), (total / F.greatest("n_tokens", F.lit(1))).alias("mean_log_likelihood"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row, of its tokens' classes alone: natural logs, whole texts; no tokens give zeros."""
    return _summed(_scored(docs, model), F.col("of_classes"))


def score_words(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """The same of the words: a word of a hashed class adds log(times / (1 + tokens of the class)).

    The one in the denominator is what all unseen words of a class share: such a word counts as one seen once.
    """
    scored = cut_lineage(_scored(docs, model))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("at")).select("row", F.col("at.rare").alias("word"), F.col("at.times").alias("n"))
    logs = counts.where("times > 1").select("word", F.log("times").alias("log"))  # the log of one adds nothing
    more = rare.join(logs, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("more"))
    return _summed(scored.drop("rare", "times").join(more, "row", "left"), F.col("of_classes") + F.col("of_words") + F.coalesce("more", F.lit(0.0)))


def score_documents(docs: DataFrame, shape: Shape | None = None) -> DataFrame:
    """Trains on the documents and scores the words of them all. Null and empty texts have no tokens; ids are not looked at but to choose."""
    counts = cut_lineage(word_counts(raw_text(docs)))
    return score_words(docs, train(docs, shape, counts=counts), counts)
