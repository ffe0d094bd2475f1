"""Language ID by bit-sliced Bloom filters of letter n-grams.

Every slot of one filter holds a bitmask with one bit per language; the masks of an n-gram's slots, ANDed, name all languages
whose profile holds it. A document counts, language by language, the n-grams that carry its bit. From that popcount goes what
false positives would give, known from the share of slots that have the bit set, and the highest corrected rate decides.

A profile holds the n-grams that a language uses at least `share` times as often as the language that uses them most, so an
n-gram that a few mislabelled texts bring along stays out. Profiles are learned from a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import lean_batches
from emberframe.llm.repeats import mix
from emberframe.session import cut_lineage

UNKNOWN = "und"  # fixed value: ISO code of an undetermined language
MASK_BITS = 63
EDGE = 1
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Grams:
    """n-grams of several texts: hash and text of each, and each text's number of letters."""

    hashes: np.ndarray
    owner: np.ndarray
    letters: np.ndarray


def grams(texts: list[str], n: int) -> Grams:
    """Lower-cased letters; other characters between them count as one gap; one edge mark ends a text."""
    padded = [f"\n{t.lower()}\n\n" for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    owner = np.repeat(np.arange(len(texts)), lengths)
    letter = _letters()[codes]
    letters = np.bincount(owner[letter], minlength=len(texts))
    codes[~letter] = 0
    codes[np.cumsum(lengths) - 1] = EDGE
    keep = np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])]
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    count = max(0, len(codes) - n + 1)
    hashes = np.zeros(count, np.uint64)
    for k in range(n):
        hashes = hashes * MULTIPLIER + codes[k : k + count]
    inside = owner[:count] == owner[n - 1 :]
    inside &= letters[owner[:count]] > 0
    return Grams(mix(hashes[inside]), owner[:count][inside], letters)


def slots_of(hashes: np.ndarray, size: int, probes: int) -> list[np.ndarray]:
    """`probes` slots of each hash in a filter of `size` slots, a power of two of at most 2**20."""
    return [((hashes >> np.uint64(20 * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(probes)]


@dataclass
class Model:
    languages: list[str]  # in order of their bits
    masks: np.ndarray  # (words of MASK_BITS languages, slots)
    n: int
    probes: int
    expected: np.ndarray | None = None  # coverage of an unseen text of each language, where it was asked for

    @property
    def false_rates(self) -> np.ndarray:
        """Share of absent n-grams that carry each language's bit."""
        return np.array([np.mean(self.masks[b // MASK_BITS] >> np.uint64(b % MASK_BITS) & np.uint64(1)) for b in range(len(self.languages))]) ** self.probes

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) corrected shares of n-grams; letters of each text."""
        found = grams(texts, self.n)
        total = np.bincount(found.owner, minlength=len(texts))
        slots = slots_of(found.hashes, self.masks.shape[1], self.probes)
        out = np.zeros((len(texts), len(self.languages)))
        for word, row in enumerate(self.masks):
            mask = row[slots[0]]
            for slot in slots[1:]:
                mask &= row[slot]
            for b in range(word * MASK_BITS, min(len(self.languages), (word + 1) * MASK_BITS)):
                out[:, b] = np.bincount(found.owner[(mask >> np.uint64(b % MASK_BITS) & np.uint64(1)).astype(bool)], minlength=len(texts))
        false = self.false_rates
        return np.clip((out / np.maximum(total, 1)[:, None] - false) / np.maximum(1 - false, 1e-9), 0, 1), found.letters


def _texts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of bounded characters, each with the place of its first."""
    texts, at, held = [], 0, 0
    for k, text in enumerate(batch.column("text")):
        text = text.as_py() or ""
        if texts and held + len(text) > most:
            yield at, texts
            texts, at, held = [], k, 0
        texts.append(text)
        held += len(text)
    if texts:
        yield at, texts


def fit(docs: DataFrame, learn: Column, n: int = 4, size: int = 1 << 20, probes: int = 3, per_language: int = 2000, share: float = 0.2, least: int = 2, estimate: bool = False) -> Model:
    """Profiles from documents where `learn` holds and lang is not null.

    `per_language` bounds the sample: of a language with more documents, each is taken with that probability by a hash of its
    id, so that about that many are read. The filter's size is a parameter too; all languages are learned, each `MASK_BITS` of
    them a further word of every slot. Without any labelled text there are no languages. `estimate` asks for the coverage that each
    profile should have of a text it has not seen: the share of n-grams whose other occurrences would still be in the profile.
    """
    lean_batches(docs.sparkSession)
    labelled = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), learn.alias("learn")).where("learn and lang is not null")
    held = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(held)
    if not languages:
        return Model([], np.zeros((1, size), np.uint64), n, probes)
    number = F.create_map(*(F.lit(x) for pair in ((name, k) for k, name in enumerate(languages)) for x in pair))
    chance = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, per_language / held[name]))))
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(unit < chance[F.col("lang")]).select(number[F.col("lang")].alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").to_numpy()
            for at, texts in _texts(batch):
                found = grams(texts, n)
                own = lang[at : at + len(texts)][found.owner]
                for code in np.unique(own):
                    gram, times = np.unique(found.hashes[own == code], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), code, np.int32)), pa.array(times)], names=["gram", "lang", "times"])

    counts = sample.mapInArrow(count, "gram long, lang int, times long").groupBy("gram", "lang").agg(F.sum("times").alias("times"))
    counts = cut_lineage(counts) if estimate else counts
    totals = counts.groupBy("lang").agg(F.sum("times").alias("total"), F.sum(F.when(F.col("times") > least, F.col("times")).otherwise(0)).alias("again"))
    expected = np.zeros(len(languages))
    for r in totals.collect() if estimate else ():  # one row a language
        expected[r["lang"]] = r["again"] / r["total"]
    rates = counts.join(F.broadcast(totals.drop("again")), "lang").select("gram", "lang", "times", (F.col("times") / F.col("total")).alias("rate"))
    uses = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "times", "rate")).alias("uses"))  # one entry a language
    kept = uses.select("gram", "top", F.explode("uses").alias("u")).where((F.col("u.rate") >= share * F.col("top")) & (F.col("u.times") >= least))
    bits = kept.groupBy("gram", (F.col("u.lang") / MASK_BITS).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("u.lang") % MASK_BITS)).alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot in slots_of(batch.column("gram").to_numpy().view(np.uint64), size, probes):
                yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column("word"), batch.column("mask")], names=["slot", "word", "mask"])

    filled = bits.mapInArrow(place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most `size` rows a word
    masks = np.zeros(((len(languages) - 1) // MASK_BITS + 1, size), np.uint64)
    masks[filled["word"], filled["slot"]] = filled["mask"].to_numpy().view(np.uint64)
    return Model(languages, masks, n, probes, expected if estimate else None)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, coverage) of every row, from the whole text alone.

    score is the winner's corrected rate over that of the first two; coverage is the winner's rate itself, the share of the text's
    n-grams that its profile holds. A null text or one without a letter gives `und`, 0, 0. If no n-gram is known the first
    language is named, with 0, 0. Ties go to the first language by name. A model without languages always gives `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for at, texts in _texts(batch):
                rates, letters = model.rates(texts)
                rates = np.hstack([rates, np.zeros((len(texts), 2))])
                best = rates.argmax(axis=1)
                top = np.sort(rates, axis=1)[:, :-3:-1]
                known = (letters > 0) & bool(model.languages)
                total = top.sum(axis=1)
                score = np.where(known & (total > 0), top[:, 0] / np.where(total > 0, total, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(score), pa.array(np.where(known, top[:, 0], 0.0))],
                    names=["doc_id", "lang_pred", "score", "coverage"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, coverage double")


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def identify(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, coverage): learned from the other folds, predicted for all documents.

    A row with null doc_id is never learned from and counts as held out.
    """
    model = fit(docs, remainder(folds) != fold)
    return predict(docs, model).withColumn("held_out", F.coalesce(remainder(folds) == fold, F.lit(True))).select("doc_id", "held_out", "lang_pred", "score", "coverage")


def keep_identified(docs: DataFrame, least_coverage: float = 0.3) -> DataFrame:
    """The documents whose language is told: not `und`, and known to the language's profile for a share of the text.

    The share is `least_coverage` of what the profile should hold of a text it has not seen, so small profiles of rare languages ask
    for less. All labelled documents teach, each row is judged on its own, ids play no part, and a null lang becomes the language told.
    """
    model = fit(docs, F.lit(True), estimate=True)
    if not model.languages:
        return docs.where("false")
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    typed = docs.select(*(docs[c].cast("string").alias(c) if c in ("text", "lang") else docs[c] for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        told = np.array(model.languages, object)
        for batch in batches:
            for at, texts in _texts(batch):
                part = batch.slice(at, len(texts))
                rates, letters = model.rates(texts)
                best = rates.argmax(axis=1)
                keep = (letters > 0) & (rates.max(axis=1) >= np.maximum(least_coverage * model.expected[best], 1e-9))
                lang = pc.coalesce(part.column("lang"), pa.array(told[best], part.column("lang").type))
                yield part.set_column(part.schema.get_field_index("lang"), "lang", lang).filter(pa.array(keep))

    kept = typed.mapInArrow(run, typed.schema)
    return kept.select(*(kept[f.name].cast(f.dataType).alias(f.name) if f.name in ("text", "lang") else kept[f.name] for f in docs.schema))
