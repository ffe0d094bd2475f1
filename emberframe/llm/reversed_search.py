"""Ranked lexical search turned round: the items are the index, and the documents stream through it.

The items' terms make an inverted index (term, its items), cut into blocks of bounded postings, each small enough to broadcast.
Every document's terms are counted once per block against its vocabulary; its contributions run down the postings of its terms into
one heap of `k` documents an item in each task, and the tasks' heaps are merged. Documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import lean_batches, raw_text, slices, spread
from emberframe.session import cut_lineage

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
EXACT = 1 << 53
CELLS, EXPANDED = 1 << 21, 1 << 20
HEAPS = 64  # tasks whose heaps are merged first


def terms(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters; only A-Z are lower-cased."""
    return TERM.findall(text.lower())


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, repeats): all rows of one item count together; rows with a null key are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [Counter(terms(t.as_buffer().to_pybytes())) for t in part.column("text")]
            owner = np.repeat(part.column("item").to_numpy(), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner), pa.array([t for c in found for t in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int64())],
                names=["item", "term", "repeats"],
            )

    lean_batches(items.sparkSession)
    rows = items.select(F.col(key).cast("long").alias("item"), F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("text")).where("item is not null")
    return rows.mapInArrow(run, "item long, term binary, repeats long").groupBy("item", "term").agg(F.sum("repeats").alias("repeats"))


@dataclass
class Index:
    """Postings of one block: those of term t are at[t] to at[t + 1]."""

    vocabulary: dict[bytes, int]
    names: np.ndarray
    at: np.ndarray
    items: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, bytes, int]]) -> Index:
        vocabulary = {t: k for k, t in enumerate(sorted({r[1] for r in rows}))}
        names, items = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
        term, repeats = np.array([vocabulary[r[1]] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        order = np.argsort(term, kind="stable")
        return cls(vocabulary, names, np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), items[order], repeats[order])

    def scores(self, sizes: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(documents, items) sums of weight x repeats x value, for documents that own the next `sizes` (term, value) pairs each."""
        owner, _ = spread(sizes)
        many = np.diff(self.at)[term]
        entry, nth = spread(many)
        posting = self.at[term][entry] + nth
        cell, part = owner[entry] * len(self.names) + self.items[posting], value[entry] * (weight[term[entry]] * self.repeats[posting])
        if part.sum(dtype=np.float64) < EXACT:
            return np.bincount(cell, part, len(sizes) * len(self.names)).astype(np.int64).reshape(len(sizes), -1)
        out = np.zeros(len(sizes) * len(self.names), np.int64)
        np.add.at(out, cell, part)
        return out.reshape(len(sizes), -1)


class Heaps:
    """The k best documents of every item: highest score first, then smallest doc_id, null ids last."""

    def __init__(self, items: int, k: int):
        self.items, self.k, self.least, self.held = items, k, np.ones(items, np.int64), 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def push(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """A row of scores a document; a score that only equals an item's k-th may still win by its id."""
        row, item = np.nonzero(scores >= self.least)
        self.parts.append((item, scores[row, item], ids[row], missing[row]))
        self.held += len(row)
        if self.held > 4 * self.k * self.items:
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        item, score, doc, missing = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.empty(0, t) for t in (int, np.int64, np.int64, bool))
        order = np.lexsort((doc, missing, -score, item))
        size = np.bincount(item, minlength=self.items)
        _, place = spread(size)
        order = order[place < self.k]
        kept = tuple(c[order] for c in (item, score, doc, missing))
        full = np.flatnonzero(size >= self.k)
        self.least[full] = kept[1][np.cumsum(np.minimum(size, self.k))[full] - 1]
        self.parts, self.held = [kept], len(order)
        return kept


def contributions(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weights(df: np.ndarray, count: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def counted(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, n, terms, tf) of documents with a term: all their terms, and the index's terms with their counts, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches, "text"):
            n, own, tf = [], [], []
            for text in part.column("text"):
                found = terms(text.as_buffer().to_pybytes())
                times = Counter(filter(known.__contains__, found))
                n.append(len(found))
                own.append(np.array([known[t] for t in times], "<i4").tobytes())
                tf.append(np.array(list(times.values()), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(tf, pa.binary())], names=["doc_id", "n", "terms", "tf"])

    return raw_text(docs).mapInArrow(run, "doc_id long, n long, terms binary, tf binary").where("n > 0")


def document_frequencies(counts: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=size)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for row in counts.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's terms
        out[row["term"]] = row["df"]
    return out


def heaps(counts: DataFrame, index: Index, weight: np.ndarray, count: int, length: int, k: int) -> DataFrame:
    """(part, item_id, doc_id, score): the heaps of every task."""
    shared = counts.sparkSession.sparkContext.broadcast((index, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = shared.value
        found, most = Heaps(len(index.names), k), max(1, CELLS // len(index.names))
        reach = np.diff(index.at)
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) // 4 for x in batch.column("terms")], np.int64)
            term = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4").astype(np.int64)
            tf = np.frombuffer(b"".join(batch.column("tf").to_pylist()), "<i4").astype(np.int64)
            # Python integers: n x N may pass 64 bits before the division
            m = np.array([25 + 75 * n * count // length for n in batch.column("n").to_pylist()], np.int64)
            value = contributions(tf, np.repeat(m, sizes))
            ids = batch.column("doc_id")
            missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            ends = np.r_[0, np.cumsum(sizes)]
            work = np.r_[0, np.cumsum(reach[term])][ends]  # postings before each document
            lo = 0
            while lo < len(sizes):
                hi = min(max(lo + 1, int(np.searchsorted(work, work[lo] + EXPANDED, "right")) - 1), lo + most, len(sizes))
                here = slice(ends[lo], ends[hi])
                found.push(index.scores(sizes[lo:hi], term[here], value[here], weight), ids[lo:hi], missing[lo:hi])
                lo = hi
        item, score, doc, missing = found.best()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(item), TaskContext.get().partitionId(), np.int64)), pa.array(index.names[item]), pa.array(doc, mask=missing), pa.array(score)],
            names=["part", "item_id", "doc_id", "score"],
        )

    return counts.mapInArrow(run, "part long, item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, postings: int = 1 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by ascending doc_id.

    Null and term-less texts have no terms and count nowhere. Rows of documents are documents of their own, also where ids repeat;
    rows with null doc_id come last among equals. Rows of items that share an id are one item; rows without id are left out.
    `postings` is the size of a block that is broadcast (an item is never split), and each block reads the documents once.
    """
    if min(k, postings) < 1:
        raise ValueError("sizes are positive")
    spark = docs.sparkSession
    pairs = cut_lineage(item_terms(items))
    blocks = max(1, math.ceil(pairs.count() / postings))
    out = None
    for block in range(blocks):
        index = Index.of([(r["item"], bytes(r["term"]), r["repeats"]) for r in pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()])  # about `postings` rows
        if not len(index.names):
            continue
        counts = cut_lineage(counted(docs, index))
        total = counts.agg(F.count("*").alias("count"), F.sum("n").alias("length")).first()
        if not total["count"]:
            break
        weight = weights(document_frequencies(counts, len(index.vocabulary)), total["count"])
        found = heaps(counts, index, weight, total["count"], total["length"], k)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", F.floor(F.col("part") / HEAPS)).orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


SQL = r"""
    with item_terms as (
        select item_id, term, count(*) as repeats from (
            select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark where item_id is not null
        ) group by all
    ), texts as (
        select row_number() over () as r, doc_id,
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
        from documents
    ), total as (
        select count(*) as docs, sum(len(terms))::bigint as length from texts where len(terms) > 0
    ), counts as (
        select r, term, count(*) as tf from (select r, unnest(terms) as term from texts) where term in (select term from item_terms) group by all
    ), weights as (
        select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from counts, total group by term
    ), shares as (
        select r, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(terms) * docs) // length)) as share from counts join texts using (r), total
    ), scored as (
        select item_id, r, sum(w * repeats * share)::bigint as score from shares join weights using (term) join item_terms using (term) group by all
    ), ranked as (
        select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank
        from scored join texts using (r) where score > 0
    )
    select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
