"""Substring dedup: words covered by a window of words that also starts earlier, found by level-wise doubling.

Windows of `first` words are hashed and counted over the whole corpus; a window of twice the length is a candidate only where
the windows of one length inside it are repeated, and so on until the wanted length leaves no candidate to extend. The texts lie once in a table bucketed by block, so every level reads them without a shuffle. What travels are
sorted hash values that each block holds, once per block, packed per range of hash values; back come bits that say which of
them are repeated. A passage that every document shares thus costs each block one value. The lower levels count one in
`ONE_IN` windows, chosen by hash alike everywhere; an uncounted window stays a candidate, so the last level, which counts all
candidates with 64 bits within a range of values, decides alone and nothing is lost.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import parallelism, raw_columns
from emberframe.session import new_path

ONE_IN = 4
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
GAP = re.compile(rb"[\x20\x09-\x0d]")
PLACES = 64
TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, (PLACES, 256), np.uint64, endpoint=False)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


def _hash_part(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and where they start."""
    gaps = SPACE[np.frombuffer(part, np.uint8)]
    starts = np.flatnonzero(~gaps & np.r_[True, gaps[:-1]]) if part else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.flatnonzero(~gaps)
    letters = np.frombuffer(part, np.uint8)[at]
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, lengths)
    values = TABLE[place % PLACES, letters]
    if lengths.max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        values[far] = mix(values[far] + (place[far] // PLACES).astype(np.uint64) * STEP)
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), starts


def word_hashes(text: bytes, most: int = 4 << 20) -> np.ndarray:
    """64-bit hashes of a text's words, in pieces of bounded size."""
    parts, lo = [], 0
    while len(text) - lo > most:
        gap = GAP.search(text, lo + most)
        hi = gap.end() if gap else len(text)
        parts.append(_hash_part(text[lo:hi])[0])
        lo = hi
    return np.concatenate([*parts, _hash_part(text[lo:])[0]])


def joint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows from those of their halves."""
    return mix(left * STEP + right)


@dataclass
class Block:
    """The words of one block's documents, in order of (null ids last, doc_id, row)."""

    words: np.ndarray
    ends: np.ndarray  # for each word, the end of its document
    bounds: np.ndarray  # where documents begin, and the end

    @classmethod
    def of(cls, texts: list[bytes]) -> "Block":
        if sum(map(len, texts)) <= 4 << 20:
            # a line break ends the last word of each text, so all texts can be hashed at once
            words, starts = _hash_part(b"\n".join(texts))
            edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
            bounds = np.searchsorted(starts, edges)
        else:
            parts = [word_hashes(t) for t in texts]
            words, bounds = np.concatenate([*parts, np.empty(0, np.uint64)]), np.cumsum([0, *map(len, parts)])
        return cls(words, np.repeat(bounds[1:], np.diff(bounds)), bounds)

    def windows(self, first: int, levels: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, hash by start, and whether the window lies within one document, level by level."""
        n = len(self.words)
        hashes = np.zeros(n, np.uint64)
        for k in range(first):
            hashes[: n - k] = hashes[: n - k] * STEP + self.words[k:]
        hashes, length = mix(hashes), first
        for level in range(levels):
            if level:
                shifted = np.zeros(n, np.uint64)
                shifted[: max(n - length, 0)] = hashes[length:]
                hashes, length = joint(hashes, shifted), 2 * length
            yield length, hashes, np.arange(n) + length <= self.ends


def inside(ok: np.ndarray, count: int) -> np.ndarray:
    """Where `count` neighbouring entries, from here on, are all true."""
    total = np.cumsum(np.r_[0, ok.astype(np.int64)])
    out = np.zeros(len(ok), bool)
    if len(ok) >= count:
        out[: len(ok) - count + 1] = total[count:] - total[: len(ok) - count + 1] == count
    return out


def counted(hashes: np.ndarray, last: bool) -> np.ndarray:
    return np.ones(len(hashes), bool) if last else (hashes & np.uint64(0xFF)) < 256 // ONE_IN


@dataclass
class Search:
    """One search over a bucketed table; level k has windows of first * 2**k words."""

    first: int
    levels: int
    bits: int  # ranges of hash values: 2**bits

    def split(self, values: np.ndarray) -> np.ndarray:
        """Where each range of sorted values begins, and the end."""
        return np.searchsorted(values >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def at_level(self, block: Block, flags: list[np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray]:
        """Window hashes by start at a level, and its candidates, given the flags of all lower levels."""
        alive = None
        for k, (length, hashes, fits) in enumerate(block.windows(self.first, self.levels)):
            candidate = fits if alive is None else fits & inside(alive, length // 2 + 1)
            if k == level:
                return hashes, candidate
            alive = candidate.copy()
            use = np.flatnonzero(candidate & counted(hashes, k == self.levels - 1))
            values, index, times = np.unique(hashes[use], return_inverse=True, return_counts=True)
            alive[use] = ((times > 1) | flags[k])[index]
        raise ValueError(level)


def bucketed(docs: DataFrame, rest: Column) -> tuple[DataFrame, int]:
    """The texts as a table in the shared folder, bucketed by block, and their bytes; `rest` is carried along.

    A document is wholly in one block, and rows of the same doc_id too; rows with null doc_id are dealt out.
    """
    spark = docs.sparkSession
    parts, rows = parallelism(spark), docs.count()
    blocks = max(1, rows // 20_000, min(rows // 256, 32 * parts))
    name, path = f"emberframe_{new_path(spark, 'blocks').rsplit('-', 1)[1]}", new_path(spark, "blocks")
    texts = docs.select(*raw_columns(docs), rest.alias("rest")).withColumn("row", F.monotonically_increasing_id())
    placed = texts.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), F.lit(blocks)))
    placed = placed.withColumn("size", F.octet_length("text"))
    placed.repartition(parts, "block").write.option("path", path).bucketBy(parts, "block").saveAsTable(name)
    stored = spark.table(name)
    return stored, stored.agg(F.sum("size")).first()[0] or 0


def _ordered(group: pa.Table) -> pa.Table:
    return group.sort_by([("doc_id", "ascending"), ("row", "ascending")])  # nulls come last


def _texts(group: pa.Table) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in group.column("text")]


def _flags(group: pa.Table, search: Search) -> list[np.ndarray]:
    """Per level, one flag for each of the block's sorted distinct values."""
    found = []
    group = group.sort_by([("level", "ascending"), ("range", "ascending")])
    level, count, bits = (group.column(c).to_numpy() for c in ("level", "count", "level"))
    bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("bits")]
    for k in range(search.levels):
        found.append(np.concatenate([np.empty(0, bool), *(np.unpackbits(bits[i], count=count[i]).astype(bool) for i in np.flatnonzero(level == k))]))
    return found


FLAGS = "block long, level int, range long, count int, bits binary"


def _send(search: Search, level: int):
    """What a block sends at a level: per range its distinct candidate values; at the last level also the doc_id of each one's first start."""
    last = level == search.levels - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group, out = _ordered(left), []
        block = Block.of(_texts(group))
        hashes, candidate = search.at_level(block, _flags(right, search), level)
        use = np.flatnonzero(candidate & counted(hashes, last))
        values, first = np.unique(hashes[use], return_index=True)
        number, cuts = group.column("block")[0].as_py() if group.num_rows else None, search.split(values)
        doc = np.searchsorted(block.bounds, use[first], "right") - 1
        late = group.column("doc_id").is_null().to_numpy()
        ids = np.where(late, group.column("row").to_numpy(), group.column("doc_id").fill_null(0).to_numpy()).astype(np.int64)
        for r in np.flatnonzero(np.diff(cuts)):
            part, own = values[cuts[r] : cuts[r + 1]], doc[cuts[r] : cuts[r + 1]]
            if last:
                # ids in order of documents compress well; null ids are told apart by a bit each
                out.append((r, number, len(part), part.astype("<u8").tobytes(), ids[own].astype("<i8").tobytes(), np.packbits(late[own]).tobytes()))
            else:
                out.append((r, number, len(part), (part << np.uint64(search.bits) >> np.uint64(32)).astype("<u4").tobytes(), b"", b""))
        return pa.Table.from_pylist([dict(zip(SENT.names, x)) for x in out], SENT)

    return run


SENT = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("count", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("late", pa.binary())])
SENT_SQL = "range long, block long, count int, hashes binary, ids binary, late binary"


def _answer(level: int, last: bool):
    """For one range of values: which of each block's values another block holds too; at the last level, holds in an earlier document."""

    def run(group: pa.Table) -> pa.Table:
        count = group.column("count").to_numpy()
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)])
        values = read("hashes", "<u8" if last else "<u4")
        if last:
            ids = read("ids", "<i8")
            late = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(group.column("late"), count)])
            order = np.lexsort((ids, late, values))
            flag = np.empty(len(values), bool)
            flag[order] = np.r_[False, values[order][1:] == values[order][:-1]]
        else:
            order = np.argsort(values, kind="stable")
            same = values[order][1:] == values[order][:-1]
            flag = np.empty(len(values), bool)
            flag[order] = np.r_[False, same] | np.r_[same, False]
        ends = np.cumsum(count)
        bits = [np.packbits(flag[hi - n : hi]).tobytes() for hi, n in zip(ends, count)]
        return pa.table({"block": group.column("block"), "level": pa.array([level] * len(count), pa.int32()), "range": group.column("range"), "count": group.column("count"), "bits": pa.array(bits, pa.binary())})

    return run


def _search(spark: SparkSession, stored: DataFrame, size: int, first: int, levels: int) -> tuple[Search, DataFrame]:
    """Flags of all levels, as a table in the shared folder."""
    # about a million windows a range; blocks and ranges exchange one row a pair, so ranges follow the data, not the partitions
    search = Search(first, levels, math.ceil(math.log2(max(64, size / 6 / (1 << 20)))))
    flags = spark.createDataFrame([], FLAGS)
    for level in range(levels):
        last = level == levels - 1
        sent = stored.select("block", "doc_id", "row", "text").groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_send(search, level), SENT_SQL)
        path = new_path(spark, "flags")
        sent.groupBy("range").applyInArrow(_answer(level, last), FLAGS).write.parquet(path)
        flags = flags.union(spark.read.schema(FLAGS).parquet(path))
    return search, flags


def _first_length(window: int) -> tuple[int, int]:
    """The shortest length of at least 5 words (or the window itself) that doubles to the window, and the number of levels."""
    first, levels = window, 1
    while first % 2 == 0 and first // 2 >= 5:
        first, levels = first // 2, levels + 1
    return first, levels


def _judged(docs: DataFrame, window: int, rest: Column, whole: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, rest) of every row; `whole` keeps white space of texts that lose nothing."""
    if window < 1:
        raise ValueError("a window has at least one word")
    spark = docs.sparkSession
    stored, size = bucketed(docs, rest)
    search, flags = _search(spark, stored, size, *_first_length(window))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = _ordered(left)
        texts = _texts(group)
        block, answers = Block.of(texts), _flags(right, search)
        hashes, candidate = search.at_level(block, answers, search.levels - 1)
        use = np.flatnonzero(candidate)
        _, start, index = np.unique(hashes[use], return_index=True, return_inverse=True)
        again = np.ones(len(use), bool)
        again[start] = False
        hit = use[again | answers[-1][index]]
        edge = np.zeros(len(block.words) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        words, removed, digests, kept = [], [], [], []
        for text, lo, hi in zip(texts, block.bounds, block.bounds[1:]):
            own = gone[lo:hi]
            words.append(int(hi - lo))
            removed.append(int(own.sum()))
            kept.append(text if whole and not removed[-1] else b" ".join(compress(text.split(), (~own).tolist())))
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
        columns = [group.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()), group.column("rest")]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "rest"])

    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary").add("rest", stored.schema["rest"].dataType)
    texts = stored.select("block", "doc_id", "row", "text", "rest")
    return texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(run, schema).withColumn("kept", F.col("kept").cast("string"))


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of documents.

    Words are runs of bytes other than space and \t to \r. A word is removed if a window of `window` words covers it whose
    word sequence also starts earlier: in a document of smaller doc_id, or further up in the same one. Windows are judged on the
    input. Rows of the same doc_id count in some fixed order as documents one after the other, rows with null doc_id after all
    others. Null and empty texts and texts shorter than a window lose nothing. Other columns are not looked at.
    """
    return _judged(docs, window, F.lit(None).cast("int")).drop("rest")


def cleaned(docs: DataFrame, window: int = 20) -> DataFrame:
    """The documents without words of repeated windows, in their own columns; `n_chars` is counted anew for texts that change.

    A text that loses nothing stays as it is, null included; one that loses all its words goes.
    """
    rest = F.struct(F.col("text").isNull().alias("missing"), *(docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"))
    judged = _judged(docs, window, rest, whole=True).where("n_removed = 0 or n_words > n_removed")

    def column(k: int, name: str) -> Column:
        if name == "text":
            return F.when(~F.col("rest.missing"), F.col("kept")).alias(name)
        own = F.col(f"rest.c{k}")
        changed = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(own).cast(docs.schema[name].dataType)
        return (changed if name == "n_chars" else own).alias(name)

    return judged.select(*(column(k, c) for k, c in enumerate(docs.columns)))
