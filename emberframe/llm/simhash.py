"""Document fingerprints: weighted SimHash, and permuted block tables to find the near ones.

Terms are pairs of neighbouring words, weighted by 1 + log2 of their count. Every bit of a fingerprint is the sign of the weighted
votes of the terms' hashes. To find all fingerprints within a Hamming radius, the bits are cut into radius + 1 blocks: two near
fingerprints agree in at least one whole block, so in the table that has this block in front they meet on an equal key.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import lean_batches, parallelism

BITS = 256
WORDS = BITS // 64


def fingerprint(text: str) -> bytes:
    """The SimHash of a whole text; without words all bits are 0."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return bytes(BITS // 8)
    terms = Counter(map(b" ".join, zip(words, words[1:]))) if len(words) > 1 else Counter(words)
    digest = xxhash.xxh3_128_digest
    hashes = b"".join([digest(t, 1) + digest(t, 2) for t in terms])
    weights = 1 + np.log2(np.fromiter(terms.values(), np.float32, len(terms)))
    votes = np.zeros(BITS, np.float64)
    step = 1 << 14
    for lo in range(0, len(weights), step):
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8, min(step, len(weights) - lo) * BITS // 8, lo * BITS // 8)).reshape(-1, BITS)
        votes += weights[lo : lo + step] @ bits.astype(np.float32)
    return np.packbits(2 * votes > weights.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum()) / BITS


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many first ones of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _part(key: str, edges: list[int]) -> Column:
    """How many descending edges lie above the key; two levels, so a row compares with few of many edges."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges)) + 1
    heads = edges[::step]
    groups = F.array(*(F.array(*(F.lit(e).cast("long") for e in edges[lo : lo + step])) for lo in range(0, len(edges), step)))
    above = lambda found: F.size(F.filter(found, lambda e: e > F.col(key)))
    group = above(F.array(*(F.lit(e).cast("long") for e in heads)))
    return F.when(group == 0, 0).otherwise((group - 1) * step + above(F.element_at(groups, F.greatest(group, F.lit(1)))))


def in_order(docs: DataFrame) -> DataFrame:
    """Texts dealt to partitions by descending doc_id, each with a copy of the document that follows its last one (`guest`).

    Bounds are quantiles of the ids, one a partition; only ids are read to find them and each partition's first document.
    """
    lean_batches(docs.sparkSession)
    parts = parallelism(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.select("doc_id").where("doc_id is not null")
    found = known.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5])).first()[0] or []
    edges = sorted({int(e) for e in found}, reverse=True)
    firsts = {r["part"]: r["first"] for r in known.groupBy(_part("doc_id", edges).alias("part")).agg(F.max("doc_id").alias("first")).collect()}  # one row a partition
    order = sorted(firsts)
    before = {firsts[p]: order[k - 1] for k, p in enumerate(order)}  # the first document of all follows the last partition's
    place = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).otherwise(_part("doc_id", edges))
    own = F.struct(place.alias("part"), F.lit(False).alias("guest"))
    if before:
        to = F.element_at(F.create_map(*(F.lit(x) for first, p in before.items() for x in (first, p))), F.col("doc_id"))
        guest = F.when(F.col("doc_id").isin(list(before)), F.array(own, F.struct(to.alias("part"), F.lit(True).alias("guest"))))
        own_only = F.array(own)
        rows = rows.select("doc_id", "text", F.explode(F.coalesce(guest, own_only)).alias("at"))
    else:
        rows = rows.select("doc_id", "text", own.alias("at"))
    rows = rows.select("doc_id", "text", F.col("at.part").alias("part"), F.col("at.guest").alias("guest"))
    return rows.repartitionById(max(parts, len(edges) + 1), "part").sortWithinPartitions(F.col("doc_id").isNull(), "guest", F.desc("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text takes its second half from the document that follows by descending doc_id (after the last one: the first).
    Null texts count as empty; rows of one doc_id follow each other in order of their texts; a row with null doc_id has no place
    in the order and follows itself, as a single document does. Likeness is the share of equal bits. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out: list[tuple] = []
            for doc, text, guest in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("guest").to_pylist()):
                if guest and waiting is None:
                    continue
                text = text.as_py()
                here = (doc, text, fingerprint(text))
                if waiting is not None and (guest or doc is not None):
                    out.append(_row(waiting, here))
                    waiting = None
                if doc is None:
                    out.append(_row(here, here))
                elif not guest:
                    waiting = here
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in out], SCHEMA)

    return in_order(docs).select("doc_id", "text", "guest").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(here: tuple, following: tuple) -> tuple:
    doc, text, own = here
    changed = edited(text, following[1])
    other = fingerprint(changed)
    return doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, following[2])


def _word(name: str, k: int) -> Column:
    return F.conv(F.substring(name, 16 * k + 1, 16), 16, -10).cast("long")


def near(prints: DataFrame, queries: DataFrame, radius: int = 7) -> DataFrame:
    """(query, fingerprint, bits): for each distinct fingerprint of `queries`, all distinct ones of `prints` at `radius` bits or less.

    Both frames have a column `fingerprint` (hex); nulls are left out. A pair is reported by the first table in which it meets.
    """
    digits, tables = BITS // 4, radius + 1
    edges = [digits * k // tables for k in range(tables + 1)]
    if not 0 <= radius < digits:
        raise ValueError("a block needs at least four bits")
    keys = F.array(*(F.substring("fingerprint", lo + 1, hi - lo) for lo, hi in zip(edges, edges[1:])))
    blocks = lambda frame: frame.select("fingerprint").where("fingerprint is not null").distinct().select("fingerprint", F.posexplode(keys).alias("table", "key"))
    left = blocks(queries).withColumnRenamed("fingerprint", "query")
    pairs = left.join(blocks(prints), ["table", "key"])
    bits = sum((F.bit_count(_word("query", k).bitwiseXOR(_word("fingerprint", k))) for k in range(WORDS)), F.lit(0))
    cut = lambda name: F.array(*(F.substring(name, lo + 1, hi - lo) for lo, hi in zip(edges, edges[1:])))
    first = F.array_position(F.zip_with(cut("query"), cut("fingerprint"), lambda a, b: a == b), True) - 1
    return pairs.where(first == F.col("table")).select("query", "fingerprint", bits.cast("int").alias("bits")).where(F.col("bits") <= radius)


def count_near(prints: DataFrame, asks: Column, radius: int = 7) -> DataFrame:
    """`prints` with n_near: for rows where `asks` holds, how many other rows' fingerprints are within the radius; null elsewhere.

    Copies are counted through their one fingerprint and never expanded. `prints` should be a stored table, as it is read often.
    """
    asked = prints.where(F.coalesce(asks, F.lit(False)))
    sizes = prints.groupBy("fingerprint").agg(F.count("*").alias("size"))
    counts = near(prints, asked, radius).join(sizes, "fingerprint").groupBy(F.col("query").alias("fingerprint")).agg((F.sum("size") - 1).alias("n_near"))
    told = asked.join(counts, "fingerprint", "left").select(*prints.columns, "n_near")
    return told.union(prints.where(~F.coalesce(asks, F.lit(False))).withColumn("n_near", F.lit(None).cast("long")))
