"""Near copies by their shingles: one document stays of each group linked by a Jaccard likeness of `least` or more.

Texts with one set of shingles form a class. Each class has `BANDS` independently seeded 64-bit fingerprints, each of the minima of
`ROWS` hashes of its shingles; two sets of likeness 0.8 agree in one of them with probability 0.9996. A link counts if the sets
themselves are as alike as asked. Of the classes that share a fingerprint each is compared with one of them first, which is another one
for each `REPRESENTATIVES`-th fingerprint. Where they are not all one component by then, they are compared with another one. What is
left after that is searched by rare hashes (`candidates`), which finds every pair as alike as asked: a pair is passed over only if
links join it already, or if the sizes and the hashes that come first in both rule the likeness out.

Another operator's near-duplicates (`also`) are proposals too: its components are one more fingerprint of a class, and sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions.small import by_group
from emberframe.llm.common import raw_text, slices
from emberframe.llm.components import components
from emberframe.llm.trie_join import shingle_hashes
from emberframe.session import cut_lineage

Also = Callable[[DataFrame], DataFrame]
BANDS, ROWS, REPRESENTATIVES, ROUNDS = 20, 5, 4, 2
STEP = 1.05
_DRAW = np.random.Generator(np.random.PCG64(5))
FACTORS, MIXERS = (_DRAW.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of sets of hashes, none of them empty: one row a set."""
    keys = np.zeros((len(sets), BANDS), np.uint64)
    if sets:
        flat, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
        for band in range(BANDS):
            for factor, mixer in zip(FACTORS[band], MIXERS[band]):
                keys[:, band] += np.minimum.reduceat(flat * factor, first) * mixer
    return keys


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h): h is a hash of the text, so id and h name a row whatever the partitioning."""
    return raw_text(docs).withColumn("h", F.xxhash64("text"))


def unique_hashes(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, set, keys) of every text; without words, set is 0 and there are no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            sets = [unique_hashes(t.as_buffer().to_pybytes(), shingle) for t in part.column("text")]
            sizes = np.array([len(s) for s in sets])
            keys = band_keys([s for s in sets if len(s)])
            names = [xxhash.xxh64_intdigest(s.tobytes(), 5) if len(s) else 0 for s in sets]
            ends = pa.array(np.r_[0, np.cumsum(BANDS * (sizes > 0))].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("h"), pa.array(np.array(names, np.uint64).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel()))],
                names=["doc_id", "h", "set", "keys"],
            )

    return keyed(docs).mapInArrow(run, "doc_id long, h long, set long, keys array<long>")


def hash_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(set, hashes) of rows (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            sets = [unique_hashes(t.as_buffer().to_pybytes(), shingle) for t in part.column("text")]
            ends = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("set"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["set", "hashes"])

    return texts.select("set", "text").mapInArrow(run, "set long, hashes array<long>")


def hashes_of(docs: DataFrame, classes: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """(set, hashes) of the classes (set, h, keys) that `named` lists, taken again from one text of each."""
    wanted = classes.join(named, "set", "left_semi").select("set", "h")
    texts = keyed(docs).select("h", "text").join(wanted, "h").dropDuplicates(["set"])
    return cut_lineage(hash_sets(texts, shingle))


def alike_pairs(pairs: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets have at least the likeness."""
    members = pairs.join(hashes.withColumnsRenamed({"set": "a"}), "a")
    others = hashes.withColumnsRenamed({"set": "b", "hashes": "of_b"}).join(pairs.select("b").distinct(), "b", "left_semi")
    both, size = F.size(F.array_intersect("hashes", "of_b")), F.size("hashes") + F.size("of_b")
    return cut_lineage(by_group(members, others, ["b"], F.col("a"), 4).where(both >= F.lit(least) * (size - both)).select("a", "b"))


def candidates(hashes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of classes of different roots, among them all that are as alike as asked.

    With a set's hashes ordered by how many classes hold them, rarest first, two sets that share at least `o` hashes share one that is
    among the first `size - o + 1` of either. `o` follows from both sizes, so sizes are dealt over steps of `STEP`: the smaller set
    of a pair offers its hashes at its own step, the larger one asks for each step that its partners can have. A passage that many
    classes hold comes last in all of them and brings none together that differ in the rest.
    """
    share = least / (1 + least)
    needed = lambda sizes: F.ceil(F.lit(share) * sizes - 1e-9)
    step = lambda size: F.floor(F.log(size.cast("double")) / math.log(STEP) + 1e-9).cast("int")
    rows = hashes.select("set", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    held = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    own = W.partitionBy("set")
    placed = by_group(rows, held, ["hash"], F.col("set"), 4).withColumn("at", F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "hash")) - 1)
    size = F.col("size")
    first = cut_lineage(placed.where(F.col("at") <= size - F.ceil(F.lit(least) * size - 1e-9)).join(roots, "set").select("set", "root", "size", "hash", "at"))
    offered = first.where(F.col("at") <= size - needed(2 * size)).withColumn("step", step(size)).toDF("b", "of", "size_b", "hash", "at_b", "step")
    below = F.sequence(F.lit(0), F.lit(math.ceil(-math.log(least) / math.log(STEP)) + 1))
    asked = first.withColumn("step", F.explode(F.transform(below, lambda n: step(size) - n)))
    smallest = F.ceil(F.pow(F.lit(STEP), F.col("step").cast("double")) * (1 - 1e-6))
    asked = asked.where(F.col("at") <= size - needed(size + F.least(smallest, size))).withColumnRenamed("set", "a")
    sizes = F.col("size") + F.col("size_b")
    fits = (F.col("at") <= F.col("size") - needed(sizes)) & (F.col("at_b") <= F.col("size_b") - needed(sizes)) & (F.col("size_b") >= F.lit(least) * size - 1e-9)
    ordered = (F.col("size_b") < size) | (F.col("size_b") == size) & (F.col("b") < F.col("a"))
    return asked.join(offered, ["hash", "step"]).where((F.col("root") != F.col("of")) & ordered & fits).select("a", "b").distinct()


def labelled(keys: DataFrame, found: DataFrame) -> DataFrame:
    """(band, key, set, root) of the buckets that hold classes of several components."""
    roots = components(found).withColumnRenamed("node", "set")
    rooted = keys.join(roots, "set", "left").select("band", "key", "set", F.coalesce("root", "set").alias("root"))
    mixed = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "key")
    return cut_lineage(by_group(rooted, mixed, ["band", "key"], F.col("set"), 4).select("band", "key", "set", "root"))


def links(docs: DataFrame, classes: DataFrame, shingle: int, least: float, further: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of classes (set, h, keys) whose sets have at least the likeness, so that all such pairs with a common fingerprint are joined.

    `further` are more fingerprints (set, band, key) of classes.
    """
    left = classes.select("set", F.posexplode("keys").alias("band", "key"))
    left = left if further is None else left.union(further)
    left = left.withColumn("root", F.col("set"))
    found = None
    for number in range(ROUNDS):
        lot = F.xxhash64("set", F.col("band") % REPRESENTATIVES, *([F.lit(number)] * bool(number)))
        heads = left.groupBy("band", "key").agg(F.min(F.struct(lot, "set", "root")).alias("head"), F.count("*").alias("n")).where("n > 1")
        heads = heads.select("band", "key", F.col("head.set").alias("b"), F.col("head.root").alias("of"))
        met = by_group(left, heads, ["band", "key"], F.col("set"), 4).where("root <> of").select(F.col("set").alias("a"), "b")
        pairs = cut_lineage(met.distinct())
        named = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
        part = alike_pairs(pairs, hashes_of(docs, classes, named, shingle), least)
        found = part if found is None else found.union(part)
        left = labelled(left.select("set", "band", "key"), found)
        if left.isEmpty():
            return found
    roots = cut_lineage(left.select("set", "root").distinct())
    hashes = hashes_of(docs, classes, roots.select("set"), shingle)
    return found.union(alike_pairs(cut_lineage(candidates(hashes, roots, least)), hashes, least))


def proposed(sets: DataFrame, near: DataFrame) -> DataFrame:
    """(set, band, key): as a further band, the components that `near` gives texts, where doc_id is the hash of a text."""
    texts = sets.where("set <> 0").select("h", "set").distinct()
    pairs = near.select(F.col("doc_id").alias("h"), F.col("component_id").alias("key")).distinct()
    return texts.join(pairs, "h").select("set", F.lit(BANDS).alias("band"), "key").distinct()


def grouped(docs: DataFrame, shingle: int, least: float, also: Also | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, set) of every row, and (set, root) of every class, where classes of one root are linked."""
    sets = cut_lineage(shingle_sets(docs, shingle))
    classes = cut_lineage(sets.groupBy("set").agg(F.min("h").alias("h"), F.first("keys").alias("keys")))
    further = None if also is None else cut_lineage(proposed(sets, also(keyed(docs).select(F.col("h").alias("doc_id"), "text"))))
    roots = components(links(docs, classes, shingle, least, further)).withColumnRenamed("node", "set")
    return sets.drop("keys"), cut_lineage(classes.select("set").join(roots, "set", "left").select("set", F.coalesce("root", "set").alias("root")))


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every document: the smallest doc_id reachable over links, the document itself included.

    Null and wordless texts are one class. Fewer words than a shingle: the whole sequence is one. Repeated rows come out as often
    as they came in; rows with null doc_id belong to their component but never name it.
    """
    sets, rooted = grouped(docs, shingle, least)
    firsts = sets.groupBy("set").agg(F.min("doc_id").alias("first")).join(rooted, "set")
    names = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    return by_group(sets, rooted.join(names, "root").select("set", "component_id"), ["set"], F.col("h") + F.coalesce("doc_id", F.lit(0))).select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, also: Also | None = None) -> DataFrame:
    """One row of each component: that of smallest doc_id, null ids last, then of smallest hash of its text.

    `also` takes (doc_id, text), where doc_id is a hash of the text, and gives each text a component_id; texts of one are compared too.
    Rows are told apart by id and text, so distinct texts that share an id are kept or dropped each on its own. Of rows that share
    both, the one whose columns have the smallest hash stays.
    """
    sets, rooted = grouped(docs, shingle, least, also)
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h"))
    firsts = sets.groupBy("set").agg(F.min(name).alias("name")).join(rooted, "set").groupBy("root").agg(F.min("name").alias("name")).select("name.*")
    times = sets.groupBy(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h").agg(F.count("*").alias("times"))
    keys = ["_none", "_id", "_h"]
    kept = cut_lineage(firsts.join(times, ["none", "id", "h"]).toDF(*keys, "times"))
    own, text = F.struct(*(docs[c] for c in docs.columns)), F.coalesce(docs["text"].cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(own.alias("_row"), docs["doc_id"].isNull().alias("_none"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("_id"), F.xxhash64(text).alias("_h"))
    once = by_group(rows, kept.where("times = 1"), keys, F.monotonically_increasing_id(), 4).select("_row")
    again = by_group(rows, kept.where("times > 1"), keys, F.monotonically_increasing_id(), 4)
    again = again.groupBy(*keys).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    return once.union(again).select("_row.*")
