"""SimHash near-duplicates: documents whose fingerprints differ in few bits, by a self-join of binary tries.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's word shingles. Equal fingerprints are merged
first. The distinct ones form a binary trie; pairs of its nodes are traversed together, carrying the bits in which their
prefixes differ, and a pair is dropped when that exceeds its budget. Two tries are joined, one on the fingerprint and one on
its halves exchanged: fingerprints at `radius` bits differ in at most radius // 2 bits in one of the halves, so that half's
budget prunes the upper levels, and node pairs stay proportional to fingerprints. The upper levels are Spark joins of node
tables, going deeper only where nodes are full; below, each node pair of bounded size is traversed in one task, which returns
a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import local_components, raw_text, slices, spread
from emberframe.llm.components import components
from emberframe.session import cut_lineage

SEED = 42  # fixed value: the seed of the shingle hash
BITS = 64
HALF = 32


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of `size` words (A-Z lower-cased), repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(size))))), np.uint64, len(words) - size + 1)


def majority_fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array: a bit is set if it is set in over half of the hashes."""
    counts = np.zeros((len(hashes), BITS), np.int64)
    flat, owner = np.concatenate([*hashes, np.empty(0, np.uint64)]), np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    for lo in range(0, len(flat), 1 << 16):
        bits = np.unpackbits(flat[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[lo : lo + (1 << 16)]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    total = np.array([len(h) for h in hashes], np.int64)
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = majority_fingerprints([shingle_hashes(t.as_buffer().to_pybytes(), shingle) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return raw_text(docs).mapInArrow(run, "doc_id long, fp long")


def allowed(depth: int, radius: int) -> int:
    """Bits in which two prefixes may differ: half of the radius within the leading half, the radius below."""
    return radius // 2 if depth <= HALF else radius


def next_depth(depth: int, step: int) -> int:
    below = min(depth + step, BITS)
    return HALF if depth < HALF < below else below


def _levels(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Trie levels under one node: each level's prefixes, and where each node's children begin in the next level."""
    levels, d = [], depth
    prefixes = np.unique(points >> np.uint64(BITS - d)) if d else np.zeros(1, np.uint64)
    while d < BITS:
        below = next_depth(d, 8)
        children = np.unique(points >> np.uint64(BITS - below))
        up = children >> np.uint64(below - d)
        levels.append((prefixes, np.searchsorted(up, np.r_[prefixes, prefixes[-1:] + np.uint64(1)], "left")))
        prefixes, d = children, below
    return [*levels, (prefixes, np.empty(0, np.int64))]


def trie_links(a: np.ndarray, b: np.ndarray, depth: int, radius: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j) of linked sorted distinct points under two nodes of a depth, in parts; b is a for a node with itself (then i < j).

    Frontiers of node pairs are cut so that no step holds many more than `most` child pairs.
    """
    same, la, lb = a is b, _levels(a, depth), _levels(b, depth)
    depths = [depth]
    while depths[-1] < BITS:
        depths.append(next_depth(depths[-1], 8))
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if depths[level] == BITS:
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        ca, cb = la[level][1], lb[level][1]
        na, nb = ca[i + 1] - ca[i], cb[j + 1] - cb[j]
        cost = np.cumsum(na * nb)
        if cost[-1] > most and len(i) > 1:
            cut = min(max(1, int(np.searchsorted(cost, cost[-1] // 2))), len(i) - 1)
            stack += [(level, i[:cut], j[:cut]), (level, i[cut:], j[cut:])]
            continue
        owner, place = spread(na * nb)
        x, y = ca[i][owner] + place // nb[owner], cb[j][owner] + place % nb[owner]
        far = np.bitwise_count(la[level + 1][0][x] ^ lb[level + 1][0][y])
        keep = far <= allowed(depths[level + 1], radius)
        if same:
            keep &= x <= y
        if keep.any():
            stack.append((level + 1, x[keep], y[keep]))


def joined(count: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable of each point, over links that come in parts: only the labels are kept."""
    label = np.arange(count)
    for i, j in parts:
        left, right = label[i], label[j]
        apart = left != right
        if apart.any():
            label = local_components(count, left[apart], right[apart])[label]
    return label


def _prefix(key: str, depth: int) -> F.Column:
    return F.shiftrightunsigned(F.col(key), BITS - depth) if depth else F.lit(0).cast("long")


def node_pairs(keys: DataFrame, count: int, radius: int, leaf: int) -> list[tuple[int, DataFrame]]:
    """Node pairs (turn, a, b) to be traversed in tasks, by depth; a <= b, both nodes hold few keys."""
    depth = min(HALF, max(0, math.ceil(math.log2(max(1, count / leaf)))))
    nodes = cut_lineage(keys.groupBy("turn", _prefix("key", depth).alias("node")).agg(F.count("*").alias("n")))
    right = nodes.select("turn", F.col("node").alias("b"), F.col("n").alias("nb"))
    near = F.array(F.lit(0).cast("long"), *(F.lit(1 << bit).cast("long") for bit in range(depth)))
    flips = near
    for _ in range(1, allowed(depth, radius)):
        flips = F.array_distinct(F.flatten(F.transform(flips, lambda x: F.transform(near, lambda y: x.bitwiseXOR(y)))))
    if not allowed(depth, radius):
        flips = F.array(F.lit(0).cast("long"))
    frontier = nodes.select("turn", F.col("node").alias("a"), F.col("n").alias("na"), F.explode(flips).alias("bit")).select(
        "turn", "a", "na", F.col("a").bitwiseXOR(F.col("bit")).alias("b")
    ).where("a <= b").join(right, ["turn", "b"])
    done = []
    while True:
        frontier = cut_lineage(frontier)
        full = F.col("na") + F.col("nb") > 8 * leaf
        if depth == BITS or not frontier.where(full).limit(1).count():
            return [*done, (depth, frontier.select("turn", "a", "b"))]
        done.append((depth, frontier.where(~full).select("turn", "a", "b")))
        below = next_depth(depth, 4)
        children = cut_lineage(keys.groupBy("turn", _prefix("key", below).alias("node")).agg(F.count("*").alias("n")))
        up = F.shiftrightunsigned("node", below - depth)
        side = lambda old, new, n: children.select("turn", up.alias(old), F.col("node").alias(new), F.col("n").alias(n))
        frontier = (
            frontier.where(full).select("turn", "a", "b").join(side("a", "x", "nx"), ["turn", "a"]).join(side("b", "y", "ny"), ["turn", "b"])
            .where((F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= allowed(below, radius)) & (F.col("x") <= F.col("y")))
            .select("turn", F.col("x").alias("a"), F.col("nx").alias("na"), F.col("y").alias("b"), F.col("ny").alias("nb"))
        )
        depth = below


def links(prints: DataFrame, radius: int = 3, leaf: int = 1024) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp): a spanning forest of every node pair's links.

    The transitive closure is that of all pairs that differ in at most `radius` bits. An empty table gives no links.
    """
    if not 0 <= radius < HALF:
        raise ValueError("radius out of range")
    one = prints.select(F.col("fp").alias("key"), F.lit(0).alias("turn"))
    two = prints.select(F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF)).alias("key"), F.lit(1).alias("turn"))
    keys, schema = cut_lineage(one.union(two)), "a long, b long"

    def run(group: pa.Table) -> pa.Table:
        key = np.sort(group.column("key").to_numpy().view(np.uint64))
        depth, turn = group.column("depth")[0].as_py(), group.column("turn")[0].as_py()
        first, last = (np.uint64(group.column(c)[0].as_py() & (2**64 - 1)) for c in ("a", "b"))
        if first == last:
            root = joined(len(key), trie_links(key, key, depth, radius))
        else:
            side = key >> np.uint64(BITS - depth) == last
            left, right = key[~side], key[side]
            key = np.concatenate([left, right])
            root = joined(len(key), ((i, j + len(left)) for i, j in trie_links(left, right, depth, radius)))
        child = np.flatnonzero(root != np.arange(len(key)))
        if turn:
            key = (key << np.uint64(HALF)) | (key >> np.uint64(HALF))
        return pa.table({"a": pa.array(key[child].view(np.int64)), "b": pa.array(key[root[child]].view(np.int64))})

    found = None
    for depth, pairs in node_pairs(keys, keys.where("turn = 0").count(), radius, leaf):
        placed = keys.withColumn("node", _prefix("key", depth))
        ends = pairs.select("turn", "a", "b", F.col("a").alias("node")).union(pairs.where("a <> b").select("turn", "a", "b", F.col("b").alias("node")))
        part = placed.join(ends, ["turn", "node"]).select("key", "turn", "a", "b", F.lit(depth).alias("depth")).groupBy("turn", "a", "b").applyInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    component_id is the smallest doc_id reachable over links of fingerprints that differ in at most `radius` bits, the
    document itself included. Null and wordless texts have fingerprint zero and are linked like any other. Fewer words than a
    shingle: the whole sequence is hashed. Repeated rows come out as often as they came in; rows with null doc_id belong to
    their component but never name it (a component of them alone has a null id). Other columns are not looked at.
    """
    own = cut_lineage(fingerprints(docs, shingle))
    prints = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(prints, radius))
    root = F.coalesce("root", "fp")
    rooted = cut_lineage(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", root.alias("root")))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(names, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One document of each component: the one that names it, once where its row is repeated. Rows with null doc_id stay."""
    kept = near_duplicates(docs, shingle, radius).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).union(docs.where("doc_id is null"))
