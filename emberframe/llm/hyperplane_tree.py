"""Hard negatives by a multiway hyperplane tree with distance ranges between sibling subtrees.

One more coordinate gives all rows the norm of the longest, so a score is a distance: d^2 = |q|^2 + M^2 - 2 score, and a window of
scores is an annulus around the query. Each node holds `FAN` split points; a row belongs to the nearest, and every point keeps the
least and greatest distance to each sibling's subtree. A subtree goes if, by one point, its range cannot meet the query's annulus.
The tree's upper part is broadcast (at most FAN ** DEPTH leaves, whatever the rows), rows of a leaf lie in chunks of bounded size with
a node of their own, and what is left is compared exactly. Each search first asks the query's own leaf, whose k-th score narrows the annulus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import spread
from emberframe.session import cut_lineage

FAN, DEPTH = 16, 3
EXACT = float(1 << 53)
ANY = 1 << 62  # beyond every score
ROW = "row long, vec_id long, label long, length int, v binary"


def usable_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, label, length, v): floor(scale * x) of each component, packed; `row` tells repeated rows apart, in a copy.

    Rows with null vec_id, label or vector, or with null or non-finite components are left out.
    """
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where("vec_id is not null and label is not null and e is not null").where(finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            packed = [np.array(e, "<i8").tobytes() for e in batch.column("e").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(packed))), batch.column("vec_id"), batch.column("label"), pa.array([len(p) // 8 for p in packed], pa.int32()), pa.array(packed, pa.binary())],
                names=["row", "vec_id", "label", "length", "v"],
            )
            row += len(packed)

    return rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale)).alias("e")).mapInArrow(run, ROW)


def matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), length)


def raised(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the coordinate that brings their squared norm to `top`."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(top - np.square(x).sum(axis=1, keepdims=True), 0))])


def apart(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of rows and points."""
    square = np.square(x).sum(axis=1)[:, None] + np.square(points).sum(axis=1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def split_points(x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """FAN rows far from one another, out of three times as many drawn; where there are fewer rows, the last is repeated."""
    x = x[draw.permutation(len(x))[: 3 * FAN]]
    chosen, far = [0], apart(x, x[:1])[:, 0]
    while len(chosen) < min(FAN, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, apart(x, x[chosen[-1:]])[:, 0])
    return x[(chosen + chosen[-1:] * FAN)[:FAN]]


def ranges(distances: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of each point (rows) to each child's rows (columns); (inf, -inf) for a child without rows."""
    low, high = np.full((FAN, FAN), np.inf), np.full((FAN, FAN), -np.inf)
    for j in np.unique(child):
        low[:, j], high[:, j] = distances[child == j].min(axis=0), distances[child == j].max(axis=0)
    return low, high


def bounds(distances: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and child the least and greatest distance that the ranges allow; (inf, -inf) for a child without rows."""
    d = distances[:, :, None]
    return np.maximum(d - high, low - d).max(axis=1), (d + high).min(axis=1)


def radius(square: np.ndarray, top: float, score: np.ndarray) -> np.ndarray:
    """Distance of a query of the given squared norm to rows of a score."""
    return np.sqrt(np.maximum(square + top - 2.0 * score, 0))


def lowest(rows: DataFrame, count: int, most: int) -> DataFrame:
    """Few more than the `most` of `count` rows whose `row` has the smallest hash: all rows below a bound of it.

    A limited sort sends the driver as many rows of each partition as it asks for in all, whatever it keeps of them.
    """
    wanted, share, lot = min(most, count), (most + 8 * math.sqrt(most)) / max(count, 1), F.xxhash64("row")
    while share < 1:
        below = rows.where(lot < math.floor((share - 0.5) * 2.0**64))
        if below.select("row").count() >= wanted:
            return below
        share *= 2
    return rows


@dataclass
class Tree:
    """The broadcast part for vectors of one length: split points by level, and ranges once all rows are placed."""

    top: float
    points: list[np.ndarray] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, sample: np.ndarray, top: float, depth: int) -> Tree:
        draw, tree, x = np.random.Generator(np.random.PCG64(13)), cls(top), raised(sample, top)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            points = np.full((FAN**level, FAN, x.shape[1]), np.inf)  # a node the sample does not reach keeps its rows in its first child
            for k in np.unique(node):
                points[k] = split_points(x[node == k], draw)
            tree.points.append(points)
            node = tree.child(x, node, level)[0]
        return tree

    def child(self, x: np.ndarray, node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The child of each row's node that takes it, and the row's distances to the node's points."""
        distances = np.full((len(x), FAN), np.inf)
        for k in np.unique(node):
            if np.isfinite(self.points[level][k, 0, 0]):
                distances[node == k] = apart(x[node == k], self.points[level][k])
        return node * FAN + distances.argmin(axis=1), distances

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, and its distances to the points on its way down."""
        x, node, seen = raised(x, self.top), np.zeros(len(x), np.int64), []
        for level in range(len(self.points)):
            node, distances = self.child(x, node, level)
            seen.append(distances)
        return node, np.hstack(seen) if seen else np.empty((len(x), 0))

    def measure(self, leaves: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> None:
        """Ranges from those of the leaves that hold rows."""
        depth = len(self.points)
        for level in range(depth):
            here = slice(level * FAN, (level + 1) * FAN)
            for name, seen, empty, ufunc in (("low", least, np.inf, np.minimum), ("high", greatest, -np.inf, np.maximum)):
                table = np.full((FAN ** (level + 1), FAN), empty)
                ufunc.at(table, leaves // FAN ** (depth - level - 1), seen[:, here])
                getattr(self, name).append(table.reshape(FAN**level, FAN, FAN).transpose(0, 2, 1))

    def route(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs whose ranges meet the annuli from `near` to `far`."""
        q = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        asks, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level, points in enumerate(self.points):
            known = np.isfinite(points[:, 0, 0])
            distances = np.full((len(q), *points.shape[:2]), np.inf)
            distances[:, known] = apart(q, points[known].reshape(-1, points.shape[2])).reshape(len(q), -1, FAN)
            next_asks, next_node = [], []
            for at in range(0, len(asks), 1 << 12):
                a, n = asks[at : at + (1 << 12)], node[at : at + (1 << 12)]
                with np.errstate(invalid="ignore"):
                    least, greatest = bounds(distances[a, n], self.low[level][n], self.high[level][n])
                # points at infinity rule nothing out: their comparisons are with nan
                row, child = np.nonzero(~(least > far[a, None]) & ~(greatest < near[a, None]) & np.isfinite(self.high[level][n]).any(axis=1) | ~known[n, None] & (np.arange(FAN) == 0))
                next_asks.append(a[row])
                next_node.append(n[row] * FAN + child)
            asks, node = np.concatenate([*next_asks, asks[:0]]), np.concatenate([*next_node, node[:0]])
        return asks, node


@dataclass
class Chunk:
    """Rows of a leaf under one more node, searched exactly."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    top: float

    def best(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, lows: np.ndarray, highs: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """(query, window, id, score, evaluated): the k best rows of each query and window, and the products taken by all."""
        lifted = raised(self.x, self.top)
        points = lifted[np.linspace(0, len(lifted) - 1, FAN).astype(int)]
        distances = apart(lifted, points)
        child = distances.argmin(axis=1)
        square = np.square(q.astype(np.float64)).sum(axis=1)
        slack = 1e-6 * (math.sqrt(self.top) + np.sqrt(square)) + 1e-6
        to_points = apart(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]), points)
        least, greatest = bounds(to_points, *ranges(distances, child))
        near, lows, windows = radius(square, self.top, highs.max(axis=1)) - slack, lows.copy(), lows.shape[1]
        found, evaluated = [np.empty(0, np.int64)] * 4, 0
        exact = self.top < EXACT
        x, y = (self.x.astype(np.float64), q.astype(np.float64)) if exact else (self.x, q)
        for j in np.argsort(least.mean(axis=0)):
            far = radius(square, self.top, lows.min(axis=1)) + slack
            asks, rows = np.flatnonzero((least[:, j] <= far) & (greatest[:, j] >= near)), np.flatnonzero(child == j)
            for lo in range(0, len(asks), max(1, (1 << 21) // max(len(rows), 1))):
                some = asks[lo : lo + max(1, (1 << 21) // max(len(rows), 1))]
                scores = (y[some] @ x[rows].T).astype(np.int64)
                evaluated += scores.size
                fits = ((self.labels[rows] == label[some, None]) == same) & (self.ids[rows] != own[some, None])
                for w in range(windows):
                    a, r = np.nonzero(fits & (scores >= lows[some, w, None]) & (scores <= highs[some, w, None]))
                    found = [np.r_[c, n] for c, n in zip(found, (some[a], np.full(len(a), w), self.ids[rows[r]], scores[a, r]))]
                order = np.lexsort((found[2], -found[3], found[1], found[0]))
                group, size = np.unique(found[0][order] * windows + found[1][order], return_counts=True)
                order = order[spread(size)[1] < k]
                found = [c[order] for c in found]
                full = group[size >= k]
                np.maximum.at(lows, (full // windows, full % windows), found[3][np.cumsum(np.minimum(size, k))[size >= k] - 1])
        return *found, evaluated


class Forest:
    """All rows under one tree a length, as a table of leaves, with what the driver keeps of it."""

    def __init__(self, rows: DataFrame, leaf_rows: int = 4096, chunk: int = 8192, fit_rows: int = 16_384):
        spark = rows.sparkSession
        self.rows, self.chunk = rows, chunk

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("length"), pa.array([float(np.square(np.frombuffer(x.as_buffer(), "<i8").astype(np.float64)).sum()) for x in batch.column("v")])], names=["length", "square"])

        # vectors of a length that the sample does not show lie in one leaf
        count = rows.count()
        top = rows.select("length", "v").mapInArrow(squares, "length int, square double").agg(F.max("square")).first()[0] or 0.0
        depth = min(DEPTH, max(1, math.ceil(math.log(max(count / leaf_rows, 1.0), FAN))))
        sample: dict[int, list[bytes]] = {}
        for r in lowest(rows, count, fit_rows).select("length", "v", "row").orderBy(F.xxhash64("row"), "row").limit(fit_rows).collect():  # `fit_rows` rows
            sample.setdefault(r["length"], []).append(bytes(r["v"]))
        self.top = float(top)
        self.trees = {n: Tree.of(np.frombuffer(b"".join(v), "<i8").reshape(len(v), n), self.top, depth) for n, v in sample.items()}
        shared = spark.sparkContext.broadcast(self.trees)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = batch.column("length").to_numpy()
                leaf, seen = np.zeros(len(lengths), np.int64), np.zeros((len(lengths), depth * FAN))
                for n in np.unique(lengths):
                    here = np.flatnonzero(lengths == n)
                    if n in shared.value:
                        leaf[here], seen[here] = shared.value[n].place(matrix(batch.column("v").take(pa.array(here)), n))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(leaf), pa.array(list(seen))], names=[*batch.schema.names, "leaf", "seen"])

        placed = cut_lineage(rows.mapInArrow(place, f"{ROW}, leaf long, seen array<double>"))
        each = lambda f: F.array(*(f(F.col("seen")[k]) for k in range(depth * FAN)))
        leaves = placed.groupBy("length", "leaf").agg(F.count("*").alias("n"), each(F.min).alias("least"), each(F.max).alias("greatest")).collect()  # FAN ** DEPTH a length
        for n, tree in self.trees.items():
            own = [r for r in leaves if r["length"] == n]
            tree.measure(np.array([r["leaf"] for r in own]), np.array([r["least"] for r in own], float), np.array([r["greatest"] for r in own], float))
        self.sizes = spark.createDataFrame([(r["length"], r["leaf"], math.ceil(r["n"] / chunk)) for r in leaves], "length int, leaf long, chunks int")
        self.held = placed.drop("seen")

    def routed(self, asked: DataFrame) -> DataFrame:
        """The queries, once for each leaf that may hold rows of their windows."""
        shared, top = self.rows.sparkSession.sparkContext.broadcast(self.trees), self.top

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                lengths = batch.column("length").to_numpy()
                for n in np.unique(lengths):
                    here = np.flatnonzero(lengths == n)
                    for lo in range(0, len(here), 128):
                        some = table.take(pa.array(here[lo : lo + 128]))
                        asks, leaf = np.arange(some.num_rows), np.zeros(some.num_rows, np.int64)
                        if n in shared.value:
                            q = matrix(some.column("v"), n)
                            square = np.square(q.astype(np.float64)).sum(axis=1)
                            slack = 1e-6 * (math.sqrt(top) + np.sqrt(square)) + 1e-6
                            near = np.array([max(x) for x in some.column("highs").to_pylist()], float)
                            far = np.array([min(x) for x in some.column("lows").to_pylist()], float)
                            asks, leaf = shared.value[n].route(q, radius(square, top, near) - slack, radius(square, top, far) + slack)
                        out = some.take(pa.array(asks))
                        yield from out.set_column(out.schema.get_field_index("leaf"), "leaf", pa.array(leaf)).to_batches()

        return asked.mapInArrow(run, asked.schema)

    def best(self, asked: DataFrame, same: bool, k: int, queries: int = 16_384) -> DataFrame:
        """(row, own, w, tag, high, id, score, rank): the k best of each query's w-th window in the leaves it names.

        A chunk of a leaf meets the queries sent there in lots of `queries`: only leaves that more queries name are copied. What is broadcast
        is the numbers of lots and chunks; without the hint the planner may take a table of vectors instead.
        """
        top = self.top
        asked = cut_lineage(asked)
        lots = F.broadcast(asked.groupBy("length", "leaf").agg(F.ceil(F.count("*") / queries).cast("int").alias("lots")))  # FAN ** DEPTH rows a length
        sizes = F.broadcast(self.sizes)
        deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(lots, ["length", "leaf"]).withColumn("lot", deal("lots")).join(sizes, ["length", "leaf"]).withColumn("chunk", every("chunks")).drop("lots", "chunks")
        right = self.held.join(sizes, ["length", "leaf"]).withColumn("chunk", deal("chunks")).join(lots, ["length", "leaf"]).withColumn("lot", every("lots")).drop("lots", "chunks")

        def run(asks: pa.Table, held: pa.Table) -> pa.Table:
            names = ("row", "own", "w", "tag", "high", "id", "score")
            if not asks.num_rows or not held.num_rows:
                return pa.table({n: pa.array([], pa.int64()) for n in names})
            n = asks.column("length")[0].as_py()
            column = lambda t, c: t.column(c).to_numpy()
            wide = max(len(x) for x in asks.column("lows").to_pylist())
            pad = lambda c, empty: np.array([x + [empty] * (wide - len(x)) for x in asks.column(c).to_pylist()], np.int64)
            highs, tags = pad("highs", -ANY), pad("tags", 0)
            lows = np.where(highs == -ANY, ANY, pad("lows", ANY))
            chunk = Chunk(matrix(held.column("v"), n), column(held, "vec_id"), column(held, "label"), top)
            q, w, ids, scores, _ = chunk.best(matrix(asks.column("v"), n), column(asks, "vec_id"), column(asks, "label"), lows, highs, same, k)
            return pa.table(dict(zip(names, (column(asks, "row")[q], column(asks, "vec_id")[q], w, tags[q, w], highs[q, w], ids, scores))))

        keys = ["length", "leaf", "chunk", "lot"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "row long, own long, w long, tag long, high long, id long, score long")
        place = F.row_number().over(Window.partitionBy("row", "w").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    def search(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """As `best`, over all leaves that matter: the k-th score in a query's own leaf is a lower end for its window."""
        home = cut_lineage(self.best(asked, same, k))
        kth = home.where(F.col("rank") == k).groupBy("row").agg(F.collect_list(F.struct("w", "score")).alias("kth"))
        raised_low = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.get(F.filter("kth", lambda x: x["w"] == w), F.lit(0))["score"], low)))
        narrowed = asked.join(kth.hint("merge"), "row", "left").withColumn("lows", raised_low).select(*asked.columns)
        return self.best(self.routed(narrowed), same, k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, margin: int = 80, scale: int = 256, **sizes: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, embedding, label) that anchor.

    An anchor's positives are its best rows of the same label; its negatives, for each positive, the best rows of another label that
    score between `margin` hundredths of the positive's score and that score itself. Ties go to the smaller vec_id. Rows with null
    vec_id, label or vector or a null or non-finite component take no part. Rows that repeat an id are rows of their own, but never
    partners of rows with their id. Vectors of different lengths never meet. Scores must fit a long.
    """
    forest = Forest(cut_lineage(usable_rows(vectors, scale)), **sizes)
    anchors = cut_lineage(forest.held.where(is_anchor))
    one = lambda x: F.array(F.lit(x).cast("long"))
    first = cut_lineage(forest.search(anchors.withColumns({"tags": one(0), "lows": one(-ANY), "highs": one(ANY)}), True, positives))
    # 80 p <= 100 n <= 100 p has solutions for p >= 0 alone
    windows = first.where("score >= 0").groupBy("row").agg(F.collect_list(F.struct("id", "score")).alias("w"))
    low = F.expr(f"transform(w, x -> (x.score * {margin} + 99) div 100)")
    asked = anchors.join(windows.hint("merge"), "row").withColumns({"tags": F.col("w.id"), "highs": F.col("w.score"), "lows": low}).drop("w")
    found = forest.search(asked, False, negatives)
    return found.select(F.col("own").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))
