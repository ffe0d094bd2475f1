"""Exact top-k inner products with a pivot table.

Every vector's distances to a few pivots are computed once. The triangle inequality turns them into a lower bound of the distance
of a query and a candidate, hence an upper bound of their inner product; in each block of candidates a query evaluates them in
order of that bound and stops as soon as no bound reaches its k-th best score. Blocks of queries meet blocks of candidates, so a
task holds one of each whatever the sizes, and only k rows a query leave a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.session import cut_lineage

EXACT = float(1 << 53)
FOUND = ["row", "query_id", "vec_id", "score"]  # row is the query's


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors null or holding null or non-finite components are left out.

    Rows that repeat an id or a vector stay rows of their own; rows with null id are left out too.
    """
    usable = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null").where(usable)
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Packed rows of one length as a matrix."""
    return np.array([np.frombuffer(x.as_buffer(), kind) for x in column])


def dot(left: np.ndarray, right: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer products: in floating point while every sum fits, else in integers."""
    if largest < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    return left @ right


def best_of_block(query: np.ndarray, own: int, vectors: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int, largest: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (id, score) for a query, ties to smaller ids, and how many candidates were evaluated; `own` is the query's own place or -1."""
    order = np.argsort(-bound, kind="stable")
    at, step, seen = 0, max(64, 4 * k), 0
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    while at < len(order):
        part = order[at : at + step]
        part, at, step = part[part != own], at + step, 2 * step
        seen += len(part)
        best_ids, best = np.r_[best_ids, ids[part]], np.r_[best, dot(vectors[part], query, largest)]
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
        # a bound that only equals the k-th score may still win by its id
        if len(best) == k and at < len(order) and bound[order[at]] < best[-1]:
            break
    return best_ids, best, seen


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = 32, block: int = 1 << 14, query_block: int = 1 << 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector (vec_id, v) where `is_query` holds, the k others of highest inner product.

    `pivots` vectors, picked by a hash of their ids, are the pivot table's columns. Ties go to the smaller vec_id; a query with
    fewer candidates returns all; candidates are all other rows of the same length. Of rows that repeat an id, each is a candidate, and
    where it is a query it has its own ranks. Scores must fit a long.
    """
    if min(k, pivots, block, query_block) < 1:
        raise ValueError("sizes are positive")
    base = cut_lineage(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("length"), is_query.alias("asks")))
    count, asking = base.agg(F.count("*"), F.count_if("asks")).first()
    chosen = [np.array(r["v"], np.int64) for r in base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]  # `pivots` rows

    def distances(batches):
        for batch in batches:
            out = []
            for row in batch.column("v"):
                v = np.array(row.as_py(), np.int64)
                far = [np.sqrt(np.square((v - p).astype(np.float64)).sum()) if len(p) == len(v) else 0.0 for p in chosen]
                out.append((v.astype("<i8").tobytes(), np.array(far, "<f8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("row", "vec_id", "length", "asks")), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
                names=["row", "vec_id", "length", "asks", "v", "far"],
            )

    known = cut_lineage(base.mapInArrow(distances, "row long, vec_id long, length int, asks boolean, v binary, far binary"))
    blocks, query_blocks = max(1, math.ceil(count / block)), max(1, math.ceil(asking / query_block))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = known.select("row", "vec_id", "length", "v", "far", deal(blocks, "candidate").alias("b"), every(query_blocks).alias("q"))
    queries = known.where("asks").select("row", "vec_id", "length", "v", "far", deal(query_blocks, "query").alias("q"), every(blocks).alias("b"))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in FOUND})
        ids, x, far = held.column("vec_id").to_numpy(), matrix(held.column("v"), "<i8"), matrix(held.column("far"), "<f8")
        rows, asking = held.column("row").to_numpy(), asked.column("row").to_numpy()
        own, y, near = asked.column("vec_id").to_numpy(), matrix(asked.column("v"), "<i8"), matrix(asked.column("far"), "<f8")
        size, asked_size = (np.square(m.astype(np.float64)).sum(axis=1) for m in (x, y))
        largest = float(np.sqrt(size.max(initial=0.0) * asked_size.max(initial=0.0)))
        out = []
        for i in range(len(own)):
            least = np.zeros(len(ids))
            for p in range(len(chosen)):
                np.maximum(least, np.abs(far[:, p] - near[i, p]), out=least)
            bound = (size + asked_size[i] - np.square(least)) / 2
            bound += 1e-9 * (size + asked_size[i]) + 1e-6  # rounding of distances
            here = np.flatnonzero(rows == asking[i])
            found, scores, _ = best_of_block(y[i], int(here[0]) if len(here) else -1, x, ids, bound, k, largest)
            out.append((np.full(len(found), asking[i]), np.full(len(found), own[i]), found, scores))
        return pa.table({n: pa.array(np.concatenate(c).astype(np.int64)) for n, c in zip(FOUND, zip(*out))})

    keys = ["length", "b", "q"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, ", ".join(f"{n} long" for n in FOUND))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Top k among all rows for those whose vec_id is divisible by `every`, as `quantised` and `top_k` define them; an empty table gives no rows."""
    return top_k(quantised(vectors), F.col("vec_id") % every == 0, k)
