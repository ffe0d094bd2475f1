"""Running totals and neighbours where a sketch comes out otherwise each time it is made, as it does on several executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberframe.functions.order import cumulative
from emberframe.operators.neighbours import nearest_information

N = 200_000


@pytest.fixture
def unsteady(spark):
    """A table whose rows come in another order at each reading; no stage is shared, so each use of a sketch makes its own.

    A sketch sorts 50,000 values at a time, so the order matters only in a larger table.
    """

    def shuffled(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng().permutation(batch.num_rows)))

    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(N))
    rows = spark.range(0, N, 1, 1).select("id", (F.col("id") * 7919 % N).alias("v"), F.lit(1).alias("n"), (F.col("id") % 2).alias("target"))
    yield rows.mapInArrow(shuffled, rows.schema)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_totals_hold_when_edges_would_differ(unsteady):
    found = cumulative(unsteady, [], "v", ["n"])
    assert found.where("cum_n <> v + 1").count() == 0 and found.count() == N


def test_neighbours_hold_when_edges_would_differ(unsteady, monkeypatch):
    # tables that the library cuts are read back in the order written, so here they are not cut but for the edges
    table = nearest_information.__globals__
    monkeypatch.setitem(table, "cut_lineage", lambda df: df)
    (row,) = nearest_information(unsteady, [], "v", resolution=1.0).collect()
    # values 0 to N - 1 in two classes by parity (7919 is odd, N even): the third neighbour of a class is 4 away, so within 3 on
    # either side lie 7 rows with the row itself, fewer near the ends
    v = np.arange(N)
    away = np.where(np.minimum(v, N - 1 - v) >= 4, 4, np.where(np.minimum(v, N - 1 - v) >= 2, 4, 6))
    near = np.minimum(v + away - 1, N - 1) - np.maximum(v - away + 1, 0) + 1
    psi = lambda n: float((1 / np.arange(1, n)).sum()) - 0.5772156649015329
    want = psi(N) + psi(3) - psi(N // 2) - np.mean([psi(n) for n in near])
    assert row.n == N and row.mi == pytest.approx(max(0.0, want), abs=1e-9)
