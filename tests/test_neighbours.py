"""Nearest-neighbour information against a plain version that compares every row with every other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators.neighbours import digamma, nearest_information


def harmonic(n: int) -> float:
    return sum(1 / j for j in range(1, n)) - 0.5772156649015329


def plain(values: list[int], labels: list, k: int) -> tuple[int, float]:
    v, c = np.array(values), np.array(labels)
    in_class = np.array([(c == x).sum() for x in c])
    v, c, in_class = v[in_class > 1], c[in_class > 1], in_class[in_class > 1]
    terms = []
    for i in range(len(v)):
        near = min(k, in_class[i] - 1)
        apart = np.abs(v - v[i])
        r = np.sort(np.delete(apart, i)[np.delete(c, i) == c[i]])[near - 1]
        terms.append((harmonic(near), harmonic(in_class[i]), harmonic(((apart < r) | (apart == 0)).sum())))
    a, b, m = np.mean(terms, axis=0)
    return len(v), max(0.0, harmonic(len(v)) + a - b - m)


@pytest.mark.parametrize("k,slots", [(1, 2), (3, 9), (5, 40)])
def test_information_of_every_group(spark, k, slots):
    draw = np.random.Generator(np.random.PCG64(k))
    rows = [("far", int(x), "a" if x > 0 else "b") for x in draw.normal(0, 10_000, 300)]
    rows += [("ties", int(x), str(int(y))) for x, y in zip(draw.integers(0, 25, 300), draw.integers(0, 3, 300))]
    rows += [("skewed", int(x), "a" if x < 800 else "b") for x in draw.exponential(300, 300)]
    rows += [("few", 1, "a"), ("few", 5, "a"), ("few", 6, "b"), ("few", 8, "b"), ("few", 9, "b"), ("few", 2, "alone"), ("one", 3, "a"), ("same", 4, "a"), ("same", 4, "a")]
    rows += [("far", None, "a"), ("far", 3, None), ("far", float("nan"), "a"), ("far", float("inf"), "b")]
    table = spark.createDataFrame([(g, None if v is None else float(v), c) for g, v, c in rows], "g string, x double, target string")
    found = {r.g: (r.n, r.mi) for r in nearest_information(table, ["g"], "x", k=k, resolution=1.0, slots=slots).collect()}
    usable = [r for r in rows if r[1] is not None and math.isfinite(r[1]) and r[2] is not None]
    wanted = {g: plain([v for h, v, _ in usable if h == g], [c for h, _, c in usable if h == g], k) for g in ("far", "ties", "skewed", "few", "same")}
    assert found.keys() == wanted.keys()
    for g, (n, mi) in wanted.items():
        assert found[g][0] == n and found[g][1] == pytest.approx(mi, abs=1e-9), g
    assert found["far"][1] > 0.5 > found["ties"][1]


def test_one_group_without_names_and_an_empty_table(spark):
    table = spark.createDataFrame([(float(x), x % 2) for x in range(40)], "x double, target int")
    (row,) = nearest_information(table, [], "x").collect()
    assert row.n == 40 and row.mi == pytest.approx(plain(list(range(40)), [x % 2 for x in range(40)], 3)[1], abs=1e-9)
    assert nearest_information(table.where("false"), [], "x").count() == 0


def test_digamma(spark):
    found = spark.range(1, 60).select("id", digamma(F.col("id")).alias("psi")).collect()
    assert all(r.psi == pytest.approx(harmonic(r.id), abs=1e-10) for r in found)
