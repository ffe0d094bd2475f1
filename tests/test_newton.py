"""Newton's refinement: known mixtures, starts that fail, and the whole retrieval with it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.functions import radiometry as rm
from emberframe.operators import newton, retrieval
from test_physics import COEFFS, lum


def mixtures(cases):
    """solve()'s arguments for starts and true (p, t, tb)."""
    start_p, start_t, p, t, tb = np.array(cases, float).T
    seen = np.array([[a * lum(b, x) + (1 - a) * lum(b, c) for a, x, c in zip(p, t, tb)] for b in (7, 14)])
    coefficients = np.array([[np.full(len(p), COEFFS[f"{n}_{b}"]) for b in (7, 14)] for n in ("fk1", "fk2", "bc1", "bc2")])
    return start_p, start_t, seen, tb, coefficients


def test_roots_whatever_the_batch():
    cases = [(0.008, 780, 0.01, 800, 295), (0.002, 700, 0.001, 900, 295), (0.3, 500, 0.05, 650, 300), (0.5, 1900, 0.0004, 1100, 290)]
    p, t, converged = newton.solve(*mixtures(cases))
    assert converged.all()
    assert np.allclose(p, [c[2] for c in cases], rtol=1e-3) and np.allclose(t, [c[3] for c in cases], rtol=1e-4)
    for k, case in enumerate(cases):
        alone = newton.solve(*mixtures([case]))
        assert (alone[0][0], alone[1][0], alone[2][0]) == (p[k], t[k], converged[k])


@pytest.mark.parametrize("start", [(2.0, 600), (1e-9, 600), (0.01, -5), (float("nan"), 600), (0.01, float("nan")), (0.01, 295.0)])
def test_a_start_that_fails_stays_where_it_is(start):
    p, t, converged = newton.solve(*mixtures([(*start, 0.01, 800, 295), (0.009, 790, 0.01, 800, 295)]))
    assert list(converged) == [False, True]
    assert np.array_equal([p[0], t[0]], start, equal_nan=True)


def test_without_rows_and_without_a_solution():
    empty = np.zeros(0)
    assert all(len(x) == 0 for x in newton.solve(empty, empty, np.zeros((2, 0)), empty, np.zeros((4, 2, 0))))
    p, t, seen, tb, coefficients = mixtures([(0.01, 800, 0.01, 800, 295)] * 3)
    seen[0, 0], seen[1, 1], tb[2] = -1.0, np.nan, 0.0
    assert not newton.solve(p, t, seen, tb, coefficients)[2].any()


def test_slope_is_that_of_the_columns(spark):
    coefficients = mixtures([(0.01, 800, 0.01, 800, 295)])[4]
    _, slope = newton._curves(*coefficients)
    one = spark.range(1).select(*(F.lit(v).alias(n) for n, v in COEFFS.items()))
    row = one.select(*(rm.radiance_slope(F.lit(700.0), F.lit(1.0), rm.BandCoefficients.of(b)).alias(f"s{b}") for b in (7, 14))).first()
    assert np.allclose(slope(np.array([700.0]))[:, 0], [row.s7, row.s14], rtol=1e-12)


def test_retrieval_with_newton_names_the_same_classes(spark):
    cases = [(0.01, 800.0), (0.001, 900.0), (0.05, 650.0), (0.2, 380.0), (0.0, 295.0)]
    rows = [(k, p * lum(7, t) + (1 - p) * lum(7, 295.0), p * lum(14, t) + (1 - p) * lum(14, 295.0), 8 if k % 2 else -1) for k, (p, t) in enumerate(cases)]
    rows += [(5, None, 1.0, -1), (6, -1.0, 1.0, -1)]
    px = spark.createDataFrame(rows, "k int, r7_diff double, r14_diff double, fail_char int").select(
        "*", F.lit("open").alias("path"), F.lit(False).alias("skip_retrieval"), F.lit(False).alias("sat_flag"), F.lit(False).alias("use_ch13"),
        F.lit(295.0).alias("bt14_bkg_corr"), *(F.lit(v).alias(n) for n, v in COEFFS.items()),
    )
    plain = {r.k: r for r in retrieval.retrieve(px).collect()}
    for row in retrieval.retrieve(px, newton=True).collect():
        other = plain[row.k]
        assert (row.fail_char, row.retrieval_valid) == (other.fail_char, other.retrieval_valid)
        assert row.fire_temp == pytest.approx(other.fire_temp, abs=0.01) and (row.fire_frac is None) == (other.fire_frac is None)
        assert set(row.asDict()) == set(other.asDict())
