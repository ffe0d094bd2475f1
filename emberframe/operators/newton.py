"""Refinement of a two-band retrieval by Newton's method, a whole Arrow batch of pixels at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from emberframe import codes as k
from emberframe.functions.radiometry import BandCoefficients
from emberframe.operators.corrections import long_coefficients

MOST_STEPS, HALVINGS, TOLERANCE, SINGULAR = 50, 9, 1e-6, 1e-15
SOLUTION = StructType([StructField("p", DoubleType()), StructField("t", DoubleType()), StructField("converged", BooleanType())])


def _curves(k1: np.ndarray, k2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> tuple[Callable, Callable]:
    """Radiance and its slope in temperature; coefficients and results are (bands, pixels)."""

    def radiance(t: np.ndarray, at=slice(None)) -> np.ndarray:
        return k1[:, at] / np.expm1(k2[:, at] / (t * b2[:, at] + b1[:, at]))

    def slope(t: np.ndarray, at=slice(None)) -> np.ndarray:
        shifted = t * b2[:, at] + b1[:, at]
        return k1[:, at] * k2[:, at] * b2[:, at] / (2 * shifted * np.sinh(k2[:, at] / shifted / 2)) ** 2

    return radiance, slope


def solve(p: np.ndarray, t: np.ndarray, seen: np.ndarray, tb: np.ndarray, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fraction, temperature, converged) for p * L(t) + (1 - p) * L(tb) = seen in both bands.

    `seen` is (2, pixels), `coefficients` (4, 2, pixels). A step is halved until it stays in the domain and lowers the larger relative
    residual; a pixel whose step is singular or never does so is left where it is, not converged. Only pixels still moving are computed.
    """
    p, t = p.astype(float), t.astype(float)
    converged = np.zeros(len(p), bool)
    with np.errstate(all="ignore"):
        radiance, slope = _curves(*coefficients)
        cold = radiance(tb)
        scale = np.maximum(np.abs(seen), 1.0)

        def residual(p: np.ndarray, t: np.ndarray, at: np.ndarray) -> np.ndarray:
            return p * radiance(t, at) + (1 - p) * cold[:, at] - seen[:, at]

        inside = lambda p, t: (p >= k.P_LOW) & (p <= k.P_HIGH) & (t > 0) & np.isfinite(t)
        moving = np.flatnonzero(inside(p, t) & (tb > 0) & np.isfinite(cold).all(axis=0) & (seen > 0).all(axis=0) & np.isfinite(seen).all(axis=0))
        for _ in range(MOST_STEPS):
            if not len(moving):
                break
            off = residual(p[moving], t[moving], moving)
            worst = (np.abs(off) / scale[:, moving]).max(axis=0)
            done = worst <= TOLERANCE
            converged[moving[done]] = True
            moving, off, worst = moving[~done], off[:, ~done], worst[~done]
            by_p, by_t = radiance(t[moving], moving) - cold[:, moving], p[moving] * slope(t[moving], moving)
            size = np.maximum(np.abs(by_p), np.abs(by_t)).max(axis=0)
            by_p, by_t, off = by_p / size, by_t / size, off / size
            det = by_p[0] * by_t[1] - by_t[0] * by_p[1]
            dp, dt = (by_t[1] * off[0] - by_t[0] * off[1]) / det, (by_p[0] * off[1] - by_p[1] * off[0]) / det
            waiting = np.flatnonzero((np.abs(det) >= SINGULAR) & np.isfinite(dp) & np.isfinite(dt))
            taken = []
            for halving in range(HALVINGS):
                at = moving[waiting]
                new_p, new_t = p[at] - dp[waiting] / 2**halving, t[at] - dt[waiting] / 2**halving
                better = inside(new_p, new_t) & ((np.abs(residual(new_p, new_t, at)) / scale[:, at]).max(axis=0) < worst[waiting])
                p[at[better]], t[at[better]] = new_p[better], new_t[better]
                taken.append(at[better])
                waiting = waiting[~better]
            moving = np.concatenate(taken)
    return p, t, converged


@F.pandas_udf(SOLUTION)
def _solve(start: pd.DataFrame, seen: pd.DataFrame, tb: pd.Series, coefficients: pd.DataFrame) -> pd.DataFrame:
    packed = coefficients.to_numpy(float).T.reshape(4, 2, -1)
    found = solve(start["p"].to_numpy(float), start["t"].to_numpy(float), seen.to_numpy(float).T, tb.to_numpy(float), packed)
    return pd.DataFrame(dict(zip(("p", "t", "converged"), found)))


def refined(px: DataFrame, p: Column, t: Column, name: str = "newton") -> DataFrame:
    """Struct column `name` of (p, t, converged), from the starts `p` and `t`; a start that is missing or outside the domain stays and does not converge."""
    seven, long = BandCoefficients.of(7), long_coefficients()
    pairs = [getattr(band, n).cast("double").alias(f"{n}{b}") for n in ("fk1", "fk2", "bc1", "bc2") for b, band in enumerate((seven, long))]
    seen = F.struct(F.col("r7_diff").cast("double").alias("seven"), F.col("r14_diff").cast("double").alias("long"))
    return px.withColumn(name, _solve(F.struct(p.alias("p"), t.alias("t")), seen, F.col("bt14_bkg_corr").cast("double"), F.struct(*pairs)))
