"""Background of a pixel in a window that grows until a fifth of it is valid.

Two forms. `valid_counts` and `window_sums` are separable running sums along rows and then columns: exact, JVM side, and
enough for counts and moments of a fixed set of half-widths. The histogram rule (modal bin and its neighbours within the
pixel's own window) has no such form; a join would emit up to 111 x 111 pairs a pixel. `expanding_background` cuts the
scene into fixed tiles with a 55-pixel rim, so that a group is bounded by the tile whatever the scene, and reads each
window's moments from summed-area tables with four lookups.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe import codes as k
from emberframe.operators.gates import valid_background

TILE = 256
RIM = max(k.HALF_WIDTHS)
CELLS = 1 << 20  # cells of the grids that are summed in one step

_STATS = (
    "half_width int, n_valid int, window_size int, n_hist int, n_refl int, t7_stat_mean double, t7_stat_std double, "
    "t14_stat_mean double, t14_stat_std double, diff_stat_std double, t7_hist_mean double, t7_hist_std double, "
    "t14_hist_mean double, t14_hist_std double, diff_hist_std double, vis_hist_mean double, vis_hist_std double, "
    "vis_bin_mean double, vis_bin_std double, reflb double, rad_diff_sigma double"
)


def _strip(values: dict[str, str], along: str, fixed: Sequence[str], half: int) -> dict:
    """Sum of each value over [along - half, along + half] as the difference of two running sums."""
    line = W.partitionBy(*fixed).orderBy(along)
    upto = lambda name, end: F.coalesce(F.sum(name).over(line.rangeBetween(W.unboundedPreceding, end)), F.lit(0))
    return {out: upto(src, half) - upto(src, -half - 1) for out, src in values.items()}


def window_sums(px: DataFrame, values: Sequence[str], halves: Sequence[int]) -> DataFrame:
    """Columns `<value>_<half>`: sums over the square window, clipped at the scene's edges. Two shuffles in all."""
    across, down = {}, {}
    for h in halves:
        across |= _strip({f"_r_{v}_{h}": v for v in values}, "j", ("region", "scene", "i"), h)
        down |= _strip({f"{v}_{h}": f"_r_{v}_{h}" for v in values}, "i", ("region", "scene", "j"), h)
    return px.withColumns(across).withColumns(down).drop(*across)


def valid_counts(px: DataFrame, halves: Sequence[int] = k.HALF_WIDTHS) -> DataFrame:
    """Valid background pixels per half-width (the centre left out) and the first half-width with enough of them."""
    px = px.withColumn("_v", valid_background().cast("int"))
    px = window_sums(px, ["_v"], halves)
    px = px.withColumns({f"n_{h}": (F.col(f"_v_{h}") - F.col("_v")).cast("int") for h in halves})
    enough = [F.when(F.col(f"n_{h}") >= k.VALID_FRACTION * (2 * h + 1) ** 2, h) for h in halves]
    return px.withColumn("half_width", F.coalesce(*enough)).drop("_v", *[f"_v_{h}" for h in halves])


def _summed(grids: np.ndarray) -> np.ndarray:
    """Summed-area tables over the last two axes, with a row and a column of zeros in front."""
    table = np.zeros((*grids.shape[:-2], grids.shape[-2] + 1, grids.shape[-1] + 1), grids.dtype)
    np.cumsum(np.cumsum(grids, axis=-2, dtype=grids.dtype), axis=-1, out=table[..., 1:, 1:])
    return table


class _Areas:
    """Summed-area lookups over the windows of the pixels `at`, the centre left out."""

    def __init__(self, shape, rows, cols, half):
        self.shape, self.rows, self.cols = shape, rows, cols
        self.top, self.left = np.maximum(rows - half, 0), np.maximum(cols - half, 0)
        self.bottom, self.right = np.minimum(rows + half + 1, shape[0]), np.minimum(cols + half + 1, shape[1])

    def look_up(self, table: np.ndarray, grid: np.ndarray, some=slice(None)) -> np.ndarray:
        top, left, bottom, right = self.top[some], self.left[some], self.bottom[some], self.right[some]
        box = table[..., bottom, right] - table[..., top, right]
        box += table[..., top, left] - table[..., bottom, left]
        return box - grid[..., self.rows[some], self.cols[some]]

    def total(self, grid: np.ndarray, some=slice(None)) -> np.ndarray:
        return self.look_up(_summed(grid), grid, some)

    def moments(self, mask: np.ndarray, values: np.ndarray, some=slice(None)) -> np.ndarray:
        """Sums of the values and of their squares, of one grid or of several."""
        kept = np.where(mask, values, 0.0)
        return np.stack([self.total(kept, some), self.total(kept * kept, some)])


def _mean_std(n, sums, shift=0.0):
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, sums[0] / n, np.nan)
        std = np.sqrt(np.maximum(np.where(n > 0, sums[1] / n, np.nan) - mean * mean, 0.0))
    return mean + shift, std


def _modal(areas: _Areas, mask: np.ndarray, bins: np.ndarray):
    """Per pixel: the modal bin; the lowest bin wins a tie. Bins are counted as many at once as CELLS allows."""
    present = np.unique(bins[mask])
    best = np.zeros(len(areas.rows), dtype=np.int64)
    peak = np.full(len(areas.rows), np.nan)
    step = max(1, CELLS // max(mask.size, len(areas.rows)))
    for lo in range(0, len(present), step):
        some = present[lo : lo + step]
        n = areas.total((mask & (bins == some[:, None, None])).astype(np.int32))
        first = n.argmax(axis=0)
        top = np.take_along_axis(n, first[None], axis=0)[0]
        better = top > best
        best, peak = np.where(better, top, best), np.where(better, some[first], peak)
    return present, peak


def _near_peak(areas: _Areas, mask, bins, grids: dict[str, np.ndarray]):
    """Moments of each grid over the pixels in the modal bin +- 1; a bin is looked up for the pixels that it concerns."""
    present, peak = _modal(areas, mask, bins)
    n = np.zeros(len(areas.rows), dtype=np.int64)
    values = np.stack(list(grids.values()))
    sums = np.zeros((2, len(grids), len(areas.rows)))
    for b in present:
        chosen = np.flatnonzero(np.abs(peak - b) <= 1)
        if not len(chosen):
            continue
        here = mask & (bins == b)
        n[chosen] += areas.total(here.astype(np.int64), chosen)
        sums[:, :, chosen] += areas.moments(here, values, chosen)
    return n, {name: sums[:, place] for place, name in enumerate(grids)}


def _tile_background(table: pa.Table, stats: pa.Schema) -> pa.Table:
    """Background of the survivors of one tile; rim pixels only lend their values."""
    column = lambda name: table.column(name).to_numpy()
    i, j, home = column("i"), column("j"), column("survivor")
    payload = [n for n in table.column_names if n not in ("_ti", "_tj", "_valid", "survivor")]
    at = np.flatnonzero(home)
    r, c = (i - i.min()).astype(int), (j - j.min()).astype(int)
    shape = (int(r.max()) + 1, int(c.max()) + 1)

    def grid(values, fill=0.0):
        out = np.full(shape, fill, dtype=float)
        out[r, c] = values
        return out

    valid = grid(column("_valid").astype(float)) > 0
    t7, t14 = grid(column("bt7").astype(float)) - 290.0, grid(column("bt14e").astype(float)) - 290.0
    vis, refl = grid(column("vis").astype(float), np.nan), grid(column("refl").astype(float), np.nan)
    half = np.zeros(len(at), dtype=int)
    n_valid = np.zeros(len(at), dtype=np.int64)
    counted = valid.astype(np.int64)
    table_of_valid = _summed(counted)
    for h in k.HALF_WIDTHS:
        n = _Areas(shape, r[at], c[at], h).look_up(table_of_valid, counted)
        first = (half == 0) & (n >= k.VALID_FRACTION * (2 * h + 1) ** 2)
        half, n_valid = np.where(first, h, half), np.where(first, n, n_valid)
    found = half > 0
    areas = _Areas(shape, r[at], c[at], np.where(found, half, k.HALF_WIDTHS[0]))
    n = np.where(found, n_valid, 0)
    diff = t7 - t14
    out = {"half_width": half, "n_valid": n, "window_size": (2 * half + 1) ** 2}
    for name, values in (("t7", t7), ("t14", t14), ("diff", diff)):
        mean, std = _mean_std(n, areas.moments(valid, values), 0.0 if name == "diff" else 290.0)
        out |= {f"{name}_stat_mean": mean, f"{name}_stat_std": std}
    seen = np.isfinite(vis)
    grids = {"t7": t7, "t14": t14, "diff": diff, "vis": np.where(seen, vis, 0.0), "blind": (~seen).astype(float)}
    n_hist, sums = _near_peak(areas, valid, np.rint(diff), grids)
    out["n_hist"] = n_hist
    # A pixel without a visible value leaves the visible mean undefined.
    n_seen = np.where(sums.pop("blind")[0] > 0, 0, n_hist)
    for name, moments in sums.items():
        mean, std = _mean_std(n_seen if name == "vis" else n_hist, moments, 290.0 if name in ("t7", "t14") else 0.0)
        out |= {f"{name}_hist_mean": mean, f"{name}_hist_std": std}
    n_bin, sums = _near_peak(areas, valid & seen, np.rint(np.where(seen, vis, 0.0)), {"vis": np.where(seen, vis, 0.0)})
    mean, std = _mean_std(n_bin, sums["vis"])
    out |= {"vis_bin_mean": mean, "vis_bin_std": std}
    true_refl = valid & (refl > k.REFL_VALID_ABOVE)
    n_refl = areas.total(true_refl.astype(np.int64))
    mean, std = _mean_std(n_refl, areas.moments(true_refl, np.where(true_refl, refl, 0.0)))
    # With nothing but sentinels in the window the sentinels are all there is to average.
    out |= {"n_refl": n_refl, "reflb": np.where(n_refl > 0, mean, k.REFL_SENTINEL), "rad_diff_sigma": np.where(n_refl > 0, std, 0.0)}
    rows = table.select(payload).take(pa.array(at))
    for field in stats:
        values = out[field.name]
        empty = ~found | ~np.isfinite(values.astype(float))
        rows = rows.append_column(field, pa.array(values, mask=empty, type=field.type))
    return rows


def expanding_background(gated: DataFrame, tile: int = TILE) -> DataFrame:
    """Survivors with the statistics of their background window; NULL statistics where no window is valid enough.

    One shuffle: a pixel goes to its own tile and, within 55 pixels of a border, to the neighbours' rims. Only a
    survivor in its own tile carries its other columns.
    """
    keep = [n for n in gated.columns if n != "survivor"]
    core = ("region", "scene", "i", "j", "bt7", "bt14e", "vis", "refl")
    around = lambda name: F.sequence(
        F.floor(F.greatest(F.col(name) - RIM, F.lit(0)) / tile), F.floor((F.col(name) + RIM) / tile)
    )
    px = gated.withColumn("_valid", valid_background()).where(F.col("_valid") | F.col("survivor"))
    px = px.withColumn("_ti", F.explode(around("i"))).withColumn("_tj", F.explode(around("j")))
    home = (F.floor(F.col("i") / tile) == F.col("_ti")) & (F.floor(F.col("j") / tile) == F.col("_tj"))
    px = px.withColumn("survivor", F.col("survivor") & home).where(F.col("_valid") | F.col("survivor"))
    px = px.withColumns({n: F.when(F.col("survivor"), F.col(n)) for n in keep if n not in core})
    px = px.select(*keep, "_valid", "survivor", "_ti", "_tj")
    stats = T.StructType.fromDDL(_STATS)
    schema = T.StructType([px.schema[n] for n in keep] + stats.fields)
    arrow = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.float64()) for f in stats])
    return px.groupBy("region", "scene", "_ti", "_tj").applyInArrow(lambda t: _tile_background(t, arrow), schema)


def choose_approach(bkg: DataFrame) -> DataFrame:
    """Statistical or histogram background, by the smaller spread of band 7.

    Equal spreads mean statistical; when the histogram kept every valid pixel both are the same numbers.
    """
    stat = F.coalesce((F.col("n_hist") == F.col("n_valid")) | (F.col("t7_stat_std") <= F.col("t7_hist_std")), F.lit(False))
    bkg = bkg.withColumn("approach", F.when(F.col("half_width").isNotNull(), F.when(stat, "stat").otherwise("hist")))
    pick = lambda a, b: F.when(F.col("approach") == "stat", F.col(a)).otherwise(F.col(b))
    return bkg.withColumns({
        "n_passes": (F.col("half_width") / 5 - 1).cast("int"),
        "valid_fraction": F.col("n_valid") / F.col("window_size"),
        "bt7_bkg": pick("t7_stat_mean", "t7_hist_mean"), "bt14_bkg": pick("t14_stat_mean", "t14_hist_mean"),
        "bt7_bkg_std": pick("t7_stat_std", "t7_hist_std"), "bt14_bkg_std": pick("t14_stat_std", "t14_hist_std"),
        "diff_std": pick("diff_stat_std", "diff_hist_std"),
        "vis_bkg": pick("vis_bin_mean", "vis_hist_mean"), "vis_bkg_std": pick("vis_bin_std", "vis_hist_std"),
    })


def full_window(px: DataFrame, half: int) -> DataFrame:
    """Unfiltered mean and spread of both bands in a window; NULL when a pixel in it has no value."""
    px = px.withColumns({"_n": F.lit(1), "_k7": F.col("bt7").isNotNull().cast("int"), "_k14": F.col("bt14e").isNotNull().cast("int")})
    for band, name in ((7, "bt7"), (14, "bt14e")):
        shifted = F.coalesce(F.col(name) - 290.0, F.lit(0.0))
        px = px.withColumns({f"_s{band}": shifted, f"_q{band}": shifted * shifted})
    sums = window_sums(px, ["_n", "_k7", "_k14", "_s7", "_q7", "_s14", "_q14"], [half])
    for band in (7, 14):
        whole = F.col(f"_k{band}_{half}") == F.col(f"_n_{half}")
        mean, square = F.col(f"_s{band}_{half}") / F.col(f"_n_{half}"), F.col(f"_q{band}_{half}") / F.col(f"_n_{half}")
        sums = sums.withColumns({
            f"bt{band}_full_mean": F.when(whole, mean + 290.0),
            f"bt{band}_full_std": F.when(whole, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))),
        })
    return sums.drop(*[n for n in sums.columns if n.startswith("_")])
