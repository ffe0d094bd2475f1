"""Preparation of grids and ancillary fields: joins on cell keys instead of array indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions.nulls import holds
from emberframe.functions.small import by_group


def time_grid(bounds: DataFrame, start: str, end: str, minutes: int, name: str = "grid_ts") -> DataFrame:
    """Every step from start to end, both included, per row of bounds."""
    step = F.expr(f"interval {minutes} minutes")
    return bounds.withColumn(name, F.explode(F.sequence(F.col(start), F.col(end), step)))


def floor_minutes(ts: Column, minutes: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / (minutes * 60)) * (minutes * 60))


def block_mean(fine: DataFrame, value: str, factor: int) -> DataFrame:
    """Mean of the valid (non-negative) samples of each factor x factor block; NULL for a block without any."""
    cell = lambda n: F.floor(F.col(n) / factor).cast("int").alias(n)
    return fine.groupBy("region", "scene", cell("i"), cell("j")).agg(
        F.avg(F.when(F.col(value) >= 0, F.col(value))).alias(value), F.count("*").alias("n_samples")
    )


def shape_mismatch(fine: DataFrame, coarse: DataFrame, slack: int = 4) -> DataFrame:
    """Scenes whose fine grid is not the coarse grid times one factor, give or take the slack."""
    size = lambda df, p: df.groupBy("region", "scene").agg((F.max("i") + 1).alias(f"{p}h"), (F.max("j") + 1).alias(f"{p}w"))
    both = size(fine, "f").join(size(coarse, "c"), ["region", "scene"])
    both = both.withColumns({"fi": F.rint(F.col("fh") / F.col("ch")), "fj": F.rint(F.col("fw") / F.col("cw"))})
    pad = lambda a, b, f: F.col(b) * F.col(f) - F.col(a)
    bad = (F.col("fi") != F.col("fj")) | (F.col("fi") < 1)
    for p in (pad("fh", "ch", "fi"), pad("fw", "cw", "fj")):
        bad = bad | (p < 0) | (p > slack)
    return both.where(bad).select("region", "scene", "fh", "fw", "ch", "cw")


def wavelength_weights(wavelengths: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Per target the two nearest wavelengths with interpolation weights. The spectral axis is a short fixed list."""
    rows = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(t).alias("target")) for n, t in targets.items()])
    ranked = wavelengths.select("wavelength_um").distinct().select("*", F.inline(rows))
    near = W.partitionBy("band").orderBy(F.abs(F.col("wavelength_um") - F.col("target")), "wavelength_um")
    pair = ranked.withColumn("_k", F.row_number().over(near)).where("_k <= 2").groupBy("band", "target").agg(
        F.min("wavelength_um").alias("w0"), F.max("wavelength_um").alias("w1")
    )
    weight = (F.col("target") - F.col("w0")) / (F.col("w1") - F.col("w0"))
    ends = F.array(F.struct(F.col("w0").alias("wavelength_um"), (1 - weight).alias("weight")),
                   F.struct(F.col("w1").alias("wavelength_um"), weight.alias("weight")))
    return pair.select("band", F.inline(ends))


def nearest_cell(value: Column, step: float) -> Column:
    return F.rint(value / step).cast("int")


def emissivity(px: DataFrame, field: DataFrame, targets: dict[str, float], step: float = 0.05, month: str = "month") -> DataFrame:
    """Emissivity per band at the nearest cell of the pixel's month: one row per month and cell, then a join on both."""
    weights = wavelength_weights(field, targets)
    cells = field.join(F.broadcast(weights), "wavelength_um").groupBy(month, "cell_i", "cell_j").agg(
        *[F.sum(F.when(F.col("band") == b, F.col("weight") * F.col("emissivity"))).alias(b) for b in targets]
    )
    at = px.withColumns({"cell_i": nearest_cell(F.col("lat"), step), "cell_j": nearest_cell(F.col("lon"), step)})
    return at.join(cells, [month, "cell_i", "cell_j"], "left").drop("cell_i", "cell_j")


def bilinear(px: DataFrame, field: DataFrame, value: str, step: float = 0.25, cycle: str = "cycle") -> DataFrame:
    """Bilinear value at each pixel from the four corner cells of its forecast cycle; NULL unless all that weigh are there.

    On a grid line the corners beyond it weigh nothing, so the last line of the field belongs to it.
    """
    gi, gj = F.col("lat") / step, F.col("lon") / step
    px = px.withColumns({"_i": F.floor(gi).cast("int"), "_j": F.floor(gj).cast("int")})
    px = px.withColumns({"_u": gi - F.col("_i"), "_v": gj - F.col("_j")})
    # Four cells side by side in one row of the field, so that the pixels are joined once and not multiplied.
    corner = lambda di, dj: field.select(
        cycle, (F.col("cell_i") - di).alias("_i"), (F.col("cell_j") - dj).alias("_j"), F.lit(f"c{di}{dj}").alias("_c"), F.col(value).alias("_x")
    )
    parts = corner(0, 0).unionByName(corner(0, 1)).unionByName(corner(1, 0)).unionByName(corner(1, 1))
    quads = parts.groupBy(cycle, "_i", "_j").agg(*[F.max(F.when(F.col("_c") == c, F.col("_x"))).alias(c) for c in ("c00", "c01", "c10", "c11")])
    u, v = F.col("_u"), F.col("_v")
    weighed = lambda corner, weight: F.when(weight == 0, 0.0).otherwise(F.col(corner) * weight)
    mixed = weighed("c00", (1 - u) * (1 - v)) + weighed("c01", (1 - u) * v) + weighed("c10", u * (1 - v)) + weighed("c11", u * v)
    return px.join(quads, [cycle, "_i", "_j"], "left").withColumn(value, mixed).drop("_i", "_j", "_u", "_v", "c00", "c01", "c10", "c11")


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def crop_field(field: DataFrame, px: DataFrame, margin: float = 1.0) -> DataFrame:
    """Field rows within the pixels' bounding box and a margin; longitudes may run 0..360."""
    box = px.agg(
        (F.min("lat") - margin).alias("_a"), (F.max("lat") + margin).alias("_b"), (F.min("lon") - margin).alias("_c"), (F.max("lon") + margin).alias("_d")
    )  # one row
    field = field.withColumn("lon", wrap_longitude(F.col("lon")))
    inside = F.col("lat").between(F.col("_a"), F.col("_b")) & F.col("lon").between(F.col("_c"), F.col("_d"))
    return field.join(F.broadcast(box)).where(inside).drop("_a", "_b", "_c", "_d")


def forecast_cycle(ts: Column) -> Column:
    """The 6-hour cycle at or before a time."""
    return floor_minutes(ts, 360)


def vapour_climatology(px: DataFrame, ts: str = "ts") -> DataFrame:
    """Seasonal vapour plus a 0..10 mm ramp from the scene's south to its north."""
    month = F.month(ts)
    base = F.when(month.isin(12, 1, 2), 40.0).when(month.isin(3, 4, 5), 30.0).when(month.isin(6, 7, 8), 20.0).otherwise(25.0)
    span = px.groupBy("region", "scene").agg(F.min("lat").alias("_lo"), F.max("lat").alias("_hi"))
    ramp = (F.col("lat") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    return by_group(px, span, ["region", "scene"], F.struct("i", "j")).withColumn("tpw_climatology", base + ramp * 10.0).drop("_lo", "_hi")


def choose_vapour(px: DataFrame, field: str = "tpw_field", fallback: str = "tpw_climatology") -> DataFrame:
    """The field where the scene has any value of it, else the climatology."""
    has = px.groupBy("region", "scene").agg(F.bool_or(F.col(field).isNotNull()).alias("_has"))
    return by_group(px, has, ["region", "scene"], F.struct("i", "j")).withColumn("tpw", F.when(F.col("_has"), F.col(field)).otherwise(F.col(fallback))).drop("_has")


def in_box(lat: Column, lon: Column, lat_min, lat_max, lon_min, lon_max) -> Column:
    """Inside a box whose longitudes may cross the antimeridian."""
    x, lo, hi = wrap_longitude(lon), wrap_longitude(lon_min), wrap_longitude(lon_max)
    across = F.when(lo <= hi, (x >= lo) & (x <= hi)).otherwise((x >= lo) | (x <= hi))
    return holds(lat.between(lat_min, lat_max) & across)


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Closed edges from ordered vertices (shape, ord, lat, lon)."""
    ring = W.partitionBy("shape").orderBy("ord")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    here = F.struct("lat", "lon")
    nxt = F.coalesce(F.lead(here).over(ring), F.first(here).over(whole))
    return vertices.select("shape", F.col("lat").alias("y0"), F.col("lon").alias("x0"), nxt.alias("_n")).select(
        "shape", "y0", "x0", F.col("_n.lat").alias("y1"), F.col("_n.lon").alias("x1")
    )


def polygon_cells(edges: DataFrame, cell: float = 0.1) -> DataFrame:
    """The grid cells (row, col) that a shape covers: (shape, odd, edges).

    `edges` are those that pass through the cell, so cells wholly inside have none; `odd` tells whether the cell's lower right corner
    lies inside. An edge is cut by rows and then spread over the columns of its piece, so it meets the cells it passes and no others.
    Between two border cells of a row all cells are alike, and the left one's corner tells which kind they are. Static: store it.
    """
    at = lambda c: F.floor(c / cell)
    slack = 1e-9
    rows = edges.withColumn("row", F.explode(F.sequence(at(F.least("y0", "y1")), at(F.greatest("y0", "y1")))))
    flat = F.col("y0") == F.col("y1")
    cross = lambda y: F.when(flat, F.col("x0")).otherwise((F.col("x1") - F.col("x0")) * F.try_divide(y - F.col("y0"), F.col("y1") - F.col("y0")) + F.col("x0"))
    low, high = F.greatest(F.least("y0", "y1"), F.col("row") * cell), F.least(F.greatest("y0", "y1"), (F.col("row") + 1) * cell)
    ends = [F.when(flat, F.col("x1")).otherwise(cross(low)), cross(high)]
    pieces = rows.withColumn("col", F.explode(F.sequence(at(F.least(*ends) - slack), at(F.greatest(*ends) + slack))))
    border = pieces.groupBy("shape", "row", "col").agg(F.collect_list(F.struct("y0", "x0", "y1", "x1")).alias("edges"))
    corner = pieces.select("shape", "row", "col").distinct().join(rows, ["shape", "row"])
    bottom = F.col("row") * cell
    right_of = ((F.col("y0") > bottom) != (F.col("y1") > bottom)) & (cross(bottom) > (F.col("col") + 1) * cell)
    odd = corner.groupBy("shape", "row", "col").agg((F.count_if(right_of) % 2 == 1).alias("odd"))
    border = border.join(odd, ["shape", "row", "col"])
    after = border.withColumn("_next", F.lead("col").over(W.partitionBy("shape", "row").orderBy("col"))).where(F.col("odd") & (F.col("_next") > F.col("col") + 1))
    inner = after.select("shape", "row", F.explode(F.sequence(F.col("col") + 1, F.col("_next") - 1)).alias("col"), F.lit(True).alias("odd"), F.array_except("edges", "edges").alias("edges"))
    return border.select("shape", "row", "col", "odd", "edges").unionByName(inner)


def in_cells(points: DataFrame, cells: DataFrame, cell: float = 0.1) -> DataFrame:
    """(the points' other columns, shape) for each point (lat, lon, ..) inside a shape, by the even-odd rule.

    One equi-join by cell: a point meets the shapes of its own cell only, and of their edges those in that cell. The way from the point
    goes right to the cell's end and down to its corner, whose side is known.
    """
    lat, lon, right, bottom = F.col("lat"), F.col("lon"), (F.col("_col") + 1) * cell, F.col("_row") * cell

    def crossings(e):
        level = F.when((e["y0"] > lat) != (e["y1"] > lat), (e["x1"] - e["x0"]) * (lat - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])
        upright = F.when((e["x0"] > right) != (e["x1"] > right), (e["y1"] - e["y0"]) * (right - e["x0"]) / (e["x1"] - e["x0"]) + e["y0"])
        count = lambda hit: F.when(hit, 1).otherwise(0)
        return count((lon < level) & (level <= right)) + count((upright > bottom) != (upright > lat))

    placed = points.withColumns({"_row": F.floor(lat / cell), "_col": F.floor(lon / cell)})
    met = placed.join(cells.withColumnsRenamed({"row": "_row", "col": "_col"}), ["_row", "_col"])
    times = F.aggregate("edges", F.when(F.col("odd"), 1).otherwise(0), lambda n, e: n + crossings(e))
    return met.where(times % 2 == 1).select(*(c for c in points.columns if c not in ("lat", "lon")), "shape")


def in_polygons(points: DataFrame, edges: DataFrame, cell: float = 0.1) -> DataFrame:
    """(point key, shape) for each point inside a shape, by the even-odd rule. `points` has key, lat, lon."""
    return in_cells(points.select("key", "lat", "lon"), polygon_cells(edges, cell), cell)


def surface_masks(px: DataFrame, estuary: bool = False) -> DataFrame:
    """Land is ecosystem code 0 whatever the region of interest; without codes, an estuary rule."""
    water = (F.col("lat") < -34) & (F.col("lon") > -58) & (F.col("lon") < -52) if estuary else F.lit(False)
    land = F.when(F.col("eco_code").isNotNull(), F.col("eco_code") == 0).otherwise(F.col("in_roi") & ~water)
    return px.withColumn("land", land)


def grid_offset(inner: DataFrame, outer: DataFrame, axis: str, tolerance: float = 1e-6) -> DataFrame:
    """Index in the outer grid of the inner grid's first line, matched on the scan angle; no row beyond the tolerance."""
    first = inner.agg(F.min_by(axis, "idx").alias("_x"))  # one row
    near = outer.join(F.broadcast(first)).withColumn("_d", F.abs(F.col(axis) - F.col("_x")))
    return near.agg(F.min_by("idx", F.struct("_d", "idx")).alias("offset"), F.min("_d").alias("distance")).where(F.col("distance") <= tolerance)


def nearest_slice(axis_values: DataFrame, low: float, high: float) -> DataFrame:
    """First and last grid line of a bound, by nearest scan angle."""
    near = lambda bound: F.min_by("idx", F.struct(F.abs(F.col("x") - bound), F.col("idx")))
    ends = axis_values.agg(near(low).alias("a"), near(high).alias("b"))
    return ends.select(F.least("a", "b").alias("first_idx"), F.greatest("a", "b").alias("last_idx"))
