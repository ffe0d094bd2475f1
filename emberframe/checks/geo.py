"""Checks of grid preparation and geospatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.checks.common import Book, product, px_sql, rd, rds, srd, srds
from emberframe.checks.oracle import upto
from emberframe.functions import sky
from emberframe.functions.nulls import recover_unsigned
from emberframe.functions.radiometry import reflectance_of
from emberframe.operators import ancillary, geometry
from emberframe.sources import views

BOOK = Book.empty()
add = BOOK.add
A, B, H, LON0 = 6378137.0, 6356752.3, 35786023.0, -75.0
SPREAD = "scene_epoch + event_id * 3601"


def sky_pixels(spark, sf):
    return views.pixels(spark, sf).withColumn("ts", F.timestamp_seconds(F.expr(SPREAD)))


@add("g1_time_grid", """
    select event_type, count(*) n, min(g)::bigint first_epoch, max(g)::bigint last_epoch from
      (select event_type, unnest(generate_series(epoch(min(ts))::bigint // 600 * 600, epoch(max(ts))::bigint // 600 * 600, 600)) g from events group by event_type) group by event_type""".replace("epoch(min(ts))::bigint", "floor(epoch(min(ts)))::bigint").replace("epoch(max(ts))::bigint", "floor(epoch(max(ts)))::bigint"))
def _(spark, sf):
    ten = lambda c: ancillary.floor_minutes(c, 10)
    bounds = views.events(spark, sf).groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = ancillary.time_grid(bounds.withColumns({"a": ten(F.col("a")), "b": ten(F.col("b"))}), "a", "b", 10)
    return grid.groupBy("event_type").agg(F.count("*").alias("n"), F.min(F.unix_timestamp("grid_ts")).alias("first_epoch"), F.max(F.unix_timestamp("grid_ts")).alias("last_epoch"))


_ANGLES = ("-152e-4 + 56e-6 * j", "865e-4 + 2e-3 * i")
_FRAME = ("-16e-2 + 65e-4 * j", "-16e-2 + 65e-4 * i")  # the whole frame: its corners look past the disk


def _position_sql(x: str, y: str) -> str:
    fixed = f"""
        select event_id, x, y, {H + A!r}::double hh, sin(x) * sin(x) + cos(x) * cos(x) * (cos(y) * cos(y) + sin(y) * sin(y) * ({A}::double * {A}::double / ({B}::double * {B}::double))) qa,
          -2e0 * ({H + A!r}::double) * cos(x) * cos(y) qb, ({H + A!r}::double) * ({H + A!r}::double) - {A}::double * {A}::double qc
        from (select event_id, {x} x, {y} y from px)"""
    return px_sql(f"""
        select event_id, {srd(f'degrees(atan(({A}::double * {A}::double / ({B}::double * {B}::double)) * sz / sqrt((hh - sx) * (hh - sx) + sy * sy)))')} lat,
          {srd(f'{LON0} - degrees(atan(sy / (hh - sx)))')} lon
        from (select event_id, hh, r * cos(x) * cos(y) sx, -r * sin(x) sy, r * cos(x) * sin(y) sz from
          (select *, case when qb * qb - 4 * qa * qc >= 0 then (-qb - sqrt(abs(qb * qb - 4 * qa * qc))) / (2 * qa) end r from ({fixed})))""")


def _positions(spark, sf, x: str, y: str):
    px = views.pixels(spark, sf).withColumns({"x": F.expr(x), "y": F.expr(y)})
    at = sky.fixed_grid_position(F.col("x"), F.col("y"), LON0, H, A, B)
    return px.select("event_id", *[rd(c).alias(n) for n, c in at.items()])


@add("g2_fixed_grid_position", _position_sql(*_ANGLES))
def _(spark, sf):
    return _positions(spark, sf, *_ANGLES)


@add("g2_off_disk", _position_sql(*_FRAME))
def _(spark, sf):
    return _positions(spark, sf, *_FRAME)


_SUN0 = f"""
    select *, radians(2345e-2 * sin(b)) de, radians(15 * (hour(t) + minute(t) / 60e0 + (4 * lon + 987e-2 * sin(2 * b) - 753e-2 * cos(b) - 15e-1 * sin(b)) / 60e0 - 12)) ha
    from (select *, radians(360e0 / 365 * (dayofyear(t) - 81)) b from (select *, make_timestamp(({SPREAD}) * 1000000) t from px))"""
_SUN = f"select *, acos(greatest(-1, least(1, sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(ha)))) z from ({_SUN0})"
_AZ0 = f"select *, degrees(acos(greatest(-1, least(1, (sin(radians(lat)) * cos(z) - sin(de)) / (cos(radians(lat)) * greatest(sin(z), 1e-6)))))) az0 from ({_SUN})"
_AZ = f"select *, case when ha > 0 then fmod(az0 + 180, 360) else fmod(540 - az0, 360) end az from ({_AZ0})"


def sun(px):
    px = px.withColumns(sky.solar_angles(F.col("lat"), F.col("lon"), F.col("ts")))
    return px.withColumn("solar_azimuth", sky.solar_azimuth(F.col("lat"), F.col("declination"), F.col("hour_angle"), F.col("solar_zenith")))


@add("g3_solar_position", px_sql(f"select event_id, {srd('degrees(z)', 3)} solar_zenith, {srd('az', 2)} solar_azimuth from ({_AZ})"))
def _(spark, sf):
    return sun(sky_pixels(spark, sf)).select("event_id", *rds("solar_zenith", 3), *rds("solar_azimuth", 2))


_E2 = f"(1 - {B}::double * {B}::double / ({A}::double * {A}::double))"
_VIEW0 = f"""
    select *, {A}::double / sqrt(1 - {_E2} * sin(radians(lat)) * sin(radians(lat))) nn, ({A}::double + {H}::double) * cos(radians({LON0})) xs,
      ({A}::double + {H}::double) * sin(radians({LON0})) ys, radians(lat) la, radians(lon) lo from ({_AZ})"""
_VIEW1 = f"select *, xs - nn * cos(la) * cos(lo) dx, ys - nn * cos(la) * sin(lo) dy, -nn * (1 - {_E2}) * sin(la) dz from ({_VIEW0})"
_VIEW = """
    select *, degrees(acos(greatest(-1, least(1, (dx * cos(la) * cos(lo) + dy * cos(la) * sin(lo) + dz * sin(la)) / sqrt(dx * dx + dy * dy + dz * dz))))) vz,
      fmod(degrees(atan2(-dx * sin(lo) + dy * cos(lo), -dx * sin(la) * cos(lo) - dy * sin(la) * sin(lo) + dz * cos(la))) + 360, 360) va from (""" + _VIEW1 + ")"


@add("g4_view_geometry", px_sql(f"select region, i, j, {srd('any_value(vz)', 3)} view_zenith, {srd('any_value(va)', 3)} view_azimuth from ({_VIEW}) group by all"))
def _(spark, sf):
    angles = sky.view_angles(F.col("lat"), F.col("lon"), LON0, H, A, B)
    return views.region_geometry(spark, sf).select("region", "i", "j", *[rd(c, 3).alias(n) for n, c in angles.items()])


@add("g5_glint_angle", px_sql(f"""
    select event_id, {srd('fmod(va - az + 360, 360)', 1)} rel_azimuth,
      {srd('degrees(acos(greatest(-1, least(1, cos(z) * cos(radians(vz)) + sin(z) * sin(radians(vz)) * cos(radians(va - az))))))', 2)} glint_angle from ({_VIEW})"""))
def _(spark, sf):
    px = sun(sky_pixels(spark, sf)).withColumns(sky.view_angles(F.col("lat"), F.col("lon"), LON0, H, A, B))
    px = px.withColumn("rel_azimuth", sky.relative_azimuth(F.col("view_azimuth"), F.col("solar_azimuth")))
    glint = sky.glint_angle(F.col("solar_zenith"), F.col("view_zenith"), F.col("rel_azimuth"))
    return px.select("event_id", rd("rel_azimuth", 1).alias("rel_azimuth"), rd(glint, 2).alias("glint_angle"))


@add("g6_block_mean", px_sql(f"""
    select region, scene, i // 4 i, j // 4 j, count(*) n_samples, {srd('avg(v) filter (where v >= 0)')} v from
      (select *, case when event_id % 17 = 0 then -1e0 when i < 4 and j < 4 then -2e0 else refl2 * 100 end v from px) group by region, scene, i // 4, j // 4"""))
def _(spark, sf):
    px = views.pixels(spark, sf).withColumn("v", F.expr("case when event_id % 17 = 0 then -1e0 when i < 4 and j < 4 then -2e0 else refl2 * 100 end"))
    return ancillary.block_mean(px, "v", 4).select("region", "scene", "i", "j", "n_samples", *rds("v"))


@add("g6_shape_check", px_sql("""
    , f as (select region, scene, max(i) + 1 fh, max(j) + 1 fw from px group by region, scene), c as (select region, scene, max(i) // 4 + 1 ch, max(j) // 5 + 1 cw from px group by region, scene)
    select region, scene, fh, fw, ch, cw from (select *, round_even(fh / ch, 0) a, round_even(fw / cw, 0) b from f join c using (region, scene))
    where a <> b or a < 1 or ch * a - fh < 0 or ch * a - fh > 4 or cw * b - fw < 0 or cw * b - fw > 4"""))
def _(spark, sf):
    px = views.pixels(spark, sf).select("region", "scene", "i", "j")
    coarse = px.select("region", "scene", F.expr("i div 4").alias("i"), F.expr("j div 5").alias("j"))
    return ancillary.shape_mismatch(px, coarse)


@add("g7_reflectance", px_sql(f"select event_id, {srd('case when refl2 is not null then least(greatest((pi() / 1622088e-3) * (refl2 * 2500 - 100), 0), 15e-1) end')} refl from px"))
def _(spark, sf):
    import math

    px = views.pixels(spark, sf)
    return px.select("event_id", rd(reflectance_of(F.expr("refl2 * 2500 - 100"), F.lit(math.pi / 1622.088))).alias("refl"))


_WL = (3.6, 3.8, 4.3, 10.8, 11.3, 12.1)


@add("g8_emissivity", px_sql(f"""
    , cells as (select distinct cast(round_even(lat / 5e-2, 0) as int) ci, cast(round_even(lon / 5e-2, 0) as int) cj from px),
    e as (select *, 9e-1 + 1e-3 * ((ci * 7 + cj * 3) % 50) + 1e-3 * w + 1e-2 * m em from cells, (select unnest([{", ".join(f"{w}::double" for w in _WL)}]) w), (select unnest([1, 2]) m))
    select p.event_id, {srd('(1 - (39e-1 - 38e-1) / (43e-1 - 38e-1)) * a.em + (39e-1 - 38e-1) / (43e-1 - 38e-1) * b.em')} emiss7,
      {srd('(1 - (112e-1 - 108e-1) / (113e-1 - 108e-1)) * c.em + (112e-1 - 108e-1) / (113e-1 - 108e-1) * d.em')} emiss14
    from px p {" ".join(f"left join e {n} on {n}.ci = round_even(p.lat / 5e-2, 0) and {n}.cj = round_even(p.lon / 5e-2, 0) and {n}.w = {w}::double and {n}.m = 1 + p.event_id % 2" for n, w in (("a", 3.8), ("b", 4.3), ("c", 10.8), ("d", 11.3)))}""").replace("38e-1", "3.8::double"))
def _(spark, sf):
    px = views.pixels(spark, sf).select("event_id", "lat", "lon", F.expr("cast(1 + event_id % 2 as int)").alias("month"))
    cells = px.select(ancillary.nearest_cell(F.col("lat"), 0.05).alias("cell_i"), ancillary.nearest_cell(F.col("lon"), 0.05).alias("cell_j")).distinct()
    field = cells.withColumn("wavelength_um", F.explode(F.array(*[F.lit(w) for w in _WL]))).withColumn("month", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "emissivity", F.expr("9e-1 + 1e-3 * ((cell_i * 7 + cell_j * 3) % 50) + 1e-3 * wavelength_um + 1e-2 * month"))
    return ancillary.emissivity(px, field, {"emiss7": 3.9, "emiss14": 11.2}).select("event_id", *rds("emiss7 emiss14"))


_FIELD = "(ci * 13 + cj * 7) % 41 + 5e-1 * ci"


@add("g9_bilinear_vapour", px_sql(f"""
    , k as (select event_id, event_id % 2 cy, lat / 25e-2 gi, lon / 25e-2 gj, cast(floor(lat / 25e-2) as int) fi, cast(floor(lon / 25e-2) as int) fj
      from (select event_id, case when event_id % 19 = 0 then -30e0 else lat end lat, lon from px)),
    cells as (select distinct fi + a ci, fj + b cj from k, (select unnest([0, 1]) a), (select unnest([0, 1]) b)),
    f as (select *, {_FIELD} + 3e0 * cy v from cells, (select unnest([0, 1]) cy) where (ci + cj) % 11 <> 0 and ci <= -120)
    select event_id, {srd('case when (1 - u) * (1 - w) = 0 then 0 else q.v * (1 - u) * (1 - w) end + case when (1 - u) * w = 0 then 0 else r.v * (1 - u) * w end + case when u * (1 - w) = 0 then 0 else s.v * u * (1 - w) end + case when u * w = 0 then 0 else t.v * u * w end')} pwat
    from (select *, gi - fi u, gj - fj w from k) k0 left join f q on q.cy = k0.cy and q.ci = fi and q.cj = fj
    left join f r on r.cy = k0.cy and r.ci = fi and r.cj = fj + 1 left join f s on s.cy = k0.cy and s.ci = fi + 1 and s.cj = fj
    left join f t on t.cy = k0.cy and t.ci = fi + 1 and t.cj = fj + 1"""))
def _(spark, sf):
    px = views.pixels(spark, sf).select("event_id", F.expr("case when event_id % 19 = 0 then -30e0 else lat end").alias("lat"), "lon", F.expr("event_id % 2").alias("cycle"))
    corners = px.select(F.explode(F.array(*[F.struct((F.floor(F.col("lat") / 0.25) + a).cast("int").alias("ci"), (F.floor(F.col("lon") / 0.25) + b).cast("int").alias("cj")) for a in (0, 1) for b in (0, 1)])).alias("c"))
    cells = corners.select("c.*").distinct().where("(ci + cj) % 11 <> 0 and ci <= -120").withColumn("cycle", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    field = cells.select(F.col("ci").alias("cell_i"), F.col("cj").alias("cell_j"), F.expr(f"{_FIELD} + 3e0 * cycle").alias("pwat"), "cycle")
    return ancillary.bilinear(px, field, "pwat").select("event_id", *rds("pwat"))


_GLOBE = "select event_id, -40e0 + 25e-2 * (event_id % 80) as lat, 280e0 + 25e-2 * (event_id {div} 80 % 160) as lon, value from events"


@add("g10_crop_field", px_sql(f"""
    , f as (select event_id, lat, (lon + 180) % 360 - 180 lon, value from ({_GLOBE.format(div='//')}))
    select event_id, lat, lon, value from f where lat between (select min(lat) - 1 from px) and (select max(lat) + 1 from px)
      and lon between (select min(lon) - 1 from px) and (select max(lon) + 1 from px)"""))
def _(spark, sf):
    field = spark.sql(_GLOBE.format(div="div").replace("from events", "from {ev}"), ev=views.events(spark, sf))
    return ancillary.crop_field(field, views.pixels(spark, sf)).select("event_id", "lat", "lon", "value")


@add("g11_forecast_cycle", "select floor(epoch(ts))::bigint // 21600 * 21600 cycle_epoch, count(*) n from events group by 1")
def _(spark, sf):
    ev = views.events(spark, sf).select(F.unix_timestamp(ancillary.forecast_cycle(F.col("ts"))).alias("cycle_epoch"))
    return ev.groupBy("cycle_epoch").agg(F.count("*").alias("n"))


_CLIM = f"""
    select event_id, region, scene, case when month(t) in (12, 1, 2) then 40 when month(t) in (3, 4, 5) then 30 when month(t) in (6, 7, 8) then 20 else 25 end
      + 10 * (lat - lo) / greatest(hi - lo, 1e-6) clim, case when scene % 2 = 0 and event_id % 3 = 0 then tpw end fld
    from (select *, make_timestamp((scene_epoch + event_id * 36010) * 1000000) t from px) join (select region, scene, min(lat) lo, max(lat) hi from px group by region, scene) using (region, scene)"""


def climate(spark, sf):
    px = views.pixels(spark, sf).withColumn("ts", F.timestamp_seconds(F.expr("scene_epoch + event_id * 36010")))
    return ancillary.vapour_climatology(px)


@add("g12_vapour_climatology", px_sql(f"select event_id, {srd('clim')} tpw_climatology from ({_CLIM})"))
def _(spark, sf):
    return climate(spark, sf).select("event_id", *rds("tpw_climatology"))


@add("g13_vapour_choice", px_sql(f"""
    , c as ({_CLIM}) select event_id, {srd('case when has then fld else clim end')} tpw from c join (select region, scene, bool_or(fld is not null) has from c group by region, scene) using (region, scene)"""))
def _(spark, sf):
    px = climate(spark, sf).withColumn("tpw_field", F.expr("case when scene % 2 = 0 and event_id % 3 = 0 then tpw end"))
    return ancillary.choose_vapour(px).select("event_id", *rds("tpw"))


@add("g14_box_mask", px_sql("""
    select event_id, lat between -3081e-2 and -3021e-2 and x >= -5781e-2 and x <= -5719e-2 plain, lat between -3081e-2 and -3021e-2 and (y >= 170 or y <= -170) wrapped
    from (select *, (lon + 180 + 360) % 360 - 180 x, (lon * 3 + 2 + 180 + 720) % 360 - 180 y from px)"""))
def _(spark, sf):
    px = views.pixels(spark, sf)
    box = lambda lon, a, b: ancillary.in_box(F.col("lat"), lon, F.lit(-30.81), F.lit(-30.21), F.lit(a), F.lit(b))
    return px.select("event_id", box(F.col("lon"), -57.81, -57.19).alias("plain"), box(F.col("lon") * 3 + 2, 170.0, 190.0).alias("wrapped"))


# One eight-sided department per nation, spread over the grid.
_VERTICES = """
    select n_name as shape, k as ord, -3005e-2 - 18e-2 * (n_nationkey {div} 5) + 83e-3 * sin(k * 785398e-6 + 1e-1) as lat,
      -5797e-2 + 19e-2 * (n_nationkey % 5) + (7e-2 + 2e-3 * n_nationkey) * cos(k * 785398e-6 + 1e-1) as lon
    from nation cross join (select {list} as k) as corner"""
_EDGES = f"""
    v as ({_VERTICES.format(div='//', list='unnest(range(8))')}),
    edges as (select a.shape, a.lat y0, a.lon x0, b.lat y1, b.lon x1 from v a join v b on a.shape = b.shape and b.ord = (a.ord + 1) % 8),
    hits as (select p.event_id, e.shape from px p join edges e on (e.y0 > p.lat) <> (e.y1 > p.lat) and p.lon < (e.x1 - e.x0) * (p.lat - e.y0) / (e.y1 - e.y0) + e.x0
      group by all having count(*) % 2 = 1)"""


def departments(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    sql = _VERTICES.format(div="div", list="explode(sequence(0, 7))").replace("from nation", "from {nation}")
    return ancillary.polygon_edges(spark.sql(sql, nation=nation))


def inside(spark, sf):
    """Shapes of every pixel of a region: static, so found once and kept."""
    return product(spark, sf, "departments", lambda: ancillary.in_cells(views.region_geometry(spark, sf), ancillary.polygon_cells(departments(spark, sf))))


@add("g15_polygon_mask", px_sql(f", {_EDGES} select event_id, shape from hits"))
def _(spark, sf):
    return views.pixels(spark, sf).select("region", "i", "j", "event_id").join(inside(spark, sf), ["region", "i", "j"]).select("event_id", "shape")


@add("i12_fires_by_department", px_sql(f", {_EDGES} select shape, count(*) n from hits join px using (event_id) where value > 150 group by shape"))
def _(spark, sf):
    fires = views.pixels(spark, sf).where("value > 150").select("region", "i", "j")
    return fires.join(inside(spark, sf), ["region", "i", "j"]).groupBy("shape").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@add("g16_surface_masks", px_sql("""
    select event_id, case when event_id % 3 > 0 then (eco_byte & 255) = 0 else in_roi and not (lat * 115e-2 < -34 and lon > -58 and lon < -52) end land from px"""))
def _(spark, sf):
    px = views.pixels(spark, sf).withColumns({"eco_code": F.when(F.expr("event_id % 3 > 0"), recover_unsigned(F.col("eco_byte"))), "lat": F.expr("lat * 115e-2")})
    return ancillary.surface_masks(px, estuary=True).select("event_id", "land")


@add("g17_grid_offset", px_sql("""
    select cast(arg_min(idx, (abs(x - x0), idx)) as int) as offset from (select distinct j idx, -152e-4 + 56e-6 * j x from px),
      (select -152e-4 + 56e-6 * min(j) x0 from px where j >= 7)"""))
def _(spark, sf):
    px = views.pixels(spark, sf).select(F.col("j").alias("idx"), F.expr("-152e-4 + 56e-6 * j").alias("x")).distinct()
    return ancillary.grid_offset(px.where("idx >= 7"), px, "x").select("offset")


@add("g18_nearest_slice", px_sql("""
    select least(a, b) first_idx, greatest(a, b) last_idx from (select arg_min(idx, (abs(x + 149e-4), idx)) a, arg_min(idx, (abs(x + 131e-4), idx)) b
      from (select distinct j idx, -152e-4 + 56e-6 * j x from px))"""))
def _(spark, sf):
    axis = views.pixels(spark, sf).select(F.col("j").alias("idx"), F.expr("-152e-4 + 56e-6 * j").alias("x")).distinct()
    return ancillary.nearest_slice(axis, -0.0149, -0.0131)


@add("g19_pixel_area", upto("areas", f"select region, i, j, {srds('area_km2')} from areas"))
def _(spark, sf):
    return geometry.pixel_areas(views.region_geometry(spark, sf)).select("region", "i", "j", *rds("area_km2"))
