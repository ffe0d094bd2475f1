"""Checks of scans and sinks: tables are written to the shared folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.checks.common import Book, product, px_sql, rd, rds, srd, srds
from emberframe.checks.learning import feature_rows
from emberframe.functions.nulls import recover_unsigned
from emberframe.operators import scenario, scoring
from emberframe.session import cut_lineage, new_path
from emberframe.sources import colocated, tables, views

BOOK = Book.empty()
add = BOOK.add


def stored(spark, sf, name, rows):
    return product(spark, sf, name, lambda: rows)


def bands(spark, sf):
    px = views.pixels(spark, sf)
    seven = stored(spark, sf, "band7", px.where("bt7 is not null").select("region", "scene", "i", "j", "event_id", "rad7"))
    long = stored(spark, sf, "band14", px.where("bt14 is not null and not (scene = 1 and i > 40)").select("region", "scene", "i", "j", "rad14"))
    fifteen = stored(spark, sf, "band15", px.where("scene <> 1 and bt15 is not null").select("region", "scene", "i", "j", "bt15"))
    return {"B07": seven, "B14": long}, {"B15": fifteen}


@add("s1_band_scan", px_sql(f"""
    select event_id, {srds('rad7 rad14')}, {srd('case when scene <> 1 then bt15 end')} bt15 from px where bt7 is not null and bt14 is not null and not (scene = 1 and i > 40)"""))
def _(spark, sf):
    return tables.join_bands(*bands(spark, sf)).select("event_id", *rds("rad7 rad14 bt15"))


def lying_together(spark, sf, name, rows):
    """A band table of its own name, laid out by scan line in the shared folder."""
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    colocated.write_band(rows, table, path, buckets=16)
    return table


@add("s1_colocated_bands", px_sql(f"""
    , b as (select *, rad7 - lag(rad7) over (partition by region, scene, i order by j) step from px where bt7 is not null and bt14 is not null and not (scene = 1 and i > 40))
    select event_id, {srds('rad7 rad14 step')}, {srd('case when scene <> 1 then bt15 end')} bt15 from b"""))
def _(spark, sf):
    """Three bands and the difference along the scan line, from buckets alone."""
    required, optional = ({n: lying_together(spark, sf, n.lower(), rows) for n, rows in named.items()} for named in bands(spark, sf))
    with colocated.joined_by_line(spark):
        px = colocated.read_bands(spark, required, optional)
        px = px.withColumn("step", F.col("rad7") - F.lag("rad7").over(W.partitionBy(*colocated.LINE).orderBy("j")))
        return cut_lineage(px).select("event_id", *rds("rad7 rad14 step bt15"))


@add("q9_colocated_write_back", px_sql("select event_id, case when value > 150 then ref_code + 100 else ref_code end code from px"))
def _(spark, sf):
    """Codes of the hot pixels alone, written back onto all pixels."""
    px = views.pixels(spark, sf).select("region", "scene", "i", "j", "event_id", F.col("ref_code").alias("code"), "value")
    codes = lying_together(spark, sf, "codes", px.drop("value"))
    masks = lying_together(spark, sf, "masks", px.where("value > 150").select("region", "scene", "i", "j", (F.col("code") + 100).alias("code")))
    with colocated.joined_by_line(spark):
        colocated.same_layout(spark, [codes, masks])
        return cut_lineage(colocated.write_back(spark.table(codes), spark.table(masks))).select("event_id", "code")


_FROM, _TO = 1704067200, 1704067200 + 900


@add("s1_range_scan", px_sql(f"select region, scene, i, j, event_id, {srds('bt7 bt14')} from px where region = 'r1' and scene_epoch >= {_FROM} and scene_epoch < {_TO}"))
def _(spark, sf):
    path = new_path(spark, "pixels")
    tables.write_pixels(views.pixels(spark, sf), path)
    return tables.read_pixels(spark, path, _FROM, _TO, ["r1"]).select("region", "scene", "i", "j", "event_id", *rds("bt7 bt14"))


@add("s1_missing_bands", px_sql("select region, scene, 'B15' band from px where scene = 1 group by region, scene"))
def _(spark, sf):
    required, optional = bands(spark, sf)
    return tables.absent_bands(required | optional, views.pixels(spark, sf).select("region", "scene").distinct())


def sidecars(spark, sf):
    path = new_path(spark, "sidecars")
    px = views.pixels(spark, sf).select("scene", "scene_epoch", "fk1_7", "fk2_7", "bc1_7", "bc2_7", "fk1_14", "fk2_14", "bc1_14", "bc2_14").distinct()
    rows = F.array(*[F.struct(F.lit(b).alias("band"), *[F.col(f"{c}_{b}").alias(f"planck_{c}") for c in ("fk1", "fk2", "bc1", "bc2")]) for b in (7, 14)])
    flat = px.select(F.date_format(F.timestamp_seconds("scene_epoch"), "yyyyMMdd_HHmm").alias("stamp"), F.expr("case when scene % 4 = 3 then 2 when scene % 4 = 2 then null else 0 end").alias("fpt_count"), F.inline(rows))
    flat.write.partitionBy("band", "stamp").json(path)
    return tables.read_coefficients(spark, path)


_SIDE = "(select distinct strftime(make_timestamp(scene_epoch * 1000000), '%Y%m%d_%H%M') stamp, scene, fk1_7, fk2_7, bc1_7, bc2_7, fk1_14, fk2_14, bc1_14, bc2_14 from px)"


@add("s3_calibration_sidecars", px_sql(" union all ".join(
    f"select {b} band, stamp, {srd(f'fk1_{b}')} fk1, {srd(f'fk2_{b}')} fk2, {srd(f'bc1_{b}', 6)} bc1, {srd(f'bc2_{b}', 6)} bc2 from {_SIDE}" for b in (7, 14))))
def _(spark, sf):
    return sidecars(spark, sf).select("band", "stamp", *rds("fk1 fk2"), *rds("bc1 bc2", 6))


@add("s4_focal_plane", px_sql(f"select stamp, case when scene % 4 = 3 then 91e0 else 0e0 end fpt from {_SIDE}"))
def _(spark, sf):
    return sidecars(spark, sf).where("band = 7").select("stamp", "fpt")


@add("s5_kappa_fallback", """
    with s as (select distinct event_id // 500 scene from events)
    select scene, round(case when scene % 3 = 0 then 2e-3 + 1e-5 * scene when scene % 3 = 1 then 19e-4 else pi() / 1622088e-3 end + 1.7e-09, 8) + 0e0 kappa0,
      case scene % 3 when 0 then 'sidecar' when 1 then 'legacy' else 'default' end source from s""")
def _(spark, sf):
    scenes = views.events(spark, sf).select(F.expr("event_id div 500").alias("scene")).distinct()
    side = scenes.where("scene % 3 = 0").withColumn("kappa0", F.expr("2e-3 + 1e-5 * scene"))
    legacy = scenes.where("scene % 3 < 2").withColumn("kappa0", F.lit(1.9e-3))
    return tables.kappa_lookup(scenes, side, legacy).select("scene", rd("kappa0", 8).alias("kappa0"), "source")


@add("s6_quality_layouts", px_sql("select region, scene, i, j, case when event_id % 3 = 0 then 1 else 2 end dqf from px where event_id % 3 = 0 or event_id % 2 = 0"))
def _(spark, sf):
    px = views.pixels(spark, sf)
    own = px.where("event_id % 3 = 0").select("region", "scene", "i", "j", F.lit(1).alias("dqf"))
    beside = px.where("event_id % 2 = 0").select("region", "scene", "i", "j", F.lit(2).alias("dqf"))
    return tables.first_layout(own, beside)


@add("s7_unsigned_codes", px_sql("select event_id, eco_byte & 255 eco_code, (((event_id * 37) % 256 - 128)::int) & 255 ref_byte from px"))
def _(spark, sf):
    return views.pixels(spark, sf).select("event_id", recover_unsigned(F.col("eco_byte")).alias("eco_code"), recover_unsigned(F.expr("event_id * 37 % 256 - 128")).alias("ref_byte"))




@add("s8_lut_validation", px_sql("""
    , l as (select scene, 1 + event_id % 5 tpw_bin, 1 + cast(round_even(value, 0) as int) % 8 zenith_bin from px), s as (select scene, k // 7 + 1 tpw_bin, k % 7 + 1 zenith_bin from (select distinct scene from l), (select unnest(range(35)) k)),
    c as (select scene, tpw_bin, zenith_bin, count(*) n from l group by all)
    select coalesce(s.scene, c.scene) scene, coalesce(s.tpw_bin, c.tpw_bin)::int tpw_bin, coalesce(s.zenith_bin, c.zenith_bin)::int zenith_bin, coalesce(n, 0) n
    from s full join c on s.scene = c.scene and s.tpw_bin = c.tpw_bin and s.zenith_bin = c.zenith_bin where coalesce(n, 0) <> 1"""))
def _(spark, sf):
    lut = views.pixels(spark, sf).select("scene", F.expr("cast(1 + event_id % 5 as int)").alias("tpw_bin"), (F.rint("value").cast("int") % 8 + 1).alias("zenith_bin"))
    return tables.lut_problems(lut, ["scene"])


@add("s9_neutral_lut", px_sql("select event_id, cast(least(greatest(round_even(tpw / 10, 0), 1), 5) as int) tpw_bin, 1e0 trans_4um, 0e0 offset_11um from px"))
def _(spark, sf):
    from emberframe.operators.corrections import attach_lut

    px = attach_lut(views.pixels(spark, sf), scenario.neutral_lut(views.lut(spark)))
    return px.select("event_id", "tpw_bin", "trans_4um", "offset_11um")


@add("s10_detection_csv", px_sql(f"""
    select {srd('lat', 2)} latitude, {srd('lon', 2)} longitude, {srd('bt7', 2)} bright_ti4, {srd('value', 2)} frp, case when value > 200 then 'h' else 'n' end confidence,
      cast(event_id % 2400 // 100 * 100 + event_id % 60 as int) acq_time from px"""))
def _(spark, sf):
    path = new_path(spark, "detections")
    px = views.pixels(spark, sf)
    empty = lambda kind: F.lit(None).cast(kind)
    px.select(
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("bt7").alias("bright_ti4"), empty("double").alias("scan"), empty("double").alias("track"),
        F.lit("2024-01-01").alias("acq_date"), F.expr("cast(event_id % 2400 div 100 * 100 + event_id % 60 as int)").alias("acq_time"), F.lit("N").alias("satellite"),
        F.lit("V").alias("instrument"), F.expr("case when value > 200 then 'h' else 'n' end").alias("confidence"), F.lit("2").alias("version"),
        F.col("bt14").alias("bright_ti5"), F.col("value").alias("frp"), F.lit("D").alias("daynight"),
    ).write.csv(path, header=True)
    return tables.read_detections(spark, path).select(*rds("latitude longitude bright_ti4 frp", 2), "confidence", "acq_time")


def by_scene(spark, sf):
    path = new_path(spark, "by-scene")
    tables.write_by_scene(feature_rows(spark, sf), path)
    return spark.read.parquet(path)


_STAMP = "strftime(make_timestamp(scene_epoch * 1000000), '%Y%m%d_%H%M')"


@add("s11_contract_scan", px_sql(f"""
    select concat('f', scene) scene, count(distinct s) n_stamps, count(*) n_other, count(*) filter (where event_id % 50 = 0) n_bad_target from (select *, {_STAMP} s from px) group by scene"""))
def _(spark, sf):
    px = views.pixels(spark, sf)
    rows = px.select(F.concat(F.lit("f"), F.col("scene")).alias("scene"), F.date_format(F.timestamp_seconds("scene_epoch"), "yyyyMMdd_HHmm").alias("timestamp"),
                     F.expr("case when event_id % 50 = 0 then 'x' else '1' end").alias("ref_fire"))
    return tables.contract_violations(rows)


@add("s12_scene_partitions", px_sql(f"select {_STAMP} scene, count(*) n from px where in_roi group by 1"))
def _(spark, sf):
    return by_scene(spark, sf).groupBy(F.col("scene").cast("string").alias("scene")).agg(F.count("*").alias("n"))


@add("s13_incremental_skip", "select distinct event_id // 500 scene from events where event_id // 500 not in (select distinct event_id // 500 from events where value > 400)")
def _(spark, sf):
    ev = views.events(spark, sf).withColumn("scene", F.expr("event_id div 500"))
    return tables.still_to_do(ev.select("scene").distinct(), ev.where("value > 400"))


@add("s14_csv_to_parquet", f"select event_id, user_id, event_type, {srd('value')} as value from events")
def _(spark, sf):
    source, target = new_path(spark, "csv"), new_path(spark, "parquet")
    rows = views.events(spark, sf).select("event_id", "user_id", "event_type", "value")
    rows.write.csv(source, header=True)
    tables.csv_to_parquet(spark, source, target, rows.schema)
    return spark.read.parquet(target).select("event_id", "user_id", "event_type", *rds("value"))


@add("s15_ragged_csv", px_sql(f"select event_id, {srd('value')} as value, case when value > 150 then {srd('bt7')} end bt7, case when value <= 150 then {srd('tpw')} end tpw from px"))
def _(spark, sf):
    px, path = views.pixels(spark, sf), new_path(spark, "ragged")
    hot, rest = px.where("value > 150").select("event_id", "value", "bt7"), px.where("value <= 150").select("tpw", "value", "event_id")
    tables.ragged_union(hot, rest, preferred=["event_id", "value"]).write.csv(path, header=True)
    back = spark.read.csv(path, schema="event_id long, value double, bt7 double, tpw double", header=True)
    return back.select("event_id", *rds("value bt7 tpw"))


@add("s16_summary_json", px_sql(f"select scene, count(*) n, {srd('avg(value)')} mean_value from px group by scene"))
def _(spark, sf):
    path = new_path(spark, "summary")
    views.pixels(spark, sf).groupBy("scene").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).write.json(path)
    return spark.read.schema("scene long, n long, mean_value double").json(path).select("scene", "n", *rds("mean_value"))


# Runs are a user's events of one type. Documents differ: some lack a section or a metric, some have one more, text or a clash of names.
_RUNS = """
  select concat('run-', event_type, '-', user_id) as run, count(*) as n, avg(value) as mean, max(value) as high, min(value) as low, sum(event_id % 2) as odd from {ev} group by event_type, user_id"""
_METRICS = """select run, 'average_precision' as metric, mean / 100 as value from r union all select run, 'recall', high / 500 from r where n % 3 <> 0
  union all select run, 'support', case when n % 7 = 0 then odd else n end from r union all select run, 'worst', low from r where (n % 5 <> 0 or n % 7 = 0) and low < 50"""
_SHORT = {"average_precision": "ap", "recall": "recall", "support": "n", "worst": "worst"}


def metric_documents(spark, sf):
    """Documents as JSON lines: `support` is in both sections where n % 7 = 0, and the second section's counts."""
    path = new_path(spark, "metrics")
    runs = spark.sql(_RUNS, ev=views.events(spark, sf))
    first = F.struct(
        (F.col("mean") / 100).alias("average_precision"), F.expr("case when n % 3 <> 0 then high / 500 end").alias("recall"), F.col("n").alias("support"),
        F.expr("case when n % 2 = 0 then 'a note' end").alias("note"), F.array(F.lit(1), F.lit(2)).alias("history"),
    )
    second = F.struct(F.expr("case when n % 7 = 0 then odd end").alias("support"), F.expr("case when low < 50 then low end").alias("worst"))
    document = F.to_json(F.struct("run", first.alias("global"), F.when(F.expr("n % 5 <> 0 or n % 7 = 0"), second).alias("scene_level")))
    runs.select(document.alias("value")).write.text(path)
    return tables.read_metrics(spark, path)


_LONG = f"with r as ({_RUNS.format(ev='events')}), m as ({_METRICS})"


@add("s17_metrics_json", f"{_LONG} select run, metric, {srd('value', 6)} as value from m")
def _(spark, sf):
    return scoring.run_metrics(metric_documents(spark, sf)).select("run", "metric", rd("value", 6).alias("value"))


@add("m11_run_comparison", f"""{_LONG} select run, row_number() over (order by ap desc nulls last, run) place, {srds('ap recall n worst', 3)} from
    (select run, {", ".join(f"max(value) filter (metric = '{name}') as {short}" for name, short in _SHORT.items())} from m group by run)""")
def _(spark, sf):
    table = scoring.compare_runs(scoring.run_metrics(metric_documents(spark, sf)), _SHORT, "average_precision", digits=9)
    return table.select("run", "place", *rds("ap recall n worst", 3))
