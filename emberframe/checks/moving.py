"""Checks of the temporal filter, its state, and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.checks.common import Book, px_sql
from emberframe.checks.oracle import upto
from emberframe.operators import matching, temporal
from emberframe.session import new_path
from emberframe.sources import scenes, views
from emberframe.streaming import fire_state, windows

BOOK = Book.empty()
add = BOOK.add

# Fires of the pixel view, with scenes far enough apart that the look-back ends within them.
_FIRES = "select event_id, region, i, j, 1704067200 + scene * 20000 as scene_epoch, cast(10 + event_id % 6 as int) as category, ref_code, true as confirmed from {px} where value > {low}"
_FIRES_SQL = "fires as materialized (" + _FIRES.format(px="px", low=60) + ")"
_NEAR = "b.region = a.region and abs(b.i - a.i) <= 1 and abs(b.j - a.j) <= 1 and b.scene_epoch < a.scene_epoch"


def fires(spark, sf, source=None):
    return spark.sql(_FIRES.replace("{low}", "60"), px=views.pixels(spark, sf) if source is None else source)


@add("t1_temporal_filter", px_sql(f"""
    , {_FIRES_SQL} select event_id, case when exists (select 1 from fires b where {_NEAR} and b.scene_epoch >= a.scene_epoch - 43200) then 20 else 0 end + category final_code from fires a"""))
def _(spark, sf):
    return temporal.temporal_filter(fires(spark, sf)).select("event_id", "final_code")


@add("t2_running_state", px_sql(f"""
    , {_FIRES_SQL} select event_id, max(scene_epoch) over (partition by region, i, j order by scene_epoch range between 43200 preceding and 1 preceding) last_fire from fires"""))
def _(spark, sf):
    from pyspark.sql import Window as W

    line = W.partitionBy(*temporal.PIXEL).orderBy("scene_epoch").rangeBetween(-43200, -1)
    return fires(spark, sf).select("event_id", F.max("scene_epoch").over(line).alias("last_fire"))


_AT = 1704067200 + 50000


@add("t2_state_before", px_sql(f", {_FIRES_SQL} select region, i, j, max(scene_epoch) last_fire from fires where scene_epoch >= {_AT} - 43200 and scene_epoch < {_AT} group by all"))
def _(spark, sf):
    return temporal.state_before(fires(spark, sf), _AT)


@add("t3_state_update", px_sql(f", {_FIRES_SQL} select region, i, j, max(scene_epoch) last_fire from fires group by all"))
def _(spark, sf):
    rows = fires(spark, sf)
    state = temporal.state_before(rows, _AT)
    return temporal.merge_state(state, rows)


@add("t4_state_bounds", px_sql(f", {_FIRES_SQL} select region, i, j, max(scene_epoch) last_fire from fires where i >= 40 or j >= 45 group by all"))
def _(spark, sf):
    empty = spark.createDataFrame([], "region string, i int, j int, last_fire bigint")
    return temporal.outside_grid(temporal.merge_state(empty, fires(spark, sf)), 40, 45)


@add("t6_temporal_source", px_sql(f"""
    , {_FIRES_SQL} select event_id, s.src, case when s.src <> 'none' and exists (select 1 from fires b where {_NEAR} and b.scene_epoch >= a.scene_epoch - 43200
      and (s.src = 'own' or b.ref_code in ({views.FIRE_LIST}))) then 20 else 0 end + category final_code from fires a, (select unnest(['none', 'own', 'reference']) src) s"""))
def _(spark, sf):
    rows = fires(spark, sf)
    parts = None
    for source in ("none", "own", "reference"):
        events = temporal.fire_events(source, rows, rows)
        part = temporal.temporal_filter(rows, events).select("event_id", F.lit(source).alias("src"), "final_code")
        parts = part if parts is None else parts.unionByName(part)
    return parts


STRETCHES = 4


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


@add("t7_streaming_filter", px_sql(f"""
    , {_FIRES_SQL} select region, i, j, scene_epoch, case when exists (select 1 from fires b where {_NEAR} and b.scene_epoch >= a.scene_epoch - 43200) then 20 else 0 end + category final_code from fires a"""))
def _(spark, sf):
    """Fires in a few stretches of time, one micro-batch each; a scene is split over two stretches where they meet, the rows of a stretch
    lie in several files and out of order, and a last row far ahead closes the stream."""
    part = F.expr("(scene_epoch - 1704067200) div 20000 + event_id % 2")
    names = ["region", "i", "j", "scene_epoch", "category"]
    rows = fires(spark, sf).select(*names, part.alias("part"))
    folder, out, progress = new_path(spark, "fires-in"), new_path(spark, "stream"), new_path(spark, "stream-progress")
    ends = rows.agg(F.min("part").alias("first"), F.max("part").alias("last"), F.max("scene_epoch").alias("epoch")).first()
    first, wide = ends["first"] or 0, ((ends["last"] or 0) - (ends["first"] or 0)) // STRETCHES + 1
    schema = rows.select(*names).schema
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    for number in range(STRETCHES + 1):
        if number < STRETCHES:
            some = rows.where(F.col("part").between(first + number * wide, first + (number + 1) * wide - 1)).select(*names)
            some.sortWithinPartitions(F.desc("scene_epoch")).write.parquet(f"{folder}/{number}")
        else:
            spark.createDataFrame([("closing", -9, -9, (ends["epoch"] or 0) + 10**7, 10)], schema).coalesce(1).write.parquet(f"{folder}/closing")
        fire_state.to_table(fire_state.temporal_stream(stream()), out, progress)
    found = spark.read.schema(T.StructType.fromDDL(fire_state.OUT)).parquet(out).where("region <> 'closing'")
    return found.select("region", "i", "j", "scene_epoch", "final_code")


BANDS = {
    "B02": ["refl2"], "B07": ["bt7", "rad7"], "B13": ["bt13", "rad13"], "B14": ["bt14", "rad14"], "B15": ["bt15"],
    "ground": ["scene", "event_id", "value", "sza", "lza", "glint", "azimuth", "tpw", "emiss7", "emiss14", "eco_byte", "land", "in_roi", "fpt", "lat", "lon", "area_km2", "ref_code",
               *[f"{c}_{b}" for b in (7, 14, 13) for c in ("fk1", "fk2", "bc1", "bc2")]],
}
CLOSING_EPOCH = 4_102_444_800


def scene_store(spark, sf):
    """All scenes of the pixel view, every band of every scene in two parts written by two jobs, announced in one go, and their columns."""
    px, root = views.scene_pixels(spark, sf), new_path(spark, "scenes")
    for half in (0, 1):
        scenes.write_bands(px.where(F.col("event_id") % 2 == half), root, f"half-{half}", BANDS)
    scenes.announce(root, "00000000000000000001", ["half-0", "half-1"])
    kinds = {f.name: f.dataType.simpleString() for f in px.schema}
    return root, ", ".join(f"{c} {kinds[c]}" for names in BANDS.values() for c in names)


@add("s1_scene_source", px_sql("select region, scene_epoch, i, j, event_id, round(bt7 + 1.7e-9, 4) bt7, round(rad14 + 1.7e-9, 4) rad14 from px where region = 'r0' and scene_epoch >= 1704067200 and scene_epoch < 1704067200 + 900 and bt7 is not null and bt14 is not null"))
def _(spark, sf):
    root, columns = scene_store(spark, sf)
    rows = scenes.read_scenes(spark, root, columns, regions=["r0"], bands=["B07", "B14", "ground"], start=1704067200, end=1704067200 + 900)
    return scenes.assemble(rows, ["B07", "B14"]).select("region", "scene_epoch", "i", "j", "event_id", F.round(F.col("bt7") + 1.7e-9, 4).alias("bt7"), F.round(F.col("rad14") + 1.7e-9, 4).alias("rad14"))


@add("t7_detect_stream", upto("fin", "select region, i, j, cast(1704067200 + scene * 600 as bigint) scene_epoch, final_code from fin where confirmed"))
def _(spark, sf):
    """Scenes in split files to confirmed fires to final codes: two streams, the second over what the first announces."""
    root, columns = scene_store(spark, sf)
    fires_at, out = new_path(spark, "stream-fires"), new_path(spark, "stream-codes")
    fire_state.detect_stream(scenes.stream_scenes(spark, root, columns), views.lut(spark), fires_at, new_path(spark, "detect-progress"), bands=["ground"]).awaitTermination()
    # a scene far ahead lets the watermark pass all others, and one more lets the stream see it
    progress = new_path(spark, "codes-progress")
    for epoch in (None, CLOSING_EPOCH, CLOSING_EPOCH + 600):
        if epoch:
            closing = spark.createDataFrame([("closing", epoch, "fires", -9, -9, 10)], f"{scenes.KEY_SCHEMA}, category int")
            closing.write.partitionBy("region", "scene_epoch", "band").parquet(f"{fires_at}/closing-{epoch}")
            scenes.announce(fires_at, f"closing-{epoch}", [f"closing-{epoch}"])
        found = scenes.stream_scenes(spark, fires_at, fire_state.FIRES).select("region", "i", "j", "scene_epoch", "category")
        fire_state.to_table(fire_state.temporal_stream(found), out, progress)
    codes = spark.read.schema(T.StructType.fromDDL(fire_state.OUT)).parquet(out).where("region <> 'closing'")
    return codes.select("region", "i", "j", "scene_epoch", "final_code")


def fire_stream(spark, sf):
    """Fires of the pixel view as a stream of timed rows, and a last row far ahead that closes it."""
    folder = new_path(spark, "fires-in")
    rows = fires(spark, sf).select("region", "i", "j", "scene_epoch", F.timestamp_seconds("scene_epoch").alias("ts"))
    rows.write.parquet(folder)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(folder).withWatermark("ts", "12 hours")

    def close():
        spark.createDataFrame([("closing", -9, -9, CLOSING_EPOCH)], "region string, i int, j int, scene_epoch bigint").withColumn("ts", F.timestamp_seconds("scene_epoch")).write.mode("append").parquet(folder)

    return stream, close


def closed_windows(spark, sf, name, over):
    """The windows that `over` makes of the fire stream, each written once when the watermark has passed it."""
    stream, close = fire_stream(spark, sf)
    out, progress = new_path(spark, name), new_path(spark, f"{name}-progress")
    fire_state.to_table(over(stream()), out, progress)
    close()
    fire_state.to_table(over(stream()), out, progress)
    return windows.bounds(spark.read.parquet(out)).where("region <> 'closing'")


@add("t8_tumbling_windows", "select floor(epoch(ts))::bigint // 600 * 600 from_epoch, floor(epoch(ts))::bigint // 600 * 600 + 600 to_epoch, event_type, count(*) n from events group by all")
def _(spark, sf):
    out = new_path(spark, "tumbling")
    stream = event_stream(spark, sf).withWatermark("ts", "1 hour")
    windows.run_complete(windows.tumbling(stream, "event_type"), out, new_path(spark, "tumbling-progress"))
    return windows.bounds(spark.read.parquet(out))


@add("t8_sliding_windows", px_sql(f"""
    , {_FIRES_SQL} select s from_epoch, s + 43200 to_epoch, region, i, j, count(*) n from (
      select region, i, j, unnest(generate_series((scene_epoch // 600 - 71) * 600, scene_epoch // 600 * 600, 600)) s from fires) group by all"""))
def _(spark, sf):
    """Fires of each pixel in 12 hours, every 10 minutes, as a stream."""
    return closed_windows(spark, sf, "sliding", lambda f: windows.sliding(f, "region", "i", "j"))


@add("t8_fire_episodes", px_sql(f"""
    , {_FIRES_SQL} select min(scene_epoch) from_epoch, max(scene_epoch) + 30000 to_epoch, region, i, j, count(*) n from (
      select *, sum(case when scene_epoch - before < 30000 then 0 else 1 end) over (partition by region, i, j order by scene_epoch) g from (
        select *, lag(scene_epoch) over (partition by region, i, j order by scene_epoch) before from fires)) group by region, i, j, g"""))
def _(spark, sf):
    """Episodes of each pixel: fires less than 30,000 s apart, as a stream."""
    return closed_windows(spark, sf, "episodes", lambda f: windows.episodes(f, "region", "i", "j", gap="30000 seconds"))


@add("t9_previous_scenes", """
    with d as (select event_id, floor(epoch(ts))::bigint // 600 * 600 - 600 last_slot from events where event_type = 'error'), s as (select distinct floor(epoch(ts))::bigint // 600 * 600 slot from events where event_type = 'view')
    select event_id, count(slot) n, min(slot) first_slot, max(slot) last_slot from d join s on slot between last_slot - 43200 and last_slot group by event_id""")
def _(spark, sf):
    ev = views.events(spark, sf).select("event_id", "event_type", F.unix_timestamp("ts").alias("epoch"))
    scenes = ev.where("event_type = 'view'").select((F.floor(F.col("epoch") / 600) * 600).alias("slot"))
    hits = matching.match_scenes(ev.where("event_type = 'error'"), scenes, 12)
    return hits.groupBy("event_id").agg(F.count("slot").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
