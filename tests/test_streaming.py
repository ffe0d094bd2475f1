"""Streams give the batch result, batch by batch, and late scenes are dropped."""


from emberframe.operators import temporal
from emberframe.session import new_path
from emberframe.sources import scenes
from emberframe.streaming import fire_state

T0 = 1704067200
SCHEMA = "region string, i int, j int, scene_epoch bigint, category int, confirmed boolean"


def write_batches(spark, folder, batches):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/b{number}")


def run(spark, folder, out, progress):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    fire_state.to_table(fire_state.temporal_stream(stream), out, progress)
    return spark.read.schema(fire_state.OUT).parquet(out)


CLOSING = ("closing", -9, -9, T0 + 10**7, 10, True)


def test_stream_equals_batch_out_of_order_and_in_split_scenes(spark):
    rows = [("r", n % 3, (n * s) % 4, T0 + s * 14400, 10 + n % 6, True) for s in range(6) for n in range(6)]
    # neighbouring scenes are exchanged and every scene comes in two files
    batches = [[r for n, r in enumerate(rows) if n // 6 == s and n % 2 == half] for s, half in ((1, 0), (0, 1), (1, 1), (0, 0), (3, 0), (2, 1), (2, 0), (3, 1), (5, 1), (4, 0), (4, 1), (5, 0))]
    folder, out = new_path(spark, "in"), new_path(spark, "out")
    progress = new_path(spark, "progress")
    for number, some in enumerate([*batches, [CLOSING]]):
        write_batches(spark, f"{folder}/{number}", [some])
        got = run(spark, folder, out, progress)
    want = temporal.temporal_filter(spark.createDataFrame(rows, SCHEMA)).select("region", "i", "j", "scene_epoch", "final_code")
    got = got.where("region = 'r'").select("region", "i", "j", "scene_epoch", "final_code")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert want.where("final_code >= 30").count() > 0 and want.where("final_code < 30").count() > 0


def test_a_row_waits_for_earlier_fires_within_the_watermark(spark):
    folder, out, progress = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "progress")
    seen = []
    for number, some in enumerate(([("r", 5, 5, T0 + 600, 10, True)], [("r", 5, 5, T0, 10, True)], [CLOSING])):
        write_batches(spark, f"{folder}/{number}", [some])
        seen.append(sorted((r.scene_epoch - T0, r.final_code) for r in run(spark, folder, out, progress).where("region = 'r'").collect()))
    assert seen == [[], [], [(0, 10), (600, 30)]]


def test_last_fire_is_strictly_earlier_and_within_the_look_back(spark):
    rows = [("r", 5, 5, T0, 10, True), ("r", 6, 6, T0, 10, True), ("r", 6, 6, T0 + 43200, 11, True), ("r", 5, 5, T0 + 86401, 12, True)]
    got = {(r.i, r.scene_epoch - T0): r.final_code for r in temporal.temporal_filter(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(5, 0): 10, (6, 0): 10, (6, 43200): 31, (5, 86401): 12}


def test_a_scene_later_than_the_watermark_is_dropped(spark):
    folder, out, progress = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "progress")
    for number, row in enumerate([*(("r", 5, 5, epoch, 10, True) for epoch in (T0 + 864000, T0 + 864600, T0)), CLOSING]):
        write_batches(spark, f"{folder}/{number}", [[row]])
        got = run(spark, folder, out, progress)
    assert sorted((r.scene_epoch, r.final_code) for r in got.where("region = 'r'").collect()) == [(T0 + 864000, 10), (T0 + 864600, 30)]


def test_detection_on_a_stream_of_scenes(spark):
    from test_physics import mild_lut, scene

    folder, out = new_path(spark, "scenes"), new_path(spark, "fires")
    scene(spark, fire=(20, 20)).coalesce(1).write.parquet(folder)
    pixels = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    fire_state.detect_stream(pixels, mild_lut(spark), out, new_path(spark, "progress")).awaitTermination()
    found = spark.read.parquet(out).collect()
    assert [(r.i, r.j) for r in found] == [(20, 20)]


def test_a_scene_in_two_files_is_detected_whole(spark):
    from test_physics import mild_lut, scene

    px, root = scene(spark, fire=(20, 20)), new_path(spark, "store")
    bands = {"B07": ["bt7", "rad7"], "B14": ["bt14", "rad14"], "ground": [c for c in px.columns if c not in ("region", "scene_epoch", "i", "j", "bt7", "rad7", "bt14", "rad14")]}
    columns = ", ".join(f"{c} {px.schema[c].dataType.simpleString()}" for names in bands.values() for c in names)
    out, progress = new_path(spark, "fires"), new_path(spark, "progress")

    def run():
        fire_state.detect_stream(scenes.stream_scenes(spark, root, columns), mild_lut(spark), out, progress, bands=["ground"]).awaitTermination()
        return [(r.region, r.i, r.j) for r in scenes.read_scenes(spark, out, fire_state.FIRES).collect()]

    # the upper half alone has another background; nothing is seen until the whole scene is announced
    scenes.write_bands(px.where("i < 21"), root, "first", bands)
    assert run() == []
    scenes.write_bands(px.where("i >= 21"), root, "second", bands)
    assert run() == [] and scenes.announce(root, "1", ["first", "second"], ["B07", "B14"]) == []
    assert run() == [("r", 20, 20)]
    assert run() == [("r", 20, 20)]


def test_only_parts_within_the_bounds_are_planned(spark):
    rows = [(r, T0 + 600 * s, i, 0, float(i), None if s == 2 else 1.0) for r in ("north/1", "south") for s in range(3) for i in range(4)]
    px, root = spark.createDataFrame(rows, "region string, scene_epoch bigint, i int, j int, a double, b double"), new_path(spark, "store")
    scenes.write_bands(px, root, "p", {"A": ["a"], "B": ["b"]})
    assert scenes.read_scenes(spark, root, "a double").count() == 0
    # the scenes without band B stay out
    assert sorted(scenes.announce(root, "1", ["p"], ["A", "B"])) == [("north/1", T0 + 1200), ("south", T0 + 1200)]
    everything = scenes.read_scenes(spark, root, "a double, b double")
    some = scenes.read_scenes(spark, root, "a double, b double", regions=["north/1"], start=T0 + 600, bands=["A"])
    assert everything.rdd.getNumPartitions() == 8 and some.rdd.getNumPartitions() == 1
    assert some.count() == 4 and everything.count() == 32 and {r.region for r in some.collect()} == {"north/1"}
    pixels = scenes.assemble(everything, ["A", "B"])
    want = px.where("b is not null").select(pixels.columns)
    assert pixels.exceptAll(want).count() == 0 and want.exceptAll(pixels).count() == 0


def test_late_fires_of_windows_are_dropped(spark):
    from pyspark.sql import functions as F

    from emberframe.streaming import windows

    folder, out, progress = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "progress")
    schema = "region string, i int, j int, scene_epoch bigint"
    for number, epoch in enumerate((T0, T0 + 300, T0 + 86400, T0, T0 + 10**7)):  # the second T0 is a day late
        spark.createDataFrame([("r", 1, 1, epoch)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{number}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder).withColumn("ts", F.timestamp_seconds("scene_epoch")).withWatermark("ts", "1 hour")
        fire_state.to_table(windows.sliding(stream, "region", "i", "j"), out, progress)
    found = {(r.from_epoch - T0, r.n) for r in windows.bounds(spark.read.parquet(out)).collect()}
    assert found == {(600 * k - 43200 + 600, 2) for k in range(72)} | {(600 * k + 43200 + 600, 1) for k in range(72)}


def test_windows_of_a_stream_are_those_of_a_batch(spark):
    from pyspark.sql import functions as F

    from emberframe.streaming import windows

    folder, out, progress = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "progress")
    schema = "region string, i int, j int, scene_epoch bigint"
    # rows come out of order, but none behind the watermark
    batches = [[("r", n % 2, 1, T0 + 997 * n + 7 * (n % 3)) for n in range(60)] * 2, [("r", 0, 1, T0 + 90001), ("s", 5, 5, T0 + 70000)], [("r", 0, 1, T0 + 87000), ("r", 7, 7, T0 + 90000)], [("closing", -9, -9, T0 + 10**7)]]
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds("scene_epoch"))
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{number}")
        stream = timed(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)).withWatermark("ts", "1 hour")
        fire_state.to_table(windows.sliding(stream, "region", "i", "j", width="3 hours", step="10 minutes"), out, progress)
    table = spark.read.parquet(out)
    got = windows.bounds(table).where("region <> 'closing'")
    every = timed(spark.createDataFrame([r for rows in batches[:3] for r in rows], schema))
    want = windows.bounds(windows.sliding(every, "region", "i", "j", width="3 hours", step="10 minutes"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert table.count() < got.count() / 4  # runs, not windows, are kept and written
