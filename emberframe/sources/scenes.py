"""Scenes as a data source for batch and stream: a partition holds one band of a large scene or many small ones, and only whole scenes.

A store is a folder of band files, written by any number of Spark jobs below `<root>/<part>/region=../scene_epoch=../band=../`, and of
markers `<root>/_ready/<name>.json`. A marker pins the files of its scenes; until it is there no reader sees them, so a scene that
comes in several files is never read by halves. Markers are read in the order of their names, which is the order of a stream's offsets.

The store must be reachable by Arrow's file systems on the driver and on executors (a shared mount, or a URI that Arrow knows).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KEYS = ("region", "scene_epoch", "band", "i", "j")
KEY_SCHEMA = "region string, scene_epoch bigint, band string, i int, j int"
READY = "_ready"
OPEN_COST, LARGEST = 1 << 20, 64 << 20  # a file counts as so many bytes more; parts of a partition add up to so many bytes at most
LINES = 256  # scan lines of a scene that are written together


@dataclass
class ScenePart:
    """The files of one band of one scene."""

    region: str
    epoch: int
    band: str
    files: tuple[str, ...]
    size: int = 0  # bytes; markers written before sizes were kept have none

    def keys(self) -> dict:
        return {"region": self.region, "scene_epoch": self.epoch, "band": self.band}


@dataclass
class SceneParts(InputPartition):
    parts: tuple[ScenePart, ...] = ()


def dealt(parts: Sequence[ScenePart], tasks: int) -> list[SceneParts]:
    """Parts that follow each other, put together up to LARGEST bytes, but so that there is work for `tasks` tasks."""
    costs = [p.size + OPEN_COST * len(p.files) for p in parts]
    limit, out, held = min(LARGEST, max(OPEN_COST, sum(costs) / max(tasks, 1))), [], 0
    for part, cost in zip(parts, costs):
        if not out or held + cost > limit:
            out.append([])
            held = 0
        out[-1].append(part)
        held += cost
    return [SceneParts(tuple(some)) for some in out] or [SceneParts()]


def store(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def marker_names(root: str, after: str = "", upto: str | None = None) -> list[str]:
    system, path = store(root)
    found = system.get_file_info(fs.FileSelector(f"{path}/{READY}", allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.endswith(".json"))
    return [n for n in names if n > after and (upto is None or n <= upto)]


def parts_of(root: str, names: Sequence[str]) -> list[ScenePart]:
    system, path = store(root)
    out = []
    for name in names:
        with system.open_input_stream(f"{path}/{READY}/{name}") as f:
            out += [ScenePart(e["region"], e["epoch"], e["band"], tuple(e["files"]), e.get("size", 0)) for e in json.loads(f.read())]
    return out


def read_part(root: str, part: ScenePart, schema: StructType) -> Iterator[pa.RecordBatch]:
    """The rows of a band in the asked schema: its own columns, and NULL for those of other bands."""
    wanted, (system, path), keys = to_arrow_schema(schema), store(root), part.keys()
    for name in part.files:
        with system.open_input_file(f"{path}/{name}") as f:
            table = pq.ParquetFile(f)
            own = set(table.schema_arrow.names)
            for batch in table.iter_batches(columns=[n for n in wanted.names if n in own and n not in keys]):
                columns = []
                for field in wanted:
                    if field.name in keys:
                        columns.append(pa.repeat(pa.scalar(keys[field.name], field.type), batch.num_rows))
                    elif field.name in own:
                        columns.append(batch.column(field.name).cast(field.type))
                    else:
                        columns.append(pa.nulls(batch.num_rows, field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)


def read_parts(root: str, parts: Sequence[ScenePart], schema: StructType) -> Iterator[pa.RecordBatch]:
    for part in parts:
        yield from read_part(root, part, schema)


@dataclass
class Bounds:
    """What is read of a store: regions and bands (all where empty), and scenes from `start` to before `end`."""

    regions: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()
    start: int | None = None
    end: int | None = None

    def hold(self, part: ScenePart) -> bool:
        early, late = self.start is not None and part.epoch < self.start, self.end is not None and part.epoch >= self.end
        return not early and not late and (not self.regions or part.region in self.regions) and (not self.bands or part.band in self.bands)


class SceneReader(DataSourceReader):
    """Ready scenes at the time of planning.

    Bounds are options and not pushed filters: Spark 4.1 keeps the filters of one query with the relation, so another query over the
    same DataFrame would miss rows.
    """

    def __init__(self, root: str, schema: StructType, bounds: Bounds, tasks: int):
        self.root, self.schema, self.bounds, self.tasks = root, schema, bounds, tasks

    def partitions(self) -> list[SceneParts]:
        return dealt([p for p in parts_of(self.root, marker_names(self.root)) if self.bounds.hold(p)], self.tasks)

    def read(self, partition: SceneParts) -> Iterator[pa.RecordBatch]:
        return read_parts(self.root, partition.parts, self.schema)


class SceneStream(DataSourceStreamReader):
    """Offsets are names of markers: a micro-batch holds whole scenes, and a repeated one holds the same."""

    def __init__(self, root: str, schema: StructType, tasks: int):
        self.root, self.schema, self.tasks = root, schema, tasks

    def initialOffset(self) -> dict:
        return {"marker": ""}

    def latestOffset(self) -> dict:
        return {"marker": max(marker_names(self.root), default="")}

    def partitions(self, start: dict, end: dict) -> list[SceneParts]:
        return dealt(parts_of(self.root, marker_names(self.root, start["marker"], end["marker"])), self.tasks)

    def read(self, partition: SceneParts) -> Iterator[pa.RecordBatch]:
        return read_parts(self.root, partition.parts, self.schema)


class SceneSource(DataSource):
    """Format `scenes`: options `path`, `bounds` and `tasks` (of the cluster at once), and a schema of KEY_SCHEMA and the columns wanted of any band."""

    @classmethod
    def name(cls) -> str:
        return "scenes"

    def schema(self) -> str:
        return KEY_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SceneReader(self.options["path"], schema, Bounds(**json.loads(self.options.get("bounds", "{}"))), int(self.options.get("tasks", 1)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SceneStream(self.options["path"], schema, int(self.options.get("tasks", 1)))


def read_scenes(spark: SparkSession, root: str, columns: str = "", **bounds) -> DataFrame:
    """Band rows of the whole scenes within the bounds (`regions`, `bands`, `start`, `end`); parts of others are not planned."""
    spark.dataSource.register(SceneSource)
    reader = spark.read.format("scenes").schema(", ".join(filter(None, (KEY_SCHEMA, columns))))
    return reader.option("path", root).option("bounds", json.dumps(bounds)).option("tasks", spark.sparkContext.defaultParallelism).load()


def stream_scenes(spark: SparkSession, root: str, columns: str = "") -> DataFrame:
    """Band rows of scenes in the order of their announcement; each micro-batch holds whole scenes."""
    spark.dataSource.register(SceneSource)
    reader = spark.readStream.format("scenes").schema(", ".join(filter(None, (KEY_SCHEMA, columns))))
    return reader.option("path", root).option("tasks", spark.sparkContext.defaultParallelism).load()


def write_bands(px: DataFrame, root: str, part: str, bands: dict[str, Sequence[str]]) -> None:
    """Files of pixels below `part` (overwritten), by band: its columns, and the pixels that have any of them. Not visible yet.

    A scene's LINES lines are written by one task, so a band of them is one file however the pixels came.
    """
    px = px.repartition("region", "scene_epoch", F.expr(f"i div {LINES}"))
    structs = F.array(*[F.when(F.coalesce(*[F.col(c).cast("string") for c in names]).isNotNull(), F.lit(band)) for band, names in bands.items()])
    rows = px.withColumn("band", F.explode(F.array_compact(structs)))
    own = {c: [b for b, names in bands.items() if c in names] for names in bands.values() for c in names}
    values = [F.when(F.col("band").isin(own[c]), F.col(c)).alias(c) for c in own]
    rows.select(*KEYS, *values).write.mode("overwrite").partitionBy("region", "scene_epoch", "band").parquet(f"{root}/{part}")


def announce(root: str, name: str, parts: Sequence[str], required: Sequence[str] = ()) -> list[tuple[str, int]]:
    """Make the scenes below `parts` visible by one marker; returns those that stay out for want of a required band.

    One entry a scene and band passes through the driver. An announcement repeated under the same name replaces the first.
    """
    system, path = store(root)
    scenes: dict[tuple[str, int], dict[str, list[tuple[str, int]]]] = {}
    for part in parts:
        for f in system.get_file_info(fs.FileSelector(f"{path}/{part}", recursive=True)):
            if f.is_file and f.base_name.endswith(".parquet"):
                below = f.path[f.path.index(f"/{part}/") + len(part) + 2 :]
                region, epoch, band = (unquote(x.split("=", 1)[1]) for x in below.split("/")[:3])
                scenes.setdefault((region, int(epoch)), {}).setdefault(band, []).append((f"{part}/{below}", f.size))
    partial = [s for s, bands in scenes.items() if not set(required) <= set(bands)]
    left_out = set(partial)
    entries = [
        {"region": r, "epoch": e, "band": b, "files": sorted(name for name, _ in files), "size": sum(size for _, size in files)}
        for (r, e), bands in sorted(scenes.items()) if (r, e) not in left_out for b, files in sorted(bands.items())
    ]
    system.create_dir(f"{path}/{READY}", recursive=True)
    # written beside and moved, so no reader meets half a marker
    with system.open_output_stream(f"{path}/{READY}/{name}.tmp") as f:
        f.write(json.dumps(entries).encode())
    system.move(f"{path}/{READY}/{name}.tmp", f"{path}/{READY}/{name}.json")
    return partial


def assemble(rows: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Band rows as pixels: one shuffle for any number of bands; a pixel must be in every required one."""
    values = [c for c in rows.columns if c not in KEYS]
    seen = [F.bool_or(F.col("band") == b).alias(f"_has_{n}") for n, b in enumerate(required)]
    whole = rows.groupBy("region", "scene_epoch", "i", "j").agg(*seen, *[F.first(c, ignorenulls=True).alias(c) for c in values], F.lit(1).alias("_one"))
    return whole.where(" and ".join(f"_has_{n}" for n in range(len(required))) or "true").select("region", "scene_epoch", "i", "j", *values)
