"""The pixel view of the events table: two regions share each scene time, 50 x 50 pixels a region and scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.codes import FIRE_CODES

# Rows whose id leaves a given remainder carry a fault, so that every gate has pixels to stop.
_BASE = """
select event_id, value, event_id {div} 2500 as slot, event_id {div} 5000 as scene, concat('r', cast((event_id {div} 2500) % 2 as varchar(3))) as region,
  cast((event_id % 2500) {div} 50 as int) as i, cast(event_id % 50 as int) as j,
  288e0 + (event_id * 7919 % 1000) / 1e2
    + case when value > 200 then 5e-2 * (1e1 + 4e-1 * (value - 2e2)) else 0e0 end as warm14,
  case when value > 200 then 1e1 + 4e-1 * (value - 2e2) else 5e-2 * value end as rise
from events
"""
_TEMPS = """
select *, 1704067200 + scene * 600 as scene_epoch,
  case when event_id % 113 = 5 then null when event_id % 131 = 7 then 346e0 when event_id % 139 = 9 then 190e0
       when event_id % 163 = 13 then 2605e-1 when event_id % 179 = 16 then 268e0 when event_id % 181 = 17 then 272e0
       when event_id % 167 = 14 then 290e0 else warm14 end as bt14,
  case when event_id % 101 = 1 then null when event_id % 127 = 6 then 418e0 when event_id % 137 = 8 then 190e0
       when event_id % 163 = 13 then 261e0 when event_id % 179 = 16 then 275e0 when event_id % 181 = 17 then 283e0
       when event_id % 167 = 14 then 285e0 when value > 320 then 4118e-1 else warm14 + rise end as bt7,
  202263e0 + 1e1 * (scene % 3) as fk1_7, 369819e-2 as fk2_7, 43361e-5 as bc1_7, 99939e-5 as bc2_7,
  851022e-2 + 1e0 * (scene % 2) as fk1_14, 128627e-2 as fk2_14, 22516e-5 as bc1_14, 9992e-4 as bc2_14,
  107736e-1 as fk1_13, 139274e-2 as fk2_13, 755e-4 as bc1_13, 99975e-5 as bc2_13
from base
"""
_LONG = """
select *, case when event_id % 6 = 0 then null else bt14 + 1e-1 * ((event_id % 7) - 3) end as bt13,
  case when event_id % 157 = 12 then -5e-1 else fk1_7 / (exp(fk2_7 / (bt7 * bc2_7 + bc1_7)) - 1) end as rad7,
  fk1_14 / (exp(fk2_14 / (bt14 * bc2_14 + bc1_14)) - 1) as rad14
from temps
"""
_PIXEL = """
select region, scene, scene_epoch, i, j, event_id, value, bt7, rad7, bt14, rad14, bt13,
  fk1_13 / (exp(fk2_13 / (bt13 * bc2_13 + bc1_13)) - 1) as rad13,
  case when event_id % 5 = 0 then null when event_id % 173 = 15 then 260e0 else bt14 - 3 end as bt15,
  case when event_id % 41 = 0 then null when event_id % 43 = 2 then 1e-6 else 5e-2 + (event_id % 40) / 1e2 end as refl2,
  case when event_id % 107 = 3 then 5e0 when slot % 4 = 0 then 40e0 when slot % 4 = 1 then 75e0
       when slot % 4 = 2 then 100e0 else 60e0 end as sza,
  case when event_id % 103 = 2 then 82e0 else 45e0 + i % 5 end as lza,
  case when event_id % 109 = 4 then 6e0 else 45e0 end as glint, 120e0 as azimuth,
  5e0 + (event_id * 31 % 500) / 1e1 as tpw,
  case when event_id % 149 = 10 then 12e-1 else 95e-2 end as emiss7,
  case when event_id % 191 = 0 then null else 97e-2 end as emiss14,
  cast(case when event_id % 151 = 11 then -106 when event_id % 193 = 1 then -105 when event_id % 197 = 2 then -104
       when event_id % 199 = 3 then -103 else 0 end as int) as eco_byte,
  not (i < 30 and j < 30) and value < 300 as land, not (i = 0 and j >= 40) as in_roi,
  case when slot % 4 = 3 then 91e0 else 0e0 end as fpt, -30e0 - 2e-2 * i as lat, -58e0 + 2e-2 * j as lon,
  cast(case when value > 150 then 10 + event_id % 6 + case when event_id % 3 = 0 then 20 else 0 end else 100 end as int)
    as ref_code,
  fk1_7, fk2_7, bc1_7, bc2_7, fk1_14, fk2_14, bc1_14, bc2_14, fk1_13, fk2_13, bc1_13, bc2_13
from longwave
"""


def pixel_sql(div: str) -> str:
    """The view as one statement over `events`; only integer division is spelt differently by engine."""
    return (
        f"with base as ({_BASE.format(div=div)}), temps as ({_TEMPS}), longwave as ({_LONG}) {_PIXEL}"
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(pixel_sql("div").replace("from events", "from {ev}"), ev=events(spark, sf_dir))


def lut(spark: SparkSession) -> DataFrame:
    """The 35-row water vapour table, by formula (5 vapour bins x 7 angle bins)."""
    return spark.sql(
        """
        select cast(id div 7 + 1 as int) as tpw_bin, cast(id % 7 + 1 as int) as zenith_bin,
          9e-1 - 3e-2 * (id div 7 + 1) - 1e-2 * (id % 7 + 1) as trans_4um,
          88e-2 - 3e-2 * (id div 7 + 1) - 1e-2 * (id % 7 + 1) as trans_11um,
          1e-3 * (id div 7 + 1) as offset_4um, 1e-2 * (id div 7 + 1) as offset_11um
        from range(35)
        """
    )


FIRE_LIST = ", ".join(str(c) for c in FIRE_CODES)


def region_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region and pixel."""
    return pixels(spark, sf_dir).select("region", "i", "j", "lat", "lon").distinct()


_AREAS: dict[tuple, str] = {}


def stored_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel areas are static: computed once per application and kept in the shared folder."""
    from emberframe.operators.geometry import pixel_areas
    from emberframe.session import new_path

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _AREAS:
        path = new_path(spark, "areas")
        pixel_areas(region_geometry(spark, sf_dir)).select("region", "i", "j", "area_km2").write.parquet(path)
        _AREAS[key] = path
    return spark.read.parquet(_AREAS[key])


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel view with the static area of each pixel."""
    return pixels(spark, sf_dir).join(stored_areas(spark, sf_dir), ["region", "i", "j"], "left")
