"""A check pairs a Spark query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.plans import detect
from emberframe.session import new_path
from emberframe.sources import views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Book:
    """Queries of one area by name, with their SQL where there is one."""

    queries: dict[str, Query]
    sql: dict[str, str]

    @classmethod
    def empty(cls) -> "Book":
        return cls({}, {})

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


# Values on a decimal grid fall on rounding ties, which engines break by their own noise; the shift moves them off.
_SHIFT = 1.7e-9


def rd(value: Column | str, digits: int = 4) -> Column:
    """Rounded, with no negative zero."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(_SHIFT), digits) + F.lit(0.0)


def rds(names: str, digits: int = 4) -> list[Column]:
    return [rd(n, digits).alias(n) for n in names.split()]


def srd(expression: str, digits: int = 4) -> str:
    return f"(round(({expression}) + {_SHIFT}, {digits}) + 0e0)"


def srds(names: str, digits: int = 4) -> str:
    return ", ".join(f"{srd(n, digits)} as {n}" for n in names.split())


def px_sql(body: str) -> str:
    """SQL over the pixel view `px`."""
    return f"with px as materialized ({views.pixel_sql('//')}) {body}"


def gated(spark: SparkSession, sf: str) -> DataFrame:
    return detect.gated_pixels(views.pixels(spark, sf))


_PRODUCTS: dict[tuple, str] = {}


def product(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read: written once per application to the shared folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PRODUCTS:
        path = new_path(spark, name)
        build().write.parquet(path)
        _PRODUCTS[key] = path
    return spark.read.parquet(_PRODUCTS[key])


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """The detector's full trace of every pixel: its three parts are tables, read together."""
    stopped = product(spark, sf, "trace_gated", lambda: detect.gated_pixels(views.scene_pixels(spark, sf)))
    found = product(spark, sf, "trace_classified", lambda: detect.classified(stopped))
    rest = product(spark, sf, "trace_rest", lambda: detect.traced(found, views.lut(spark)))
    return detect.whole_trace(stopped, found, rest)
