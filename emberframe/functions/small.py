"""Joins of many rows with one row a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def by_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str], salt: Column, salts: int = SALTS) -> DataFrame:
    """Each row with its group's columns; a key may hold a large share of the rows.

    Rows are dealt over `salts` copies of their group by a hash of `salt`, which tells the rows of a group apart and is the same
    when a task is run again; so a hot key is split. The planner still broadcasts the groups where it sees that they are small. Rows
    whose key is null or has no group are left out.
    """
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")
