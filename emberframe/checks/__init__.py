"""Every operator as a query over the given tables, paired with SQL for a second engine."""

from __future__ import annotations

import importlib

AREAS = ("detector", "scoring", "geo", "stock", "learning", "moving", "files")


def everything() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for area in AREAS:
        book = importlib.import_module(f"emberframe.checks.{area}").BOOK
        queries |= book.queries
        sql |= book.sql
    return queries, sql
