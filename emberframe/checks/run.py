"""Run checks: `python -m emberframe.checks.run <sf_dir> [name ...]`."""

from __future__ import annotations

import glob
import math
import os
import signal
import sys
import time

import duckdb

from emberframe.session import build_session


LIMIT_SECONDS = 60


def _plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{_plain(k)}:{_plain(v)}" for k, v in sorted(value.items(), key=str)) + "}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple(_plain(r[n]) for n in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def compare(spark, con, sf_dir, query, sql) -> tuple[bool, str]:
    start = time.time()
    got = query(spark, sf_dir)
    built = time.time() - start
    rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    ran = time.time() - start - built
    if sql is None:
        return True, f"{len(rows)} rows, built {built:.1f}s, ran {ran:.1f}s"
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(got.columns):
        return False, f"columns {sorted(got.columns)} against {sorted(names)}"
    expected = rows_of(names, want.fetchall())
    if rows == expected:
        sql_time = time.time() - start - built - ran
        return True, f"{len(rows)} rows, built {built:.1f}s, ran {ran:.1f}s, sql {sql_time:.1f}s"
    have, wanted = set(rows), set(expected)
    extra, missing = [r for r in rows if r not in wanted][:3], [r for r in expected if r not in have][:3]
    return False, f"{len(rows)} against {len(expected)} rows in {sorted(names)}; spark only {extra}; sql only {missing}"


def main() -> int:
    from emberframe.checks import everything

    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, sql = everything()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    chosen = [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    failed = 0

    def stop(*_):
        raise TimeoutError("over the limit")

    signal.signal(signal.SIGALRM, stop)
    for name in chosen:
        start = time.time()
        signal.alarm(LIMIT_SECONDS)
        try:
            ok, note = compare(spark, con, sf_dir, queries[name], sql.get(name))
        except Exception as error:  # one broken check must not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        signal.alarm(0)
        failed += not ok
        mark = ("ok " if name in sql else "row") if ok else "BAD"
        print(f"{mark} {name:36s} {time.time() - start:6.1f}s {note if len(note) < 1500 else note[:1500]}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} fine")
    return failed


if __name__ == "__main__":
    sys.exit(main())
