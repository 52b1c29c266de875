"""Run registered queries beside their SQL on DuckDB and compare the rows.

Usage: python tests/crosscheck.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, datetime):
        return v.date() if (v.hour, v.minute, v.second) == (0, 0, 0) else v
    if isinstance(v, date):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, text, sf_dir) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    diff = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if diff:
        return False, f"{len(diff)} of {len(got)} rows differ, e.g. {diff[0]}"
    return True, f"{len(got)} rows"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="crosscheck-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = argv[1:] or list(e.queries())
    bad = 0
    for name in names:
        t = time.time()
        try:
            if name in e.oracle_sql():
                ok, note = compare(spark, con, e.queries()[name], e.oracle_sql()[name], sf_dir)
            else:
                ok, note = True, f"{e.queries()[name](spark, sf_dir).count()} rows (no SQL)"
        except Exception as ex:  # report and go on with the next query
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
