"""Run every query and its SQL twin side by side and compare.

    python tools/verify.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

import pairs  # noqa: E402
from chirpframe.plans.session import local_session  # noqa: E402
from pairs.base import TABLES  # noqa: E402


def kind(value):
    if isinstance(value, bool):
        return value
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(kind(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark, con, sf_dir, name):
    started = time.time()
    frame = pairs.QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - started
    if name not in pairs.ORACLES:
        return f"rows {len(got[1])}", spent, True
    relation = con.sql(pairs.ORACLES[name])
    want = rows_of(relation.columns, relation.fetchall())
    spark_types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    duck_types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    odd = {
        n: (spark_types[n], duck_types.get(n)) for n in spark_types
        if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        .get(spark_types[n]) != duck_types.get(n)
    }
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", spent, False
    if got[1] != want[1]:
        only = [r for r in got[1] if r not in set(want[1])][:3]
        miss = [r for r in want[1] if r not in set(got[1])][:3]
        return f"VALUES {len(got[1])} vs {len(want[1])}; spark only {only}; sql only {miss}", spent, False
    return f"ok {len(got[1])}" + (f"  types {odd}" if odd else ""), spent, True


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    failed = 0
    for name in pairs.QUERIES:
        if len(args) > 1 and not any(p in name for p in args[1:]):
            continue
        try:
            text, spent, ok = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            text, spent, ok = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, False
        failed += not ok
        print(f"{'' if ok else 'FAIL '}{name:38s} {spent:6.2f}s {text}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
