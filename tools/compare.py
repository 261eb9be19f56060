"""Run registered queries in Spark and their SQL twins in DuckDB and compare the rows.

usage: python tools/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plansift.catalog import ORACLE, QUERIES, load_all  # noqa: E402
from plansift.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value != value:
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    data.sort(key=lambda r: tuple((v is None, str(type(v).__name__) if False else "", str(v)) for v in r))
    return [columns[i] for i in order], data


def main(argv: list[str]) -> int:
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    load_all()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    bad = []
    for name in sorted(QUERIES):
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name not in ORACLE:
                print(f"ROWS {name} {len(got)} rows {t1 - t0:.1f}s", flush=True)
                if not got:
                    bad.append(name)
                continue
            cur = duck.execute(ORACLE[name])
            ocols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
            t2 = time.time()
            problem = None
            if cols != ocols:
                problem = f"columns {cols} vs {ocols}"
            elif len(got) != len(want):
                problem = f"{len(got)} rows vs {len(want)}"
            elif got != want:
                diff = [(a, b) for a, b in zip(got, want) if a != b]
                problem = f"{len(diff)} rows differ, first {diff[:2]}"
            elif not got:
                problem = "empty"
            if problem:
                bad.append(name)
                print(f"FAIL {name}: {cols} {problem}"[:1500], flush=True)
            else:
                print(f"ok   {name} {len(got)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s", flush=True)
        except Exception as exc:  # report and go on with the next query
            bad.append(name)
            print(f"ERR  {name}: {str(exc)[:1200]}", flush=True)
            if "-v" in argv:
                traceback.print_exc()
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    code = main(sys.argv[1:])
    sys.stdout.flush()
    sys.exit(code)
