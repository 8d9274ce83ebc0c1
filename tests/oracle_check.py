"""Run registered queries next to their oracle SQL and compare every value.

    python tests/oracle_check.py [--sf DIR] [--plan] [name prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry_module  # noqa: E402
from seriesloom.plans.inputs import TABLES  # noqa: E402
from seriesloom.session import get_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(value: object) -> object:
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("T00:00:00", "").split("+")[0]
    return str(value)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(cell(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    a, b = rows(got), rows(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return None if not bad else f"{len(bad)} of {len(a)} rows differ, first: {bad[0][0]} != {bad[0][1]}"[:900]


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = get_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    chosen = [q for q in queries if not args.names or any(q.startswith(n) for n in args.names)]
    failed = 0
    for name in chosen:
        t0 = time.time()
        try:
            got = queries[name](spark, args.sf).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"rows {name}: {len(got)} rows, {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            problem = difference(got, want)
            note = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s"
        except Exception as exc:  # report and go on
            problem, note = f"{type(exc).__name__}: {str(exc)[:700]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {note} {problem or ''}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} fine")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
