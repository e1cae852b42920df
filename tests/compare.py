"""Compare queries with their SQL in DuckDB: ``python tests/compare.py [pattern] [sf_dir]``."""

from __future__ import annotations

import os
import re
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False, name=None):
        out.append(tuple(None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else v for v in row))
    return sorted(out, key=lambda r: tuple((v is None, str(type(v).__name__), str(v)) for v in r))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    # whole numbers with nulls come as float64 from one side and as Int64 from the other
    return {c: str(frame[c].dtype).replace("Int64", "float64") for c in sorted(frame.columns)}


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows(got), rows(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ; first {bad[0][0]} != {bad[0][1]}"
    if kinds(got) != kinds(want):
        diff = {c: (k, kinds(want)[c]) for c, k in kinds(got).items() if kinds(want)[c] != k}
        return None if not diff else f"types {diff}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from feathergrid.session import get_session

    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = get_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if not re.search(pattern, name):
            continue
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracle:
                start = time.time()
                problem = difference(got, con.execute(oracle[name]).fetchdf())
                duck = time.time() - start
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state, duck = "rows-only", 0.0
        except Exception as error:  # noqa: BLE001
            state, took, duck, got = f"ERROR {str(error)[:700]}", time.time() - start, 0.0, []
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:45s} {took:6.2f}s {duck:6.2f}s {len(got):7d} {state}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
