"""Run registered queries against their SQL in DuckDB: ``python tests/compare.py SF_DIR [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v, depth: int = 0):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def same(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return abs(a - b) <= 1.5e-6 + 1e-9 * abs(b) if isinstance(a, float) or isinstance(b, float) else a == b
    return a == b


def differences(spark, con, name: str, run, sql: str, sf_dir: str) -> str | None:
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    at = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    key = lambda r: tuple("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        if not all(same(x, y) for x, y in zip(a, b)):
            return f"{a}\n   and {b}"
    exact = sum(a != b for a, b in zip(sorted(got, key=key), sorted(want, key=key)))
    return f"~ {exact} rows differ in the last place" if exact else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sys.argv[1]), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or [n for n in queries if not n.startswith("op") or n in ("optimal_bins", "optimal_threshold_f1", "one_hot")]
    for name in names:
        began = time.time()
        try:
            if name in sql:
                said = differences(spark, con, name, queries[name], sql[name], sys.argv[1])
            else:
                said = f"rows only: {[r.asDict() for r in queries[name](spark, sys.argv[1]).limit(3).collect()]}"[:300]
        except Exception as e:  # noqa: BLE001
            said = f"FAILED {type(e).__name__}: {str(e)[:500]}"
        if said and not said.startswith("rows only"):
            bad += 1
        print(f"{name} {time.time() - began:.1f}s {said or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
