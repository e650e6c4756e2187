"""Run registered queries against their SQL statements: python tests/check.py [name part …]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def differences(spark_df, con, statement: str) -> list[str]:
    got = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(statement)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    problems = []
    if sorted(columns) != sorted(spark_df.columns):
        problems.append(f"columns {sorted(spark_df.columns)} != {sorted(columns)}")
        return problems
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    a, b = rows_of(spark_df.columns, got), rows_of(columns, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}")
    kinds = {d[0]: str(d[1]) for d in cur.description}
    for name, kind in spark_df.dtypes:
        wide = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if wide.get(kind) and wide[kind] not in kinds[name].upper() and kinds[name] not in ("NUMBER", "STRING", "bool"):
            problems.append(f"type of {name}: {kind} / {kinds[name]}")
    return problems


def make_session(cores: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    parts = sys.argv[1:]
    spark = make_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, build in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            statement = entry.oracle_sql().get(name)
            if statement is None:
                problems, note = [], f"rows only: {len(df.collect())}"
                spent = time.time() - start
            else:
                rows = df.collect()
                spent = time.time() - start
                problems, note = differences(df, con, statement), f"{len(rows)} rows"
        except Exception as error:  # noqa: BLE001
            problems, note, spent = [f"{type(error).__name__}: {str(error)[:900]}"], "", time.time() - start
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok':4s} {name:34s} {spent:6.1f}s total {time.time() - start:6.1f}s {note} {'; '.join(problems)}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
