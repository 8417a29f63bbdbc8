"""Compare a registered query with its SQL in DuckDB on the same Parquet tables."""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, con) -> str | None:
    """None when both results are equal, else a short description."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(names, cursor.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(actual) != len(expected):
        extra = [r for r in actual if r not in set(expected)][:2]
        missing = [r for r in expected if r not in set(actual)][:2]
        return f"{len(actual)} rows != {len(expected)}; extra {extra}; missing {missing}"
    for a, e in zip(actual, expected):
        if a != e:
            return f"columns {sorted(names)}\n   spark {a}\n   sql   {e}"
    return None


def main(folder: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                result = difference(df, sql[name], con)
            else:
                result = None
                print(f"   {name}: {df.count()} rows, no SQL")
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:700]}"
        failed += result is not None
        print(f"{'FAIL' if result else 'ok  '} {name} {time.time() - started:.1f}s {result or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
