"""Run registered queries next to their SQL and report differences.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from .oracle import ORACLE
from .queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def comparable(rows, columns: list[str]) -> list[tuple]:
    """Rows with columns by name, in a fixed order, every value as text of its own kind."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value) -> str:
        if isinstance(value, bool) or value is None:
            return str(value)
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
            return repr(float(value))
        return str(value)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


# Spark type -> type name on the other side
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def type_differences(schema, description) -> list[str]:
    other = {d[0]: str(d[1]) for d in description}
    return [
        f"{f.name}: {f.dataType.simpleString()} != {other[f.name]}"
        for f in schema.fields
        if SAME_TYPE.get(f.dataType.simpleString()) != other[f.name]
    ]


def compare(spark: SparkSession, connection, sf_dir: str, name: str) -> str:
    """Empty if equal, otherwise what differs."""
    result = QUERIES[name](spark, sf_dir)
    got = comparable(result.collect(), result.columns)
    if name not in ORACLE:
        return "" if got else "no rows"
    cursor = connection.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    want = comparable(cursor.fetchall(), columns)
    if sorted(result.columns) != sorted(columns):
        return f"columns {sorted(result.columns)} != {sorted(columns)}"
    types = type_differences(result.schema, cursor.description)
    if types:
        return "types differ: " + ", ".join(types)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(different)} rows differ, first {different[0]}" if different else ""


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.ui.enabled", "false").config("spark.driver.memory", "8g").config(
        "spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failures = 0
    for name in names:
        start = time.perf_counter()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[-600:]}"
        failures += bool(problem)
        kind = "sql" if name in ORACLE else "rows"
        print(f"{name:32} {kind:4} {time.perf_counter() - start:6.2f}s  {problem or 'ok'}", flush=True)
    print(f"{failures} of {len(names)} failed")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
