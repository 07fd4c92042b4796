"""Runs registered queries next to their SQL and reports every difference.

Usage: python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return None if value is None else str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, v or "") for v in r))


def differences(df, connection, sql: str) -> list[str]:
    """Empty when columns, row counts and all values agree."""
    got = [tuple(r) for r in df.collect()]
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    out = []
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    for field in df.schema:
        simple, other = field.dataType.simpleString(), kinds[field.name]
        pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP"}
        if pairs.get(simple) != other:
            out.append(f"type of {field.name}: {simple} / {other}")
    left, right = _sorted_rows(df.columns, got), _sorted_rows(names, want)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        out.append(f"{len(wrong)} of {len(left)} rows differ, e.g. {wrong[0]}")
    return out


def main() -> None:
    from clientela import build_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                problems = differences(query(spark, folder), connection, sql[name])
                note = "ok" if not problems else "DIFF " + " | ".join(problems)
            else:
                rows = query(spark, folder).collect()
                note = f"rows only: {len(rows)}"
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {type(error).__name__}: {str(error)[:400]}"
        failed += note.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - start:6.2f}s {name:32s} {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
