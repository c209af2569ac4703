"""Run registered queries on Spark and DuckDB and compare rows.

    python -m workload.check [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def _kind(v) -> str:
    return "float" if isinstance(v, float) else "int" if isinstance(v, int) else type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def kinds_of(columns, rows):
    found = {}
    for r in rows:
        for c, v in zip(columns, r):
            if v is not None:
                found.setdefault(c, set()).add(_kind(v))
    return found


def compare(spark_df, con, sql: str | None) -> tuple[str, int]:
    spark_rows = [tuple(r) for r in spark_df.collect()]
    if sql is None:
        return "no oracle", len(spark_rows)
    cursor = con.execute(sql)
    duck_cols = [d[0] for d in cursor.description]
    loose = {d[0]: str(d[1]) for d in cursor.description if str(d[1]) not in ("BIGINT", "DOUBLE", "VARCHAR", "NUMBER", "STRING")}
    duck_rows = cursor.fetchall()
    if loose:
        return f"duckdb types: {loose}", len(spark_rows)
    a_cols, a = rows_of(spark_df.columns, spark_rows)
    b_cols, b = rows_of(duck_cols, duck_rows)
    if a_cols != b_cols:
        return f"columns differ: only spark {set(a_cols) - set(b_cols)}, only duckdb {set(b_cols) - set(a_cols)}", len(a)
    ka, kb = kinds_of(spark_df.columns, spark_rows), kinds_of(duck_cols, duck_rows)
    wrong = {c: (ka[c], kb[c]) for c in ka if c in kb and ka[c] != kb[c]}
    if wrong:
        return f"types differ: {wrong}", len(a)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} and {len(b)}", len(a)
    if a != b:
        i = next(i for i in range(len(a)) if a[i] != b[i])
        n = sum(x != y for x, y in zip(a, b))
        diff = [(c, x, y) for c, x, y in zip(a_cols, a[i], b[i]) if x != y]
        return f"values differ in {n} rows, first: {diff[:3]} of {a[i][:4]}", len(a)
    return "ok", len(a)


def main(argv: list[str]) -> int:
    from nextcover.session import local_session
    from workload.catalog import REGISTRY
    from workload.registry import runner

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(REGISTRY)
    names = [n for n in REGISTRY if n in names or any(a.endswith("*") and n.startswith(a[:-1]) for a in names)]
    spark, con, bad = local_session(), duck(sf_dir), 0
    for n in names:
        start = time.time()
        try:
            result, rows = compare(runner(REGISTRY[n])(spark, sf_dir), con, REGISTRY[n].sql)
        except Exception as e:  # noqa: BLE001 - the report goes on with the next query
            result, rows = "error: " + "".join(traceback.format_exception_only(e))[:700], 0
        bad += result not in ("ok", "no oracle")
        empty = " EMPTY" if rows == 0 else ""
        print(f"{time.time() - start:6.2f}s {rows:7d} {n}: {result}{empty}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
