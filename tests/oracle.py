"""Run registered queries next to their SQL in DuckDB and compare all values.

    python tests/oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    want_names, want = canonical(columns, result.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    for name, kind in df.dtypes:
        twin = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if twin.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
        return f"{len(got)} vs {len(want)} rows; {len(diff)} differ; {names}: {diff[:2]}"
    return None if got else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from tensorloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf_dir, fn, sql[name])
            else:
                problem = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
