"""Registry of named queries and their ANSI SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tensorloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_written: dict[tuple, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with SQL giving the same rows if there is any."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]) -> str:
    """Path of a derived dataset, written once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _written:
        path = scratch_path(spark, label)
        write(path)
        _written[key] = path
    return _written[key]


def h32(*parts: str) -> str:
    """SQL of ``functions.hashing.hash32``."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"


def half_sql(v: str) -> str:
    """SQL of ``functions.half.half_value`` for finite values, as DOUBLE."""
    x = f"({v})::DOUBLE"
    ulp = f"pow(2.0::DOUBLE, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"(CASE WHEN {x} = 0 THEN 0::DOUBLE ELSE round_even({x} / {ulp}, 0) * {ulp} END)"


def unnest_sql(source: str, key: str, arr: str) -> str:
    """Rows (key, i, v) of an array column, i zero-based, v double."""
    return f"SELECT {key}, unnest(range(len({arr}))) AS i, unnest({arr})::DOUBLE AS v FROM {source}"
