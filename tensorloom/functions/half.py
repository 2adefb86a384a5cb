"""Half-precision storage for an engine without a half type."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# IEEE 754 binary16: fixed values
HALF_MIN_EXPONENT = -14
HALF_FRACTION_BITS = 10
HALF_OVERFLOW = 65520.0  # smallest magnitude that rounds to infinity


def half_value(v: Column) -> Column:
    """Round one float/double to the nearest half (ties to even), as float."""
    x = v.cast("double")
    mag = F.abs(x)
    # log2 can be one off only within ~1e-15 of a power of two, where both
    # candidate steps round to that same power
    exponent = F.floor(F.log2(mag))
    ulp = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(HALF_MIN_EXPONENT)).cast("double") - F.lit(float(HALF_FRACTION_BITS)))
    inf = F.lit(float("inf"))
    return (
        F.when(x.isNull(), F.lit(None))
        .when(F.isnan(x) | (mag == 0), x)
        .when(mag >= F.lit(HALF_OVERFLOW), F.when(x > 0, inf).otherwise(-inf))
        .otherwise(F.rint(x / ulp) * ulp)
        .cast("float")
    )


def to_half(arr: Column) -> Column:
    """Element-wise :func:`half_value` over an array column."""
    return F.transform(arr, half_value)


def round_half(df: DataFrame, columns: list[str], packed: bool = False) -> DataFrame:
    """Round whole float-array columns to half precision, batch by batch.

    Same values as :func:`to_half` at numpy speed, for wide rows on their way to a
    file. ``packed`` leaves little-endian binary16 bytes (half the size of float)
    instead of float arrays. A batch transform rather than a scalar UDF: a write needs
    every column anyway, and the input may then be any expression.
    """
    chosen = set(columns)
    out_type = T.BinaryType() if packed else T.ArrayType(T.FloatType())
    schema = T.StructType(
        [T.StructField(f.name, out_type if f.name in chosen else f.dataType, True) for f in df.schema.fields]
    )

    def convert(column: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            half = column.flatten().to_numpy(zero_copy_only=False).astype("<f2")
        lengths = column.value_lengths().to_pylist()
        ends = np.cumsum([0] + [n or 0 for n in lengths])
        if packed:
            raw = half.tobytes()
            return pa.array(
                [None if n is None else raw[2 * e : 2 * (e + n)] for n, e in zip(lengths, ends, strict=False)], pa.binary()
            )
        missing = pa.array([n is None for n in lengths], pa.bool_())
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(half.astype(np.float32)), mask=missing if column.null_count else None
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            arrays = [convert(c) if n in chosen else c for n, c in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_half(raw: pd.Series) -> pd.Series:
    """Little-endian binary16 bytes -> array of floats (widened for compute)."""
    return raw.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f2").astype(np.float32))
