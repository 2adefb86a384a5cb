"""The encoded feature store: Parquet partitioned by shard, with a shard table and a schema beside it.

``<store>_shards`` lists every committed shard with its row count and item sums,
``<store>_schema`` is the schema of all files together. Entries of the shards that a write
replaces are taken out before it and put back after it, so whatever the table lists is on
disk as listed, also after a crash; a store without a table is counted. A shard counts as
complete when count and sums equal the plan. Writes replace whole shard partitions
(dynamic overwrite), so a retried or repeated run leaves the same store. The manifest comes
last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions.half import round_half, unpack_half
from tensorloom.operators.shards import (
    CONTENT,
    SHARD_SIZE,
    dataset_fingerprint,
    default_logvar,
    locate,
    model_diff,
    shard_audit,
    shard_contents,
    shard_sizes,
)
from tensorloom.session import FILTER_INDICES, MAX_BROADCAST_ROWS, index_rows, shuffle_width, stored, task_slots
from tensorloom.sources.inventory import open_root, path_exists, qualified

TENSORS = ("tokens", "gt_mean", "gt_logvar")
ROWS_PER_FILE = 250  # ~0.25 GB of half-precision full-size rows

# fixed values: the interchange names of a manifest; the shard ids stand in the shard table
MANIFEST_SCHEMA = (
    "version int, dataset_root string, dataset_hash string, model_versions map<string,string>, "
    "total_shards int, shard_count int, last_shard int, created_at timestamp"
)
SHARD_TABLE = "shard_id int, n_images long, " + ", ".join(f"{c} long" for c in CONTENT)


def place_rows(df: DataFrame, rows_per_file: int = ROWS_PER_FILE, n_rows: int | None = None) -> DataFrame:
    """Bring the rows of each output file together, in offset order.

    Rows spread over (shard, file slot), so a large shard is written by many tasks.
    Do this while rows are still small (before encoding) and pass
    ``placed=True`` to :func:`write_shards`: tensors then never cross the network. The
    partition count is stated, so adaptive execution does not merge the compact rows
    into fewer tasks than the encoding that follows can use; with ``n_rows`` it is one per
    output file, so a task's share doesn't grow with the store.
    """
    slot = F.floor(F.col("offset") / F.lit(int(rows_per_file)))
    files = -(-n_rows // rows_per_file) if n_rows else 0
    spread = df.repartition(max(shuffle_width(df.sparkSession), files), "shard_id", slot)
    return spread.sortWithinPartitions("shard_id", "offset")


def write_shards(
    df: DataFrame,
    path: str,
    *,
    storage: str = "float",
    rows_per_file: int = ROWS_PER_FILE,
    placed: bool = False,
    replacing: DataFrame | None = None,
) -> None:
    """Write or replace the shards present in ``df``.

    Tensors are rounded to half precision. ``storage='float'`` keeps them as float
    arrays (the zero low bits compress away); ``'half'`` packs them as binary16. A store
    keeps the storage it began with. ``replacing`` (shard_id) spares finding out which
    shards ``df`` holds.
    """
    spark = df.sparkSession
    if storage not in ("float", "half"):
        raise ValueError(f"unknown storage {storage!r}")
    present = [t for t in TENSORS if t in df.columns]
    before = committed_shards(spark, path)  # a written or empty table, or counted from disk
    known = path_exists(spark, path)
    replaced = stored((replacing if replacing is not None else df).select(F.col("shard_id").cast("int")).distinct(), "shards-replaced")
    if not placed:
        df = place_rows(df, rows_per_file)
    out = round_half(df, present, packed=storage == "half") if present else df
    schema = merge_schemas(store_schema(spark, path) if known else None, out.schema)
    left = stored(before.join(replaced, "shard_id", "left_anti"), "shards-left")
    if known:
        _save_table(left, path)
    _save_schema(spark, schema, path)
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", int(rows_per_file))
        .partitionBy("shard_id")
        .parquet(path)
    )
    if {"item_id", "offset"} <= set(out.columns):
        _save_table(left.unionByName(_counted(spark, path, schema, replaced)), path)  # what is written is counted, not the store


def merge_schemas(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """All columns of both; a column must keep its type."""
    if old is None:
        return new
    kinds = {f.name: f.dataType for f in old}
    for f in new:
        had = kinds.get(f.name, f.dataType).simpleString()
        if had != f.dataType.simpleString():
            raise ValueError(f"the store keeps {f.name} as {had}, not {f.dataType.simpleString()}")
    return T.StructType([*old.fields, *[f for f in new if f.name not in kinds]])


def store_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema of all files of a store: the one beside it, or else merged from the footers."""
    beside = f"{path.rstrip('/')}_schema"
    if path_exists(spark, beside):
        return T.StructType.fromJson(json.loads(spark.read.text(beside, wholetext=True).first()[0]))
    return spark.read.option("mergeSchema", "true").parquet(path).schema


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 4  # for each task slot


def open_files(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The files of a store, whose folders are listed by a few tasks for each slot.

    Left alone, Spark starts one task for each folder, that is for each shard, and
    starting it takes far longer than the listing.
    """
    reader, before = spark.read if schema is None else spark.read.schema(schema), spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(min(int(before or 10_000), LISTING_TASKS * task_slots(spark))))
    try:
        return reader.parquet(path)  # lists at once
    finally:
        spark.conf.unset(LISTING) if before is None else spark.conf.set(LISTING, before)


def _save_schema(spark: SparkSession, schema: T.StructType, path: str) -> None:
    text = spark.createDataFrame([(schema.json(),)], "value string").coalesce(1)
    text.write.mode("overwrite").text(f"{path.rstrip('/')}_schema")


def _save_table(shards: DataFrame, path: str) -> None:
    table = stored(shards.select("shard_id", "n_images", *CONTENT), "shard-table")
    table.write.mode("overwrite").parquet(f"{path.rstrip('/')}_shards")


def _counted(spark: SparkSession, path: str, schema: T.StructType, only: DataFrame | None = None) -> DataFrame:
    """The shard table of what is on disk (or of ``only`` some shards); reads positions and ids only."""
    rows = open_files(spark, path, schema)
    rows = rows if only is None else _of_shards(rows, only)
    if not {"item_id", "offset"} <= set(rows.columns):
        return shard_sizes(rows).withColumns({c: F.lit(None).cast("long") for c in CONTENT})
    return shard_contents(rows)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Store rows widened to float arrays, missing log-variances as zeros.

    Columns that only some shards have are null in the others; a tensor that none has is
    added to the schema, so old and new shards read together.
    """
    schema = T.StructType(list(store_schema(spark, path)))
    tensor = next((schema[t].dataType for t in TENSORS if t in schema.names), T.ArrayType(T.FloatType()))
    for name in TENSORS:
        if name not in schema.names:
            schema = schema.add(name, tensor)
    raw = open_files(spark, path, schema)
    if isinstance(tensor, T.BinaryType):
        raw = raw.withColumns({t: unpack_half(F.col(t)) for t in TENSORS})
    return default_logvar(raw)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Positions only; no tensor column is read."""
    return open_files(spark, path).select("global_idx", "item_id", "shard_id", "offset")


def committed_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards on disk with row counts and item sums (empty when there is no store yet).

    Taken from the shard table; a store without one is counted.
    """
    table = f"{path.rstrip('/')}_shards"
    if path_exists(spark, path) and path_exists(spark, f"{table}/_SUCCESS"):
        return spark.read.schema(SHARD_TABLE).parquet(table)
    return counted_shards(spark, path)


def counted_shards(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`committed_shards`, from the files themselves: what a resumed run trusts."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], SHARD_TABLE)
    return _counted(spark, path, store_schema(spark, path))


def drop_shards(spark: SparkSession, path: str, planned: DataFrame) -> int:
    """Remove the shards on disk that are not ``planned`` (shard_id); returns how many."""
    found = stored(counted_shards(spark, path), "shards-found")
    stale = found.join(planned.select("shard_id"), "shard_id", "left_anti").select("shard_id")
    if stale.isEmpty():
        return 0
    _save_table(found.join(stale, "shard_id", "left_anti"), path)
    base = qualified(spark, path)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_root(base)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                folder = f"{top}/shard_id={shard}"
                if system.get_file_info(folder).type != fs.FileType.NotFound:  # a repeated task finds it gone
                    system.delete_dir(folder)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    spread = stored(stale, "shards-stale").repartition(task_slots(spark), "shard_id")
    return spread.mapInArrow(remove, "n long").agg(F.sum("n")).first()[0]


def lookup(spark: SparkSession, path: str, indices: list[int] | DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Tensors for global indices, reading only the shards that hold them.

    A short Python list is located first (as many narrow rows as the list is long),
    so the scan gets constant filters: other shard partitions are not listed and
    other row groups not read. Longer lists and DataFrames first meet the store as the
    set of their shards, one narrow row each, and are joined inside those.
    ``meta`` (shard_id, n_images) defaults to the shard table.
    """
    meta = meta if meta is not None else committed_shards(spark, path)
    rows = read_store(spark, path)
    if isinstance(indices, DataFrame):
        wanted = stored(locate(meta, indices), "lookup")
        rows = _of_shards(rows, wanted)
    else:
        wanted = locate(meta, index_rows(spark, indices, "list_pos", "idx"))
        if len(indices) <= FILTER_INDICES:
            found = wanted.collect()
            wanted = F.broadcast(spark.createDataFrame(found, wanted.schema))
            rows = rows.where(
                F.col("shard_id").isin(sorted({r["shard_id"] for r in found}))
                & F.col("offset").isin(sorted({r["offset"] for r in found}))
            )
        else:
            wanted = stored(wanted, "lookup")
            rows = _of_shards(rows, wanted)
            if len(indices) <= MAX_BROADCAST_ROWS:  # one row per wanted index
                wanted = F.broadcast(wanted)
    return rows.join(wanted, ["shard_id", "offset"])


def _of_shards(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted shards only: prunes partitions before anything wide is joined."""
    ids = wanted.select("shard_id").distinct()
    n = ids.count()
    if n <= FILTER_INDICES:
        return rows.where(F.col("shard_id").isin([r["shard_id"] for r in ids.collect()]))
    return rows.join(F.broadcast(ids) if n <= MAX_BROADCAST_ROWS else ids, "shard_id", "left_semi")


def load_shards(spark: SparkSession, path: str, num_shards: int, planned: DataFrame | None = None, *, keep: bool = True) -> DataFrame:
    """The first ``num_shards`` shards, persisted if they are to ``keep``; a missing or short shard is an error."""
    found = committed_shards(spark, path).where(F.col("shard_id") < num_shards)
    if planned is None:
        planned = spark.range(num_shards).select(
            F.col("id").cast("int").alias("shard_id"), F.lit(None).cast("long").alias("n_images")
        )
        gaps = planned.join(found, "shard_id", "left_anti").select("shard_id")
    else:
        gaps = shard_audit(planned.where(F.col("shard_id") < num_shards), found).select("shard_id")
    bad = [r["shard_id"] for r in gaps.orderBy("shard_id").take(20)]
    if bad:
        raise FileNotFoundError(f"missing or short shards (first 20): {bad}")
    rows = read_store(spark, path).where(F.col("shard_id") < num_shards)
    return rows.persist(StorageLevel.MEMORY_AND_DISK) if keep else rows


def save_manifest(
    spark: SparkSession,
    path: str,
    items: DataFrame,
    models: dict[str, str],
    *,
    store: str,
    dataset_root: str = "",
    shard_size: int = SHARD_SIZE,
) -> None:
    """Describe the committed store in a one-row JSON table, written after the shards."""
    size = F.lit(int(shard_size))
    done = committed_shards(spark, store).agg(
        F.count(F.lit(1)).cast("int").alias("shard_count"),
        F.max("shard_id").alias("last_shard"),
    )
    model_map = F.create_map(*[F.lit(v) for pair in models.items() for v in pair]) if models else F.create_map()
    (
        dataset_fingerprint(items)
        .select(
            F.lit(1).alias("version"),
            F.lit(dataset_root).alias("dataset_root"),
            F.col("fingerprint").alias("dataset_hash"),
            model_map.cast("map<string,string>").alias("model_versions"),
            F.ceil(F.col("n_items") / size).cast("int").alias("total_shards"),
            done.select("shard_count").scalar().alias("shard_count"),
            done.select("last_shard").scalar().alias("last_shard"),
            F.current_timestamp().alias("created_at"),
        )
        .coalesce(1)
        .write.mode("overwrite")
        .json(path)
    )


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest row; unknown fields are ignored, a missing one is an error."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no manifest at {path}")
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def validate_store(spark: SparkSession, manifest_path: str, items: DataFrame, models: dict[str, str]) -> list[str]:
    """Reasons why the store cannot be used (empty list: valid)."""
    try:
        manifest = load_manifest(spark, manifest_path)
    except FileNotFoundError:
        return ["no_manifest"]
    reasons = []
    if manifest.first()["dataset_hash"] != dataset_fingerprint(items).first()["fingerprint"]:
        reasons.append("hash")
    recorded = manifest.select(F.explode("model_versions").alias("model", "version"))
    expected = spark.createDataFrame(list(models.items()), "model string, version string")
    changed = model_diff(recorded, expected).where(F.col("expected").isNotNull())
    return reasons + [f"model:{r['model']}" for r in changed.orderBy("model").collect()]
