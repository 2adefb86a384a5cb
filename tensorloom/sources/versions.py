"""A feature store with versions: immutable shard folders under a log of commits.

``<path>/data/commit=C/shard_id=K`` holds what one commit wrote and never changes.
``<path>/tables/T`` lists the row groups of all shards of a version: commit, file, position
in the file, first offset, rows, and how many values their tensors have, all taken from the
files' footers. ``<path>/versions/N.json`` names the table and the schema of version N; it
appears whole, and only one writer can create it. That file is the commit.

So a reader that began at version N keeps seeing N, whatever is written meanwhile, and a
crash before the last step leaves folders that no version names. Two writers of one base
version both write their data; the one that comes second finds its number taken. If the
other one replaced none of its shards, it puts its own on top, otherwise it is refused.

Since the table knows every row group, a lookup opens just those that hold wanted rows, and
a description of the store reads no tensor at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tensorloom.functions.half import round_half, unpack_half
from tensorloom.operators.shards import default_logvar, locate
from tensorloom.session import FILTER_INDICES, MAX_BROADCAST_ROWS, index_rows, stored
from tensorloom.sources.inventory import _listed, child_names, open_root, path_exists, qualified
from tensorloom.sources.store import ROWS_PER_FILE, TENSORS, merge_schemas, place_rows

GROUP_BYTES = 16 << 20  # of a row group: a few rows of full size
FOOTER = "below string, row_group int, n_rows long, first_offset long, token_values long, latent_values long, n_logvar long"
TABLE = "commit string, shard_id int, " + FOOTER
EMPTY = 0  # the version of a store without commits


class ConflictError(RuntimeError):
    """Another writer replaced some of the same shards first."""


# ---- the log -----------------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions that can still be read, in order."""
    names = child_names(spark, f"{path}/versions")
    return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]


def _entry(spark: SparkSession, path: str, version: int) -> dict:
    file = f"{path}/versions/{version:012d}.json"
    if not path_exists(spark, file):
        raise FileNotFoundError(f"no version {version} at {path}")
    return json.loads(spark.read.text(file, wholetext=True).first()[0])


def _create_entry(spark: SparkSession, path: str, entry: dict) -> bool:
    """Create a version file whole; false when that version is there already.

    The text is written beside it and then moved where nothing may be: a hard link on a
    local disk, a rename without overwriting elsewhere, which is atomic on a file system
    such as HDFS. (An object store without such a rename can't keep two writers apart.)
    """
    target = f"{path}/versions/{entry['version']:012d}.json"
    system, own = _hadoop(spark, f"{path}/versions/.{uuid.uuid4().hex}.json")
    out = system.create(own, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    jvm = spark._jvm
    _, final = _hadoop(spark, target)
    try:
        if system.getScheme() == "file":
            paths = [jvm.java.nio.file.Path.of(system.makeQualified(p).toUri()) for p in (final, own)]
            jvm.java.nio.file.Files.createLink(*paths)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), spark._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(own, final, none)
        return True
    except Exception as error:  # noqa: BLE001 -- the JVM's error tells which
        if "AlreadyExists" in str(error):
            return False
        raise
    finally:
        system.delete(own, False)


def _table(spark: SparkSession, path: str, version: int) -> DataFrame:
    if version == EMPTY:
        return spark.createDataFrame([], TABLE)
    return spark.read.schema(TABLE).parquet(f"{path}/tables/{_entry(spark, path, version)['table']}")


def _version(spark: SparkSession, path: str, version: int | None) -> int:
    return version if version is not None else max(versions(spark, path), default=EMPTY)


# ---- writing -----------------------------------------------------------------------


def commit_shards(
    df: DataFrame,
    path: str,
    *,
    base: int | None = None,
    storage: str = "float",
    rows_per_file: int = ROWS_PER_FILE,
    placed: bool = False,
    removing: DataFrame | None = None,
) -> int:
    """Write the shards present in ``df`` as a new version and return its number.

    ``base`` is the version that the shards were made from (default: the newest). A later
    commit that changed one of the same shards is a :class:`ConflictError`, and the store
    stays as that one left it. ``removing`` (shard_id) names shards to leave out of the new
    version. Tensors are rounded to half precision, ``storage='half'`` packs them; a store
    keeps the storage it began with. The work is that of the written shards and of one
    narrow row per row group of the store.
    """
    spark = df.sparkSession
    if storage not in ("float", "half"):
        raise ValueError(f"unknown storage {storage!r}")
    path = path.rstrip("/")
    base = _version(spark, path, base)
    present = [t for t in TENSORS if t in df.columns]
    rows = df if placed else place_rows(df, rows_per_file)
    rows = round_half(rows, present, packed=storage == "half") if present else rows
    old = T.StructType.fromJson(_entry(spark, path, base)["schema"]) if base != EMPTY else None
    merge_schemas(old, rows.schema)  # refuse before anything is written
    commit = uuid.uuid4().hex
    (
        rows.write.option("compression", "zstd")
        .option("maxRecordsPerFile", int(rows_per_file))
        # row groups by bytes, looked at from the first row on: rows may be megabytes
        .option("parquet.block.size", GROUP_BYTES)
        .option("parquet.page.size.row.check.min", 1)
        .partitionBy("shard_id")
        .parquet(f"{path}/data/commit={commit}")
    )
    fresh = stored(row_groups(spark, f"{path}/data/commit={commit}").select(F.lit(commit).alias("commit"), "*"), "store-fresh")
    touched = fresh.select("shard_id").distinct()
    if removing is not None:
        touched = stored(touched.union(removing.select(F.col("shard_id").cast("int"))).distinct(), "store-touched")
    return _commit(spark, path, base, fresh, touched, rows.schema)


def _commit(spark: SparkSession, path: str, base: int, fresh: DataFrame, touched: DataFrame, schema: T.StructType) -> int:
    on = base
    began = _table(spark, path, base).select("shard_id", "commit").distinct()
    while True:
        last = max(versions(spark, path), default=EMPTY)
        if last > on:
            now = _table(spark, path, last).select("shard_id", "commit").distinct()
            changed = now.exceptAll(began).union(began.exceptAll(now)).select("shard_id")
            both = [r["shard_id"] for r in changed.join(touched, "shard_id", "left_semi").distinct().orderBy("shard_id").take(20)]
            if both:
                raise ConflictError(f"shards {both} changed since version {base} (now {last})")
            on = last
        kept = _table(spark, path, on).join(touched, "shard_id", "left_anti")
        table, name = kept.select(*fresh.columns).union(fresh), uuid.uuid4().hex
        table.write.parquet(f"{path}/tables/{name}")
        old = T.StructType.fromJson(_entry(spark, path, on)["schema"]) if on != EMPTY else None
        whole = merge_schemas(old, schema)
        if _create_entry(spark, path, {"version": on + 1, "base": base, "table": name, "schema": whole.jsonValue()}):
            return on + 1


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drop all but the newest ``keep`` versions and the commits that none of them names; returns how many commits.

    Readers of dropped versions fail from then on.
    """
    path, numbers = path.rstrip("/"), versions(spark, path.rstrip("/"))
    kept, gone = numbers[-keep:] if keep else [], numbers[: len(numbers) - keep]
    if not gone or not kept:
        return 0
    live: set[str] = set()
    for number in kept:
        live |= {r["commit"] for r in _table(spark, path, number).select("commit").distinct().collect()}  # one per commit
    system, data = _hadoop(spark, f"{path}/data")
    tables = {_entry(spark, path, n)["table"] for n in gone}
    dead = [s.getPath() for s in system.listStatus(data) if s.getPath().getName().removeprefix("commit=") not in live]
    for number in gone:  # first the names, then what they named
        system.delete(_hadoop(spark, f"{path}/versions/{number:012d}.json")[1], False)
    for folder in [*dead, *[_hadoop(spark, f"{path}/tables/{t}")[1] for t in sorted(tables)]]:
        system.delete(folder, True)
    return len(dead)


# ---- footers -----------------------------------------------------------------------


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, below, row_group, ...) of all files of a folder of shards, from their footers.

    Tasks list the shard folders and read the footers; no column chunk is opened.
    ``token_values`` and ``latent_values`` are values per row of ``tokens`` and ``gt_mean`` (null
    where they are packed), ``n_logvar`` the rows that have log-variances.
    """
    base = qualified(spark, path)
    top = _listed(spark.createDataFrame([("",)], "below string"), base).where("folder")
    files = _listed(top.select("below").repartition("below"), base).where("not folder and below like '%.parquet'")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_root(base)
        for batch in batches:
            rows = []
            for below in batch.column(0).to_pylist():
                with system.open_input_file(f"{root}/{below}") as file:
                    rows += [(below, *group) for group in _described(pq.ParquetFile(file).metadata)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in FOOTER.split(", ")]
            )

    shard = F.regexp_extract("below", r"shard_id=(-?\d+)/", 1).cast("int")
    return files.select("below").repartition("below").mapInArrow(read, FOOTER).select(shard.alias("shard_id"), "*")


def _described(footer: pq.FileMetaData) -> Iterator[tuple]:
    """(row group, rows, first offset, token values, latent values, rows with log-variances)."""
    for g in range(footer.num_row_groups):
        group = footer.row_group(g)
        chunks = {(c := group.column(k)).path_in_schema.split(".")[0]: c for k in range(group.num_columns)}

        def per_row(name: str) -> int | None:
            chunk = chunks.get(name)
            return None if chunk is None or chunk.physical_type == "BYTE_ARRAY" else chunk.num_values // group.num_rows  # noqa: B023

        offset, logvar = chunks.get("offset"), chunks.get("gt_logvar")
        first = offset.statistics.min if offset is not None and offset.statistics is not None else None
        nulls = logvar.statistics.null_count if logvar is not None and logvar.statistics is not None else None
        filled = 0 if logvar is None else group.num_rows - (nulls or 0)
        yield g, group.num_rows, first, per_row("tokens"), per_row("gt_mean"), filled


# ---- reading -----------------------------------------------------------------------


def version_shards(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(shard_id, n_images) of a version (default: the newest)."""
    table = _table(spark, path.rstrip("/"), _version(spark, path.rstrip("/"), version))
    return table.groupBy("shard_id").agg(F.sum("n_rows").alias("n_images"))


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of a version (default: the newest) with tensors as float arrays, missing log-variances as zeros.

    The frame stays with its version: later commits change nothing it reads.
    """
    path = path.rstrip("/")
    version = _version(spark, path, version)
    if version == EMPTY:
        raise FileNotFoundError(f"no version at {path}")
    live = _table(spark, path, version).select("commit", "shard_id").distinct()
    schema = T.StructType.fromJson(_entry(spark, path, version)["schema"])
    raw = spark.read.schema(_with_tensors(schema).add("commit", "string")).parquet(f"{path}/data")
    n = live.count()
    if n <= FILTER_INDICES:
        held: dict[str, list[int]] = {}
        for r in live.collect():
            held.setdefault(r["commit"], []).append(r["shard_id"])
        chosen = F.lit(False)
        for commit, ids in sorted(held.items()):
            chosen = chosen | ((F.col("commit") == commit) & F.col("shard_id").isin(sorted(ids)))
        raw = raw.where(F.col("commit").isin(sorted(held)) & chosen)
    else:
        raw = raw.join(F.broadcast(live) if n <= MAX_BROADCAST_ROWS else live, ["commit", "shard_id"], "left_semi")
    return _widened(raw).drop("commit")


def _with_tensors(schema: T.StructType) -> T.StructType:
    """The schema with any tensor that no commit had."""
    tensor = next((schema[t].dataType for t in TENSORS if t in schema.names), T.ArrayType(T.FloatType()))
    return T.StructType([*schema.fields, *[T.StructField(t, tensor) for t in TENSORS if t not in schema.names]])


def _widened(rows: DataFrame) -> DataFrame:
    packed = [t for t in TENSORS if isinstance(rows.schema[t].dataType, T.BinaryType)]
    return default_logvar(rows.withColumns({t: unpack_half(F.col(t)) for t in packed}) if packed else rows)


def located_groups(spark: SparkSession, path: str, indices: list[int] | DataFrame, version: int | None = None) -> DataFrame:
    """Wanted global indices with the row group that each one is in; indices beyond the store are left out.

    ``indices`` is a list, which adds ``list_pos``, or a table with a column ``idx``.
    """
    path = path.rstrip("/")
    table = _table(spark, path, _version(spark, path, version))
    wanted = indices if isinstance(indices, DataFrame) else index_rows(spark, indices, "list_pos", "idx")
    shards = table.groupBy("shard_id").agg(F.sum("n_rows").alias("n_images"))
    # a row group belongs to the files of its shard; within it, offsets tell
    groups = table.select("shard_id", "commit", "below", "row_group", "first_offset", "n_rows")
    placed = locate(shards, wanted).join(groups, "shard_id")
    inside = (F.col("offset") >= F.col("first_offset")) & (F.col("offset") < F.col("first_offset") + F.col("n_rows"))
    return placed.where(inside).drop("first_offset", "n_rows")


def lookup_version(spark: SparkSession, path: str, indices: list[int] | DataFrame, version: int | None = None) -> DataFrame:
    """Store rows of the wanted global indices, with the columns of ``indices``; reads the row groups that hold them and no others.

    The shards of the version have no holes: row k of a shard has offset k. Wanted rows meet
    by row group, so each one is opened by one task, however many of its rows are wanted;
    a task holds one row group.
    """
    path = path.rstrip("/")
    version = _version(spark, path, version)
    found = located_groups(spark, path, indices, version)
    schema = T.StructType.fromJson(_entry(spark, path, version)["schema"])
    own = [f for f in _with_tensors(schema).fields if f.name not in ("shard_id", "offset")]
    carried = [c for c in found.columns if c not in ("commit", "below", "row_group")]
    base, names = qualified(spark, f"{path}/data"), [f.name for f in own]
    out = T.StructType([*[found.schema[c] for c in carried], *own])
    arrow = to_arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_root(base)
        for part in _by_group(batches):
            commit, below, group = (part.column(c)[0].as_py() for c in ("commit", "below", "row_group"))
            with system.open_input_file(f"{root}/commit={commit}/{below}") as file:
                opened = pq.ParquetFile(file)
                there = [c for c in names if c in opened.schema_arrow.names]
                rows = opened.read_row_group(group, columns=["offset", *there])
            offsets = rows.column("offset").to_numpy()
            order = np.argsort(offsets)
            at = order[np.searchsorted(offsets, part.column("offset").to_numpy(), sorter=order)]
            taken = rows.take(pa.array(at)).combine_chunks()
            columns = [part.column(c) for c in carried]
            for name in names:  # a column that this commit doesn't have is null
                kind = arrow.field(name).type
                columns.append(taken.column(name).combine_chunks().cast(kind) if name in there else pa.nulls(part.num_rows, kind))
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], [*carried, *names])

    spread = found.repartition("commit", "below", "row_group").sortWithinPartitions("commit", "below", "row_group")
    return _widened(spread.select(*carried, "commit", "below", "row_group").mapInArrow(read, out))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal (commit, below, row_group); they arrive together."""
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("commit", "below", "row_group")], strict=True))
        edges = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]] + [len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def version_info(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row as ``store_info``, from the version's table alone; lengths of packed tensors are null."""
    path = path.rstrip("/")
    return _summed(_table(spark, path, _version(spark, path, version)))


def store_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row as ``store_info`` for a plain store folder, from its footers: no tensor is read.

    Tensors of a store are of one length each, which the footers give as values per row;
    for packed ones, whose lengths no footer tells, it is that of the first row.
    """
    told = _summed(row_groups(spark, path))
    raw = spark.read.parquet(path)
    packed = [(t, c) for t, c in (("tokens", "token_values"), ("gt_mean", "latent_values")) if dict(raw.dtypes).get(t) == "binary"]
    if packed:
        first = raw.select(*[F.octet_length(t).alias(c) for t, c in packed]).first()
        told = told.withColumns({c: F.lit(first[c] // 2 if first and first[c] is not None else None).cast("int") for _, c in packed})
    return told


def _summed(groups: DataFrame) -> DataFrame:
    per_shard = groups.groupBy("shard_id").agg(
        F.sum("n_rows").alias("n"),
        F.max("token_values").alias("token_values"),
        F.max("latent_values").alias("latent_values"),
        F.sum("n_logvar").alias("n_logvar"),
    )
    return per_shard.agg(
        F.sum("n").alias("total_samples"),
        F.count(F.lit(1)).alias("shard_count"),
        F.max("n").alias("largest_shard"),
        F.min("n").alias("smallest_shard"),
        F.max("token_values").cast("int").alias("token_values"),
        F.max("latent_values").cast("int").alias("latent_values"),
        F.sum("n_logvar").alias("with_logvar"),
    )
