"""Incremental ingestion, and live logs as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tensorloom.operators.telemetry import RUN_IN_PATH, parse_steps, with_run
from tensorloom.sources.inventory import child_names, glob_to_regex, list_tree, with_path_parts

LANDED = "path string, length long, mtime timestamp, file_name string, parent string, ext string"
SETTLED = 60.0  # seconds after which a folder's time of change tells whether it changed again


def incremental_ingest(
    spark: SparkSession, root: str, sink: str, checkpoint: str, name_glob: str = "*", settled: float = SETTLED
) -> None:
    """Append the files that arrived since the last call to the Parquet sink; each path enters once.

    Names that start with ``_`` or ``.`` count (see ``list_files``). A call lists the tree and
    lands the files of folders that changed since the last call; a stream takes what has
    landed, drops the paths it knows from its state store, and writes every micro-batch
    into its own partition of the sink (``batch``). So a call that dies at any point may be
    repeated: folders are noted only after their files have landed, and a batch that is run
    again meets the same state and replaces its own partition. Beyond the listing, the work is that
    of changed folders. One call runs at a time; a second one fails on the stream's checkpoint.

    A folder counts as changed unless its time of change is the noted one, and older than
    ``settled`` seconds when it was noted; where folders have no times, all count as changed.
    The state holds one path per file: set ``spark.sql.streaming.stateStore.providerClass`` to
    RocksDB for many millions.
    """
    checkpoint, landing = checkpoint.rstrip("/"), f"{checkpoint.rstrip('/')}/landing"
    tree = list_tree(spark, root)
    fits = F.concat(F.lit("/"), F.col("below")).rlike(glob_to_regex(name_glob))
    parent = F.regexp_extract("below", r"^(.*)/[^/]*$", 1)
    files = tree.where("not folder").where(fits).select("path", "length", "mtime", parent.alias("_in"))
    noted = child_names(spark, f"{checkpoint}/folders")
    if noted:
        before = spark.read.schema(FOLDERS).parquet(f"{checkpoint}/folders/{noted[-1]}").where("settled")
        now = tree.where("folder").select(F.col("below").alias("_in"), "mtime")
        same = now.join(before.select("_in", "mtime"), ["_in", "mtime"]).select("_in")
        files = files.join(same, "_in", "left_anti")
    with_path_parts(files.drop("_in")).select(*LANDED_COLUMNS).write.mode("append").parquet(landing)
    old = F.current_timestamp() - F.make_dt_interval(secs=F.lit(settled)) > F.col("mtime")
    folders = tree.where("folder").select(F.col("below").alias("_in"), "mtime", F.coalesce(old, F.lit(False)).alias("settled"))
    folders.write.parquet(f"{checkpoint}/folders/{int(noted[-1]) + 1 if noted else 0:012d}")
    fresh_paths(spark, landing).writeStream.foreachBatch(lambda rows, batch: put_batch(rows, batch, sink)).option(
        "checkpointLocation", f"{checkpoint}/stream"
    ).trigger(availableNow=True).start().awaitTermination()


FOLDERS = "_in string, mtime timestamp, settled boolean"
LANDED_COLUMNS = [c.split()[0] for c in LANDED.split(", ")]


def fresh_paths(spark: SparkSession, landing: str) -> DataFrame:
    """Stream of landed files whose path never came before."""
    return spark.readStream.schema(LANDED).parquet(landing).dropDuplicates(["path"])


def put_batch(rows: DataFrame, batch: int, sink: str) -> None:
    """Write a micro-batch as the partition of its number: again gives the same sink."""
    writer = rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch").parquet(sink)


def tail_steps(
    spark: SparkSession,
    path: str,
    steps_per_epoch: Column | int | None = None,
    name_glob: str = "*.log",
    run_pattern: str = RUN_IN_PATH,
) -> DataFrame:
    """Step rows from log files as they arrive."""
    lines = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob).text(path)
    return parse_steps(with_run(lines, run_pattern), steps_per_epoch)


def write_steps(steps: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return (
        steps.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
