"""Session helpers: a tuned local/cluster builder and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "tensorloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings this package is tuned for.

    Nothing in the package depends on these values for correct results; a caller
    may hand any session to any operator.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # rows of a few KB: one Arrow batch stays near 10 MB; lower it to some tens for full-size tensor rows
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.parquet.compression.codec": "zstd",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from the session.

    The cluster names it in ``spark.checkpoint.dir``. Only in local mode, where driver
    and executors are one process, do we make our own and register it, so later calls
    share it; elsewhere a session without the setting is an error, because executors
    would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tensorloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never-reused path below :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below :func:`scratch_root` and read back, so its lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """How many shuffle partitions this session plans for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def task_slots(spark: SparkSession) -> int:
    """How many tasks run at once, the bound used for partial-sum fan-in."""
    return max(spark.sparkContext.defaultParallelism, 1)


FILTER_INDICES = 1000  # index lists up to here become constant scan filters
MAX_BROADCAST_ROWS = 1_000_000  # narrow rows of a few longs: tens of MB


def index_rows(spark: SparkSession, indices: list[int], *columns: str) -> DataFrame:
    """A Python index list as a table; broadcast only while it is short.

    One column name gives the values alone, two give (position, value).
    """
    rows = [(int(i),) if len(columns) == 1 else (pos, int(i)) for pos, i in enumerate(indices)]
    listed = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns))
    return F.broadcast(listed) if len(rows) <= MAX_BROADCAST_ROWS else listed
