"""Corpus inventory: which files exist, without opening any of them."""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.session import stored, task_slots

SIGNATURE_HEX = 16  # fixed value: signature length in hex digits
SIGNATURE_JOIN = ":::"  # fixed value: separator between root and pattern


def with_path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Add file_name, parent (last directory) and ext (lower case, no dot)."""
    p = F.col(path)
    return df.withColumns(
        {
            "file_name": F.regexp_extract(p, r"([^/]+)$", 1),
            "parent": F.regexp_extract(p, r"([^/]+)/[^/]+$", 1),
            "ext": F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1)),
        }
    )


def scan_items(spark: SparkSession, root: str, patterns: str | list[str] = "**/*.jpg") -> DataFrame:
    """Recursive listing of ``root``; several glob patterns are concatenated.

    Patterns see the path below the root, so a folder named like the root is no match by
    itself. Names that start with ``_`` or ``.`` are files like any other. Rows hold path,
    length and mtime; no file is opened.
    """
    files = list_files(spark, root)
    listings = [
        files.where(F.concat(F.lit("/"), F.col("below")).rlike(glob_to_regex(p)))
        for p in ([patterns] if isinstance(patterns, str) else patterns)
    ]
    out = listings[0]
    for more in listings[1:]:
        out = out.unionByName(more)
    return with_path_parts(out.drop("below"))


LISTED = "below string, length long, mtime timestamp, folder boolean"


PAGE = 10_000  # names of a folder that a task holds at once


def list_files(spark: SparkSession, root: str, page: int = PAGE) -> DataFrame:
    """(path, below, length, mtime) of every file under ``root``; ``below`` is the path from the root."""
    return list_tree(spark, root, page).where("not folder").drop("folder")


def list_tree(spark: SparkSession, root: str, page: int = PAGE) -> DataFrame:
    """(path, below, length, mtime, folder) of everything under ``root``.

    Spark's own file index leaves out names that start with ``_`` or ``.`` and keeps the
    whole tree on the driver. Here tasks list directories, one level of the tree per
    round; each level is written to the shared folder, and the driver only asks whether
    there is a next one.
    """
    base = qualified(spark, root)
    levels, now = [], stored(_listed(spark.createDataFrame([("",)], "below string"), base, page), "listing")
    while True:
        levels.append(now)
        folders = now.where("folder").select("below")
        if folders.isEmpty():
            break
        now = stored(_listed(folders.repartition("below"), base, page), "listing")
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    path = F.concat(F.lit(base.rstrip("/") + "/"), F.col("below"))
    return out.select(path.alias("path"), "below", "length", "mtime", "folder")


def _listed(folders: DataFrame, base: str, page: int = PAGE) -> DataFrame:
    """Entries of each folder, itself given as a path below ``base``.

    On a local or mounted disk one task streams the names of a folder in pages, and sizes
    and times are asked for by all tasks, so a folder of any size keeps neither one task
    busy nor its memory full. Elsewhere a listing brings sizes and times along.
    """
    if base.startswith("file:"):
        names = _names(folders, base, page)
        return _stated(names.repartition(task_slots(names.sparkSession), "below"), base, page)

    def ls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_root(base)
        for batch in batches:
            for below in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{top}/{below}" if below else top))
                for at in range(0, len(found), page):
                    part = found[at : at + page]
                    yield _entries([f"{below}/{i.base_name}" if below else i.base_name for i in part], part)

    return folders.mapInArrow(ls, LISTED)


def name_pages(folder: str, below: str, page: int) -> Iterator[list[str]]:
    """Names in a local folder, ``page`` at once, as paths below the root."""
    names: list[str] = []
    with os.scandir(folder) as entries:
        for entry in entries:
            names.append(f"{below}/{entry.name}" if below else entry.name)
            if len(names) == page:
                yield names
                names = []
    if names:
        yield names


def _names(folders: DataFrame, base: str, page: int) -> DataFrame:
    def ls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, top = open_root(base)
        for batch in batches:
            for below in batch.column(0).to_pylist():
                for names in name_pages(f"{top}/{below}" if below else top, below, page):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["below"])

    return folders.mapInArrow(ls, "below string")


def _stated(names: DataFrame, base: str, page: int) -> DataFrame:
    """Sizes and times of names; those that are gone by now are left out."""

    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_root(base)
        for batch in batches:
            for at in range(0, batch.num_rows, page):
                own = batch.column(0).slice(at, page).to_pylist()
                found = system.get_file_info([f"{top}/{n}" for n in own])
                there = [k for k, i in enumerate(found) if i.type != fs.FileType.NotFound]
                yield _entries([own[k] for k in there], [found[k] for k in there])

    return names.mapInArrow(stat, LISTED)


def _entries(names: list[str], found: list[fs.FileInfo]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.string()),
            pa.array([i.size for i in found], pa.int64()),
            pa.array([i.mtime for i in found], pa.timestamp("us", "UTC")),
            pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_()),
        ],
        ["below", "length", "mtime", "folder"],
    )


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's readers show it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def open_root(base: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a qualified folder, usable inside tasks."""
    if base.startswith("file:"):
        return fs.LocalFileSystem(), "/" + base.removeprefix("file:").strip("/")
    system, top = fs.FileSystem.from_uri(base)
    return system, top.rstrip("/")


def write_files(files: DataFrame, root: str) -> int:
    """Write ``content`` (binary) to ``below`` (a path under ``root``) in tasks; returns the number of files.

    A file appears under its name when complete, so a repeated task leaves the same tree.
    """
    base = qualified(files.sparkSession, root)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_root(base)
        for batch in batches:
            for below, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder, _, name = f"{top}/{below}".rpartition("/")
                system.create_dir(folder, recursive=True)
                own = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(own, compression=None) as out:
                    out.write(content.as_buffer())
                system.move(own, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return files.select("below", "content").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def glob_to_regex(pattern: str) -> str:
    """Regex over the path below the root. ``**`` spans directories; a pattern is
    matched at any depth, as a recursive glob is."""
    pieces = []
    for part in pattern.strip("/").split("/"):
        if part == "**":
            pieces.append("(?:[^/]+/)*")
        else:
            one = fnmatch.translate(part)
            inner = re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"\1", one).replace(".*", "[^/]*")
            pieces.append(re.sub(r"(?<![\\\]])\.(?!\*)", "[^/]", inner) + "/")
    return "/(?:[^/]+/)*" + "".join(pieces).rstrip("/") + "$"


def signature(root: Column, pattern: Column) -> Column:
    """Key of a cached listing: first hex digits of sha256 over root and pattern."""
    return F.substring(F.sha2(F.concat_ws(SIGNATURE_JOIN, root, pattern), 256), 1, SIGNATURE_HEX)


def inventory_snapshot(
    spark: SparkSession, store: str, root: str, pattern: str = "**/*.jpg", *, refresh: bool = False
) -> DataFrame:
    """Listing kept as Parquet below ``store``, one partition per (root, pattern).

    Reused when present, replaced when ``refresh`` is set; the partition filter
    means other listings are never touched.
    """
    sig = spark.range(1).select(signature(F.lit(root), F.lit(pattern))).first()[0]
    if refresh or not _has_partition(spark, store, sig):
        (
            scan_items(spark, root, pattern)
            .withColumn("sig", F.lit(sig))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("sig")
            .parquet(store)
        )
        if not _has_partition(spark, store, sig):  # empty listing writes no partition
            return scan_items(spark, root, pattern).withColumn("sig", F.lit(sig))
    return spark.read.parquet(store).where(F.col("sig") == sig)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _has_partition(spark: SparkSession, store: str, sig: str) -> bool:
    return path_exists(spark, f"{store}/sig={sig}")
