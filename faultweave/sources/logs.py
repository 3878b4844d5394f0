"""Manifests, log lines, labels and bucket files."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultweave.functions import text as X

REQUIRED = ["Case", "Regr Log", "Sim Log", "Trace Log"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, ord, regr_log, sim_log, trace_log) in file order, with relative log paths put under the manifest's folder.

    A manifest is one small CSV file: it is read as one split, so its rows are numbered as they stand.
    """
    rows = spark.read.csv(path, header=True)
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"manifest lacks columns {missing}; found {rows.columns}")
    base = os.path.dirname(path if "://" in path else os.path.abspath(path))
    numbered = rows.select(*[F.col(f"`{c}`") for c in REQUIRED]).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    log = lambda c: X.resolve_path(base, F.trim(F.col(f"`{c}`"))).alias(c.lower().replace(" ", "_"))
    return numbered.select(F.col("Case").cast("long").alias("case_id"), F.col("n").alias("ord"), *[log(c) for c in REQUIRED[1:]])


def read_lines(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """(case_id, line_no, value) of ``wanted(case_id, path)``; a path ending in .gz is unpacked.

    Missing files have no lines; of a file that breaks off (a cut gzip) the lines before the break count.
    Only the paths go to the driver, and one listing a folder. Files are read line by line and large
    plain ones in several splits: a line's number is its place in its split after the lines of the splits before.
    """
    paths = [r["path"] for r in wanted.select("path").distinct().collect() if r["path"]]
    there = _existing(spark, paths)
    if not there:
        return spark.createDataFrame([], "case_id long, line_no int, value string")
    source = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(sorted(there))
    uri = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("uri")
    lines = source.select(uri, F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), "value")
    counts = lines.groupBy("uri", "split").agg(F.count("*").alias("lines"))
    before = counts.select("uri", "split", (F.sum("lines").over(Window.partitionBy("uri").orderBy("split")) - F.col("lines")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("uri", "split").orderBy("n")) - 1
    numbered = lines.withColumn("nth", nth).join(before, ["uri", "split"])
    places = spark.createDataFrame(list(there.items()), "path string, uri string")
    return numbered.join(F.broadcast(places), "uri").join(wanted, "path").select("case_id", (F.col("before") + F.col("nth")).cast("int").alias("line_no"), "value")


def _existing(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """path -> its full name, for those that are files; each folder is listed once."""
    folders: dict[str, dict[str, str]] = {}
    out = {}
    for path in paths:
        p, fs = _path(spark, path)
        folder = str(p.getParent()) if p.getParent() is not None else ""
        if folder not in folders:
            found = fs.listStatus(p.getParent()) if folder and fs.exists(p.getParent()) else []
            folders[folder] = {f.getPath().getName(): f.getPath().toUri().toString() for f in found if f.isFile()}
        if p.getName() in folders[folder]:
            out[path] = re.sub("^file:/+", "file:/", folders[folder][p.getName()])
    return out


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV; numbers in Case become long, all else stays text."""
    rows = spark.read.csv(path, header=True)
    return rows.withColumn("Case", F.col("Case").cast("long")) if "Case" in rows.columns else rows


def write_buckets(rows: DataFrame, path: str) -> None:
    """One CSV file at ``path``, with a header, in manifest order (one row a case); what was there before is replaced."""
    spark, parts = rows.sparkSession, f"{path.rstrip('/')}.parts"
    rows.coalesce(1).write.mode("overwrite").csv(parts, header=True)
    folder, fs = _path(spark, parts)
    goal = _path(spark, path)[0]
    written = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    fs.delete(goal, True)
    if not fs.rename(written[0], goal):
        raise OSError(f"cannot write {path}")
    fs.delete(folder, True)


def numbered_lines(texts: DataFrame, case: str, text: str) -> DataFrame:
    """(case_id, line_no, value) from a table that holds whole logs as text."""
    return texts.select(F.col(case).alias("case_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "value"))


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    back = Window.partitionBy("case_id").orderBy(F.col("line_no").desc())
    return lines.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n).drop("back")
