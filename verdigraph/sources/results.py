"""Result files: verdict rows as JSON with a format marker, and as partitioned Parquet.

A JSON result folder has one object a line. The first line of every file marks format and version;
files without a mark are version 0. Parquet results are partitioned by package, so a reader prunes
both packages and property keys at the source.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.runtime import remove_path

FORMAT, VERSION = "verdigraph-results", 1
SCHEMA = "elem_id bigint, package string, key string, value string, origin string"
#: Keys whose explicit FALSE is a decision and is written; elsewhere FALSE is the default.
EXPLICIT_FALSE = ("nonModifyingMethod", "unmodifiedParameter")


class UnknownVersion(ValueError):
    """A result file has a version that this reader does not know."""


@dataclass
class Loaded:
    """Rows that were read, and how many lines could not be."""

    rows: DataFrame
    skipped: int


def sparse(rows: DataFrame) -> DataFrame:
    """Rows without defaults: undecided values go, and FALSE where it is not an explicit decision."""
    return rows.where(F.col("value").isNotNull() & ((F.col("value") != "false") | F.col("key").isin(*EXPLICIT_FALSE)))


def write_json(rows: DataFrame, path: str) -> int:
    """Write rows, marked with format and version; returns how many had no encodable value."""
    bad = rows.where("elem_id is null or key is null").count()
    good = sparse(rows.where("elem_id is not null and key is not null"))
    lines = good.select(F.to_json(F.struct("elem_id", "package", "key", "value", "origin")).alias("value"), "package", "elem_id", "key")
    ordered = lines.repartitionByRange("package", "elem_id").sortWithinPartitions("package", "elem_id", "key").select("value")
    mark = json.dumps({"format": FORMAT, "version": VERSION})

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(batches):
            if not n:
                yield pa.RecordBatch.from_arrays([pa.array([mark])], names=["value"])
            yield b

    ordered.mapInArrow(marked, "value string").write.option("maxRecordsPerFile", 0).text(path)
    return bad


def _check_version(lines: DataFrame) -> None:
    marks = lines.where(F.get_json_object("value", "$.format").isNotNull())
    wrong = marks.where(~F.coalesce(F.get_json_object("value", "$.version").cast("int"), F.lit(-1)).isin(0, VERSION)).limit(1).collect()
    if wrong:
        raise UnknownVersion(f"result file with an unknown version: {wrong[0].value}")


def read_lines(lines: DataFrame, strict: bool = True, keys: list[str] | None = None) -> Loaded:
    """Rows from a table of JSON lines (value); ``strict`` raises on the first that is broken."""
    _check_version(lines)
    body = lines.where(F.get_json_object("value", "$.format").isNull() & (F.trim("value") != ""))
    parsed = body.select(F.from_json("value", SCHEMA + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    good = F.col("_broken").isNull() & F.col("elem_id").isNotNull() & F.col("key").isNotNull()
    skipped = parsed.where(~good).count()
    if strict and skipped:
        raise ValueError(f"{skipped} result lines cannot be decoded")
    rows = parsed.where(good).drop("_broken")
    return Loaded(rows.where(F.col("key").isin(*keys)) if keys is not None else rows, skipped)


def read_json(spark: SparkSession, paths: list[str], strict: bool = True, keys: list[str] | None = None) -> Loaded:
    """Rows from result folders; see ``read_lines``."""
    return read_lines(spark.read.text(paths), strict, keys)


def read_string(spark: SparkSession, content: str, strict: bool = True) -> Loaded:
    return read_lines(spark.createDataFrame([(line,) for line in content.splitlines()], "value string"), strict)


def read_archive(spark: SparkSession, path: str, folder: str, strict: bool = True) -> Loaded:
    """Rows from a zip of result files, unpacked to ``folder``, which all executors must see."""
    with zipfile.ZipFile(path) as z:
        z.extractall(folder)
        names = [f"{folder}/{n}" for n in z.namelist() if not n.endswith("/")]
    return read_json(spark, names, strict)


def write_parquet(rows: DataFrame, path: str) -> None:
    sparse(rows).repartition("package").sortWithinPartitions("key", "elem_id").write.partitionBy("package").parquet(path)


def read_parquet(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Rows with a filter on keys that reaches the scan."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.where(F.col("key").isin(*keys)) if keys is not None else rows


def restore(present: DataFrame, loaded: DataFrame) -> DataFrame:
    """What was there stays; only absent (elem_id, key) are filled from ``loaded``."""
    return present.unionByName(loaded.join(present.select("elem_id", "key"), ["elem_id", "key"], "left_anti"))


class Checkpoints:
    """Appends each pass's changed rows; reading takes the last row of each (elem_id, key)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def pass_completed(self, iteration: int, changed: DataFrame) -> None:
        changed.select("elem_id", "package", "key", "value", "origin").withColumn("iteration", F.lit(iteration)).write.mode("append").partitionBy("iteration").parquet(self.path)

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA + ", iteration int").parquet(self.path)
        newest = rows.groupBy("elem_id", "key").agg(F.max_by(F.struct("package", "value", "origin"), "iteration").alias("r"))
        return newest.select("elem_id", "r.package", "key", "r.value", "r.origin")

    def clear(self) -> None:
        remove_path(self.spark, self.path)


class IncrementalState:
    """Fingerprints and consumption edges between runs, as two tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, fingerprints: DataFrame, consumption: DataFrame) -> None:
        fingerprints.select("node", "fp").write.mode("overwrite").parquet(f"{self.path}/fingerprints")
        consumption.select("consumed", "consumer").write.mode("overwrite").parquet(f"{self.path}/consumption")

    def load(self) -> tuple[DataFrame, DataFrame]:
        return self.spark.read.parquet(f"{self.path}/fingerprints"), self.spark.read.parquet(f"{self.path}/consumption")

    def changed(self, now: DataFrame) -> DataFrame:
        """Nodes that are new or whose fingerprint differs."""
        before, _ = self.load()
        return now.select("node", "fp").join(before, ["node", "fp"], "left_anti").select("node")
