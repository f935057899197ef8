"""File sources and sinks: CSV, TSV, JSON, JSON lines, Parquet; the columnar store and its maintenance."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schemas import EXPORT, conform
from tidemark.sources import mapping as mp

#: Nodes of a parsed statement that change something.
WRITES = ("InsertInto", "Command", "CreateTable", "DeleteFrom", "UpdateTable", "MergeInto", "OverwriteBy", "DropTable")
SUFFIXES = (".csv", ".tsv", ".json", ".jsonl", ".ndjson", ".parquet")


def within(path: str, roots: list[str]) -> str:
    """The resolved path, if one of the allowed roots holds it."""
    full = os.path.realpath(path)
    if not any(full == os.path.realpath(r) or full.startswith(os.path.realpath(r) + os.sep) for r in roots):
        raise ValueError("the path is outside the allowed folders")
    return full


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of a file scan (with ``file`` and ``block``, where the piece of the file they were read from begins) with ``row``: their number over
    all files in order of path, and of place in the file.

    Two passes: rows are counted for each piece, running sums of the counts give each piece its first number, and a row adds its place
    in the piece, which one task reads in order. How files are cut and dealt doesn't matter, nor that the last one has grown since.
    """
    placed = rows.withColumn("_id", F.monotonically_increasing_id())
    pieces = placed.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each piece of a file, not for rows
    offsets = pieces.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, ["file", "block"]).withColumn("row", F.col("_offset") + F.col("_id") - F.col("_first")).drop("_id", "_first", "_offset", "block")


def scan(spark: SparkSession, path: str, records_path: str | None = None) -> DataFrame:
    """(payload variant, file, row): one row per record of a file or folder of one format, numbered in order; lines that aren't records keep their numbers."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"no reader for {suffix}")
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    if suffix in (".csv", ".tsv"):
        table = spark.read.csv(path, sep="\t" if suffix == ".tsv" else ",", header=True, multiLine=True, escape='"', encoding="UTF-8")
        return numbered(table.select(F.parse_json(F.to_json(F.struct("*"))).alias("payload"), *at)).select("payload", "file", "row")
    if suffix == ".parquet":
        return numbered(spark.read.parquet(path).select(F.parse_json(F.to_json(F.struct("*"))).alias("payload"), *at)).select("payload", "file", "row")
    if suffix == ".json":
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), *at)
        held = mp.extract_path(F.col("v"), records_path) if records_path else F.coalesce(F.when(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")), F.col("v")), mp.extract_path(F.col("v"), "jobs"), mp.extract_path(F.col("v"), "results"), mp.extract_path(F.col("v"), "data"))
        return numbered(whole.select(F.explode(F.try_variant_get(held, "$", "array<variant>")).alias("payload"), "file", "block")).select("payload", "file", "row")
    lines = numbered(spark.read.text(path).select("value", *at))
    return lines.filter(F.trim("value") != "").select(F.try_parse_json("value").alias("payload"), "file", "row").filter("payload IS NOT NULL")


def dataset(spark: SparkSession, path: str, source: str, mapping: dict[str, str] | None = None, roots: list[str] | None = None, after: int = -1) -> DataFrame:
    """Raw records of a file; ``after`` resumes behind a row number."""
    if roots is not None:
        path = within(path, roots)
    rows = scan(spark, path).filter(F.col("row") > after)
    return mp.to_raw(rows, source, "dataset", mapping, PurePosixPath(path).stem)


def export(jobs: DataFrame, root: str) -> None:
    """Write the columnar store; partitions that ``jobs`` touches are replaced, so a repeat changes nothing."""
    flat = conform(jobs, EXPORT)
    e = F.coalesce("published_at", "first_seen_at")
    flat = flat.withColumns({"year": F.year(e), "month": F.month(e), "day": F.dayofmonth(e), "skills": F.array_sort(F.array_distinct("skills"))})
    flat.repartition("year", "month", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy("year", "month", "day").parquet(root)


def store(spark: SparkSession, root: str) -> DataFrame:
    """The columnar store as a view named jobs."""
    found = spark.read.schema(EXPORT).parquet(root)
    found.createOrReplaceTempView("jobs")
    return found


def query(spark: SparkSession, root: str, sql: str, args: dict | list | None = None) -> DataFrame:
    """Any read-only SQL over the view jobs, with bound parameters."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    # the parser knows what a statement is; commands and inserts, also behind WITH, are no queries
    nodes = [plan.nodeName(), plan.toString()]
    if not sql.lstrip().lower().startswith(("select", "with")) or any(w in n for n in nodes for w in WRITES):
        raise ValueError("only queries are allowed")
    store(spark, root)
    return spark.sql(sql, args=args or {})


def _footers(spark: SparkSession, root: str) -> DataFrame:
    """The store read so that counts and extremes come from the files' footers: in a session of its own, whose settings nobody else sees."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(root)


def partitions(spark: SparkSession, root: str) -> DataFrame:
    """(year, month, day, n): the partitions of the store with their rows; no column is read."""
    return _footers(spark, root).groupBy("year", "month", "day").agg(F.count("*").alias("n"))


def row_count(spark: SparkSession, root: str) -> int:
    return _footers(spark, root).agg(F.count("*").alias("n")).first()["n"]


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def quarantine(bad: DataFrame, path: str) -> None:
    bad.write.mode("append").parquet(path)
