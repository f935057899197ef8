"""Tables in the folder that driver and executors share: staged results, small JSON files, a keyed table with versions."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without one, as in tests, gets a temporary folder; a cluster has to name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local-one")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "tidemark-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back, so that nothing before it is computed again."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, at = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def put_json(spark: SparkSession, path: str, value: object) -> None:
    """Write a small JSON file under a name that isn't taken yet: whole or not at all, by renaming."""
    fs, at = _fs(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    if not fs.rename(part, at):
        fs.delete(part, False)
        raise FileExistsError(path)


def get_json(spark: SparkSession, path: str) -> object:
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    return json.loads(rows[0][0])


def last_by(order: str, keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Of a key's stored and new rows the one of the greatest ``order``, the new one among equals; late rows don't win."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        kept = both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*old.columns), F.struct(order, "_new")).alias("r"))
        return kept.select("r.*")

    return merge


class KeyedTable:
    """Rows unique by ``keys``, kept in buckets of a hash of them, with versions.

    A merge rewrites only the buckets that its rows fall into, as files of a new version, and then adds one file to the log:
    which version holds each bucket, and the last batch of every writer. The newest log file is the table, so readers see a batch
    whole or not at all, a batch that is replayed is known by its number and changes nothing, and one that failed half-way
    leaves only files that no log names. One writer at a time; a second one that took the same version fails and can repeat.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: StructType, keys: list[str], buckets: int = 64) -> KeyedTable:
        table = cls(spark, folder)
        put_json(spark, f"{table.folder}/_log/{0:012d}.json", {"version": 0, "schema": schema.jsonValue(), "keys": keys, "buckets": buckets, "parts": {}, "ledger": {}})
        return table

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in names(self.spark, f"{self.folder}/_log") if n.endswith(".json")]

    def state(self, version: int | None = None) -> dict:
        return get_json(self.spark, f"{self.folder}/_log/{self.versions()[-1] if version is None else version:012d}.json")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of some buckets if they are named."""
        state = self.state(version)
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in state["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int")

    def merge(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame], writer: str = "") -> bool:
        """Merge a batch that is unique by the keys; False if this writer's batch has been merged before."""
        state = self.state()
        if state["ledger"].get(writer, -1) >= batch_id:
            return False
        version, schema = state["version"] + 1, StructType.fromJson(state["schema"])
        new = batch.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        touched = sorted(r[0] for r in new.select(self.bucket(state)).distinct().collect())  # at most ``buckets`` numbers
        parts = dict(state["parts"])
        if touched:
            merged = merge(self.read(state["version"], touched), new).select(*schema.names)
            path = f"{self.folder}/data/v={version}"
            merged.withColumn("bucket", self.bucket(state)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = {n.split("=")[1] for n in names(self.spark, path) if n.startswith("bucket=")}
            parts = {b: v for b, v in parts.items() if int(b) not in touched} | {b: version for b in written}
        put_json(self.spark, f"{self.folder}/_log/{version:012d}.json", state | {"version": version, "parts": parts, "ledger": state["ledger"] | {writer: batch_id}})
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Delete what only versions before the newest ``keep`` use, and files that no version names."""
        versions = self.versions()
        used = {f"v={v}/bucket={b}" for n in versions[-keep:] for b, v in self.state(n)["parts"].items()}
        for n in versions[:-keep]:
            delete(self.spark, f"{self.folder}/_log/{n:012d}.json")
        for v in names(self.spark, f"{self.folder}/data"):
            if int(v.split("=")[1]) <= versions[-1]:
                for b in names(self.spark, f"{self.folder}/data/{v}"):
                    if b.startswith("bucket=") and f"{v}/{b}" not in used:
                        delete(self.spark, f"{self.folder}/data/{v}/{b}")


def upserting(table: KeyedTable, order: str, writer: str = "", merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges the last row of each key; a replayed batch changes nothing."""
    keys = table.state()["keys"]

    def run(batch: DataFrame, batch_id: int) -> None:
        unique = batch.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*").persist()
        try:
            table.merge(unique, batch_id, merge or last_by(order, keys), writer)
        finally:
            unique.unpersist()

    return run
