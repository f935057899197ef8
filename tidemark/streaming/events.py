"""An event processor over micro-batches: handlers by type, failed events tried again, dead letters after the last attempt.

Events that fail go to the retry folder with one attempt more, as the wire format of ``jobs.encode``; ``with_retries`` reads that folder as a
second source of the same stream. After the last attempt, or without a handler, or when they can't be decoded, they go to the dead letters with a
reason. Both folders take one folder a batch and type, written whole or not at all; a replayed batch finds its own there and writes
nothing twice. Handlers get the batch id and have to be idempotent by it, as a merge into a ``tables.KeyedTable`` is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.streaming import jobs

#: (event_type) -> function of (events, batch id) that raises, or gives the failed events as (event_id, error), or None.
Handler = Callable[[DataFrame, int], DataFrame | None]


def with_retries(spark: SparkSession, wire: DataFrame, retry_folder: str) -> DataFrame:
    """Decoded events of a stream of (key, value) and of the retry folder, with the wire value for dead letters."""
    fs, at = tables._fs(spark, retry_folder)
    fs.mkdirs(at)
    again = spark.readStream.schema("key string, value string").option("recursiveFileLookup", "true").json(retry_folder)
    both = wire.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).unionByName(again)
    return both.select("value", F.from_json("value", jobs.EVENT).alias("e")).select("value", "e.*")


def _once(df: DataFrame, folder: str) -> None:
    """Write a folder that isn't there yet; what a lost attempt left is written over."""
    if not tables.exists(df.sparkSession, f"{folder}/_SUCCESS"):
        df.write.mode("overwrite").json(folder)


def processing(handlers: dict[str, Handler], retry_folder: str, dead_folder: str, attempts: int = jobs.MAX_ATTEMPTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for ``with_retries``; an event that fails is tried ``attempts`` times in all."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = tables.stage(batch.withColumn("attempt", F.coalesce("attempt", F.lit(0))), "events")
        known = F.coalesce(F.col("event_type").isin(*handlers), F.lit(False))
        reason = F.when(F.col("event_id").isNull() | F.col("event_type").isNull(), "undecodable").when(~known, "no handler")
        lost = batch.withColumn("error", reason).filter("error is not null").select("value", "error")
        if lost.limit(1).count():
            _once(lost, f"{dead_folder}/batch={batch_id}-other")
        for kind, handler in handlers.items():
            mine = batch.filter((F.col("event_type") == kind) & F.col("event_id").isNotNull())
            if not mine.limit(1).count():
                continue
            try:
                failed = handler(mine.drop("value"), batch_id)
                told = None if failed is None else mine.join(failed.select("event_id", "error").dropDuplicates(["event_id"]), "event_id")
            except Exception as error:  # a handler may fail in any way; the events aren't lost, they are tried again
                told = mine.withColumn("error", F.lit(f"{type(error).__name__}: {error}"[:500]))
            if told is None:
                continue
            told = tables.stage(told, "failed").withColumn("attempt", F.col("attempt") + 1)
            more, dead = told.filter(F.col("attempt") < attempts), told.filter(F.col("attempt") >= attempts)
            if more.limit(1).count():
                _once(jobs.encode(more), f"{retry_folder}/batch={batch_id}-{kind}")
            if dead.limit(1).count():
                _once(dead.select("value", "error", "event_id", "event_type", "attempt"), f"{dead_folder}/batch={batch_id}-{kind}")

    return run


def dead_letters(spark: SparkSession, dead_folder: str) -> DataFrame:
    """(value, error, event_id, event_type, attempt) of all that was given up."""
    schema = "value string, error string, event_id string, event_type string, attempt int"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(dead_folder) if tables.exists(spark, dead_folder) else spark.createDataFrame([], schema)
