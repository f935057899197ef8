"""Structured Streaming: ingestion of raw files, exact dedup with a bounded state, daily counts, events."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import tables
from tidemark.operators import records
from tidemark.schemas import EVENT, RAW

MAX_ATTEMPTS = 3


def raw_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder; the checkpoint is the cursor."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", per_trigger).json(folder)


def accepted(raw: DataFrame, as_of: datetime) -> DataFrame:
    """Cleaned and valid records; late and future ones fall to the validation rule, not to a watermark."""
    return records.validate(records.clean(raw), as_of).filter("reason IS NULL")


def distinct(found: DataFrame, keys: list[str], time: str = "published_at", keep: str = "30 days") -> DataFrame:
    """First record of each key within the time that state is kept."""
    return found.withWatermark(time, keep).dropDuplicatesWithinWatermark(keys)


def daily(found: DataFrame, time: str = "published_at", late: str = "2 days") -> DataFrame:
    """(day, n) by tumbling windows of one day."""
    counted = found.withWatermark(time, late).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), "n")


def encode(event: DataFrame) -> DataFrame:
    """Events as (key, value) with the whole event as one JSON string."""
    return event.select(F.col("event_id").alias("key"), F.to_json(F.struct(*[F.col(c) for c in EVENT.names])).alias("value"))


def decode(wire: DataFrame) -> DataFrame:
    """Events of a JSON column; what can't be parsed has a null event_id."""
    return wire.select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*")


def retried(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed events for another attempt, and those that had their last one."""
    more = events.withColumn("attempt", F.col("attempt") + 1)
    return more.filter(F.col("attempt") < MAX_ATTEMPTS), more.filter(F.col("attempt") >= MAX_ATTEMPTS)


def dispatch(handlers: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each handler the events of its type; handlers are idempotent by batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for kind, handler in handlers.items():
                handler(batch.filter(F.col("event_type") == kind), batch_id)
        finally:
            batch.unpersist()

    return run


def merge_batches(target: str, keys: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into the keyed table at ``target``, made by the first one; a replay changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        made = tables.exists(spark, f"{target}/_log")
        table = tables.KeyedTable(spark, target) if made else tables.KeyedTable.create(spark, target, batch.schema, keys, buckets)
        tables.upserting(table, order)(batch, batch_id)

    return run


def run_once(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", batch: Callable | None = None) -> StreamingQuery:
    """All that is there now, then stop: to Parquet files or to a batch function."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(batch).start() if batch is not None else writer.format("parquet").option("path", sink).start()
    query.awaitTermination()
    return query


def expired(jobs: DataFrame, as_of: datetime, days: int = 45) -> Column:
    return F.col("last_seen_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
