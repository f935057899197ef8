"""Near-duplicates in a stream: per band key the signatures of a window of event time, as keyed state with timers.

A record goes to each of its band keys. The state of a key holds one entry (id, place in order, time, signature) for each different
signature; a record is compared with those, and a pair is told by the first band that both share, so once. Entries leave by an
event-time timer when the window has passed them. A later record of a known signature isn't kept: it is never accepted,
so nothing can be a duplicate of it; state is bounded by the different signatures of a window, whatever the copies.

The pairs of a micro-batch are resolved by the greedy rule of the batch operator, with the duplicates of earlier batches known: what
came in an earlier micro-batch stands before what came later. Within a micro-batch ``ord`` decides.

A null text or one without tokens has no band and is never a duplicate; a record with a null time is compared but not kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark import tables
from tidemark.operators import dedup

DAY = 86_400_000
#: What the state needs of a session.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class NearWindow(StatefulProcessor):
    """State and pairs of one band key."""

    def __init__(self, days: int, threshold: float, bands: int) -> None:
        self.keep, self.threshold, self.bands = days * DAY, threshold, bands

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "id long, ord long, ms long, sig binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.seen.get())
        sigs = [np.frombuffer(h[3], np.int64) for h in held]
        come = pd.concat(list(rows)).sort_values(["ord", "id"])
        fresh, found = [], []
        for r in come.itertuples(index=False):
            mine, ms = np.asarray(r.sig, dtype=np.int64), None if pd.isna(r.ms) else int(r.ms)
            known = False
            for (other, place, then, _), theirs in zip(held, sigs, strict=True):
                if ms is not None and abs(ms - then) > self.keep:
                    continue
                same = mine == theirs
                known |= bool(same.all())
                if same.mean() >= self.threshold and int(np.argmax(same.reshape(self.bands, -1).all(axis=1))) == r.band:
                    found.append((int(r.id), other, float(same.mean()), place))
            if ms is not None and not known:
                entry = (int(r.id), int(r.ord), ms, mine.tobytes())
                held.append(entry)
                sigs.append(mine)
                fresh.append(entry)
        if fresh:
            self.seen.appendList(fresh)
            for end in {(e[2] // DAY + 1) * DAY + self.keep for e in fresh}:  # one timer a day
                self.handle.registerTimer(end)
        yield pd.DataFrame(found, columns=["later", "earlier", "score", "ord"]).astype({"later": "int64", "earlier": "int64", "score": "float64", "ord": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        left = [tuple(h) for h in self.seen.get() if h[2] + self.keep >= end]
        if left:
            self.seen.put(left)
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def near_pairs(found: DataFrame, time: str = "published_at", days: int = 30, late: str = "2 days", threshold: float = 0.85, bands: int = dedup.BANDS) -> DataFrame:
    """(later, earlier, score, ord) of a stream of (id long, ord long, ``time``, text): pairs at most ``days`` apart."""
    signed = found.withWatermark(time, late).select("id", "ord", time, dedup.signature(F.col("text")).alias("sig"))
    each = signed.select("id", "ord", time, F.unix_millis(time).alias("ms"), "sig", F.posexplode(dedup.band_keys(F.col("sig"), bands)).alias("band", "key"))
    return each.groupBy("key").transformWithStateInPandas(NearWindow(days, threshold, bands), "later long, earlier long, score double, ord long", "Append", "eventTime")


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, duplicate_of, score, batch_id): what has been found so far."""
    schema = "id long, duplicate_of long, score double, batch_id long"
    return spark.read.schema(schema).parquet(folder) if tables.exists(spark, folder) else spark.createDataFrame([], schema)


def resolving(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds the verdicts of a micro-batch's pairs; a replay overwrites its own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pairs = tables.stage(batch, "stream-pairs")
        before = verdicts(spark, folder).filter(F.col("batch_id") < batch_id).select(F.col("id").alias("earlier"))
        open_pairs = tables.stage(pairs.join(before, "earlier", "left_anti").select("later", "earlier", "score", "ord"), "stream-open")
        dedup.greedy(open_pairs).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return run
