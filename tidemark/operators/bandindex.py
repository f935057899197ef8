"""A stored index of MinHash bands: near-duplicates of a batch among all stored records, reading only what the batch hits.

Three tables in one folder, each partitioned by a bucket of its key: ``bands`` (key, class), ``classes`` (class, signature) and ``members``
(class, id, ord). Records of equal content are one class, so copies cost one member row each and a band no more than its
different contents. A batch is banded, its keys name the buckets to read, the bands found name the classes, and only
their buckets of signatures and members are read then.

Appends add files to the buckets; ``compact`` writes each bucket anew without repeats.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.operators import dedup, listing, maintenance

_BANDS, _CLASSES, _MEMBERS = "bucket int, key long, class long", "bucket int, class long, sig array<long>", "bucket int, class long, id {id}, ord {ord}"


class BandIndex:
    """The index in ``folder``. Signed records are (id, ord, sig) and optionally class, a long that equal contents share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.settings = tables.get_json(spark, f"{self.folder}/index.json")
        self.buckets, self.bands = self.settings["buckets"], self.settings["bands"]

    @classmethod
    def create(cls, signed: DataFrame, folder: str, buckets: int | None = None, bands: int = 32) -> BandIndex:
        """A new index of ``signed``; ``bands`` of 128 / bands values each find pairs at 0.85 with certainty 1 - 1e-10 for 32.

        Without ``buckets`` there is one for about 200 records, from 16 to 4096.
        """
        if dedup.PERMUTATIONS % bands:
            raise ValueError(f"bands divide {dedup.PERMUTATIONS}")
        types = dict(signed.dtypes)
        if buckets is None:
            buckets = 1 << min(max((signed.count() // 200).bit_length(), 4), 12)
        tables.put_json(signed.sparkSession, f"{folder.rstrip('/')}/index.json", {"buckets": buckets, "bands": bands, "id": types["id"], "ord": types["ord"]})
        index = cls(signed.sparkSession, folder)
        index.add(signed)
        return index

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _classed(self, signed: DataFrame) -> DataFrame:
        kind = F.col("class") if "class" in signed.columns else F.xxhash64("sig")
        return signed.filter(F.size("sig") > 0).select("id", "ord", "sig", kind.alias("class"))

    def _banded(self, classes: DataFrame) -> DataFrame:
        """(bucket, key, class) of distinct classes (class, sig)."""
        keys = classes.select(F.explode(dedup.band_keys(F.col("sig"), self.bands)).alias("key"), "class")
        return keys.select(self._bucket(F.col("key")).alias("bucket"), "key", "class")

    def _write(self, df: DataFrame, name: str, sort: str) -> None:
        df.repartition("bucket").sortWithinPartitions("bucket", sort).write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def _stored(self, name: str, buckets: list[int] | None) -> DataFrame:
        schema = {"bands": _BANDS, "classes": _CLASSES, "members": _MEMBERS.format(**self.settings)}[name]
        found = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return found if buckets is None else found.filter(F.col("bucket").isin(buckets))

    def add(self, signed: DataFrame) -> None:
        """Index more records; one of a known class adds a member only, apart from repeats that ``compact`` removes."""
        rows = tables.stage(self._classed(signed), "signed")
        classes = rows.groupBy("class").agg(F.first("sig").alias("sig"))
        self._write(rows.select(self._bucket(F.col("class")).alias("bucket"), "class", "id", "ord"), "members", "class")
        self._write(classes.select(self._bucket(F.col("class")).alias("bucket"), "class", "sig"), "classes", "class")
        self._write(self._banded(classes), "bands", "key")

    def compact(self) -> BandIndex:
        """The same index in a new folder beside this one, without repeats of appends."""
        folder = tables.fresh(self.spark, "bands")
        tables.put_json(self.spark, f"{folder}/index.json", self.settings)
        new = BandIndex(self.spark, folder)
        new._write(self._stored("bands", None).distinct(), "bands", "key")
        new._write(self._stored("classes", None).groupBy("bucket", "class").agg(F.first("sig").alias("sig")), "classes", "class")
        new._write(self._stored("members", None).distinct(), "members", "class")
        return new

    def _hit(self, found: DataFrame, column: str) -> list[int]:
        return sorted(r[0] for r in found.select(column).distinct().collect())  # at most ``buckets`` numbers

    def candidates(self, batch: DataFrame) -> DataFrame:
        """(asked, class): classes of the batch with the stored classes that share a band, only hit buckets being read. ``batch`` is (class, sig)."""
        asked = tables.stage(self._banded(batch), "asked")
        stored = self._stored("bands", self._hit(asked, "bucket"))
        return asked.select("bucket", "key", F.col("class").alias("asked")).join(stored, ["bucket", "key"]).select("asked", "class").distinct()

    def members(self, classes: DataFrame) -> DataFrame:
        """(class, n, id, ord) of the given classes: how many records, and the first of them."""
        named = classes.select("class").distinct().withColumn("bucket", self._bucket(F.col("class")))
        stored = self._stored("members", self._hit(named, "bucket")).distinct()
        return stored.join(named, ["bucket", "class"], "left_semi").groupBy("class").agg(F.count("*").alias("n"), F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord"))

    def near(self, signed: DataFrame, threshold: float = 0.85) -> DataFrame:
        """(asked, class, score): classes of ``signed`` with the stored classes whose estimate reaches the threshold, themselves included."""
        batch = tables.stage(self._classed(signed).groupBy("class").agg(F.first("sig").alias("sig")), "batch")
        found = tables.stage(self.candidates(batch).withColumn("bucket", self._bucket(F.col("class"))), "candidates")
        stored = self._stored("classes", self._hit(found, "bucket")).dropDuplicates(["class"])
        scored = found.join(stored, ["bucket", "class"]).join(batch.toDF("asked", "asked_sig"), "asked")
        return scored.withColumn("score", dedup.similarity(F.col("sig"), F.col("asked_sig"))).filter(F.col("score") >= threshold).select("asked", "class", "score")

    def rescan(self, signed: DataFrame, threshold: float = 0.85) -> DataFrame:
        """(id, duplicate_of, score) of those of ``signed`` that have a near record before them, by the greedy rule of ``dedup.greedy``.

        The first record of a class stands for it: a later copy is never accepted itself, so nothing can be a duplicate of it.
        """
        rows = tables.stage(self._classed(signed), "rescanned")
        found = tables.stage(self.near(rows, threshold), "near")
        firsts = self.members(found).select("class", F.col("id").alias("earlier"), F.col("ord").alias("o2"))
        pairs = rows.select(F.col("id").alias("later"), F.col("ord").alias("o1"), F.col("class").alias("asked")).join(found, "asked").join(firsts, "class")
        return dedup.greedy(tables.stage(pairs.filter("o2 < o1").select("later", "earlier", "score", F.col("o2").alias("ord")), "pairs"))


def signed_jobs(jobs: DataFrame, since: datetime, limit: int = 2000, companies: list[str] | None = None) -> DataFrame:
    """(id, ord, sig) of the newest ``limit`` stored postings since a moment, as a re-scan takes them."""
    newest = listing.recent_signatures(jobs, since, limit, companies)
    return newest.join(jobs.select("id", F.col("first_seen_at").alias("ord")), "id").select("id", "ord", F.col("signature").alias("sig"))


def rescan_jobs(jobs: DataFrame, index: BandIndex, since: datetime, limit: int = 2000, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(verdicts, jobs with the verdicts applied): the newest postings against all that ``index`` holds, as of their first_seen_at."""
    verdicts = index.rescan(signed_jobs(jobs, since, limit), threshold).withColumn("kind", F.lit("near"))
    return verdicts, maintenance.mark_duplicates(jobs, verdicts)
