"""Operator 11, sharding by minimax contiguous partition.

Rows that share a key are an atomic group. Groups stand in the order of their key (a hash of the text) and are
cut into contiguous shards whose largest has the smallest possible size. That capacity is found by binary search
over integers; a candidate is checked greedily, each shard filled up to the last group that still fits.

No list of groups reaches the driver. It holds a skeleton: the sums of key ranges, and whether a range is one group.
Cutting anywhere inside a range of several groups gives a lower bound of the capacity, cutting at its ends only an upper one.
While they differ, the ranges in which a cut of a capacity between them can lie are summed again in finer ranges by
one aggregation of Spark, so each round needs a few thousand sums whatever the input. The smallest capacity is exact.
Within it, cuts are drawn at the known borders nearest to equal shares, as long as the rest still fits.

Places in a shard are numbered in two levels, (shard, slice of a hash of row and key), so a group of copies that
holds a third of all rows is numbered by many tasks.

Nulls: a null text has no bytes (size 1, crc32 0) and stands in the group of empty texts. A null doc_id is numbered like any
other, last in its slice. Repeated rows each have a place. Texts whose 64-bit keys meet form one group. With fewer
groups than shards some shards are empty; an empty table gives an empty result. Columns of the output's names that rows bring are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, table, unstage

#: log2 of the number of key ranges that the first pass sums, and that each range is cut into later.
FIRST_BITS, FINER_BITS = 12, 8
#: Rows that one numbering window holds on average.
ROWS_OF_A_SLICE = 20_000


@dataclass(frozen=True)
class Segment:
    """A range of keys that holds rows: its first and last key and the sum of its sizes."""

    first: int
    last: int
    size: int

    @property
    def atomic(self) -> bool:
        return self.first == self.last


@dataclass(frozen=True)
class Cuts:
    """The smallest capacity and the first key of every shard but the first; None: the shard is empty."""

    capacity: int
    keys: tuple[int | None, ...]

    def shard(self, key: Column) -> Column:
        """The number of the shard that a key falls into."""
        out = F.lit(0)
        for k in self.keys:
            if k is not None:
                out = out + F.when(key >= F.lit(k).cast("long"), 1).otherwise(0)
        return out


def _ends(segments: list[Segment]) -> list[int]:
    """Running sums: where each segment starts, and the total."""
    out = [0]
    for s in segments:
        out.append(out[-1] + s.size)
    return out


def _greedy(segments: list[Segment], ends: list[int], capacity: int, shards: int, inside: bool) -> tuple[bool, list[int]]:
    """Whether ``shards`` shards of ``capacity`` hold everything, and their ends; ``inside`` cuts within ranges of several groups too."""
    at, cuts = 0, []
    for _ in range(shards):
        goal = at + capacity
        if goal >= ends[-1]:
            return True, [*cuts, *[ends[-1]] * (shards - len(cuts))]
        k = bisect_right(ends, goal) - 1
        at = goal if inside and not segments[k].atomic else max(at, ends[k])
        cuts.append(at)
    return False, cuts


def _smallest(segments: list[Segment], ends: list[int], shards: int, inside: bool) -> int:
    """The smallest capacity that the greedy check accepts."""
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if _greedy(segments, ends, mid, shards, inside)[0]:
            high = mid
        else:
            low = mid + 1
    return low


def _unsure(segments: list[Segment], ends: list[int], low: int, high: int, shards: int) -> list[int]:
    """Segments of several groups in which a cut of some capacity from ``low`` to ``high`` may lie."""
    first, last = _greedy(segments, ends, low, shards, False)[1], _greedy(segments, ends, high, shards, True)[1]
    out: set[int] = set()
    for a, b in zip(first, last, strict=True):
        k = max(bisect_right(ends, a) - 1, 0)
        while k < len(segments) and ends[k] < b:
            if not segments[k].atomic:
                out.add(k)
            k += 1
    return sorted(out)


def _even(segments: list[Segment], ends: list[int], capacity: int, shards: int) -> list[int]:
    """Indices of the segments at which shards 1.. start: near equal shares, none above ``capacity``."""
    total = ends[-1]
    latest = [len(segments)]  # from the right: the first segment from which the remaining shards can hold the rest
    for _ in range(shards - 1):
        latest.append(bisect_left(ends, ends[latest[-1]] - capacity))
    large = [k for k, s in enumerate(segments) if s.atomic and s.size * shards > total]
    out, at = [], 0
    for left in range(shards, 1, -1):
        beyond = [k for k in large if k >= at]
        rest = total - ends[at] - sum(segments[k].size for k in beyond)
        goal = ends[at + 1] if at in beyond else ends[at] + rest / max(left - len(beyond), 1)
        low, high = max(latest[left - 1], at), bisect_right(ends, ends[at] + capacity) - 1
        k = min(max(bisect_left(ends, goal), low), high)
        if k > low and goal - ends[k - 1] < ends[k] - goal:
            k -= 1
        out.append(at := k)
    return out


def _summed(rows: DataFrame, ranges: list[tuple[int, int]]) -> list[tuple[Segment, int]]:
    """Sums of the parts of disjoint ``ranges`` (number, bits: the keys that number gives when bits are shifted out), with their bits."""
    bits, part = F.lit(None).cast("int"), F.lit(None).cast("long")
    for b in {b for _, b in ranges}:
        inside = F.shiftright("key", b).isin([n for n, c in ranges if c == b])
        finer = max(b - FINER_BITS, 0)
        bits, part = F.when(inside, finer).otherwise(bits), F.when(inside, F.shiftright("key", finer)).otherwise(part)
    return _collected(rows.select("size", "key", bits.alias("bits"), part.alias("part")).filter("bits is not null"))


def _collected(ranged: DataFrame) -> list[tuple[Segment, int]]:
    """One segment of each (bits, part) of ``ranged``; there are a few thousand."""
    sums = ranged.groupBy("bits", "part").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("size").alias("s"))
    return [(Segment(r["a"], r["b"], r["s"]), r["bits"]) for r in sums.collect()]


def minimax(rows: DataFrame, shards: int) -> Cuts:
    """The cuts of ``rows`` (key long, size long, no nulls) into ``shards`` contiguous shards; rows are read once a round."""
    if shards < 1:
        raise ValueError("at least one shard")
    first = 64 - FIRST_BITS
    found = sorted(_collected(rows.select("size", "key", F.lit(first).alias("bits"), F.shiftright("key", first).alias("part"))), key=lambda f: f[0].first)
    if not found:
        return Cuts(0, (None,) * (shards - 1))
    while True:
        segments = [s for s, _ in found]
        ends = _ends(segments)
        low, high = _smallest(segments, ends, shards, True), _smallest(segments, ends, shards, False)
        if low == high:
            break
        chosen = set(_unsure(segments, ends, low, high, shards))
        finer = _summed(rows, [(s.first >> b, b) for k, (s, b) in enumerate(found) if k in chosen])
        found = sorted([f for k, f in enumerate(found) if k not in chosen] + finer, key=lambda f: f[0].first)
    starts = _even(segments, ends, high, shards)
    return Cuts(high, tuple(segments[k].first if k < len(segments) else None for k in starts))


def text_key(text: Column) -> Column:
    """The group of a text: a hash that equal texts share, null being the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text and one for its row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def numbered(rows: DataFrame, cuts: Cuts, key: str, rows_of_a_slice: int = ROWS_OF_A_SLICE, order: str = "doc_id") -> DataFrame:
    """Columns of ``rows`` with shard (int) and slot (long, gapless from 0 in each shard); ``key`` names the key's column."""
    packed = rows.select(F.struct(*[c for c in rows.columns if c not in ("shard", "slot")]).alias("row"), F.col(key).alias("key"), F.col(order).alias("id"))
    slices = max(1, -(-packed.count() // rows_of_a_slice))
    dealt = packed.withColumn("shard", cuts.shard(F.col("key"))).withColumn("slice", F.pmod(F.xxhash64("id", "key"), F.lit(slices)))
    so_far = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    heads = dealt.groupBy("shard", "slice").agg(F.count("*").alias("n")).select("shard", "slice", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "slice").orderBy(F.col("id").asc_nulls_last(), "key")
    placed = dealt.withColumn("place", F.row_number().over(inside)).join(heads, ["shard", "slice"])
    return placed.select("row.*", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Columns of ``docs`` with shard and slot: equal texts together, the largest shard as small as it can be."""
    narrow = stage(docs.select(text_key(F.col(text)).alias("key"), text_size(F.col(text)).alias("size")), "sizes")
    cuts = minimax(narrow, shards)
    unstage(narrow)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in ("shard", "slot")]).alias("row"), text_key(docs[text]).alias("key"), docs[order].alias("id"))
    return numbered(packed, cuts, "key", order="id").select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = 8, files_of_a_shard: int = 1) -> None:
    """Write ``docs`` as Parquet folders shard=0, shard=1, ..., each in the order of its slots, in ranges of slots one a file."""
    placed = shard_documents(docs, shards)
    placed.repartitionByRange(max(shards * files_of_a_shard, 1), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = stage(docs.select("doc_id", text_key(text).alias("key"), text_size(text).alias("size"), crc.alias("text_crc32")), "sizes")
    placed = numbered(rows, minimax(rows.select("key", "size"), 8), "key")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
