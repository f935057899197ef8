"""Range buckets of a numeric key: equal shares of rows in contiguous ranges, with bounded driver state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most ranges whatever the input, so the bounds that the driver holds are bounded.
MOST = 16_384


def bounds(df: DataFrame, key: str, ranges: int) -> list[int]:
    """Ascending upper bounds (the last range is open) that cut the non-null keys into about equal shares."""
    ranges = min(ranges, MOST)
    if ranges < 2:
        return []
    cuts = [k / ranges for k in range(1, ranges)]
    got = df.agg(F.percentile_approx(key, cuts, 20 * ranges)).first()[0]
    return sorted(set(got or []))


def bucket(key: Column, cuts: list[int]) -> Column:
    """The number of cuts below ``key``, found in two steps of about sqrt(n) comparisons each."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    whole = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    coarse = F.split(F.lit(",".join(map(str, cuts[step - 1 :: step])) or "0"), ",").cast("array<bigint>") if cuts[step - 1 :: step] else F.array().cast("array<bigint>")
    jump = F.size(F.filter(coarse, lambda c: c < key)) * step
    return jump + F.size(F.filter(F.slice(whole, jump + 1, F.lit(step)), lambda c: c < key))
