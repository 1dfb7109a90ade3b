"""Which of disjoint intervals a point lies in, as one ordered merge.

A join on the key with a range behind it forms every pair of a point and an
interval of its key first.  Intervals that do not overlap need less: a point can
only lie in the last one that begins before it.  Points and beginnings are
sorted together, and each point sees the last beginning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.operators.segments import last_seen, with_ordered

#: Points of a key are sorted an hour at a time; what an earlier hour leaves open is one row.
HOUR_MS = 3_600_000
_FAR = (1 << 63) - 1


def join_disjoint(
    points: DataFrame,
    at: str,
    intervals: DataFrame,
    start: str,
    stop: str,
    keys: list[str],
    how: str = "inner",
    condition: Column | None = None,
    bucket_ms: int = HOUR_MS,
) -> DataFrame:
    """Join points to the interval of the same keys that contains them.

    Both ends are inclusive, a NULL ``stop`` is open.  Intervals of a key do
    not overlap; where they do, the one that begins last counts (of those that
    begin together the longest), so a point never multiplies.  ``how`` is inner
    or left; ``condition`` may use the columns of both.  Interval columns other
    than the keys must not collide with point columns.  Points or intervals
    with a NULL key, and points without a time, lie in none.  ``points`` is
    read twice.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    given = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    fields = [c for c in intervals.columns if c not in keys]
    begins = intervals.where(given & F.col(start).isNotNull()).select(
        *keys, F.col(start).cast("bigint").alias("_at"), F.lit(0).alias("_kind"), F.coalesce(F.col(stop), F.lit(_FAR)).cast("bigint").alias("_until"), F.struct(*fields).alias("_begun")
    )
    timed = points.select("*", F.col(at).cast("bigint").alias("_at"), F.lit(1).alias("_kind"), F.lit(_FAR).cast("bigint").alias("_until"))
    both = timed.unionByName(begins, allowMissingColumns=True).withColumn("_hour", F.expr(f"_at div {bucket_ms}"))
    merged = with_ordered(both, keys, ["_at", "_kind", "_until"], {"_in": last_seen(F.col("_begun"))}, block="_hour")
    found = merged.where("_kind = 1").select(*points.columns, "_in")
    inside = F.col("_in").isNotNull() & given & (F.col(f"_in.{stop}").isNull() | (F.col(at) <= F.col(f"_in.{stop}")))
    open_up = found.withColumn("_in", F.when(inside, F.col("_in"))).select(*points.columns, "_in.*")
    if how == "inner":
        kept = open_up.where(F.col(start).isNotNull())
        return kept if condition is None else kept.where(condition)
    if condition is None:
        return open_up
    return open_up.select(*points.columns, *[F.when(condition, F.col(f)).alias(f) for f in fields])
