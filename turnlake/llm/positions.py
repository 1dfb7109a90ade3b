"""Dense positions in a total order, whatever the skew of its groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.llm.common import cut

#: Bits of monotonically_increasing_id() below the partition number.
_ROW_BITS = 33


def numbered(rows: DataFrame, by: list[str], order: list[str], position: str = "position", total: str | None = None) -> DataFrame:
    """``rows`` with their 0-based ``position`` among the rows of equal ``by``, ascending by ``order``.

    ``total`` names a column for the number of those rows.  NULLs are a group
    of their own in ``by`` and come first in ``order``; rows equal in all of
    ``order`` get neighbouring positions in any order.

    One range-partitioned pass, written to the shared folder, puts neighbours
    into one partition and splits large groups; a window then only sees one
    row for each partition and group.  No rows give no rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    placed = cut(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    pieces = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = W.partitionBy(*by)
    ahead = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)],
        F.col("_part").alias("_by_part"),
        (ahead - F.col("_first")).alias("_shift"),
        F.sum("_n").over(group).alias("_total"),
    )
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_by_part"))
    made = [(F.col("_at") + F.col("_shift")).alias(position)] + ([F.col("_total").alias(total)] if total else [])
    return placed.join(pieces, same).select(*rows.columns, *made)
