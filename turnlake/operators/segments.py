"""Ordered (window) computations that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(...)`` sends all rows of one key to
one task.  Here the rows of a key are cut into *blocks* that are contiguous in
the order and bounded in size; the ordered value is computed inside each block
and corrected by what the earlier blocks carry in.  The carry is a window over
one summary row per block, thousands of times smaller than the data, and it is
pre-aggregated on the map side.

Blocks come from one of

* :func:`position_blocks` - the order is a dense integer position,
* a natural bound the caller has (a file split),
* :func:`range_blocks` - any order: one range-partitioned, checkpointed pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.session import cut_lineage

BLOCK = "_block"
DEFAULT_BLOCK_ROWS = 100_000


@dataclass(frozen=True)
class Ordered:
    """One ordered value to compute; build it with the functions below."""

    kind: str
    value: Column | None = None
    default: Column | None = None


def last_seen(value: Column) -> Ordered:
    """Latest non-NULL value up to and including this row."""
    return Ordered("last_seen", value)


def previous_seen(value: Column) -> Ordered:
    """Latest non-NULL value strictly before this row."""
    return Ordered("previous_seen", value)


def first_seen(value: Column) -> Ordered:
    """First non-NULL value up to and including this row."""
    return Ordered("first_seen", value)


def running_sum(value: Column) -> Ordered:
    """Sum up to and including this row (NULL counts as 0)."""
    return Ordered("running_sum", F.coalesce(value, F.lit(0)))


def running_max(value: Column) -> Ordered:
    """Largest value up to and including this row, structs field by field; NULLs are passed over."""
    return Ordered("running_max", value)


def row_index() -> Ordered:
    """0-based position in the order."""
    return Ordered("row_index", F.lit(1).cast("bigint"))


def lag_value(value: Column) -> Ordered:
    """The previous row's value, NULL on the first row (or if it was NULL)."""
    return Ordered("lag", value)


def lead_value(value: Column) -> Ordered:
    """The next row's value, NULL on the last row (or if it is NULL)."""
    return Ordered("lead", value)


def position_blocks(df: DataFrame, position: str, rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Blocks of a dense integer position."""
    return df.withColumn(BLOCK, F.floor(F.col(position) / F.lit(rows)).cast("bigint"))


def range_blocks(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Blocks of an arbitrary order.

    One range-partitioned pass puts contiguous rows of ``(keys, order)`` into
    each partition whatever the key skew; the partition number is the block.
    The result is checkpointed because the number must be the same for every
    reader of it (range bounds are sampled).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order)
    return cut_lineage(ranged.withColumn(BLOCK, F.spark_partition_id().cast("bigint")))


def with_ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Ordered],
    block: str = BLOCK,
    keep_block: bool = False,
) -> DataFrame:
    """Add the ordered ``values`` to ``df``; the block column is dropped unless
    another ordered pass over the same blocks follows (``keep_block``).

    ``(keys, order)`` must identify a row's place uniquely, keys are not NULL,
    and ``block`` must be non-decreasing along ``order`` within ``keys``.  The
    input is read twice (rows and summaries), so callers materialise an
    expensive one first.  The join keeps the window's hash partitioning.
    """
    place = F.struct(*[F.col(c) for c in order])
    inside = W.partitionBy(*keys, block).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy(block)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)

    local, summary, carry, final = {}, [], {}, {}
    for name, spec in values.items():
        loc, sm, cr = f"_l_{name}", f"_s_{name}", f"_c_{name}"
        v = spec.value
        if spec.kind in ("last_seen", "previous_seen"):
            local[loc] = F.last(v, ignorenulls=True).over(upto if spec.kind == "last_seen" else before)
            summary.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(sm))
            carry[cr] = F.last(sm, ignorenulls=True).over(earlier)
            final[name] = F.coalesce(F.col(loc), F.col(cr))
        elif spec.kind == "first_seen":
            local[loc] = F.first(v, ignorenulls=True).over(upto)
            summary.append(F.min_by(v, F.when(v.isNotNull(), place)).alias(sm))
            carry[cr] = F.first(sm, ignorenulls=True).over(earlier)
            final[name] = F.coalesce(F.col(cr), F.col(loc))
        elif spec.kind in ("running_sum", "row_index"):
            local[loc] = F.sum(v).over(upto)
            summary.append(F.sum(v).alias(sm))
            carry[cr] = F.sum(sm).over(earlier)
            total = F.col(loc) + F.coalesce(F.col(cr), F.lit(0))
            final[name] = total - F.lit(1) if spec.kind == "row_index" else total
        elif spec.kind == "running_max":
            local[loc] = F.max(v).over(upto)
            summary.append(F.max(v).alias(sm))
            carry[cr] = F.max(sm).over(earlier)
            final[name] = F.greatest(F.col(loc), F.col(cr))
        elif spec.kind == "lag":
            local[loc] = F.lag(F.struct(v.alias("v"))).over(inside)
            summary.append(F.max_by(F.struct(v.alias("v")), place).alias(sm))
            carry[cr] = F.lag(sm).over(across)
            final[name] = F.coalesce(F.col(loc), F.col(cr)).getField("v")
        elif spec.kind == "lead":
            local[loc] = F.lead(F.struct(v.alias("v"))).over(inside)
            summary.append(F.min_by(F.struct(v.alias("v")), place).alias(sm))
            carry[cr] = F.lead(sm).over(across)
            final[name] = F.coalesce(F.col(loc), F.col(cr)).getField("v")
        else:
            raise ValueError(spec.kind)

    # One row per block, of those keys that have several; most keys have one,
    # where adaptive execution drops the join with nothing on its other side.
    blocks = df.groupBy(*keys, block).agg(*summary).withColumn("_blocks", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    blocks = blocks.select(*keys, block, "_blocks", *[c.alias(n) for n, c in carry.items()]).where(F.col("_blocks") > 1)
    blocks = blocks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(block).alias("_k_block"), *carry)
    windowed = df.select("*", *[c.alias(n) for n, c in local.items()])
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col(block) == F.col("_k_block")]
    joined = windowed.join(blocks, on, "left")
    kept = [F.col(c) for c in df.columns if (keep_block or c != block) and c not in values]
    return joined.select(*kept, *[c.alias(n) for n, c in final.items()])
