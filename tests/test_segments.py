import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.operators import segments as S


@pytest.mark.parametrize("how", ["position", "range"])
def test_equals_plain_windows_on_a_hot_key(spark, how):
    """A third of the rows share one key; blocks are far smaller than the key."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 7 == 3, F.col("id") * 3).alias("v"),
    )
    v = F.col("v")
    values = {
        "last": S.last_seen(v), "prev": S.previous_seen(v), "first": S.first_seen(v), "total": S.running_sum(v),
        "row": S.row_index(), "before": S.lag_value(v), "after": S.lead_value(v),
    }
    w = W.partitionBy("k").orderBy("pos")
    upto, earlier = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = df.select(
        "k", "pos", "v", F.last("v", True).over(upto).alias("last"), F.last("v", True).over(earlier).alias("prev"),
        F.first("v", True).over(upto).alias("first"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"),
        (F.row_number().over(w) - 1).cast("bigint").alias("row"), F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"),
    )
    blocks = S.position_blocks(df, "pos", 50) if how == "position" else S.range_blocks(df, ["k"], ["pos"], 9)
    got = S.with_ordered(blocks, ["k"], ["pos"], values)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_range_blocks_spread_one_key(spark):
    df = spark.range(10_000).select(F.lit("only").alias("k"), F.col("id").alias("at"))
    sizes = S.range_blocks(df, ["k"], ["at"], 8).groupBy(S.BLOCK).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 4_000


def test_blocks_are_summed_without_moving_the_rows_again(spark):
    """Rows move once, by block; what else moves is one row per block and map task."""
    df = S.position_blocks(spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("pos")), "pos", 100)
    plan = S.with_ordered(df, ["k"], ["pos"], {"total": S.running_sum(F.col("pos"))})._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan
