"""Ordered per-key work that stays spread out when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions are cut into ranges of 2 to this power: no range of a key has more rows.
RANGE_BITS = 24


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every key under ``order``.

    Filtering ``row_number() = 1`` lets Spark drop the losers of each map partition before the
    shuffle (WindowGroupLimit), so a hot key sends one row per task, not its whole group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int,
                rank_as: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key with their rank; same early limit as above."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_as, F.row_number().over(w)).where(F.col(rank_as) <= k)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row out of several one-row results with different columns, without a cross join."""
    stacked = rows[0]
    for r in rows[1:]:
        stacked = stacked.unionByName(r, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def range_bucket(order_col: str) -> Column:
    """Number of the range that a whole-number position lies in.

    Positions are unique within a key, so a range bounds the rows of a window over (key, range) at any input size,
    and the number is known without a look at the data. Below 2^48 a key has at most 2^24 ranges.
    """
    return F.shiftright(F.col(order_col).cast("long"), RANGE_BITS)


def running_sum(df: DataFrame, keys: Sequence[str], order_col: str, value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order_col`` order, in two levels.

    The key is cut into position ranges: a window runs inside each (key, range), and the totals of
    the earlier ranges, one row each, are added back. No task sees a whole key, and nothing runs before the
    result is asked for. ``order_col`` must hold whole numbers that are unique within a key.
    """
    tagged = df.withColumn("_rb", range_bucket(order_col)).withColumn("_v", F.coalesce(value.cast("long"), F.lit(0)))
    parts = [*keys, "_rb"]
    totals = tagged.groupBy(*parts).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*parts).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_loc", F.sum("_v").over(inside))
    o = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in parts], "_off")
    cond = F.lit(True)
    for c in parts:
        cond = cond & local[c].eqNullSafe(o[f"_o_{c}"])
    joined = local.join(o, cond, "left")
    return joined.select(*[local[c] for c in df.columns], (F.col("_loc") + F.col("_off")).alias(out))


def running_number(df: DataFrame, keys: Sequence[str], order_col: str, out: str = "n") -> DataFrame:
    """Exact row numbers per key without putting a hot key into one task."""
    return running_sum(df, keys, order_col, F.lit(1), out)
