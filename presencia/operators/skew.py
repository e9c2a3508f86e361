"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presencia.session import materialise

#: Rows of one key that one task may join; keys with more are dealt over sub-keys, at any size of the tables.
HOT_ROWS = 200_000
#: Hot keys are told to all tasks by the bucket of their hash: at most this many rows of two numbers are broadcast.
BUCKETS = 1 << 18


def salted_lookup(
    big: DataFrame, small: DataFrame, on: list[str], n: str, spread: Column, hot_rows: int | None = None, stored: bool = False
) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per key) without a hot task.

    ``small`` holds in column ``n`` how many rows of ``big`` each key has (or a bound of it).  A key
    with more than HOT_ROWS of them is dealt by ``spread`` over ``ceil(n / HOT_ROWS)`` sub-keys, and
    its single row is repeated for each, so a task meets at most HOT_ROWS rows of a key however large
    the tables are.  Both sides find the number of sub-keys by the bucket of the key's hash: BUCKETS rows at most
    are broadcast, also where more keys are hot, and a key that shares its bucket with a hot one is only
    repeated more often than it needs.  Without hot keys this is an ordinary equi join.

    ``small`` is written once unless it is ``stored`` already, since it is read twice.  Null keys match nothing; empty
    inputs give an empty result.  Columns other than ``on`` must not clash between the sides.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    small = small if stored else materialise(small, "lookup")
    bucket = F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int")
    hot = small.where(F.col(n) > hot_rows).groupBy(bucket.alias("_bucket")).agg(F.max(F.ceil(F.col(n) / hot_rows)).cast("int").alias("_parts"))
    if not hot.head(1):
        return big.join(small, on)
    hot = F.broadcast(materialise(hot, "hot_buckets"))
    sides = [side.withColumn("_bucket", bucket).join(hot, "_bucket", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))) for side in (big, small)]
    dealt = sides[0].withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")).drop("_parts", "_bucket")
    repeated = sides[1].withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_bucket")
    return dealt.join(repeated, [*on, "_salt"]).drop("_salt")
