"""Items that appear together far more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.operators.skew import salted_lookup
from presencia.session import materialise

#: Items of a basket that one row holds for pairing; longer baskets pair block by block.
BLOCK = 64


def associated_pairs(df: DataFrame, group: str, basket: str, item: str, min_together: int, min_lift: float) -> DataFrame:
    """Pairs of items that share at least ``min_together`` baskets of a group, with a lift of at least ``min_lift``.

    Returns ``group, item_1 < item_2, n_12, n_1, n_2, n`` (numbers of distinct baskets),
    ``lift`` = n_12 n / (n_1 n_2) and ``conviction`` of item_1 => item_2, null where
    item_2 is in every basket that item_1 is in.  Rows with a null in any of the three are left
    out, repeated rows count once, an item does not pair with itself.

    Lossless pruning (``min_lift`` > 0): n_12 <= min(n_1, n_2), so an item of a pair has n_i >=
    min_together and, by n_12 n >= lift n_1 n_2, lift n_i <= n.  That drops the items that are
    in most baskets before any pair is made.

    Scale: distinct rows and item counts combine map-side; equal baskets
    collapse to one with a weight, so pairs are enumerated once per distinct basket; a long basket
    is cut into blocks of BLOCK items, and equal pairs of blocks, however many baskets have them, collapse
    map-side to one with the sum of the weights; pair counts combine map-side.
    """
    rows = df.select(F.col(group).alias("g"), F.col(basket).alias("b"), F.col(item).alias("i")).na.drop()
    rows = materialise(rows.distinct(), "baskets")
    sizes = rows.groupBy("g", "b").agg(F.lit(1)).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    items = rows.groupBy("g", "i").agg(F.count(F.lit(1)).alias("n_i")).where(F.col("n_i") >= min_together)
    items = items.join(sizes, "g").where(F.col("n_i") * F.lit(float(min_lift)) <= F.col("n"))
    items = materialise(items, "items")
    weighed = (
        salted_lookup(rows, items, ["g", "i"], "n_i", F.col("b"))
        .groupBy("g", "b").agg(F.sort_array(F.collect_list(F.struct("i", "n_i"))).alias("items"), F.max("n").alias("n"))
        .where("size(items) > 1")
        .groupBy("g", "items", "n").agg(F.count(F.lit(1)).alias("w"))
    )
    starts = F.expr(f"sequence(1, size(items), {BLOCK})")
    blocks = (
        weighed.withColumn("s1", F.explode(starts)).withColumn("s2", F.explode(F.filter(starts, lambda s: s >= F.col("s1"))))
        .select("g", "n", "w", F.expr(f"slice(items, s1, {BLOCK})").alias("left"), F.expr(f"slice(items, s2, {BLOCK})").alias("right"))
        .groupBy("g", "n", "left", "right").agg(F.sum("w").alias("w"))
    )
    counted = (
        blocks.select("g", "n", "w", F.explode("left").alias("x"), "right")
        .select("g", "n", "w", "x", F.explode(F.filter("right", lambda y: y["i"] > F.col("x.i"))).alias("y"))
        .groupBy("g", F.col("x.i").alias("item_1"), F.col("y.i").alias("item_2"))
        .agg(F.sum("w").alias("n_12"), F.max("x.n_i").alias("n_1"), F.max("y.n_i").alias("n_2"), F.max("n").alias("n"))
    )
    missing = F.col("n_1") - F.col("n_12")
    return (
        counted.where((F.col("n_12") >= min_together) & (F.col("n_12") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_1") * F.col("n_2")))
        .withColumn("lift", F.col("n_12") * F.col("n") / (F.col("n_1") * F.col("n_2")))
        .withColumn("conviction", F.when(missing > 0, F.col("n_1") * (F.col("n") - F.col("n_2")) / (F.col("n") * missing)))
        .withColumnRenamed("g", group)
    )
