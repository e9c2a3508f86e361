"""Exact quantiles per key, however many rows a key has.

Value histograms with mergeable counts are refined bracket by bracket until the
ranks resolve; the values of a hot key never meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presencia.operators.skew import salted_lookup
from presencia.session import materialise

#: Bins of one refinement; keys and brackets of at most FEW rows, or possible values, are resolved by value counts.
BINS, FEW = 1024, 4096
#: Brackets, or keys that need refining, broadcast at most; more are met by a salted join.
MAX_BRACKETS = 100_000


def _is_long(n: str) -> Column:
    """Whether ``n`` values of lo..hi may be more than FEW different ones."""
    return (F.col(n) > FEW) & (F.col("hi") - F.col("lo") >= FEW)


def _in_brackets(values: DataFrame, brackets: DataFrame, count: int) -> DataFrame:
    """Values of the keys that have brackets, each with the one it lies in."""
    if count <= MAX_BRACKETS:
        met = values.join(F.broadcast(brackets.withColumnRenamed("_k", "_bk")), F.col("_k") == F.col("_bk")).drop("_bk")
        return met.where("_v between lo and hi")
    held = F.collect_list(F.struct("lo", "hi", "n", "ranks", "below"))  # at most two for each quantile asked
    per_key = brackets.groupBy("_k").agg(held.alias("b"), F.max("rows").alias("rows"))
    met = salted_lookup(values, per_key, ["_k"], "rows", F.col("_s"))
    return met.select("_k", "_v", "_w", "rows", F.inline(F.filter("b", lambda b: F.col("_v").between(b["lo"], b["hi"]))))


def _of_short_keys(values: DataFrame, stats: DataFrame, long_keys: int) -> DataFrame:
    """Values of the keys that need no refining: those of the others are taken out before anything is shuffled by key."""
    there = values.where("_v is not null")
    if not long_keys:
        return there
    if long_keys <= MAX_BRACKETS:
        return there.join(F.broadcast(stats.where(_is_long("n_values")).select("_k")), "_k", "left_anti")
    sizes = stats.where("n_values > 0").select("_k", "n_values", _is_long("n_values").alias("long"))
    return salted_lookup(there, sizes, ["_k"], "n_values", F.col("_s"), stored=True).where("not long")


def key_counts(values: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """The coarsest histogram: per key ``n_rows``, ``n_values``, ``lo``, ``hi``; combined map-side."""
    return values.groupBy(*keys).agg(
        F.sum(weight).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col(value).isNotNull(), weight)), F.lit(0).cast("bigint")).alias("n_values"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )


def _select(df: DataFrame, keys: list[str], value: str, probs: list[float], weight: str | None, spread: str | None) -> tuple[DataFrame, DataFrame]:
    """Per key (``_k``, stored) the counts, and per key and quantile ``i`` the rank ``at`` and its neighbours ``lower`` and ``upper``."""
    values = df.select(
        F.struct(*keys).alias("_k"), F.col(value).cast("bigint").alias("_v"),
        (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("_w"), F.xxhash64(spread or value).alias("_s"),
    )
    n = F.sum("_w")
    stats = materialise(key_counts(values, ["_k"], "_v", F.col("_w")), "key_counts")
    of = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    size = stats.agg(F.count_if(_is_long("n_values")).alias("long"), F.count_if((F.col("n_values") > 0) & ~_is_long("n_values")).alias("short")).first()
    done = []
    if size["short"] or not size["long"]:
        # short keys: value counts, and a running count within the key, of at most FEW values
        key, upto = Window.partitionBy("_k"), F.sum("c").over(Window.partitionBy("_k").orderBy("_v"))
        counted = _of_short_keys(values, stats, size["long"]).groupBy("_k", "_v").agg(n.alias("c")).select("_k", "_v", "c", upto.alias("upto"), F.sum("c").over(key).alias("n"))
        at = lambda p: (F.col("n") - 1) * F.lit(float(p))
        there = lambda rank: F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c")), F.col("_v")))
        found = F.array(*[
            F.struct(F.lit(i).alias("i"), F.max(at(p)).alias("at"), there(F.floor(at(p))).alias("lower"), there(F.ceil(at(p))).alias("upper"))
            for i, p in enumerate(probs)
        ])
        done.append(counted.groupBy("_k").agg(found.alias("f")).select("_k", F.inline("f")))
    if size["long"]:
        ranks = (
            stats.where(_is_long("n_values")).select("_k", "lo", "hi", F.col("n_values").alias("n"), of.alias("a"))
            .select("_k", "lo", "hi", "n", "a.i", ((F.col("n") - 1) * F.col("a.p")).alias("at"))
            .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
        )
        hits = _ranked(values, ranks)
        done.append(
            ranks.select("_k", "i", "at", "rank").join(hits, ["_k", "rank"])
            .groupBy("_k", "i").agg(F.max("at").alias("at"), F.min("x").alias("lower"), F.max("x").alias("upper"))
        )
    return stats, done[0] if len(done) == 1 else done[0].unionByName(done[1])


def _ranked(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """``_k, rank, x``: the value at each rank asked of long keys, by refined histograms."""
    n = F.sum("_w")
    # a bracket: the values lo..hi of a key of `rows` values, n of them after `below` smaller ones, and the ranks (from 0) to find in it
    brackets = (
        ranks.groupBy("_k", "lo", "hi", "n").agg(F.collect_set("rank").alias("ranks"))
        .withColumn("below", F.lit(0).cast("bigint")).withColumn("rows", F.col("n"))
    )
    found = None
    while True:
        brackets = materialise(brackets, "brackets")
        wide, short = F.col("lo") < F.col("hi"), ~_is_long("n")
        size = brackets.agg(F.count_if(wide & short).alias("few"), F.count_if(wide & ~short).alias("many")).first()
        hits = brackets.where(~wide).select("_k", F.explode("ranks").alias("rank"), F.col("lo").alias("x"))
        if size["few"]:
            counted = _in_brackets(values, brackets.where(wide & short), size["few"]).groupBy("_k", "lo", "below", "ranks", "_v").agg(n.alias("c"))
            upto = F.col("below") + F.sum("c").over(Window.partitionBy("_k", "lo").orderBy("_v"))
            hits = hits.unionByName(
                counted.select("_k", "ranks", F.col("_v").alias("x"), "c", upto.alias("upto"))
                .select("_k", F.explode("ranks").alias("rank"), "x", "c", "upto")
                .where("rank < upto and rank >= upto - c").select("_k", "rank", "x")
            )
        found = hits if found is None else found.unionByName(hits)
        if not size["many"]:
            return found
        bins = (
            _in_brackets(values, brackets.where(wide & ~short), size["many"])
            .withColumn("bin", F.expr(f"(_v - lo) div ((hi - lo) div {BINS} + 1)"))
            .groupBy("_k", "lo", "below", "ranks", "rows", "bin").agg(n.alias("c"), F.min("_v").alias("blo"), F.max("_v").alias("bhi"))
        )
        before = F.col("below") + F.sum("c").over(Window.partitionBy("_k", "lo").orderBy("bin")) - F.col("c")
        brackets = (
            bins.withColumn("b", before)
            .withColumn("r", F.filter("ranks", lambda r: (r >= F.col("b")) & (r < F.col("b") + F.col("c"))))
            .where(F.size("r") > 0)
            .select("_k", F.col("blo").alias("lo"), F.col("bhi").alias("hi"), F.col("c").alias("n"), F.col("r").alias("ranks"), F.col("b").alias("below"), "rows")
        )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], weight: str | None = None, spread: str | None = None
) -> DataFrame:
    """Per key: ``n_rows``, ``n_values``, ``lo``, ``hi`` and ``quantiles``, one DOUBLE for each of ``probs``.

    ``value`` is an integer column within +-2**53 (cast times and scaled decimals
    first); quantiles interpolate linearly between the two neighbouring ranks.
    ``weight`` names a column of positive counts where each row stands for several.
    Null values are not ranked; a key without values has null quantiles; null
    keys form a key; repeated rows and ties count as often as they occur; an
    empty table gives no rows.

    Keys of at most FEW rows, or FEW possible values, are resolved by value counts at once.  Longer ones are refined: each round reads
    the table once and shuffles at most BINS counts per open bracket and task, so a key of n rows resolves in about
    log(n / FEW) / log(BINS) + 2 rounds.  Brackets are broadcast up to MAX_BRACKETS; beyond, rows meet the brackets of their
    key in sub-keys of a fixed number of rows, dealt by the hash of ``spread`` (a row id; the value if absent).
    """
    stats, found = _select(df, keys, value, probs, weight, spread)
    q = F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("at") - F.floor("at"))
    resolved = found.withColumn("q", q).groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("quantiles"))
    return stats.join(resolved, "_k", "left").select("_k.*", "n_rows", "n_values", "lo", "hi", "quantiles")


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """``key, n_rows`` of the non-null keys with at least ``share`` of all rows (null keys and repeated rows counted).

    The keys are put in one order (of a 53-bit hash), in which a heavy key is a run of at least ``share`` of
    the rows, so that one of the exact quantiles at distances of ``share`` lies in it.  These quantiles, found
    by :func:`exact_quantiles`' refinement over the whole table as a single key, are at most 1 / ``share`` + 2 candidates,
    whose rows are then counted exactly.  The counts of all keys, however many, are never made.

    ``share`` counts to six decimals.  An empty table has no heavy keys.
    """
    parts = round(share * 1_000_000)
    if not 0 < parts <= 1_000_000:
        raise ValueError("share must lie above 0 and not above 1")
    code = F.when(F.col(key).isNotNull(), F.shiftright(F.xxhash64(key), 11))
    probs = sorted({min(1.0, i * parts / 1_000_000) for i in range(math.ceil(1_000_000 / parts) + 1)})
    stats, found = _select(df.select(F.lit(0).alias("all"), code.alias("code")), ["all"], "code", probs, None, None)
    total = stats.agg(F.sum("n_rows").alias("n")).first()["n"] or 0  # one row
    candidates = found.select(F.explode(F.array("lower", "upper")).alias("code")).distinct()
    counts = (
        df.select(F.col(key), code.alias("code")).join(F.broadcast(candidates), "code", "left_semi")
        .groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return counts.where(F.col("n_rows").cast("decimal(38,0)") * 1_000_000 >= F.lit(parts * total).cast("decimal(38,0)"))
