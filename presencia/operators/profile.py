"""Column-level data quality: profiles of columns, and of each load against the one before.

What footers and dictionaries of the files say is taken from them, chunk by chunk (a column of a row
group); only the chunks that leave something open are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presencia.operators.quantiles import exact_quantiles
from presencia.session import materialise
from presencia.sources.parquet_pages import chunk_counts, column_chunks

#: Sets of columns that are scanned each for itself at most.
SCANS = 16
#: Medians of DOUBLE columns are taken on numbers scaled by this.
SCALE = 1_000_000


@dataclass(frozen=True)
class Rule:
    """What a column may hold: a number's range (in days or microseconds for dates and times), or the allowed texts."""

    column: str
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Limits:
    """Findings are reported above these."""

    nulls: float = 0.117
    outside: float = 0.019
    ratio: float = 1.453
    distance: float = 0.193


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_NUMBERS = (T.FloatType, T.DoubleType, T.DecimalType)


def profiled(schema: T.StructType) -> dict[str, str]:
    """The columns that can be profiled, and which of l, d and t holds their values; binary and nested ones cannot."""
    kind = lambda t: "l" if isinstance(t, _INTEGERS) else "d" if isinstance(t, _NUMBERS) else "t" if isinstance(t, T.StringType) else ""
    return {f.name: kind(f.dataType) for f in schema if kind(f.dataType)}


def _violates(rules: Iterable[Rule], value: Column) -> Column:
    """Whether a non-null value (l, d, t) breaks the rule of the row's ``column_name``; NaN breaks every range."""
    out = F.lit(False)
    for r in rules:
        number = F.coalesce(value["l"].cast("double"), value["d"])
        bad = F.lit(False)
        if r.allowed:
            bad = ~value["t"].isin(*r.allowed)
        else:
            for x, below in ((r.low, True), (r.high, False)):
                if x is not None:
                    whole = F.when(value["l"].isNotNull(), value["l"] < x if below else value["l"] > x)
                    bad = bad | F.coalesce(whole, F.isnan(number) | (number < x if below else number > x))
        out = F.when(F.col("column_name") == r.column, F.coalesce(bad, F.lit(False))).otherwise(out)
    return out


def _value() -> Column:
    return F.struct("l", "d", "t")


def _there() -> Column:
    return F.coalesce(F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("t").isNotNull(), F.lit(False))


def _one(column: str) -> Column:
    """The single value of a chunk, (l, d, t) of nulls if all are null, and null if there may be several."""
    nothing = F.expr("named_struct('l', cast(null as bigint), 'd', cast(null as double), 't', cast(null as string))")
    return F.when(F.col("candidates_exact") & (F.size(column) <= 1), F.coalesce(F.get(column, F.lit(0)), nothing))


def _stored(column: str, kind: T.DataType) -> dict[str, Column]:
    """A column of a scan as (l, d, t)."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.TimestampNTZType):  # from its parts, so that no session time zone comes in
        seconds = (F.unix_date(c.cast("date")) * F.lit(86400).cast("bigint") + F.hour(c) * 3600 + F.minute(c) * 60) * 1_000_000
        value = seconds + (F.expr(f"extract(second from `{column}`)") * 1_000_000).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(c)
    elif isinstance(kind, T.DateType):
        value = F.unix_date(c).cast("bigint")
    else:
        value = c.cast("bigint" if isinstance(kind, _INTEGERS) else "double" if isinstance(kind, _NUMBERS) else "string")
    of = profiled(T.StructType([T.StructField("c", kind)]))["c"]
    return {of: value}


def _scanned(files: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows by key, column and value of a scan: one pass, an aggregation over a grouping set for each column."""
    counted = files.groupingSets([[F.col(k) for k in keys] + [F.col(c)] for c in columns], *keys, *columns).agg(
        F.count(F.lit(1)).alias("_n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)]
    )
    name, value = F.lit(None).cast("string"), {x: F.lit(None).cast(t) for x, t in (("l", "bigint"), ("d", "double"), ("t", "string"))}
    for i, c in enumerate(columns):
        here = F.col(f"_g{i}") == 0
        name = F.when(here, F.lit(c)).otherwise(name)
        for x, v in _stored(c, files.schema[c].dataType).items():
            value[x] = F.when(here, v).otherwise(value[x])
    return counted.select(*keys, name.alias("column_name"), *[v.alias(x) for x, v in value.items()], F.col("_n").alias("n"))


def open_counts(spark: SparkSession, table: DataFrame, keys: list[str], chunks: DataFrame) -> DataFrame:
    """Rows by ``keys``, ``column_name`` and value of the ``open`` chunks alone; counts are to be summed.

    Files whose row groups all leave the same columns open are scanned for these columns; of the others, single chunks are
    read.  At most SCANS sets of columns get a scan, the commonest.  The driver holds the names of files, as it does for
    any scan.
    """
    opened = chunks.where("open")
    groups = chunks.groupBy("path", "row_group").agg(F.array_sort(F.collect_list(F.when(F.col("open"), F.col("column_name")))).alias("columns"))
    whole = groups.groupBy("path").agg(F.max("columns").alias("columns"), F.min("columns").alias("least")).where("columns = least and size(columns) > 0")
    sets = whole.groupBy("columns").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "columns").limit(SCANS)
    out, taken = [], {}
    for r in whole.join(F.broadcast(sets.select("columns")), "columns", "left_semi").toLocalIterator():
        taken.setdefault(tuple(r["columns"]), []).append(r["path"])
    for columns, files in taken.items():
        scan = spark.read.schema(table.schema).parquet(*map(unquote, files))
        out.append(_scanned(scan.select(*keys, *columns), keys, list(columns)))
    paths = [(f,) for files in taken.values() for f in files]
    rest = opened.join(spark.createDataFrame(paths, "path string"), "path", "left_anti") if paths else opened
    if not paths or rest.head(1):
        out.append(chunk_counts(rest, table, keys))
    counts = out[0]
    for more in out[1:]:
        counts = counts.unionByName(more)
    return counts


def counted_chunks(spark: SparkSession, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The chunks of the profiled columns, with ``open`` where a chunk's counts by key and value must be read.

    They are known if in its row group every key has one value and no null, and the chunk one value beside nulls
    whose number is known.  ``one`` is that value, and each key has a column of its own with its (l, d, t).
    """
    chunks = column_chunks(spark, table.inputFiles(), [*keys, *columns])
    chunks = materialise(chunks.withColumn("one", _one("candidates")), "chunks")
    of_key = chunks.where(F.col("column_name").isin(*keys) & F.col("one").isNotNull() & (F.col("nulls") == 0))
    single = of_key.groupBy("path", "row_group").agg(
        *[F.max(F.when(F.col("column_name") == k, F.col("one"))).alias(f"_{k}") for k in keys], F.count(F.lit(1)).alias("_single")
    )
    held = chunks.where(F.col("column_name").isin(*columns)).join(single, ["path", "row_group"], "left")
    known = F.col("nulls").isNotNull() & F.col("one").isNotNull() & (F.col("_single") == len(keys))
    return held.withColumn("open", ~F.coalesce(known, F.lit(False))).drop("_single")


def value_counts(spark: SparkSession, path: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows ``n`` per key, ``column_name`` and value (null included): mergeable counts of the whole table, from open chunks alone."""
    table = spark.read.parquet(path)
    chunks = materialise(counted_chunks(spark, table, keys, columns), "counted_chunks")
    counts = open_counts(spark, table, keys, chunks)
    key = lambda k: F.coalesce(F.col(f"_{k}.l").cast("string"), F.col(f"_{k}.t")).cast(table.schema[k].dataType).alias(k)
    parts = F.array(
        F.struct(F.col("one").alias("v"), (F.col("n_rows") - F.col("nulls")).alias("n")),
        F.struct(F.lit(None).cast("struct<l:bigint,d:double,t:string>").alias("v"), F.col("nulls").alias("n")),
    )
    known = chunks.where("not open").select(*[key(k) for k in keys], "column_name", F.explode(parts).alias("c")).where("c.n > 0")
    known = known.select(*keys, "column_name", "c.v.l", "c.v.d", "c.v.t", "c.n")
    return counts.unionByName(known).groupBy(*keys, "column_name", "l", "d", "t").agg(F.sum("n").alias("n"))


def load_profile(counts: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """Per key and column: rows, nulls, distinct values, violations, and extrema and median of numbers, from value counts."""
    basic = counts.groupBy(*keys, "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~_there(), F.col("n"))), F.lit(0).cast("bigint")).alias("n_nulls"),
        F.count(F.when(_there(), 1)).alias("n_distinct"),
        F.coalesce(F.sum(F.when(_there() & _violates(rules, _value()), F.col("n"))), F.lit(0).cast("bigint")).alias("n_violations"),
        F.max(F.col("d").isNotNull()).alias("scaled"),
    )
    number = F.coalesce(F.col("l"), F.when(~F.isnan("d"), F.round(F.col("d") * SCALE).cast("bigint")))
    middle = exact_quantiles(counts.withColumn("number", number).where("number is not null"), [*keys, "column_name"], "number", [0.5], weight="n")
    middle = middle.select(*keys, "column_name", "lo", "hi", F.get("quantiles", F.lit(0)).alias("median"))
    by = F.when(F.col("scaled"), F.lit(float(SCALE))).otherwise(F.lit(1.0))
    return basic.join(middle, [*keys, "column_name"], "left").withColumns({c: F.col(c) / by for c in ("lo", "hi", "median")}).drop("scaled")


def load_findings(spark: SparkSession, path: str, feed: str, load: str, rules: list[Rule], limits: Limits = Limits()) -> DataFrame:
    """Loads whose columns are broken or differ from the load before (load - 1 of the same feed).

    Returns ``feed, load_no, column_name, finding``.  Rows without feed or load
    belong to no load; a load without the one before has only findings of its own;
    shares and medians of a load without non-null values give no finding.  Medians of DOUBLE columns
    are taken to six decimals, without NaN.
    """
    keys = [feed, load]
    counts = materialise(
        value_counts(spark, path, keys, [r.column for r in rules]).where(F.col(feed).isNotNull() & F.col(load).isNotNull()), "value_counts"
    )
    now = materialise(load_profile(counts, keys, rules).withColumn("n_there", F.expr("n_rows - n_nulls")), "profile")
    before = now.select(
        feed, (F.col(load) + 1).alias(load), "column_name", *[F.col(c).alias(f"b_{c}") for c in ("n_rows", "n_nulls", "n_there", "median")]
    )
    kinds = profiled(spark.read.parquet(path).schema)
    texts = [r.column for r in rules if kinds[r.column] == "t"]
    share = (
        counts.where("t is not null")
        .join(now.select(*keys, "column_name", "n_there"), [*keys, "column_name"])
        .select(*keys, "column_name", F.col("t").alias("value"), (F.col("n") / F.col("n_there")).alias("share"))
    )
    signed = share.select(*keys, "column_name", "value", "share").unionByName(
        share.select(feed, (F.col(load) + 1).alias(load), "column_name", "value", (-F.col("share")).alias("share"))
    )
    moved = (
        signed.groupBy(*keys, "column_name", "value").agg(F.abs(F.sum("share")).alias("d"))
        .groupBy(*keys, "column_name").agg((F.sum("d") / 2).alias("distance"))
    )
    both = now.join(before, [feed, load, "column_name"], "left").join(moved, [*keys, "column_name"], "left")
    lower, upper = F.least("median", "b_median"), F.greatest("median", "b_median")
    is_text = F.col("column_name").isin(*texts)
    findings = {
        "nulls": F.expr(f"n_nulls / n_rows - b_n_nulls / b_n_rows > {limits.nulls}D"),
        "range": ~is_text & F.expr(f"n_violations > {limits.outside}D * n_there"),
        "pattern": is_text & F.expr(f"n_violations > {limits.outside}D * n_there"),
        "constant": F.expr("n_there >= 2 and n_distinct = 1"),
        "shift": F.when(is_text, F.expr(f"n_there > 0 and b_n_there > 0 and distance > {limits.distance}D")).otherwise(
            F.col("median").isNotNull() & F.col("b_median").isNotNull() & (upper > limits.ratio * lower)
        ),
    }
    listed = F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in findings.items()]), lambda x: x.isNotNull()))
    return both.select(F.col(feed).alias("feed"), F.col(load).alias("load_no"), "column_name", listed.alias("finding"))


def profile_chunks(spark: SparkSession, table: DataFrame, columns: list[str], rules: list[Rule]) -> DataFrame:
    """The chunks of columns, with ``open`` where nulls, distinct values or violations are not known without reading.

    Violations are known from exact candidates if none or all of them break the rule, and else
    from integers' extrema if these lie within the rule or wholly outside.
    """
    chunks = column_chunks(spark, table.inputFiles(), columns)
    there = F.col("n_rows") - F.col("nulls")
    wrong = F.size(F.filter("candidates", lambda v: _violates(rules, v)))
    known = F.when(there == 0, 0).when(F.col("candidates_exact") & (wrong == 0), 0).when(F.col("candidates_exact") & (wrong == F.size("candidates")), there)
    for r in rules:
        if not r.allowed:
            here = F.col("column_name") == r.column
            low, high = (F.lit(x).cast("double") for x in (r.low, r.high))
            within = F.coalesce(F.col("lo") >= low, low.isNull()) & F.coalesce(F.col("hi") <= high, high.isNull())
            outside = F.coalesce(F.col("hi") < low, F.lit(False)) | F.coalesce(F.col("lo") > high, F.lit(False))
            known = known.when(here & F.col("lo").isNotNull() & within, 0).when(here & F.col("lo").isNotNull() & outside, there)
    chunks = chunks.withColumn("violations", known.cast("bigint"))
    return chunks.withColumn("open", ~F.coalesce(F.col("nulls").isNotNull() & F.col("candidates_exact") & F.col("violations").isNotNull(), F.lit(False)))


def column_profile(spark: SparkSession, path: str, rules: list[Rule], columns: list[str] | None = None) -> DataFrame:
    """Per column: ``n_rows, n_nulls, n_distinct, lo, hi, n_violations`` over the whole table.

    ``columns`` are those of the rules if not given; a column without a rule has no violations.  ``lo`` and ``hi`` are DOUBLE, of
    numbers without NaN, days of dates and microseconds of times, and null for texts.  An empty table gives one row per
    column with zeros.  Binary and nested columns cannot be profiled; decimals go as DOUBLE.

    Scale: footers and dictionaries are read in tasks over files; of the data only the open chunks (:func:`profile_chunks`)
    are read, as scans of whole files or as single chunks (:func:`open_counts`), and counted before anything is shuffled.
    """
    table = spark.read.parquet(path)
    columns = [r.column for r in rules] if columns is None else columns
    kinds = profiled(table.schema)
    if missing := [c for c in columns if c not in kinds]:
        raise ValueError(f"no profile can be made of {missing}")
    chunks = materialise(profile_chunks(spark, table, columns, rules), "chunks")
    counts = materialise(open_counts(spark, table, [], chunks).groupBy("column_name", "l", "d", "t").agg(F.sum("n").alias("n")), "value_counts")
    known = chunks.where("not open")
    zero = F.lit(0).cast("bigint")
    totals = counts.select(
        "column_name", F.col("n").alias("n_rows"), F.when(_there(), zero).otherwise(F.col("n")).alias("n_nulls"),
        F.when(_there() & _violates(rules, _value()), F.col("n")).otherwise(zero).alias("n_violations"),
    ).unionByName(known.select("column_name", "n_rows", F.col("nulls").alias("n_nulls"), F.col("violations").alias("n_violations")))
    distinct = counts.where(_there()).select("column_name", "l", "d", "t").unionByName(
        known.select("column_name", F.inline("candidates"))
    ).distinct()
    number = F.coalesce(F.col("l").cast("double"), F.when(~F.isnan("d"), F.col("d")))
    named = spark.createDataFrame([(c,) for c in columns], "column_name string")
    filled = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return (
        named.join(totals.groupBy("column_name").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_nulls", "n_violations")]), "column_name", "left")
        .join(distinct.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"), F.min(number).alias("lo"), F.max(number).alias("hi")), "column_name", "left")
        .select("column_name", filled("n_rows"), filled("n_nulls"), filled("n_distinct"), "lo", "hi", filled("n_violations"))
    )
