"""References to records that do not exist (yet, or any more).

Parents and children go into one long table of tagged keys, one aggregation by
(target table, key) finds the groups that lack a parent in view of every child,
and only children of those groups are looked at row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presencia.operators.skew import salted_lookup
from presencia.session import materialise

#: Withdrawn parents of one key are cut by time into bins of about this many rows.
BIN_ROWS = 100_000


@dataclass(frozen=True)
class Parent:
    """A target table: its name, rows, key, and the time span in which a row is in view."""

    name: str
    rows: DataFrame
    key: Column
    seen: Column
    removed: Column | None = None


@dataclass(frozen=True)
class Child:
    """A referring table: its name, the target's name, rows, reference, time, period and row id."""

    name: str
    target: str
    rows: DataFrame
    key: Column
    seen: Column
    period: Column
    row_id: Column


def _long(children: list[Child], parents: list[Parent]) -> tuple[DataFrame, DataFrame]:
    stamp = lambda c: c.cast("timestamp_ntz")
    kids = up = None
    for c in children:
        part = c.rows.select(
            F.lit(c.target).alias("target"), c.key.alias("key"), stamp(c.seen).alias("t"),
            F.lit(c.name).alias("src_table"), c.period.alias("load_no"), c.row_id.alias("row_id"),
        ).where(F.col("key").isNotNull())
        kids = part if kids is None else kids.unionAll(part)
    for p in parents:
        removed = F.lit(None) if p.removed is None else p.removed
        part = p.rows.select(
            F.lit(p.name).alias("target"), p.key.alias("key"), stamp(p.seen).alias("t"), stamp(removed).alias("gone")
        ).where(F.col("key").isNotNull())
        up = part if up is None else up.unionAll(part)
    return kids, up


def _out_of_view(asked: DataFrame, gone: DataFrame) -> DataFrame:
    """``target, key, t, n``: the questions at whose time ``t`` no withdrawn parent of the key was in view.

    One was iff the latest withdrawal among the parents seen up to ``t`` is later than ``t``: a running maximum in order
    of time.  A key's time is cut into ``bins`` parts, so that what precedes a part is one number, put before
    its first row, and one part is all that a task orders.
    """
    asked = asked.withColumn("gone", F.lit(None).cast("timestamp_ntz"))
    spans = gone.groupBy("target", "key", "bins", "lo", "hi", "t").agg(F.max("gone").alias("gone")).withColumn("n", F.lit(None).cast("bigint"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    place = F.floor((micros("t") - micros("lo")) / F.greatest(F.lit(1), micros("hi") - micros("lo")) * F.col("bins"))
    both = spans.unionByName(asked).withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.col("bins") - 1).cast("int"))
    both = materialise(both.select("target", "key", "bins", "bin", "t", "gone", "n"), "timeline")
    line = both.drop("bins")
    if both.where("bins > 1").head(1):
        before = Window.partitionBy("target", "key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = both.where("bins > 1").groupBy("target", "key", "bin").agg(F.max("gone").alias("gone"))
        carried = bins.withColumn("gone", F.max("gone").over(before)).where("gone is not null")
        nothing = {"t": F.lit(None).cast("timestamp_ntz"), "n": F.lit(None).cast("bigint")}
        line = line.unionByName(carried.withColumns(nothing))  # a null time comes first
    upto = Window.partitionBy("target", "key", "bin").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.withColumn("latest", F.max("gone").over(upto))
    return seen.where(F.col("n").isNotNull() & ~F.coalesce(F.col("latest") > F.col("t"), F.lit(False))).select("target", "key", "t", "n")


def orphans(children: list[Child], parents: list[Parent]) -> DataFrame:
    """Every child row whose reference has no target in view when the row is loaded.

    Returns ``src_table, load_no, row_id, reason``; reason is ``missing`` (no
    target row at all), ``late`` (every target appears later) or ``deleted``.
    Null references are no references.  A row or target without a load time is in
    view of nothing; such a child of an existing target is ``deleted``.  Repeated
    rows each count; empty tables give no rows (an empty target table: all missing).

    Scale: one map-side-combined aggregation over the union of keys, however hot.  Children of the groups it leaves
    open, dealt over sub-keys where a key is hot, are compared with the first parent that stays; only where withdrawn
    parents could matter, distinct times and spans of a key meet, in parts of about BIN_ROWS.
    """
    kids, up = _long(children, parents)
    tagged = up.select("target", "key", F.lit(True).alias("p"), "t", "gone").unionAll(
        kids.select("target", "key", F.lit(False), "t", F.lit(None).cast("timestamp_ntz"))
    )
    is_p, is_c = F.col("p"), ~F.col("p")
    groups = tagged.groupBy("target", "key").agg(
        F.count_if(is_c).alias("n_child"),
        F.count_if(is_p).alias("n_parent"),
        F.count_if(is_p & F.col("gone").isNotNull()).alias("n_gone"),
        F.min(F.when(is_p, F.col("t"))).alias("first"),
        F.count_if(is_p & F.col("t").isNull()).alias("undated"),
        F.min(F.when(is_p & F.col("gone").isNull(), F.col("t"))).alias("open"),
        F.min(F.when(is_c, F.col("t"))).alias("child_first"),
        F.count_if(is_c & F.col("t").isNull()).alias("child_undated"),
        F.min("t").alias("lo"),
        F.max("t").alias("hi"),
    )
    bins = F.ceil((F.col("n_gone") + F.col("n_child")) / BIN_ROWS).cast("int")
    lacking = materialise(
        groups.where("n_child > 0 and (n_parent = 0 or child_undated > 0 or not coalesce(open <= child_first, false))")
        .drop("child_first", "child_undated").withColumn("bins", bins),
        "references",
    )
    t = F.col("t")
    reason = (
        F.when(F.col("n_parent") == 0, "missing")
        .when((F.col("undated") == 0) & (F.col("first") > t), "late")
        .otherwise("deleted")
    )
    out = ("src_table", "load_no", "row_id", "reason")
    open_ = (
        salted_lookup(kids, lacking, ["target", "key"], "n_child", F.col("row_id"), stored=True)
        .where(~F.coalesce(F.col("open") <= t, F.lit(False)))
        .withColumn("reason", reason)
        # a span that began may still hold; parents that all come later or never cannot
        .withColumn("ask", F.coalesce((F.col("n_gone") > 0) & (F.col("first") <= t), F.lit(False)))
        .select(*out, "target", "key", "t", "bins", "lo", "hi", "ask")
    )
    open_ = materialise(open_, "open_references")
    spans = salted_lookup(
        up.where("gone is not null and t < gone"), lacking.where("n_gone > 0").select("target", "key", "n_gone", "bins", "lo", "hi"),
        ["target", "key"], "n_gone", F.struct("t", "gone"), stored=True,
    )
    asked = open_.where("ask").groupBy("target", "key", "bins", "lo", "hi", "t").agg(F.count(F.lit(1)).alias("n"))
    left = salted_lookup(open_.where("ask"), _out_of_view(asked, spans), ["target", "key", "t"], "n", F.col("row_id"))
    return open_.where("not ask").select(*out).unionByName(left.select(*out))


def orphans_by_period(found: DataFrame) -> DataFrame:
    """Counts per table, period and reason of :func:`orphans`' rows."""
    return found.groupBy("src_table", "load_no", "reason").agg(F.count(F.lit(1)).alias("n_rows"))
