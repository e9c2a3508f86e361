"""Quality filters of a genome catalogue, with the counts of each stage.

Nulls in a filtered column drop the row before the comparison.  An empty catalogue
passes through every filter as an empty one; cutoffs derived from no rows are null and keep nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presencia.operators.quantiles import exact_quantiles
from presencia.session import materialise

#: Quantiles of decimals are taken on numbers scaled by this.
SCALE = 1_000_000


def by_species(summary: DataFrame, pattern: str) -> DataFrame:
    """Rows whose genome_name contains the regular expression, with a length and a gene count, both as BIGINT."""
    kept = summary.where(F.col("genome_name").rlike(pattern)).dropna(subset=["genome_length", "patric_cds"])
    return kept.withColumns({c: F.col(c).cast("bigint") for c in ("genome_length", "patric_cds")})


def _quantile(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """Interpolated quantiles of one column, exact for numbers of up to six decimals: a row that the driver may hold."""
    scale = 1 if df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long") else SCALE
    scaled = df.select(F.lit(0).alias("all"), F.round(F.col(column) * scale).cast("bigint").alias("x")).where("x is not null")
    row = exact_quantiles(scaled, ["all"], "x", probs).first()
    return [q / scale for q in row["quantiles"]] if row else [None] * len(probs)


def within_contig_outliers(df: DataFrame, column: str = "contigs") -> DataFrame:
    """Rows up to Q3 + 1.5 IQR, and of those the ones up to 2.5 times their median."""
    q1, q3 = _quantile(df, column, [0.25, 0.75])
    if q1 is None:
        return df.limit(0)
    near = df.where(F.col(column) <= q3 + 1.5 * (q3 - q1))
    (middle,) = _quantile(near, column, [0.5])
    return near.where(F.col(column) <= 2.5 * middle)


def elbow_cutoff(df: DataFrame, column: str, curve: str) -> float | None:
    """The value at the elbow (ascending order) or knee (descending order) of the ranked values.

    Rank and value are scaled to 0..1; the elbow is the point furthest below the line
    between the ends, the knee the one furthest above; ties go to the first rank.  Ranks come from counts of
    distinct values summed by value, so rows are never ordered in one task.
    """
    if curve not in ("elbow", "knee"):
        raise ValueError("curve must be elbow or knee")
    rising = curve == "elbow"
    counts = materialise(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")), "curve")
    ends = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n")).first()
    if not ends["n"]:
        return None
    # running counts in two steps: whole value ranges first, then within a range
    span = (ends["hi"] - ends["lo"]) or 1.0
    binned = counts.withColumn("bin", F.floor((F.col("v") - ends["lo"]) / span * 4095).cast("int"))
    order = F.col("bin").asc() if rising else F.col("bin").desc()
    bins = binned.groupBy("bin").agg(F.sum("c").alias("m"))  # at most 4096 rows
    bins = bins.withColumn("before", F.sum("m").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy("bin").orderBy(F.col("v").asc() if rising else F.col("v").desc())
    ranked = binned.join(F.broadcast(bins.drop("m")), "bin").withColumn(
        "last", F.coalesce("before", F.lit(0)) + F.sum("c").over(inner) - 1
    )
    y = (F.col("v") - ends["lo"]) / span if ends["hi"] > ends["lo"] else F.lit(0.0)
    n = max(ends["n"] - 1, 1)
    if rising:  # lowest y - x: of equal values the last rank
        found = ranked.select("v", (y - F.col("last") / n).alias("d"), "last").agg(F.min_by("v", F.struct("d", "last")).alias("v"))
    else:  # a falling curve: highest y + x, of equal values the last rank
        found = ranked.select("v", (y + F.col("last") / n).alias("d"), (-F.col("last")).alias("first")).agg(F.max_by("v", F.struct("d", "first")).alias("v"))
    return found.first()["v"]


@dataclass(frozen=True)
class Funnel:
    """Rows that pass, the counts of each stage, and the cutoffs in use."""

    rows: DataFrame
    stats: DataFrame
    cutoffs: dict[str, float | None] = field(default_factory=dict)


#: The labels of the stages, in order.
STAGES = ("prefiltration", "L50/N50", "contig_count", "CheckM_completeness_contamination")


def stage_counts(stages: DataFrame, order: str, name: str, remaining: str) -> DataFrame:
    """``stage, initial, num_filtered, remaining``: each stage starts with what the one before left."""
    rows = stages.select(F.col(order).alias("ord"), F.col(name).alias("stage"), F.col(remaining).cast("bigint").alias("remaining"))
    initial = F.coalesce(F.lag("remaining").over(Window.orderBy("ord")), F.col("remaining"))  # one row per stage
    return rows.withColumn("initial", initial).select("ord", "stage", "initial", (F.col("initial") - F.col("remaining")).alias("num_filtered"), "remaining")


def by_quality(
    df: DataFrame, min_n50: int | None = None, max_contigs: int | None = None, contamination: float | None = None, completeness: float | None = None, l50: int = 1
) -> Funnel:
    """Complete genomes by L50 and N50, WGS ones by contigs, contamination and completeness; other statuses are dropped.

    L50 must equal ``l50``, N50 exceed ``min_n50`` (if given), contigs not exceed ``max_contigs`` (else outliers
    go), contamination stay below and completeness above their cutoffs (else the elbow and knee of the
    rows that are left).  Given all cutoffs this is one pass; each derived one reads the rows it is derived from.
    """
    present = lambda *cs: F.greatest(*[F.col(c).isNull() for c in cs]) == F.lit(False) if len(cs) > 1 else F.col(cs[0]).isNotNull()
    complete = df.where((F.col("genome_status") == "Complete") & present("contig_l50", "contig_n50") & (F.col("contig_l50") == l50))
    if min_n50:
        complete = complete.where(F.col("contig_n50") > min_n50)
    wgs = df.where((F.col("genome_status") == "WGS"))
    dated = wgs.where(present("contigs"))
    by_contig = dated.where(F.col("contigs") <= max_contigs) if max_contigs is not None else within_contig_outliers(dated)
    if contamination is None:
        contamination = elbow_cutoff(by_contig, "checkm_contamination", "elbow")
    clean = by_contig.where(F.col("checkm_contamination") < F.lit(contamination))
    if completeness is None:
        completeness = elbow_cutoff(clean, "checkm_completeness", "knee")
    whole = clean.where(F.col("checkm_completeness") > F.lit(completeness))
    typed = {c: F.col(c).cast("bigint") for c in ("contig_l50", "contig_n50", "contigs")}
    typed |= {c: F.col(c).cast("double") for c in ("checkm_contamination", "checkm_completeness", "gc_content")}
    rows = complete.unionByName(whole).withColumns(typed)
    count = lambda part, i: part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n")
    parts = [count(df, 0), count(complete, 1), count(wgs, 2), count(by_contig, 3), count(whole, 4)]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionAll(p)
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("n")))
    left = counts.agg(
        F.array(
            *[
                F.struct(F.lit(k).alias("ord"), F.lit(s).alias("stage"), v.alias("left"))
                for k, (s, v) in enumerate(zip(STAGES, (at(0), at(1) + at(2), at(1) + at(3), at(1) + at(4)), strict=True))
            ]
        ).alias("s")
    ).select(F.inline("s"))
    cutoffs = {"min_n50": min_n50, "max_contigs": max_contigs, "contamination": contamination, "completeness": completeness}
    return Funnel(rows, stage_counts(left, "ord", "stage", "left"), cutoffs)


def low_outliers(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """``df`` with ``outlier``: a modified z-score 0.6745 |x - median| / MAD above the threshold, on the low side only.

    A MAD of 0 counts as 1e-10; a null value is no outlier.
    """
    (middle,) = _quantile(df, column, [0.5])
    if middle is None:
        return df.withColumn("outlier", F.lit(False))
    off = F.abs(F.col(column) - F.lit(middle))
    (mad,) = _quantile(df.select(off.alias("off")), "off", [0.5])
    score = F.lit(0.6745) * off / F.lit(mad or 1e-10)
    return df.withColumn("outlier", F.coalesce((score > threshold) & (F.col(column) < middle), F.lit(False)))


def without_low_outliers(df: DataFrame, column: str, threshold: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """:func:`low_outliers` removed again and again until there are none: (kept, removed with its ``round``).

    Each round only lowers the number of rows, and moves the cut upwards, so rounds are few.
    """
    kept, removed, turn = df, None, 0
    while True:
        turn += 1
        marked = materialise(low_outliers(kept, column, threshold), "outliers")
        out = marked.where("outlier").drop("outlier").withColumn("round", F.lit(turn))
        removed = out if removed is None else removed.unionByName(out)
        kept = marked.where("not outlier").drop("outlier")
        if not out.head(1):
            return kept, removed


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order; nulls in the keys count as one value.

    An aggregation with map-side combining, so a hot key needs no sort.  Rows equal in the whole order must be equal.
    """
    rest = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("_r")).select("_r.*")


def typed_catalogue(df: DataFrame, bigints: list[str], doubles: list[str]) -> DataFrame:
    """Text columns as numbers where they are numbers, null where not; ids stay text."""
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in bigints} | {c: F.col(c).try_cast("double") for c in doubles})
