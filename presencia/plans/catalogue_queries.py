"""Queries of the catalogue filters and of names and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.functions import names
from presencia.operators import qc
from presencia.plans.registry import Registry
from presencia.session import table

R = Registry()

SPECIES = "^[A-Z][a-z]*spira "


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "genome_summary")


@R.query(
    "qc_species",
    "SELECT row_id, genome_id, genome_length, patric_cds FROM genome_summary WHERE regexp_matches(genome_name, '^[A-Z][a-z]*spira ')"
    " AND genome_length IS NOT NULL AND patric_cds IS NOT NULL",
)
def qc_species(spark: SparkSession, sf: str) -> DataFrame:
    return qc.by_species(_catalogue(spark, sf), SPECIES).select("row_id", "genome_id", "genome_length", "patric_cds")


_QUALITY = """
WITH c AS (SELECT * FROM genome_summary WHERE genome_status = 'Complete' AND contig_l50 = 1 AND contig_n50 > 1500000),
w AS (SELECT * FROM genome_summary WHERE genome_status = 'WGS'),
k AS (SELECT * FROM w WHERE contigs <= 60),
q AS (SELECT * FROM k WHERE checkm_contamination < 2.5 AND checkm_completeness > 98.0)
"""


def _quality(spark: SparkSession, sf: str) -> qc.Funnel:
    return qc.by_quality(_catalogue(spark, sf), min_n50=1_500_000, max_contigs=60, contamination=2.5, completeness=98.0)


@R.query("qc_quality", _QUALITY + "SELECT row_id, genome_id, contig_l50, contig_n50, contigs, checkm_contamination, checkm_completeness FROM (SELECT * FROM c UNION ALL SELECT * FROM q)")
def qc_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).rows.select("row_id", "genome_id", "contig_l50", "contig_n50", "contigs", "checkm_contamination", "checkm_completeness")


@R.query(
    "qc_quality_stats",
    _QUALITY
    + """, n AS (SELECT (SELECT count(*) FROM genome_summary) AS a, (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM w) AS w, (SELECT count(*) FROM k) AS k, (SELECT count(*) FROM q) AS q),
s AS (SELECT 0 AS ord, 'prefiltration' AS stage, a AS remaining FROM n UNION ALL SELECT 1, 'L50/N50', c + w FROM n UNION ALL SELECT 2, 'contig_count', c + k FROM n
      UNION ALL SELECT 3, 'CheckM_completeness_contamination', c + q FROM n)
SELECT ord, stage, coalesce(lag(remaining) OVER (ORDER BY ord), remaining) AS initial, coalesce(lag(remaining) OVER (ORDER BY ord), remaining) - remaining AS num_filtered, remaining FROM s""",
)
def qc_quality_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).stats


@R.query(
    "qc_contig_outliers",
    """WITH w AS (SELECT * FROM genome_summary WHERE genome_status = 'WGS' AND contigs IS NOT NULL),
q AS (SELECT quantile_cont(contigs, 0.25) AS q1, quantile_cont(contigs, 0.75) AS q3 FROM w),
k AS (SELECT w.* FROM w, q WHERE contigs <= q3 + 1.5 * (q3 - q1))
SELECT row_id, contigs FROM k WHERE contigs <= 2.5 * (SELECT quantile_cont(contigs, 0.5) FROM k)""",
)
def qc_contig_outliers(spark: SparkSession, sf: str) -> DataFrame:
    wgs = _catalogue(spark, sf).where("genome_status = 'WGS' and contigs is not null")
    return qc.within_contig_outliers(wgs).select("row_id", "contigs")


_CURVE = """(SELECT v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c} {d}) - 1 AS r, count(*) OVER () - 1 AS n,
  min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM genome_summary WHERE genome_status = 'WGS' AND {c} IS NOT NULL)
  ORDER BY {e}, r {t} LIMIT 1)"""


@R.query(
    "qc_elbows",
    "SELECT 'elbow' AS curve, "
    + _CURVE.format(c="checkm_contamination", d="ASC", e="round((v - lo) / (hi - lo) - r / n, 12)", t="DESC")
    + " AS cutoff UNION ALL SELECT 'knee', "
    + _CURVE.format(c="checkm_completeness", d="DESC", e="round(-((v - lo) / (hi - lo) + r / n), 12)", t="ASC"),
)
def qc_elbows(spark: SparkSession, sf: str) -> DataFrame:
    wgs = _catalogue(spark, sf).where("genome_status = 'WGS'")
    cutoffs = [("elbow", qc.elbow_cutoff(wgs, "checkm_contamination", "elbow")), ("knee", qc.elbow_cutoff(wgs, "checkm_completeness", "knee"))]
    return spark.createDataFrame(cutoffs, "curve string, cutoff double")


_DERIVED = """WITH c AS (SELECT * FROM genome_summary WHERE genome_status = 'Complete' AND contig_l50 = 1 AND contig_n50 IS NOT NULL),
w AS (SELECT * FROM genome_summary WHERE genome_status = 'WGS'), o AS (SELECT quantile_cont(contigs, 0.25) AS q1, quantile_cont(contigs, 0.75) AS q3 FROM w),
k0 AS (SELECT w.* FROM w, o WHERE contigs <= q3 + 1.5 * (q3 - q1)), k AS (SELECT * FROM k0 WHERE contigs <= 2.5 * (SELECT quantile_cont(contigs, 0.5) FROM k0)),
l AS (SELECT * FROM k WHERE checkm_contamination < {elbow}), q AS (SELECT * FROM l WHERE checkm_completeness > {knee}),
n AS (SELECT (SELECT count(*) FROM genome_summary) AS a, (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM w) AS w, (SELECT count(*) FROM k) AS k, (SELECT count(*) FROM q) AS q),
s AS (SELECT 0 AS ord, 'prefiltration' AS stage, a AS remaining FROM n UNION ALL SELECT 1, 'L50/N50', c + w FROM n UNION ALL SELECT 2, 'contig_count', c + k FROM n
      UNION ALL SELECT 3, 'CheckM_completeness_contamination', c + q FROM n)
SELECT ord, stage, coalesce(lag(remaining) OVER (ORDER BY ord), remaining) AS initial, coalesce(lag(remaining) OVER (ORDER BY ord), remaining) - remaining AS num_filtered, remaining FROM s""".format(
    elbow=_CURVE.replace("genome_summary WHERE genome_status = 'WGS' AND", "k WHERE").format(c="checkm_contamination", d="ASC", e="round((v - lo) / (hi - lo) - r / n, 12)", t="DESC"),
    knee=_CURVE.replace("genome_summary WHERE genome_status = 'WGS' AND", "l WHERE").format(c="checkm_completeness", d="DESC", e="round(-((v - lo) / (hi - lo) + r / n), 12)", t="ASC"),
)


@R.query("qc_derived_cutoffs", _DERIVED)
def qc_derived_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    """The quality filter with every cutoff taken from the data."""
    return qc.by_quality(_catalogue(spark, sf)).stats


_MAD = """WITH m AS (SELECT median(gc_content) AS m FROM genome_summary), d AS (SELECT median(abs(gc_content - m)) AS mad FROM genome_summary, m)
SELECT row_id, coalesce(gc_content < m AND 0.6745 * abs(gc_content - m) / CASE WHEN mad = 0 THEN 1e-10 ELSE mad END > 2, false) AS outlier FROM genome_summary, m, d"""


@R.query("qc_low_outliers", _MAD)
def qc_low_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return qc.low_outliers(_catalogue(spark, sf), "gc_content", 2.0).select("row_id", "outlier")


def _rounds_sql(rounds: int) -> str:
    """As many rounds as given, the last of which must find nothing (as on the test tables)."""
    parts = ["k0 AS (SELECT row_id, checkm_completeness AS x FROM genome_summary WHERE checkm_completeness IS NOT NULL)"]
    for i in range(1, rounds + 1):
        parts.append(f"m{i} AS (SELECT median(x) AS m FROM k{i - 1}), d{i} AS (SELECT median(abs(x - m)) AS mad FROM k{i - 1}, m{i})")
        parts.append(
            f"t{i} AS (SELECT row_id, x, x < m AND 0.6745 * abs(x - m) / CASE WHEN mad = 0 THEN 1e-10 ELSE mad END > 3 AS gone FROM k{i - 1}, m{i}, d{i}), k{i} AS (SELECT row_id, x FROM t{i} WHERE NOT gone)"
        )
    out = " UNION ALL ".join(f"SELECT row_id, {i} AS round FROM t{i} WHERE gone" for i in range(1, rounds + 1))
    return f"WITH {', '.join(parts)} SELECT row_id, 0 AS round FROM k{rounds} UNION ALL {out}"


@R.query("qc_without_low_outliers", _rounds_sql(14))
def qc_without_low_outliers(spark: SparkSession, sf: str) -> DataFrame:
    kept, removed = qc.without_low_outliers(_catalogue(spark, sf).where("checkm_completeness is not null"), "checkm_completeness", 3.0)
    return kept.select("row_id", F.lit(0).alias("round")).unionByName(removed.select("row_id", "round"))


@R.query(
    "qc_latest_delivery",
    "SELECT * EXCLUDE (k) FROM (SELECT genome_id, row_id, load_no, genome_status, row_number() OVER (PARTITION BY genome_id ORDER BY load_no DESC, row_id DESC) AS k FROM genome_summary) WHERE k = 1",
)
def qc_latest_delivery(spark: SparkSession, sf: str) -> DataFrame:
    rows = _catalogue(spark, sf).select("genome_id", "row_id", "load_no", "genome_status")
    return qc.first_by(rows, ["genome_id"], [-F.col("load_no"), -F.col("row_id")])


@R.query(
    "qc_typed",
    "SELECT line_id, CASE WHEN regexp_full_match(split_part(line, chr(9), 5), ' *[+-]?[0-9]+ *') THEN try_cast(trim(split_part(line, chr(9), 5)) AS BIGINT) END AS genome_length, try_cast(nullif(split_part(line, chr(9), 12), '') AS DOUBLE) AS gc_content FROM genome_summary_raw",
)
def qc_typed(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda i: F.split_part("line", F.lit("\t"), F.lit(i))
    raw = table(spark, sf, "genome_summary_raw").select("line_id", part(5).alias("genome_length"), part(12).alias("gc_content"))
    return qc.typed_catalogue(raw, ["genome_length"], ["gc_content"])


# --- names ------------------------------------------------------------------------


@R.query(
    "names_parts",
    r"""SELECT row_id, nullif(regexp_extract(f, '^(.*)_([CT])(\d+)(?:([AUD])(\d+))?$', 1), '') AS name, nullif(regexp_extract(f, '^(.*)_([CT])(\d+)(?:([AUD])(\d+))?$', 2), '') AS kind,
  try_cast(regexp_extract(f, '^(.*)_([CT])(\d+)(?:([AUD])(\d+))?$', 3) AS INT) AS number, try_cast(nullif(regexp_extract(f, '^(.*)_([CT])(\d+)(?:([AUD])(\d+))?$', 5), '') AS INT) AS variant,
  f AS feature, cluster AS gene, regexp_replace(f, 'A[^A]*$', '') AS by_letter, CASE WHEN length(f) > 1 THEN f[1] || regexp_replace(f[2:], '[A-Za-z][^A-Za-z]*$', '') ELSE f END AS trimmed
  FROM (SELECT row_id, cluster, cluster || 'A' || (row_id % 7)::VARCHAR AS f FROM locus_map WHERE cluster IS NOT NULL)""",
)
def names_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = names.feature_parts(F.col("cluster"))
    rows = table(spark, sf, "locus_map").where("cluster is not null").withColumn("p", parts)
    made = names.feature_name(F.col("p.name"), F.col("p.cluster_type"), F.col("p.cluster"), F.lit("A"), F.col("row_id") % 7)
    rows = rows.select("row_id", made.alias("feature")).withColumn("p", names.feature_parts(F.col("feature")))
    return rows.select(
        "row_id", "p.name", F.col("p.cluster_type").alias("kind"), F.col("p.cluster").alias("number"), "p.variant", "feature",
        names.cluster_of(F.col("feature")).alias("gene"), names.gene_of_allele(F.col("feature")).alias("by_letter"), names.trim_variant(F.col("feature")).alias("trimmed"),
    )


@R.query(
    "names_of_paths",
    "SELECT doc_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)[.][^.]*$', '\\1') AS genome, regexp_extract(text, '^>?\\s*(\\S*)', 1) AS header FROM documents",
)
def names_of_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", names.genome_of_path(F.col("url")).alias("genome"), names.short_header(F.col("text")).alias("header")
    )


@R.query(
    "sequence_functions",
    """SELECT row_id, reverse(translate(s, 'ACGT', 'TGCA')) AS rc, sha256(s) AS key, regexp_replace(s, '(.{10})', '\\1' || chr(10), 'g') AS wrapped_all
FROM (SELECT row_id, translate(md5(locus_tag), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM annotations WHERE locus_tag IS NOT NULL)""",
)
def sequence_functions(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.translate(F.md5("locus_tag"), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = table(spark, sf, "annotations").where("locus_tag is not null").select("row_id", seq.alias("s"))
    return rows.select("row_id", names.reverse_complement(F.col("s")).alias("rc"), names.sequence_key(F.col("s")).alias("key"), names.wrapped(F.col("s"), 10).alias("wrapped_all"))


@R.query(
    "unit_numbers",
    "SELECT row_id, round(genome_length / 1e6, 1) * 1e6 AS length FROM genome_summary WHERE genome_length IS NOT NULL",
)
def unit_numbers(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.round(F.col("genome_length") / 1e6, 1).cast("string"), F.lit(" Mb"))
    return table(spark, sf, "genome_summary").where("genome_length is not null").select("row_id", names.unit_number(text).cast("double").alias("length"))


@R.query(
    "product_words",
    "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex("
    + "".join("replace(" for _ in names.PRODUCT_STOPS)
    + "lower(product)"
    + "".join(f", '{s}', '')" for s in names.PRODUCT_STOPS)
    + ", '\\s+')) AS w FROM annotations) WHERE w <> '' GROUP BY w",
)
def product_words(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "annotations").select(F.explode(names.product_words(F.col("product"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "attributes",
    "SELECT row_id, 'ID' AS k, locus_tag AS id, replace(product, '%2C', ',') AS product FROM annotations",
)
def attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of GFF text made from the annotations."""
    text = F.concat(F.lit("src=x;ID="), F.coalesce("locus_tag", F.lit("")), F.lit(";product="), F.coalesce(F.replace("product", F.lit(";"), F.lit("%3B")), F.lit("")))
    rows = table(spark, sf, "annotations").select("row_id", "locus_tag", "product", text.alias("a"))
    keep = lambda c, v: F.when(F.col(c).isNotNull(), v)
    return rows.select("row_id", F.lit("ID").alias("k"), keep("locus_tag", names.attribute(F.col("a"), "ID")).alias("id"), keep("product", names.percent_decoded(names.attribute(F.col("a"), "product"))).alias("product"))
