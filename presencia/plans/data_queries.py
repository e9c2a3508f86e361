"""Queries of the general data operators on their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.operators import badlines, packed, profile, quantiles, references
from presencia.plans.registry import Registry
from presencia.session import table

R = Registry()

# --- references -------------------------------------------------------------------

_FOUND_1 = """
WITH child AS (
  SELECT 'locus_map' AS src_table, load_no, row_id, loaded_at AS t, gene_id AS k FROM locus_map WHERE gene_id IS NOT NULL
  UNION ALL
  SELECT 'annotations', load_no, row_id, loaded_at,
         CASE WHEN contains(locus_tag, '_') THEN regexp_replace(locus_tag, '_[^_]*$', '') ELSE locus_tag END
  FROM annotations WHERE locus_tag IS NOT NULL),
parent AS (
  SELECT 'locus_map' AS src_table, locus_tag AS k, loaded_at AS f, removed_at AS g FROM annotations WHERE locus_tag IS NOT NULL
  UNION ALL
  SELECT 'annotations', genome_id, loaded_at, NULL FROM genome_summary WHERE genome_id IS NOT NULL),
seen AS (
  SELECT c.src_table, c.load_no, c.row_id,
         count(p.k) AS n,
         coalesce(bool_or(p.f <= c.t AND (p.g IS NULL OR p.g > c.t)), false) AS in_view,
         coalesce(bool_and(coalesce(p.f > c.t, false)), false) AS later
  FROM child c LEFT JOIN parent p ON p.src_table = c.src_table AND p.k = c.k
  GROUP BY ALL)
SELECT src_table, load_no, row_id, CASE WHEN n = 0 THEN 'missing' WHEN later THEN 'late' ELSE 'deleted' END AS reason
FROM seen WHERE NOT in_view
"""


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    locus, anno, cat = (table(spark, sf, t) for t in ("locus_map", "annotations", "genome_summary"))
    genome = F.regexp_replace("locus_tag", "_[^_]*$", "")
    return references.orphans(
        [
            references.Child("locus_map", "annotations", locus, F.col("gene_id"), F.col("loaded_at"), F.col("load_no"), F.col("row_id")),
            references.Child("annotations", "genome_summary", anno, genome, F.col("loaded_at"), F.col("load_no"), F.col("row_id")),
        ],
        [
            references.Parent("annotations", anno, F.col("locus_tag"), F.col("loaded_at"), F.col("removed_at")),
            references.Parent("genome_summary", cat, F.col("genome_id"), F.col("loaded_at")),
        ],
    )


@R.query("p1_found", _FOUND_1)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


@R.query("p1_by_period", f"SELECT src_table, load_no, reason, count(*) AS n_rows FROM ({_FOUND_1}) GROUP BY ALL")
def p1_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphans_by_period(_orphans(spark, sf))


# --- packed fields ----------------------------------------------------------------

_UNPACK = r"""
SELECT '{t}' AS src_table, row_id, unnest(range(1, len(v) + 1))::INT AS pos,
       unnest(list_transform(v, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END)) AS val
FROM (SELECT row_id, regexp_extract_all({c}, '"(?:[^"]|"")*"|[A-Za-z0-9:._-]+') AS v FROM {t} WHERE {c} IS NOT NULL)
"""


@R.query("p2_found", _UNPACK.format(t="annotations", c="dbxrefs") + "UNION ALL" + _UNPACK.format(t="cluster_to_go_functions", c="go"))
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for t, c in (("annotations", "dbxrefs"), ("cluster_to_go_functions", "go")):
        found = packed.unpack(table(spark, sf, t), c, ["row_id"])
        parts.append(found.select(F.lit(t).alias("src_table"), "row_id", "pos", "val"))
    return parts[0].unionByName(parts[1])


# --- column profiles --------------------------------------------------------------

RULES = [
    profile.Rule("contigs", 1, 5000),
    profile.Rule("patric_cds", 1, 20000),
    profile.Rule("genome_status", allowed=("Complete", "WGS", "Plasmid")),
]

_FOUND_3 = """
WITH n AS (
  SELECT feed, load_no, 'contigs' AS column_name, contigs AS v, (contigs NOT BETWEEN 1 AND 5000)::INT AS bad FROM genome_summary
  UNION ALL SELECT feed, load_no, 'patric_cds', patric_cds, (patric_cds NOT BETWEEN 1 AND 20000)::INT FROM genome_summary),
s AS (SELECT feed, load_no, 'genome_status' AS column_name, genome_status AS v,
             (genome_status NOT IN ('Complete', 'WGS', 'Plasmid'))::INT AS bad FROM genome_summary),
a AS (
  SELECT feed, load_no, column_name, count(*) AS n, count(v) AS m, sum(bad) AS bad, count(DISTINCT v) AS d, median(v) AS med FROM n GROUP BY ALL
  UNION ALL SELECT feed, load_no, column_name, count(*), count(v), sum(bad), count(DISTINCT v), NULL FROM s GROUP BY ALL),
b AS (SELECT c.*, p.n AS pn, p.m AS pm, p.med AS pmed FROM a c LEFT JOIN a p
      ON p.feed = c.feed AND p.load_no = c.load_no - 1 AND p.column_name = c.column_name
      WHERE c.feed IS NOT NULL AND c.load_no IS NOT NULL),
sh AS (SELECT feed, load_no, v, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY feed, load_no) AS share
       FROM s WHERE v IS NOT NULL GROUP BY feed, load_no, v),
dist AS (SELECT feed, load_no, sum(abs(x)) / 2 AS distance FROM (
           SELECT feed, load_no, v, sum(x) AS x FROM (
             SELECT feed, load_no, v, share AS x FROM sh UNION ALL SELECT feed, load_no + 1, v, -share FROM sh) GROUP BY ALL) GROUP BY ALL),
f AS (
  SELECT feed, load_no, column_name, 'nulls' AS finding FROM b WHERE (n - m) * 1.0 / n - (pn - pm) * 1.0 / pn > 0.117
  UNION ALL SELECT feed, load_no, column_name, CASE WHEN column_name = 'genome_status' THEN 'pattern' ELSE 'range' END
    FROM b WHERE bad > 0.019 * m
  UNION ALL SELECT feed, load_no, column_name, 'constant' FROM b WHERE m >= 2 AND d = 1
  UNION ALL SELECT feed, load_no, column_name, 'shift' FROM b WHERE greatest(med, pmed) > 1.453 * least(med, pmed) AND med IS NOT NULL AND pmed IS NOT NULL
  UNION ALL SELECT b.feed, b.load_no, column_name, 'shift' FROM b JOIN dist USING (feed, load_no)
    WHERE column_name = 'genome_status' AND m > 0 AND pm > 0 AND distance > 0.193)
SELECT * FROM f
"""


@R.query("p3_found", _FOUND_3)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return profile.load_findings(spark, f"{sf}/genome_summary.parquet", "feed", "load_no", RULES)


@R.query(
    "p3_profile",
    """
SELECT 'contigs' AS column_name, count(*) AS n_rows, count(*) - count(contigs) AS n_nulls, count(DISTINCT contigs) AS n_distinct,
       min(contigs) AS lo, max(contigs) AS hi, count_if(contigs NOT BETWEEN 1 AND 5000)::BIGINT AS n_violations FROM genome_summary
UNION ALL
SELECT 'patric_cds', count(*), count(*) - count(patric_cds), count(DISTINCT patric_cds), min(patric_cds), max(patric_cds),
       count_if(patric_cds NOT BETWEEN 1 AND 20000)::BIGINT FROM genome_summary
UNION ALL
SELECT 'genome_status', count(*), count(*) - count(genome_status), count(DISTINCT genome_status), NULL, NULL,
       count_if(genome_status NOT IN ('Complete', 'WGS', 'Plasmid'))::BIGINT FROM genome_summary
""",
)
def p3_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.column_profile(spark, f"{sf}/genome_summary.parquet", RULES)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("lo", "hi")})


_EVERY = {
    **dict.fromkeys(("row_id", "load_no", "genome_length", "patric_cds", "contigs", "contig_l50", "contig_n50"), "{c}::DOUBLE"),
    **dict.fromkeys(("checkm_contamination", "checkm_completeness", "gc_content"), "{c}"),
    **dict.fromkeys(("feed", "genome_id", "genome_name", "genome_status", "taxon_id"), "NULL::DOUBLE"),
    "loaded_at": "epoch_us({c})::DOUBLE",
}
_BREAKS = {"contigs": "contigs NOT BETWEEN 1 AND 5000", "patric_cds": "patric_cds NOT BETWEEN 1 AND 20000", "genome_status": "genome_status NOT IN ('Complete', 'WGS', 'Plasmid')"}


@R.query(
    "p3_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, "
        f"min({x.format(c=c)}) AS lo, max({x.format(c=c)}) AS hi, count_if({_BREAKS.get(c, 'false')})::BIGINT AS n_violations FROM genome_summary"
        for c, x in _EVERY.items()
    ),
)
def p3_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Every column of the catalogue: numbers, texts and times."""
    path = f"{sf}/genome_summary.parquet"
    return profile.column_profile(spark, path, RULES, list(profile.profiled(spark.read.parquet(path).schema)))


# --- lines ------------------------------------------------------------------------

_F = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_PARSED = rf"""
WITH w AS (SELECT line_id, coalesce(line, '') AS line, regexp_full_match(coalesce(line, ''), '(?s){_F}(?:\t{_F})*') AS whole FROM genome_summary_raw),
c AS (SELECT line_id, whole, CASE WHEN whole THEN regexp_extract_all(chr(9) || line, '(?s)\t({_F})', 1) END AS v FROM w),
u AS (SELECT line_id, whole, len(v) AS n, list_transform(v, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM c),
r AS (SELECT line_id, v, CASE
    WHEN NOT whole THEN 'broken_quoting'
    WHEN n <> 12 THEN 'column_count'
    WHEN v[5] <> '' AND NOT (regexp_full_match(v[5], '[0-9]+') AND try_cast(v[5] AS BIGINT) IS NOT NULL) THEN 'invalid_value'
    WHEN v[9] <> '' AND NOT (regexp_full_match(v[9], '[0-9]+') AND try_cast(v[9] AS BIGINT) IS NOT NULL) THEN 'invalid_value'
    WHEN v[10] <> '' AND NOT (regexp_full_match(v[10], '[0-9]+([.][0-9]+)?') AND try_cast(v[10] AS DOUBLE) <= 100) THEN 'invalid_value'
  END AS reason FROM u)
"""


@R.query("p5_found", _PARSED + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    read = badlines.read_lines(table(spark, sf, "genome_summary_raw"), "line_id", "line", badlines.CATALOGUE)
    return read.where("reason is not null").select("line_id", "reason")


@R.query(
    "p5_loaded",
    _PARSED
    + """SELECT line_id, nullif(v[1], '') AS genome_id, nullif(v[2], '') AS genome_name, nullif(v[3], '') AS genome_status, nullif(v[4], '') AS taxon_id,
       try_cast(v[5] AS BIGINT) AS genome_length, try_cast(nullif(v[6], '') AS BIGINT) AS patric_cds, try_cast(nullif(v[7], '') AS BIGINT) AS contigs,
       try_cast(nullif(v[8], '') AS BIGINT) AS contig_l50, try_cast(nullif(v[9], '') AS BIGINT) AS contig_n50,
       try_cast(v[10] AS DOUBLE) AS checkm_contamination, try_cast(v[11] AS DOUBLE) AS checkm_completeness, try_cast(v[12] AS DOUBLE) AS gc_content
FROM r WHERE reason IS NULL""",
)
def p5_loaded(spark: SparkSession, sf: str) -> DataFrame:
    read = badlines.read_lines(table(spark, sf, "genome_summary_raw"), "line_id", "line", badlines.CATALOGUE)
    return read.where("reason is null").drop("reason")


# --- hot keys ---------------------------------------------------------------------


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "locus_map").select("cluster", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded"), "row_id")
    return quantiles.exact_quantiles(rows, ["cluster"], "loaded", [0.25, 0.5, 0.9], spread="row_id")


@R.query(
    "p7_found",
    "SELECT cluster FROM locus_map WHERE cluster IS NOT NULL GROUP BY cluster HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM locus_map)",
)
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.heavy_keys(table(spark, sf, "locus_map"), "cluster", 0.02).select("cluster")


@R.query(
    "p7_quantiles",
    """SELECT cluster, count(*) AS n_rows, round(quantile_cont(epoch_us(loaded_at)::DOUBLE, 0.25) / 1e6, 2) AS loaded_p25,
       round(quantile_cont(epoch_us(loaded_at)::DOUBLE, 0.5) / 1e6, 2) AS loaded_p50, round(quantile_cont(epoch_us(loaded_at)::DOUBLE, 0.9) / 1e6, 2) AS loaded_p90
FROM locus_map GROUP BY cluster""",
)
def p7_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.round(F.get("quantiles", F.lit(i)) / 1e6, 2)
    return _clusters(spark, sf).select(
        "cluster", "n_rows", at(0).alias("loaded_p25"), at(1).alias("loaded_p50"), at(2).alias("loaded_p90")
    )
