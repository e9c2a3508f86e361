"""Queries of presence tables: genes are clusters, genomes those of the locus map."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.kernels import curves
from presencia.operators import presence as pr
from presencia.plans.registry import Registry
from presencia.session import materialise, table

R = Registry()

P = "p AS (SELECT DISTINCT cluster AS gene, genome_id AS genome FROM locus_map WHERE cluster IS NOT NULL AND genome_id IS NOT NULL)"
FREQ = P + ", f AS (SELECT gene, count(*) AS freq FROM p GROUP BY gene)"


def genes_by_genome(spark: SparkSession, sf: str) -> DataFrame:
    return pr.presence(table(spark, sf, "locus_map"), "cluster", "genome_id")


def _freq(spark: SparkSession, sf: str) -> DataFrame:
    return pr.gene_frequency(genes_by_genome(spark, sf))


@R.query("presence", f"WITH {P} SELECT * FROM p")
def presence(spark: SparkSession, sf: str) -> DataFrame:
    return genes_by_genome(spark, sf)


@R.query("presence_orders", "SELECT DISTINCT l_partkey::VARCHAR AS gene, l_suppkey::VARCHAR AS genome FROM lineitem")
def presence_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("gene"), F.col("l_suppkey").cast("string").alias("genome"))
    return pr.presence(rows)


@R.query("gene_frequency", f"WITH {FREQ} SELECT * FROM f")
def gene_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _freq(spark, sf)


@R.query(
    "frequency_histogram", f"WITH {FREQ} SELECT freq, count(*) AS n_genes, sum(count(*)) OVER (ORDER BY freq)::BIGINT AS cumulative FROM f GROUP BY freq"
)
def frequency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return pr.frequency_histogram(_freq(spark, sf))


@R.query(
    "segments",
    f"WITH {FREQ} SELECT CASE WHEN freq > floor(25.5) THEN 'core' WHEN freq < ceil(3.3) THEN 'rare' ELSE 'accessory' END AS segment, count(*) AS n_genes, sum(freq)::BIGINT AS n_cells FROM f GROUP BY 1",
)
def segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = pr.segments(_freq(spark, sf), core_min=25.5, unique_max=3.3)
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("freq").alias("n_cells"))


@R.query(
    "frequency_bands",
    f"""WITH {FREQ}, n AS (SELECT count(DISTINCT genome) AS n FROM p), b AS (SELECT * FROM (VALUES (0), (25), (50), (75), (100)) a(lo), (VALUES (0), (25), (50), (75), (100)) c(hi) WHERE lo < hi)
SELECT gene, freq, lo, hi FROM f, n, b WHERE freq * 100 > lo * n AND freq * 100 <= hi * n""",
)
def frequency_bands(spark: SparkSession, sf: str) -> DataFrame:
    p = genes_by_genome(spark, sf)
    n = p.select("genome").distinct().count()
    return pr.frequency_bands(pr.gene_frequency(p), n)


_COMPLETE = "c AS (SELECT DISTINCT genome_id AS genome FROM genome_summary WHERE genome_status = 'Complete')"


@R.query("complete_genomes_only", f"WITH {P}, {_COMPLETE} SELECT gene, count(*) AS freq FROM p SEMI JOIN c USING (genome) GROUP BY gene")
def complete_genomes_only(spark: SparkSession, sf: str) -> DataFrame:
    complete = table(spark, sf, "genome_summary").where("genome_status = 'Complete'").select(F.col("genome_id").alias("genome"))
    return pr.gene_frequency(pr.of_genomes(genes_by_genome(spark, sf), complete))


# alleles: a cluster and the residue of the row's number; the gene table is the clusters of the genomes in gene_id
_TABLES = """a AS (SELECT DISTINCT cluster || 'A' || (row_id % 5)::VARCHAR AS allele, genome_id AS genome FROM locus_map WHERE cluster IS NOT NULL AND genome_id IS NOT NULL),
g AS (SELECT DISTINCT cluster AS gene, regexp_replace(gene_id, '_[^_]*$', '') AS genome FROM locus_map WHERE cluster IS NOT NULL AND gene_id IS NOT NULL),
i AS (SELECT DISTINCT regexp_replace(allele, 'A[^A]*$', '') AS gene, genome FROM a),
d AS (SELECT genome, gene, 'gene table' AS side FROM (SELECT * FROM g EXCEPT SELECT * FROM i) UNION ALL SELECT genome, gene, 'alleles' FROM (SELECT * FROM i EXCEPT SELECT * FROM g))"""


def _inconsistent(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "locus_map").where("cluster is not null")
    alleles = rows.where("genome_id is not null").select(F.concat("cluster", F.lit("A"), (F.col("row_id") % 5).cast("string")).alias("allele"), F.col("genome_id").alias("genome"))
    genes = rows.where("gene_id is not null").select(F.col("cluster").alias("gene"), F.regexp_replace("gene_id", "_[^_]*$", "").alias("genome"))
    return pr.inconsistent(genes, alleles.distinct())


@R.query("inconsistent_tables", f"WITH {_TABLES} SELECT * FROM d")
def inconsistent_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _inconsistent(spark, sf)


@R.query("inconsistent_genes", f"WITH {_TABLES} SELECT gene, count(DISTINCT genome) AS n_genomes FROM d GROUP BY gene")
def inconsistent_genes(spark: SparkSession, sf: str) -> DataFrame:
    return pr.inconsistent_genes(_inconsistent(spark, sf))


def _by_source():
    from pyspark.sql.window import Window

    return Window.orderBy("source")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("source is not null")
    order = F.row_number().over(_by_source())
    sources = docs.select("source").distinct().select("source", order.alias("genome_ord"))  # a row per source
    return docs.join(F.broadcast(sources), "source").select(
        "genome_ord", F.col("doc_id").alias("ord"), F.col("source").alias("genome"), F.col("doc_id").cast("string").alias("header"), F.col("text").alias("seq")
    )


@R.query(
    "consolidated",
    """SELECT sha256(text) AS key, min_by(doc_id, (source, doc_id))::VARCHAR AS representative, count(*) AS n_headers, string_agg(doc_id::VARCHAR, ',' ORDER BY source, doc_id) AS headers,
  count(DISTINCT source) AS n_genomes FROM documents WHERE source IS NOT NULL AND text <> '' GROUP BY text""",
)
def consolidated(spark: SparkSession, sf: str) -> DataFrame:
    groups = pr.consolidated(_records(spark, sf))
    return groups.select("key", "representative", F.size("headers").cast("bigint").alias("n_headers"), F.array_join("headers", ",").alias("headers"), F.size("genomes").cast("bigint").alias("n_genomes"))


@R.query(
    "shared_headers",
    "SELECT min_by(doc_id, (source, doc_id))::VARCHAR AS representative, count(*) AS n FROM documents WHERE source IS NOT NULL AND text <> '' GROUP BY text HAVING count(*) > 1",
)
def shared_headers(spark: SparkSession, sf: str) -> DataFrame:
    return pr.shared_headers(pr.consolidated(_records(spark, sf))).select("representative", F.size("headers").cast("bigint").alias("n"))


@R.query("empty_sequences", "SELECT source AS genome, doc_id::VARCHAR AS header FROM documents WHERE source IS NOT NULL AND coalesce(text, '') = ''")
def empty_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return pr.empty_headers(_records(spark, sf))


@R.query(
    "numbered_variants",
    """WITH r AS (SELECT genome_id AS genome, row_id AS ord, sequence_id AS gene, product AS seq FROM annotations WHERE product <> '' AND genome_id IS NOT NULL AND sequence_id IS NOT NULL),
f AS (SELECT gene, seq, min((genome, ord)) AS seen FROM r GROUP BY gene, seq),
n AS (SELECT gene, seq, gene || 'U' || (row_number() OVER (PARTITION BY gene ORDER BY seen) - 1)::VARCHAR AS prox_id FROM f)
SELECT DISTINCT gene, seq, genome, prox_id FROM r JOIN n USING (gene, seq)""",
)
def numbered_variants(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "annotations").select(F.col("genome_id").alias("genome"), F.col("row_id").alias("ord"), F.col("sequence_id").alias("gene"), F.col("product").alias("seq"))
    return pr.numbered_variants(rows.where("genome is not null and gene is not null"), "U")


@R.query(
    "first_non_null",
    """SELECT locus_tag, min_by(product, row_id) FILTER (WHERE product IS NOT NULL) AS product, min_by(dbxrefs, row_id) FILTER (WHERE dbxrefs IS NOT NULL) AS dbxrefs
FROM annotations GROUP BY locus_tag""",
)
def first_non_null(spark: SparkSession, sf: str) -> DataFrame:
    return pr.first_non_null(table(spark, sf, "annotations"), "locus_tag", F.col("row_id"), ["product", "dbxrefs"])


_ANNOTATED = """r AS (SELECT m.cluster || 'A' || (m.row_id % 5)::VARCHAR AS allele, m.cluster AS gene, a.row_id AS ord, a.product AS annotation
  FROM locus_map m JOIN annotations a ON a.locus_tag = m.gene_id WHERE m.cluster IS NOT NULL AND a.product IS NOT NULL),
d AS (SELECT allele, gene, annotation, min(ord) AS ord FROM r GROUP BY ALL),
t AS (SELECT allele, gene, string_agg(annotation, '; ' ORDER BY ord, annotation) AS annotation, min(ord) AS ord FROM d GROUP BY allele, gene),
v AS (SELECT gene, annotation, count(*) AS n, min(ord) AS ord FROM t GROUP BY ALL),
w AS (SELECT gene, annotation FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, ord, annotation) AS k FROM v) WHERE k = 1)"""


def _annotations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    loci = table(spark, sf, "locus_map").where("cluster is not null").select(F.concat("cluster", F.lit("A"), (F.col("row_id") % 5).cast("string")).alias("allele"), F.col("gene_id").alias("locus_tag"))
    rows = table(spark, sf, "annotations").select("locus_tag", F.col("row_id").alias("ord"), F.col("product").alias("annotation"))
    return pr.collapsed_annotations(loci.join(rows, "locus_tag"))


@R.query("gene_annotations", f"WITH {_ANNOTATED} SELECT gene, annotation FROM w")
def gene_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return _annotations(spark, sf)[0]


@R.query("minority_annotations", f"WITH {_ANNOTATED} SELECT allele, t.annotation FROM t JOIN w USING (gene) WHERE t.annotation <> w.annotation")
def minority_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return _annotations(spark, sf)[1]


@R.query(
    "annotated_features",
    f"""WITH {_ANNOTATED}, m AS (SELECT allele AS feature, t.annotation FROM t JOIN w USING (gene) WHERE t.annotation <> w.annotation UNION ALL SELECT gene, annotation FROM w),
s AS (SELECT DISTINCT cluster || 'A' || (row_id % 5)::VARCHAR AS feature, cluster AS gene FROM locus_map WHERE cluster IS NOT NULL)
SELECT s.feature, coalesce(x.annotation, y.annotation) AS annotation FROM s LEFT JOIN m x ON x.feature = s.feature LEFT JOIN m y ON y.feature = s.gene""",
)
def annotated_features(spark: SparkSession, sf: str) -> DataFrame:
    genes, others = _annotations(spark, sf)
    known = genes.withColumnRenamed("gene", "feature").unionByName(others.withColumnRenamed("allele", "feature"))
    features = table(spark, sf, "locus_map").where("cluster is not null").select(F.concat("cluster", F.lit("A"), (F.col("row_id") % 5).cast("string")).alias("feature"))
    return pr.annotate(features.distinct(), known)


ITERATIONS = 20
_CURVE = f"""{P}, o AS (SELECT iter, genome, row_number() OVER (PARTITION BY iter ORDER BY md5(iter::VARCHAR || '-' || genome), genome) AS step
  FROM (SELECT DISTINCT genome FROM p), range(1, {ITERATIONS + 1}) r(iter)),
s AS (SELECT o.iter, o.step, q.gene, count(*) AS c FROM o JOIN (SELECT iter, step AS st, gene FROM p JOIN o USING (genome)) q ON q.iter = o.iter AND q.st <= o.step GROUP BY ALL)
SELECT iter::INT AS iter, step::BIGINT AS step, count(*) AS pan, count_if(c >= step * 0.987::DOUBLE)::BIGINT AS core, count_if(c > (step - 1) * 0.037::DOUBLE AND c < step * 0.987::DOUBLE)::BIGINT AS acc,
       count_if(c < (step - 1) * 0.037::DOUBLE)::BIGINT AS rare FROM s GROUP BY iter, step"""


@R.query("pan_core_curve", "WITH " + _CURVE)
def pan_core_curve(spark: SparkSession, sf: str) -> DataFrame:
    return pr.pan_core_curve(genes_by_genome(spark, sf), ITERATIONS)


@R.query("heaps_fit")
def heaps_fit(spark: SparkSession, sf: str) -> DataFrame:
    """lambda and kappa of each curve of each iteration."""
    curve = pr.pan_core_curve(genes_by_genome(spark, sf), ITERATIONS)
    long = curve.unpivot(["iter", "step"], ["pan", "core", "acc", "rare"], "section", "size")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        lam, kappa = curves.heaps(rows["size"].to_numpy(float))
        return pd.DataFrame({"iter": [rows["iter"].iloc[0]], "section": [rows["section"].iloc[0]], "lambda_": [lam], "kappa": [kappa]})

    return long.groupBy("iter", "section").applyInPandas(fit, "iter int, section string, lambda_ double, kappa double")


@R.query("segment_fit")
def segment_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The dual power-law fit of the frequencies, its inflection point and segments."""
    hist = pr.frequency_histogram(_freq(spark, sf)).orderBy("freq").toPandas()  # at most as many rows as genomes
    fit = curves.dual_power(hist["freq"].to_numpy(), hist["cumulative"].to_numpy())
    return spark.createDataFrame(pd.DataFrame([fit]))


@R.query("wide_by_load", "SELECT cluster AS gene, " + ", ".join(f"count_if(load_no = {i} AND genome_id IS NOT NULL) > 0 AS l{i}" for i in range(1, 11)) + " FROM locus_map WHERE cluster IS NOT NULL GROUP BY cluster HAVING count(genome_id) > 0")
def wide_by_load(spark: SparkSession, sf: str) -> DataFrame:
    """The export form: genes by loads as columns."""
    rows = table(spark, sf, "locus_map").where("cluster is not null and genome_id is not null").select(F.col("cluster").alias("gene"), F.concat(F.lit("l"), F.col("load_no").cast("string")).alias("genome"))
    wide = pr.wide(rows.distinct(), [f"l{i}" for i in range(1, 11)])
    return wide.select("gene", *[(F.col(f"l{i}") > 0).alias(f"l{i}") for i in range(1, 11)])


@R.query("validated_binary", f"WITH {P} SELECT genome, count(*) AS n, count(*) AS s FROM p GROUP BY genome")
def validated_binary(spark: SparkSession, sf: str) -> DataFrame:
    cells = pr.validated_binary(genes_by_genome(spark, sf).withColumn("v", F.lit(1)), "v")
    return materialise(cells, "cells").groupBy("genome").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
