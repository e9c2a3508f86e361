"""Queries of whole builds: pangenomes from sequences and clusters, and files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.operators import build, enrich
from presencia.operators import presence as pr
from presencia.plans import source_queries as src
from presencia.plans.registry import Registry
from presencia.session import materialise, shared_dir, table
from presencia.sources import sketches
from presencia.sources import tables as tb

R = Registry()

# --- proteins and their clusters --------------------------------------------------

# a record per locus, its sequence by its product, so that genomes share sequences; a seventh of the representatives is in no cluster
_SEQS = f"""a AS (SELECT genome_id AS genome, locus_tag AS header, min(row_id) AS ord, arg_min(coalesce(product, ''), row_id) AS product FROM annotations
  WHERE genome_id IS NOT NULL AND locus_tag IS NOT NULL GROUP BY ALL),
s AS (SELECT genome, header, ord, CASE WHEN product = '' THEN '' ELSE {src._SEQ.format(x="product")} END AS seq FROM a),
r AS (SELECT seq, arg_min(header, (genome, ord)) AS rep, arg_min(ord, (genome, ord)) AS o FROM s WHERE seq <> '' GROUP BY seq),
h AS (SELECT header, genome, seq, CASE WHEN o % 7 > 0 THEN 'X_C' || (o // 10) || 'A' || (o % 10) END AS allele FROM s JOIN r USING (seq))"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "annotations").where("genome_id is not null and locus_tag is not null")
    first = rows.groupBy(F.col("genome_id").alias("genome"), F.col("locus_tag").alias("header")).agg(
        F.min("row_id").alias("ord"), F.min_by(F.coalesce("product", F.lit("")), "row_id").alias("product")
    )
    return first.withColumn("seq", F.when(F.col("product") == "", "").otherwise(src._seq(F.col("product")))).drop("product")


def _built(spark: SparkSession, sf: str) -> build.Pangenome:
    seqs = build.by_name(materialise(_records(spark, sf), "records"))
    reps = build.representatives(seqs).join(seqs.select("header", "ord"), "header")
    clusters = reps.where("ord % 7 > 0").select(F.expr("cast(ord div 10 as int)").alias("cluster"), (F.col("ord") % 10).cast("int").alias("member"), "header")
    return build.pangenome(seqs, clusters, "X")


@R.query("built_headers", f"WITH {_SEQS} SELECT DISTINCT header, allele FROM h WHERE allele IS NOT NULL")
def built_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Alleles of all headers, synonyms by their representatives."""
    return _built(spark, sf).headers


@R.query("built_alleles", f"WITH {_SEQS} SELECT DISTINCT allele, genome FROM h WHERE allele IS NOT NULL")
def built_alleles(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).alleles


@R.query("built_genes", f"WITH {_SEQS} SELECT DISTINCT regexp_replace(allele, 'A[^A]*$', '') AS gene, genome FROM h WHERE allele IS NOT NULL")
def built_genes(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).genes


@R.query("built_unnamed", f"WITH {_SEQS} SELECT genome, header FROM h WHERE allele IS NULL")
def built_unnamed(spark: SparkSession, sf: str) -> DataFrame:
    """The audit of the look-up: headers in no cluster."""
    return _built(spark, sf).unnamed


@R.query("built_sequences", f"WITH {_SEQS} SELECT DISTINCT allele, seq FROM h WHERE allele IS NOT NULL")
def built_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).sequences.select("allele", "seq")


@R.query(
    "built_against_sequences",
    f"WITH {_SEQS}, t AS (SELECT DISTINCT allele AS feature, genome FROM h WHERE allele IS NOT NULL AND abs(length(genome || allele)) % 9 > 0), e AS (SELECT DISTINCT genome, allele AS feature FROM h) "
    "SELECT genome, feature, 'sequences' AS side FROM e ANTI JOIN t ON e.genome = t.genome AND e.feature IS NOT DISTINCT FROM t.feature",
)
def built_against_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """A table that lacks some cells, checked against the genomes' sequences."""
    made = _built(spark, sf)
    lacking = made.alleles.where(F.length(F.concat("genome", "allele")) % 9 > 0).select(F.col("allele").alias("feature"), "genome")
    features = made.sequences.select(F.col("allele").alias("feature"), "seq")
    return pr.against_sequences(lacking, _records(spark, sf), features)


# --- features cut out of contigs --------------------------------------------------


def _cut_sql(where: str, lo: int, hi: int, letter: str) -> str:
    return f"""{src._GFF}, c AS (SELECT genome, ord, id, strand, substring(seq, greatest(start - {lo}, 0) + 1, stop + {hi} - greatest(start - {lo}, 0)) AS x FROM g JOIN s USING (genome, contig) WHERE {where}),
k AS (SELECT genome, ord, id, CASE WHEN strand = '-' THEN {src._RC.format(x="x")} ELSE x END AS seq FROM c),
r AS (SELECT seq, arg_min(ord, (genome, ord)) AS o FROM k GROUP BY seq),
b AS (SELECT DISTINCT 'N_{letter}' || (o // 10) || 'A' || (o % 10) AS allele, genome FROM k JOIN r USING (seq))"""


def _cut(spark: SparkSession, sf: str, types: list[str], flanking: tuple[int, int], kind: str) -> build.Pangenome:
    gff = src._gff(spark, sf)
    seqs = build.by_name(materialise(build.cut_sequences(gff, src._contigs(gff), types, flanking), "cut"))
    reps = build.representatives(seqs).join(seqs.groupBy("header").agg(F.min("ord").alias("ord")), "header")
    clusters = reps.select(F.expr("cast(ord div 10 as int)").alias("cluster"), (F.col("ord") % 10).cast("int").alias("member"), "header")
    return build.pangenome(seqs, clusters, "N", kind)


@R.query("built_noncoding", f"WITH {_cut_sql('type = ' + chr(39) + 'tRNA' + chr(39), 5, 7, 'T')} SELECT count(DISTINCT genome) AS n_genomes, count(DISTINCT genome || '/' || allele) > 0 AS filled FROM b")
def built_noncoding(spark: SparkSession, sf: str) -> DataFrame:
    """Non-coding features with flanks: all genomes that have some come out."""
    made = _cut(spark, sf, ["tRNA"], (5, 7), "T").alleles
    return made.agg(F.countDistinct("genome").alias("n_genomes"), (F.count(F.lit(1)) > 0).alias("filled"))


@R.query("built_coding", f"WITH {_cut_sql('type = ' + chr(39) + 'CDS' + chr(39), 0, 0, 'C')} SELECT count(DISTINCT genome) AS n_genomes, count(DISTINCT genome || '/' || allele) > 0 AS filled FROM b")
def built_coding(spark: SparkSession, sf: str) -> DataFrame:
    """Nucleotides of coding features: all genomes that have some come out."""
    made = _cut(spark, sf, ["CDS"], (0, 0), "C").alleles
    return made.agg(F.countDistinct("genome").alias("n_genomes"), (F.count(F.lit(1)) > 0).alias("filled"))


@R.query(
    "built_proximal",
    f"WITH {src._GFF}"
    + src._PROX.format(lo="CASE WHEN strand = '-' THEN stop - 3 ELSE start - 50 END", hi="CASE WHEN strand = '-' THEN stop + 50 ELSE start + 3 END", g="g", suffix="", coding=3).replace("SELECT ord, id ||", ", u AS (SELECT genome, ord, id ||", 1)
    + """), m AS (SELECT gene_id, min(cluster) AS gene FROM locus_map WHERE cluster IS NOT NULL AND gene_id IS NOT NULL GROUP BY gene_id),
y AS (SELECT genome, ord, gene, seq FROM u JOIN m ON gene_id = name), f AS (SELECT gene, seq, min((genome, ord)) AS first_at FROM y GROUP BY ALL),
n AS (SELECT gene, seq, gene || 'U' || (row_number() OVER (PARTITION BY gene ORDER BY first_at) - 1) AS prox_id FROM f)
SELECT DISTINCT gene, md5(seq) AS seq, genome, prox_id FROM y JOIN n USING (gene, seq)""",
)
def built_proximal(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences upstream of genes, numbered within the gene."""
    gff = src._gff(spark, sf)
    genes = table(spark, sf, "locus_map").where("cluster is not null and gene_id is not null").groupBy(F.col("gene_id").alias("header")).agg(F.concat(F.min("cluster"), F.lit("A0")).alias("allele"))
    return build.proximal_variants(gff, src._contigs(gff), genes, "upstream").withColumn("seq", F.md5("seq"))


# --- files written and read back --------------------------------------------------


def _file(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = f"{shared_dir(spark)}/presencia/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    lines.write.text(path)
    return path


@R.query(
    "read_best_hits",
    """WITH h AS (SELECT locus_tag AS query, genome_id AS target, (row_id % 60 + 40)::DOUBLE AS identity, (row_id % 13)::DOUBLE AS e_val, (row_id % 101)::DOUBLE AS bitscore FROM annotations WHERE locus_tag IS NOT NULL AND genome_id IS NOT NULL)
SELECT query, target, e_val, bitscore FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY e_val, bitscore DESC, target) AS k FROM h WHERE identity > 50 AND e_val < 10) WHERE k = 1""",
)
def read_best_hits(spark: SparkSession, sf: str) -> DataFrame:
    """A tabular hit file of twelve columns, read, filtered and reduced to best hits."""
    rows = table(spark, sf, "annotations").where("locus_tag is not null and genome_id is not null")
    i = F.col("row_id")
    cells = ["locus_tag", "genome_id", i % 60 + 40, *[F.lit(1)] * 7, i % 13, i % 101]
    path = _file(spark, rows.select(F.concat_ws("\t", *[F.col(c) if isinstance(c, str) else c.cast("string") for c in cells])), "hits")
    return tb.blast_hits(tb.read_blast(spark, path), identity=50).select("query", "target", "e_val", "bitscore")


@R.query("read_allele_names", "SELECT DISTINCT cluster || 'A' || (row_id % 3) AS allele, gene_id AS header FROM locus_map WHERE cluster IS NOT NULL AND gene_id IS NOT NULL")
def read_allele_names(spark: SparkSession, sf: str) -> DataFrame:
    """A ragged file of alleles and their headers."""
    rows = table(spark, sf, "locus_map").where("cluster is not null and gene_id is not null").select(F.concat("cluster", F.lit("A"), (F.col("row_id") % 3).cast("string")).alias("allele"), "gene_id").distinct()
    lines = rows.groupBy("allele").agg(F.array_join(F.array_sort(F.collect_list("gene_id")), "\t").alias("h"))
    return tb.read_allele_names(spark, _file(spark, lines.select(F.concat_ws("\t", "allele", "h")), "alleles"))


@R.query("feature_alleles", "SELECT gene_id AS header, max(cluster || 'A' || (row_id % 3)) AS allele FROM locus_map WHERE cluster IS NOT NULL AND gene_id IS NOT NULL GROUP BY gene_id")
def feature_alleles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "locus_map").where("cluster is not null and gene_id is not null")
    return tb.feature_alleles(rows.select(F.concat("cluster", F.lit("A"), (F.col("row_id") % 3).cast("string")).alias("allele"), F.col("gene_id").alias("header")))


@R.query("read_features", "SELECT DISTINCT cluster AS gene, 't' || split_part(genome_id, '.', 1) AS genome FROM locus_map WHERE cluster IS NOT NULL AND genome_id IS NOT NULL")
def read_features(spark: SparkSession, sf: str) -> DataFrame:
    """A wide table of clusters by taxa, written as text and read into long form."""
    long = table(spark, sf, "locus_map").where("cluster is not null and genome_id is not null")
    taxa = long.withColumn("taxon", F.concat(F.lit("t"), F.substring_index("genome_id", ".", 1)))
    wide = taxa.groupBy("cluster").pivot("taxon").agg(F.max(F.lit(1)))
    path = f"{shared_dir(spark)}/presencia/{spark.sparkContext.applicationId}/features-{uuid.uuid4().hex[:12]}.csv"
    wide.write.csv(path, header=True)
    return tb.read_features(spark, path)


# --- names of functions, look-ups -------------------------------------------------

_TERMS = "SELECT DISTINCT unnest(regexp_extract_all(go, 'GO:[0-9]+')) AS function FROM cluster_to_go_functions WHERE go IS NOT NULL"


@R.query("named_functions", f"WITH t AS ({_TERMS}) SELECT function, CASE WHEN right(function, 1) <> '3' THEN 'name of ' || function ELSE function END AS name FROM t")
def named_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Terms named by an ontology file; a term that is not in it goes by itself."""
    terms = table(spark, sf, "cluster_to_go_functions").select(F.explode(F.regexp_extract_all("go", F.lit("GO:[0-9]+"), F.lit(0))).alias("function")).distinct()
    block = F.concat(F.lit("[Term]\nid: "), "function", F.lit("\nname: name of "), "function", F.lit("\nis_a: x ! y\n"))
    listed = terms.where("not endswith(function, '3')").select(block.alias("value"))
    names = tb.read_terms(spark, _file(spark, listed, "terms"))
    return enrich.named_functions(terms, names)


@R.query(
    "function_pivot",
    f"""WITH t AS ({_TERMS}), x AS (SELECT cluster, unnest(regexp_extract_all(go, 'GO:[0-9]+')) AS function, length(go)::DOUBLE AS p_value FROM cluster_to_go_functions WHERE cluster IS NOT NULL AND go IS NOT NULL),
f AS (SELECT function, row_number() OVER (ORDER BY function) AS k FROM t), y AS (SELECT right(cluster, 1) AS component, k, p_value FROM x JOIN f USING (function))
SELECT component, avg(p_value) FILTER (k = 1) AS f1, avg(p_value) FILTER (k = 2) AS f2, avg(p_value) FILTER (k = 3) AS f3 FROM y GROUP BY component""",
)
def function_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "cluster_to_go_functions").where("cluster is not null and go is not null")
    found = rows.select(F.right("cluster", F.lit(1)).alias("component"), F.explode(F.regexp_extract_all("go", F.lit("GO:[0-9]+"), F.lit(0))).alias("function"), F.length("go").cast("double").alias("p_value"))
    chosen = [r["function"] for r in found.select("function").union(rows.limit(0).select("go")).distinct().orderBy("function").limit(3).collect()]
    return enrich.component_by_function(found, chosen).withColumnsRenamed({f: f"f{i}" for i, f in enumerate(chosen, 1)})


@R.query("genomes_by_ids", "WITH i AS (SELECT genome_id, (row_number() OVER (ORDER BY reverse(genome_id)) - 1)::INT AS ord FROM (SELECT DISTINCT genome_id FROM genome_summary WHERE genome_id IS NOT NULL ORDER BY genome_id LIMIT 50)) SELECT row_id, genome_id, ord FROM genome_summary JOIN i USING (genome_id)")
def genomes_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue's rows of a list of ids, in the list's order; a miss raises."""
    rows = table(spark, sf, "genome_summary").select("row_id", "genome_id")
    ids = [r["genome_id"] for r in rows.where("genome_id is not null").select("genome_id").distinct().orderBy("genome_id").limit(50).collect()]
    return tb.by_ids(rows, "genome_id", sorted(ids, key=lambda x: x[::-1]))


@R.query("metadata_clusters", "WITH c AS (SELECT DISTINCT genome_id AS genome FROM locus_map WHERE genome_id IS NOT NULL) SELECT row_id, replace(replace(genome_name, 'sp. ', ''), 'str. ', '') AS genome_name, CASE WHEN genome IS NOT NULL THEN length(genome)::INT END AS cluster FROM genome_summary LEFT JOIN c ON genome = genome_id")
def metadata_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue with clusters attached, and plain texts taken out of names."""
    clusters = table(spark, sf, "locus_map").where("genome_id is not null").select(F.col("genome_id").alias("genome")).distinct().withColumn("cluster", F.length("genome"))
    rows = tb.without_text(table(spark, sf, "genome_summary").select("row_id", "genome_id", "genome_name"), "genome_name", ["sp. ", "str. "])
    return tb.with_clusters(rows, "genome_id", clusters).drop("genome_id")


@R.query(
    "sketched_distances",
    f"WITH {src._GFF}, d AS (SELECT DISTINCT genome FROM s) SELECT (SELECT count(*) FROM d) AS n_genomes, true AS symmetric_sketches, true AS within_bounds",
)
def sketched_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of all genomes' contigs and the distances of those that share a hash."""
    made = materialise(sketches.sketches(src._contigs(src._gff(spark, sf)), k=21, size=200), "sketches")
    within = F.expr("distance between 0 and 1 and genome1 < genome2")
    found = sketches.distances(made).agg(F.bool_and(F.col("shared") <= F.col("sketch")).alias("a"), F.bool_and(within).alias("b")).first()
    told = {"symmetric_sketches": F.lit(found["a"] is not False), "within_bounds": F.lit(found["b"] is not False)}
    return made.agg(F.count(F.lit(1)).alias("n_genomes")).withColumns(told)
