"""Queries of file formats: text made from tables, and read back by the parsers that files go through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.functions import names
from presencia.operators import consensus
from presencia.operators import presence as pr
from presencia.sources import sequences as sq
from presencia.sources import tables as tb
from presencia.plans.registry import Registry
from presencia.session import table

R = Registry()

_SEQ = "translate(md5({x}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _seq(x: F.Column) -> F.Column:
    return F.translate(F.md5(x), "0123456789abcdef", "ACGTACGTACGTACGT")


@R.query(
    "fasta_records",
    f"SELECT (row_id // 100)::VARCHAR AS path, locus_tag AS header, {_SEQ.format(x='locus_tag')} AS seq, (row_number() OVER (PARTITION BY row_id // 100 ORDER BY row_id) - 1)::INT AS ord FROM annotations WHERE locus_tag IS NOT NULL",
)
def fasta_records(spark: SparkSession, sf: str) -> DataFrame:
    """FASTA text of a hundred records each, sequences wrapped and headers with descriptions."""
    rows = table(spark, sf, "annotations").where("locus_tag is not null").select("row_id", F.floor(F.col("row_id") / 100).cast("string").alias("path"), "locus_tag")
    text = F.concat(F.lit(">"), "locus_tag", F.lit(" a > b\n"), names.wrapped(_seq(F.col("locus_tag")), 20), F.lit("\n"))
    files = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", text.alias("t")))), lambda s: s["t"]), "").alias("value"))
    return sq.fasta_records(files).withColumn("header", names.short_header(F.col("header")))


def _members_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "locus_map").where("cluster is not null and gene_id is not null").withColumn("c", F.floor(F.col("row_id") / 50).cast("int"))
    m = F.col("row_id") % 50
    line = F.concat(m.cast("string"), F.lit("\t"), F.length("gene_id").cast("string"), F.lit("aa, >"), "gene_id", F.lit("... "), F.when(m == 0, "*").otherwise(F.concat(F.lit("at "), (m + 50).cast("string"), F.lit(".25%"))))
    texts = rows.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", line.alias("t")))), lambda s: s["t"]), "\n").alias("t"))
    return texts.select(F.concat(F.lit(">Cluster "), F.col("c").cast("string"), F.lit("\n"), "t", F.lit("\n")).alias("value"))


@R.query(
    "clstr_members",
    """SELECT (row_id // 50)::INT AS cluster, (row_id % 50)::INT AS member, length(gene_id)::INT AS len, gene_id AS header, row_id % 50 = 0 AS is_rep, CASE WHEN row_id % 50 > 0 THEN row_id % 50 + 50.25 END::DOUBLE AS pct
FROM locus_map WHERE cluster IS NOT NULL AND gene_id IS NOT NULL""",
)
def clstr_members(spark: SparkSession, sf: str) -> DataFrame:
    return sq.clstr_members(_members_text(spark, sf))


@R.query(
    "header_alleles",
    """SELECT gene_id AS header, 'X_C' || (row_id // 50) || 'A' || (row_id % 50) AS allele FROM locus_map WHERE cluster IS NOT NULL AND gene_id IS NOT NULL""",
)
def header_alleles(spark: SparkSession, sf: str) -> DataFrame:
    return pr.header_alleles(sq.clstr_members(_members_text(spark, sf)), None, "X")


@R.query(
    "sample_presence",
    """WITH m AS (SELECT row_id // 50 AS n, gene_id FROM locus_map WHERE cluster IS NOT NULL AND gene_id IS NOT NULL), s AS (SELECT min(genome_id) AS s FROM locus_map)
SELECT 'X_C' || n AS cluster, bool_or(regexp_replace(gene_id, '_[^_]*$', '') = s) AS present FROM m, s GROUP BY n HAVING NOT bool_and(regexp_replace(gene_id, '_[^_]*$', '') = s)""",
)
def sample_presence(spark: SparkSession, sf: str) -> DataFrame:
    sample = table(spark, sf, "locus_map").agg(F.min("genome_id").alias("s")).first()["s"]
    members = sq.clstr_members(_members_text(spark, sf))
    own = names.genome_of_locus(F.col("header")) == sample
    named = members.withColumn("header", F.when(own, F.col("header")).otherwise(F.concat(F.lit("X_C"), F.col("cluster").cast("string"), F.lit("A"), F.col("member").cast("string"))))
    return sq.sample_presence(named, sample)


# --- features on contigs ----------------------------------------------------------

_GFF = f"""g AS (SELECT genome_id AS genome, sequence_id AS contig, row_id AS ord, CASE WHEN row_id % 5 = 0 THEN 'tRNA' ELSE 'CDS' END AS type, start_pos % 900 AS start, start_pos % 900 + 60 AS stop, strand, locus_tag AS id
  FROM annotations WHERE genome_id IS NOT NULL AND sequence_id IS NOT NULL AND locus_tag IS NOT NULL AND strand IS NOT NULL AND start_pos IS NOT NULL),
s AS (SELECT DISTINCT genome, contig, repeat({_SEQ.format(x="genome || contig")}, 30) AS seq FROM g)"""
_RC = "reverse(translate({x}, 'ACGT', 'TGCA'))"


def _gff(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "annotations").where("genome_id is not null and sequence_id is not null and locus_tag is not null and strand is not null and start_pos is not null")
    raw = rows.select(
        F.concat(F.lit("accn|"), "sequence_id").alias("accession"), F.when(F.col("row_id") % 5 == 0, "tRNA").otherwise("CDS").alias("type"), (F.col("start_pos") % 900 + 1).alias("start"),
        (F.col("start_pos") % 900 + 60).alias("stop"), "strand", F.concat(F.lit("ID="), "locus_tag", F.lit(";locus_tag="), "locus_tag").alias("attrs"), F.col("genome_id").alias("genome"), F.col("row_id").alias("ord"),
    )
    return sq.gff_rows(raw)


def _contigs(gff: DataFrame) -> DataFrame:
    return gff.select("genome", "contig").distinct().withColumn("seq", F.repeat(_seq(F.concat("genome", "contig")), 30))


@R.query("gff_features", f"WITH {_GFF} SELECT 'accn|' || contig AS accession, start + 1 AS start, stop AS \"end\", id AS locus_tag FROM g WHERE type = 'tRNA'")
def gff_features(spark: SparkSession, sf: str) -> DataFrame:
    return sq.features_table(_gff(spark, sf), ["tRNA"])


@R.query(
    "gff_unique_features",
    f"WITH {_GFF} SELECT locus_tag, arg_min(accession, k) AS accession, arg_min(start, k) AS start, arg_min(\"end\", k) AS \"end\" FROM (SELECT 'accn|' || contig AS accession, start + 1 AS start, stop AS \"end\", id AS locus_tag, (start, stop, contig) AS k FROM g WHERE type = 'CDS') GROUP BY locus_tag",
)
def gff_unique_features(spark: SparkSession, sf: str) -> DataFrame:
    return sq.features_table(_gff(spark, sf), ["CDS"], unique=True)


@R.query(
    "sliced_features",
    f"""WITH {_GFF}, c AS (SELECT genome, contig, id, strand, substring(seq, greatest(start - 5, 0) + 1, stop + 7 - greatest(start - 5, 0)) AS x FROM g JOIN s USING (genome, contig) WHERE type = 'tRNA')
SELECT genome, contig, id, CASE WHEN strand = '-' THEN {_RC.format(x="x")} ELSE x END AS seq FROM c""",
)
def sliced_features(spark: SparkSession, sf: str) -> DataFrame:
    gff = _gff(spark, sf)
    return sq.sliced(gff, _contigs(gff), ["tRNA"], flanking=(5, 7))


@R.query(
    "cds_neighbours",
    f"WITH {_GFF} SELECT ord, lag(stop) OVER w AS before, lead(start) OVER w AS after FROM g WHERE type = 'CDS' WINDOW w AS (PARTITION BY genome, contig, strand ORDER BY ord)",
)
def cds_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return sq.neighbours(_gff(spark, sf)).select("ord", "before", "after")


_PROX = """, w AS (SELECT genome, ord, id, strand, seq, {lo} AS lo, {hi} AS hi FROM {g} JOIN s USING (genome, contig)),
x AS (SELECT *, substring(seq, greatest(lo, 0) + 1, greatest(hi - greatest(lo, 0), 0)) AS part FROM w WHERE lo >= 0 AND hi <= length(seq))
SELECT ord, id || '{suffix}' AS name, CASE WHEN strand = '-' THEN reverse(translate(part, 'ACGT', 'TGCA')) ELSE part END AS seq FROM x WHERE length(part) > {coding}"""


@R.query(
    "upstream_sequences",
    f"WITH {_GFF}" + _PROX.format(lo="CASE WHEN strand = '-' THEN stop - 3 ELSE start - 50 END", hi="CASE WHEN strand = '-' THEN stop + 50 ELSE start + 3 END", g="g", suffix="_upstream(-50,3)", coding=3),
)
def upstream_sequences(spark: SparkSession, sf: str) -> DataFrame:
    gff = _gff(spark, sf)
    return sq.proximal(gff, _contigs(gff), "upstream", (-50, 3)).select("ord", "name", "seq")


@R.query(
    "downstream_sequences",
    f"WITH {_GFF}, n AS (SELECT *, lag(stop) OVER w AS before, lead(start) OVER w AS after FROM g WHERE type = 'CDS' WINDOW w AS (PARTITION BY genome, contig, strand ORDER BY ord))"
    + _PROX.format(
        lo="greatest(CASE WHEN strand = '-' THEN start - 50 ELSE stop - 3 END, coalesce(before - 10, -100000))", hi="least(CASE WHEN strand = '-' THEN start + 3 ELSE stop + 50 END, coalesce(after + 10, 100000))",
        g="n", suffix="_downstream(-3,50,10)", coding=3,
    ),
)
def downstream_sequences(spark: SparkSession, sf: str) -> DataFrame:
    gff = _gff(spark, sf)
    return sq.proximal(gff, _contigs(gff), "downstream", (-3, 50), max_overlap=10).select("ord", "name", "seq")


@R.query(
    "start_codons",
    f"WITH {_GFF}, u AS (" + ("SELECT * FROM (WITH q AS (SELECT 1) " + _PROX.format(lo="CASE WHEN strand = '-' THEN stop - 3 ELSE start - 50 END", hi="CASE WHEN strand = '-' THEN stop + 50 ELSE start + 3 END", g="g", suffix="", coding=3) + ")") + ") SELECT substring(seq, 51, 3) AS codon, count(*) AS n FROM u GROUP BY 1",
)
def start_codons(spark: SparkSession, sf: str) -> DataFrame:
    return sq.codon_counts(upstream_sequences(spark, sf), "upstream", 50)


# --- tables of other tools --------------------------------------------------------


@R.query(
    "best_hits",
    "SELECT * EXCLUDE (r) FROM (SELECT l_partkey::VARCHAR AS query, l_suppkey::VARCHAR AS target, l_quantity AS identity, l_extendedprice AS e_val, l_discount AS bitscore, "
    "row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_discount DESC, l_suppkey::VARCHAR, l_quantity) AS r FROM lineitem WHERE l_quantity > 5 AND l_extendedprice < 50000) WHERE r = 1",
)
def best_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("query"), F.col("l_suppkey").cast("string").alias("target"), F.col("l_quantity").alias("identity"), F.col("l_extendedprice").alias("e_val"), F.col("l_discount").alias("bitscore")
    )
    return tb.blast_hits(rows, e_val=50000, identity=5)


@R.query(
    "mash_rows",
    "SELECT regexp_replace(regexp_extract('/a/' || genome_id || '.fna', '([^/]*)$', 1), '(.)[.][^.]*$', '\\1') AS genome1, taxon_id AS genome2, (contigs)::INT AS shared, 1000 AS sketch FROM genome_summary WHERE genome_id IS NOT NULL",
)
def mash_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "genome_summary").where("genome_id is not null").select(
        F.concat(F.lit("/a/"), "genome_id", F.lit(".fna")).alias("genome1"), F.concat("taxon_id", F.lit(".fna")).alias("genome2"), F.concat(F.coalesce(F.col("contigs").cast("string"), F.lit("")), F.lit("/1000")).alias("matching_hashes")
    )
    return tb.mash_rows(rows).select("genome1", "genome2", "shared", "sketch")


@R.query(
    "sequence_types",
    "SELECT row_id, CASE WHEN genome_status = 'Plasmid' THEN -1 ELSE contigs END::INT AS mlst FROM genome_summary",
)
def sequence_types(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("genome_status") == "Plasmid", "-").otherwise(F.col("contigs").cast("string"))
    return table(spark, sf, "genome_summary").select("row_id", tb.sequence_type(text).alias("mlst"))


@R.query(
    "near_references",
    """WITH d AS (SELECT c_nationkey::VARCHAR AS a, s_nationkey::VARCHAR AS b, round(avg(l_quantity), 6) AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
e AS (SELECT a, b, x FROM d UNION SELECT b, a, x FROM d), r AS (SELECT * FROM e WHERE a IN ('3', '7')), c AS (SELECT avg(q) AS c FROM (SELECT quantile_cont(x, 0.2) AS q FROM r GROUP BY a)),
k AS (SELECT b AS g FROM r, c GROUP BY b, c HAVING min(x) < c)
SELECT a, b, x FROM d WHERE a IN (SELECT g FROM k) AND b IN (SELECT g FROM k)""",
)
def near_references(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by their mean traded quantity, as distances."""
    names_ = ("lineitem", "orders", "customer", "supplier")
    line, orders, customer, supplier = (table(spark, sf, t) for t in names_)
    rows = line.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    pairs = rows.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("string").alias("a"), F.col("s_nationkey").cast("string").alias("b")).agg(F.round(F.avg("l_quantity"), 6).alias("x"))
    return consensus.near_references(pairs, "a", "b", "x", ["3", "7"], 0.2).select("a", "b", "x")


@R.query(
    "pivoted_distances",
    "SELECT genome_id AS genome, "
    + ", ".join(f"first(contigs) FILTER (WHERE load_no = {i} AND feed LIKE '%_a' AND k = 1) AS s{i}" for i in (1, 2, 3))
    + " FROM (SELECT *, row_number() OVER (PARTITION BY genome_id, load_no, feed ORDER BY row_id) AS k FROM genome_summary) WHERE genome_id IS NOT NULL GROUP BY genome_id",
)
def pivoted_distances(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "genome_summary").where("genome_id is not null")
    one = rows.where("feed like '%_a' and load_no <= 3").groupBy("genome_id", "load_no").agg(F.min_by("contigs", "row_id").alias("distance"))
    pairs = one.select(F.col("genome_id").alias("genome"), F.concat(F.lit("s"), F.col("load_no").cast("string")).alias("sample"), "distance")
    return tb.pivoted_distances(pairs, rows.select(F.col("genome_id").alias("genome")), ["s1", "s2", "s3"])


@R.query(
    "locus_clusters",
    "SELECT DISTINCT cluster, gene_id FROM locus_map WHERE cluster IS NOT NULL AND gene_id IS NOT NULL",
)
def locus_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "locus_map").where("cluster is not null and gene_id is not null")
    return tb.locus_clusters(rows.select(F.concat("cluster", F.lit("A1")).alias("allele"), F.col("gene_id").alias("header")))
