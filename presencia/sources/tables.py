"""Delimited tables of the tools around a pangenome, read with explicit schemas, and columnar sinks."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.functions import names

MASH_SCHEMA = "genome1 string, genome2 string, mash_distance double, p_value double, matching_hashes string"
MLST_SCHEMA = "path string, schema string, mlst string, " + ", ".join(f"allele{i} string" for i in range(1, 8))
BLAST_SCHEMA = (
    "query string, target string, identity double, len int, mismatch int, gapopen int, qstart int, qend int, tstart int, tend int, e_val double, bitscore double"
)
CATALOGUE_TEXTS = ("genome_id", "genome_name", "genome_status", "taxon_id")


def read_mash(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distances with genomes by the base names of their files."""
    return mash_rows(spark.read.csv(path, sep="\t", schema=MASH_SCHEMA))


def mash_rows(df: DataFrame) -> DataFrame:
    """Genome ids for paths, and the shared hashes as two numbers."""
    part = lambda i: F.split_part("matching_hashes", F.lit("/"), F.lit(i)).try_cast("int")
    out = df.withColumns({c: names.genome_of_path(F.col(c)) for c in ("genome1", "genome2")})
    return out.withColumns({"shared": part(1), "sketch": part(2)}).drop("matching_hashes")


def read_mlst(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sequence types with the genome from each report's path."""
    rows = spark.read.csv(path, sep="\t", schema=MLST_SCHEMA)
    return rows.withColumn("genome_id", names.genome_of_path(F.col("path"))).drop("path")


def sequence_type(mlst: Column) -> Column:
    """A sequence type as a number; no match is -1."""
    return F.when(mlst == "-", F.lit(-1)).otherwise(mlst.try_cast("int"))


def read_blast(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tabular hits of twelve columns."""
    return spark.read.csv(path, sep="\t", schema=BLAST_SCHEMA)


def blast_hits(hits: DataFrame, e_val: float = 10, identity: float = 0, unique: bool = True) -> DataFrame:
    """Hits strictly above an identity and below an e-value; with ``unique`` the best one of each query.

    Best is by e-value, then higher bit score, then target: an aggregation with map-side combining, so a query with many
    hits needs no sort.
    """
    kept = hits.where((F.col("identity") > identity) & (F.col("e_val") < e_val))
    if not unique:
        return kept
    row = F.struct(*kept.columns)
    order = F.struct("e_val", (-F.col("bitscore")).alias("b"), "target", row)
    return kept.groupBy("query").agg(F.min_by(row, order).alias("r")).select("r.*")


def read_annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``genome, product, dbxrefs, locus`` of annotation tables, distinct; the genome is the file's folder."""
    lines = spark.read.csv(paths, sep="\t", comment="#", quote="", schema="seq string, type string, start int, stop int, strand string, locus string, gene string, product string, dbxrefs string")
    genome = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return lines.select(genome.alias("genome"), "product", "dbxrefs", "locus").distinct()


def read_allele_names(spark: SparkSession, path: str) -> DataFrame:
    """``allele, header``: a ragged table, an allele and its headers by line.

    The allele is cut off before the headers are listed: taken from the line beside them, the line would be split again for each.
    """
    tab = F.instr("value", "\t")
    lines = spark.read.text(path).where(tab > 0).select(F.substring_index("value", "\t", 1).alias("allele"), F.expr("substr(value, instr(value, '\t') + 1)").alias("headers"))
    return lines.select("allele", F.explode(F.split("headers", "\t")).alias("header"))


def feature_alleles(allele_names: DataFrame) -> DataFrame:
    """``header, allele`` by the headers' first two fields; of a header at several alleles the last by name."""
    return allele_names.groupBy(names.header_key(F.col("header")).alias("header")).agg(F.max("allele").alias("allele"))


def locus_clusters(allele_names: DataFrame) -> DataFrame:
    """Distinct ``cluster, gene_id``: clusters by the grammar of names."""
    return allele_names.select(names.cluster_of(F.col("allele")).alias("cluster"), F.col("header").alias("gene_id")).distinct()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table by its suffix: .csv or .csv.gz in wide form becomes long, all else is Parquet in long form."""
    if not path.endswith((".csv", ".csv.gz")):
        return spark.read.parquet(path)
    return long_form(spark.read.csv(path, header=True))


def long_form(wide: DataFrame) -> DataFrame:
    """``gene, genome`` of a wide table whose first column names the feature: cells that are neither null nor 0."""
    first, *genomes = wide.columns
    cells = F.array(*[F.when(F.col(f"`{g}`").try_cast("double") > 0, F.lit(g)) for g in genomes])
    return wide.select(F.col(first).alias("gene"), F.explode(F.array_compact(cells)).alias("genome"))


def by_ids(df: DataFrame, key: str, ids: list[str], order: str = "ord") -> DataFrame:
    """The rows of some ids, with ``order``, an id's place in the list (from 0); an id without a row is an error that names it.

    An id given twice has its rows at both places.  The look-up for misses is one pass over the ids' rows alone.
    """
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"{order} int, {key} string")
    missing = wanted.join(df.select(key).distinct(), key, "left_anti").orderBy(order).limit(10).collect()
    if missing:
        raise KeyError(f"no rows for {[r[key] for r in missing]}")
    return df.join(wanted, key)


def with_clusters(metadata: DataFrame, key: str, clusters: DataFrame, column: str = "cluster") -> DataFrame:
    """Metadata with the cluster of each row's genome from (genome, cluster), null where it has none."""
    own = clusters.select(F.col("genome").alias(key), F.col("cluster").alias(column))
    return metadata.join(own, key, "left")


def without_text(df: DataFrame, column: str, texts: list[str]) -> DataFrame:
    """A column with every occurrence of some plain texts taken out, one text after another."""
    value = F.col(column)
    for t in texts:
        value = F.replace(value, F.lit(t), F.lit(""))
    return df.withColumn(column, value)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """``function, name`` of an ontology's text file: blocks that begin with [Term], of lines ``id: ...`` and ``name: ...``.

    The first id and name of a block count; other blocks and those without an id are left out.
    """
    blocks = spark.read.text(path, lineSep="\n\n").select(F.concat(F.lit("\n"), "value", F.lit("\n")).alias("b"))
    first = lambda tag: F.nullif(F.regexp_extract("b", rf"\n{tag}: *([^\n]*?) *\r?\n", 1), F.lit(""))
    return blocks.where(F.col("b").rlike(r"\n\[Term\]")).select(first("id").alias("function"), first("name").alias("name")).where("function is not null")


def pivoted_distances(pairs: DataFrame, ids: DataFrame, samples: list[str]) -> DataFrame:
    """``genome`` by sample distances for the known genomes; one without a distance has nulls."""
    table = pairs.groupBy("genome").pivot("sample", samples).agg(F.first("distance"))
    return ids.select("genome").distinct().join(table, "genome", "left")


def empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of files without bytes in a folder and below; they are named, not deleted.

    From the file system's listing, since scans skip empty files; the driver goes through it once and holds
    the empty ones only.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0:
            found.append((status.getPath().toString(),))
    return spark.createDataFrame(found, "path string")


def load_config(path: str) -> dict[str, Any]:
    """A YAML file of settings."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def save_tables(tables: dict[str, DataFrame], folder: str, meta: dict[str, Any] | None = None) -> None:
    """Each table as Parquet in a folder of its name, and what else belongs to a model as JSON text."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        spark = df.sparkSession
    text = json.dumps({"tables": sorted(tables), **(meta or {})}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_meta")


def load_tables(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """What :func:`save_tables` wrote."""
    meta = json.loads(spark.read.text(f"{folder}/_meta").first()["value"])
    return {name: spark.read.parquet(f"{folder}/{name}") for name in meta["tables"]}, meta
