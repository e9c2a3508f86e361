"""Whole pangenome builds: from sequence and cluster files to presence tables.

Clustering itself runs outside; its CLSTR file is an input.  ``representatives`` is what a clustering reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.functions import names
from presencia.operators import presence as pr
from presencia.sources import sequences as sq
from presencia.sources import tables as tb


@dataclass(frozen=True)
class Pangenome:
    """``alleles`` and ``genes`` (feature, genome), ``headers`` (header, allele), ``sequences`` (allele, seq), and what did not fit."""

    alleles: DataFrame
    genes: DataFrame
    headers: DataFrame
    sequences: DataFrame
    shared: DataFrame
    empty: DataFrame
    unnamed: DataFrame

    def save(self, folder: str, meta: dict | None = None) -> None:
        """Each table in a folder of its name."""
        tb.save_tables({k: getattr(self, k) for k in ("alleles", "genes", "headers", "sequences", "shared", "empty", "unnamed")}, folder, meta)


def numbered_genomes(seqs: DataFrame, genomes: list[str]) -> DataFrame:
    """With ``genome_ord``, the genome's place in a list; genomes that are not in it are left out, and one in it without sequences is an error."""
    return tb.by_ids(seqs, "genome", genomes, "genome_ord")


def by_name(seqs: DataFrame) -> DataFrame:
    """With the genome's name as its place, for any number of genomes."""
    return seqs.withColumn("genome_ord", F.col("genome"))


def representatives(seqs: DataFrame) -> DataFrame:
    """``header, seq`` of each distinct sequence: the input of a clustering."""
    return pr.consolidated(seqs).select(F.col("representative").alias("header"), "seq")


def pangenome(seqs: DataFrame, clstr: DataFrame, name: str, kind: str = "C", synonyms: bool = True) -> Pangenome:
    """Presence of alleles and genes from sequences (genome_ord, ord, genome, header, seq) and their clusters' members.

    With ``synonyms`` equal sequences are one allele, their representative's; without, every clustered header keeps its own
    (for cluster files made of all sequences rather than distinct ones).
    """
    groups = pr.consolidated(seqs)
    shared = pr.shared_headers(groups)
    headers = pr.header_alleles(clstr, shared if synonyms else None, name, kind)
    alleles, genes, unnamed = pr.feature_tables(seqs, headers)
    return Pangenome(alleles, genes, headers, sq.representatives_of(headers, seqs), shared, pr.empty_headers(seqs), unnamed)


def cds_pangenome(spark: SparkSession, faa: list[str], clstr: str, name: str, synonyms: bool = True) -> Pangenome:
    """A coding pangenome from a protein file per genome, in the order of the list, and a cluster file."""
    seqs = sq.read_fasta(spark, faa, last_wins=False)
    order = [p.rsplit("/", 1)[-1].removesuffix(".gz").rpartition(".")[0] for p in faa]
    return pangenome(numbered_genomes(seqs, order), sq.read_clstr(spark, clstr), name, "C", synonyms)


def cut_sequences(features: DataFrame, contigs: DataFrame, types: list[str], flanking: tuple[int, int] = (0, 0)) -> DataFrame:
    """``genome, ord, header, seq`` of some feature types cut out of contigs (genome, contig, seq)."""
    chosen = features.where(F.col("type").isin(types))
    cut = sq.sliced(chosen, contigs, types, flanking=flanking)
    return cut.join(chosen.select("genome", "contig", "id", "ord"), ["genome", "contig", "id"]).select("genome", "ord", F.col("id").alias("header"), "seq")


def feature_sequences(spark: SparkSession, gff: list[str], fna: list[str], types: list[str], flanking: tuple[int, int] = (0, 0)) -> DataFrame:
    """:func:`cut_sequences` of files; a genome's files share their base name."""
    contigs = sq.read_fasta(spark, fna).select("genome", F.substring_index("header", "|", -1).alias("contig"), "seq")
    return cut_sequences(sq.read_gff(spark, gff), contigs, types, flanking)


def coding_nucleotide_pangenome(spark: SparkSession, gff: list[str], fna: list[str], clstr: str, name: str, types: tuple[str, ...] = ("CDS", "tRNA")) -> Pangenome:
    """A pangenome of coding features' nucleotides."""
    return pangenome(by_name(feature_sequences(spark, gff, fna, list(types))), sq.read_clstr(spark, clstr), name, "C")


def noncoding_pangenome(
    spark: SparkSession, gff: list[str], fna: list[str], clstr: str, name: str, flanking: tuple[int, int] = (0, 0), types: tuple[str, ...] = ("transcript", "tRNA", "rRNA", "misc_binding")
) -> Pangenome:
    """A pangenome of non-coding features, named with T, with some bases on either side."""
    return pangenome(by_name(feature_sequences(spark, gff, fna, list(types), flanking)), sq.read_clstr(spark, clstr), name, "T")


def proximal_variants(
    features: DataFrame, contigs: DataFrame, headers: DataFrame, side: str, limits: tuple[int, int] | None = None, max_overlap: int = -1, fragments: bool = False
) -> DataFrame:
    """``gene, seq, genome, prox_id``: each gene's distinct sequences up- or downstream, numbered by first appearance.

    ``headers`` (header, allele) names the features; those without an allele are left out.  Limits are 50 bases outside and 3
    inside unless given.
    """
    limits = limits or ((-50, 3) if side == "upstream" else (-3, 50))
    cut = sq.proximal(features, contigs, side, limits, max_overlap, fragments)
    named = cut.join(headers, cut["id"] == headers["header"]).select("genome", "ord", names.gene_of_allele(F.col("allele")).alias("gene"), "seq")
    return pr.numbered_variants(named, {"upstream": "U", "downstream": "D"}[side])


def proximal_pangenome(
    spark: SparkSession, gff: list[str], fna: list[str], headers: DataFrame, side: str, limits: tuple[int, int] | None = None, max_overlap: int = -1, fragments: bool = False
) -> DataFrame:
    """:func:`proximal_variants` of files."""
    features = sq.read_gff(spark, gff).where("id is not null")
    contigs = sq.read_fasta(spark, fna).select("genome", F.substring_index("header", "|", -1).alias("contig"), "seq")
    return proximal_variants(features, contigs, headers, side, limits, max_overlap, fragments)
