"""FASTA, CLSTR and GFF text as DataFrames, and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.functions import names

GFF_SCHEMA = "accession string, source string, type string, start int, stop int, score string, strand string, phase string, attrs string"


def fasta_records(files: DataFrame) -> DataFrame:
    """``path, ord, header, seq`` of whole files (path, value); the header is the line without ``>``.

    A record starts at a ``>`` that begins a line, so one inside a header is text; line breaks and blanks at line ends are
    taken out of sequences; text before the first record is skipped; an empty sequence stays, as an empty text.
    """
    at_line = F.split(F.concat(F.lit("\n"), F.replace("value", F.lit("\r"), F.lit(""))), r"\n>")
    rows = files.select("path", F.posexplode(at_line).alias("ord", "rec")).where("ord > 0")
    line = F.substring_index("rec", "\n", 1)
    body = F.regexp_replace(F.substring(F.col("rec"), F.length(line) + 1, F.length("rec")), r"\s", "")
    return rows.select("path", (F.col("ord") - 1).alias("ord"), line.alias("header"), body.alias("seq"))


def read_fasta(
    spark: SparkSession, paths: str | list[str], header: Callable[[Column], Column] = names.short_header, seq: Callable[[Column], Column] | None = None,
    keep: Callable[[Column], Column] | None = None, last_wins: bool = True,
) -> DataFrame:
    """``genome, ord, header, seq`` of FASTA files (a genome per file, so a file fits a task; .gz works too).

    ``header``, ``seq`` and ``keep`` are expressions: what a header and a sequence become, and which transformed headers to keep.
    Empty sequences are skipped unless ``last_wins`` is off; of a header twice in a genome the last record wins.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = fasta_records(files).withColumn("genome", names.genome_of_path(F.regexp_replace("path", r"\.gz$", ""))).drop("path")
    rows = rows.withColumn("header", header(F.col("header")))
    if seq is not None:
        rows = rows.withColumn("seq", seq(F.col("seq")))
    if keep is not None:
        rows = rows.where(keep(F.col("header")))
    if not last_wins:
        return rows.select("genome", "ord", "header", "seq")
    best = rows.where("seq <> ''").groupBy("genome", "header").agg(F.max(F.struct("ord", "seq")).alias("r"))
    return best.select("genome", "r.ord", "header", "r.seq")


def fasta_text(rows: DataFrame, header: str = "header", seq: str = "seq", width: int | None = 70) -> DataFrame:
    """One text ``value`` per record, to be written as text; ``width`` wraps sequences, none keeps one line."""
    body = F.col(seq) if width is None else names.wrapped(F.col(seq), width)
    return rows.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("value"))


def write_fasta(rows: DataFrame, path: str, by_header: bool = False, **kw: object) -> None:
    """Records as text files, in order of headers if asked; Spark's committer makes the output appear whole."""
    fasta_text(rows.orderBy("header") if by_header else rows, **kw).write.text(path)


def clstr_members(clusters: DataFrame) -> DataFrame:
    """``cluster, member, len, header, is_rep, pct`` from a text per cluster (``value``): its number, then its members by line.

    A member's percentage is null for the representative.  Lines that are no members are skipped.
    """
    rows = clusters.select(F.regexp_extract("value", r"^(?:>?Cluster )?(\d+)", 1).cast("int").alias("cluster"), F.explode(F.split("value", "\n")).alias("line"))
    pick = lambda p, i=1: F.regexp_extract("line", p, i)
    member = r"^(\d+)\t(\d+)(?:aa|nt), >(.*)\.\.\. (\*|at .*)$"
    return rows.where(F.col("line").rlike(member)).select(
        "cluster", pick(member).cast("int").alias("member"), pick(member, 2).cast("int").alias("len"), pick(member, 3).alias("header"),
        (pick(member, 4) == "*").alias("is_rep"), F.regexp_extract(pick(member, 4), r"([0-9.]+)%\s*$", 1).try_cast("double").alias("pct"),
    )


def read_clstr(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """:func:`clstr_members` of cluster files; the line separator makes a row per cluster, so a file of any size splits."""
    return clstr_members(spark.read.option("lineSep", "\n>Cluster ").text(path))


def sample_presence(members: DataFrame, sample: str, genome_of: Callable[[Column], Column] = names.genome_of_locus) -> DataFrame:
    """``cluster, present`` of a sample mapped onto known clusters: whether a member's genome is the sample.

    A cluster goes by the gene of its other members (the least by name); clusters of the sample only are left out.
    """
    own = genome_of(F.col("header")) == sample
    return (
        members.groupBy(F.col("cluster").alias("n"))
        .agg(F.min(F.when(~own, names.cluster_of(F.col("header")))).alias("cluster"), F.bool_or(own).alias("present"))
        .where("cluster is not null").select("cluster", "present")
    )


def read_gff(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """GFF3 rows with ``genome`` and ``ord``; comments, blank lines and a trailing FASTA section are left out.

    ``contig`` is what follows the accession's last bar; ``start`` counts from 0, ``stop`` is exclusive.
    """
    raw = spark.read.csv(paths, sep="\t", comment="#", schema=GFF_SCHEMA, quote="")
    rows = raw.select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("ord"))
    return gff_rows(rows.withColumn("genome", names.genome_of_path(F.col("path"))).drop("path"))


def gff_rows(rows: DataFrame) -> DataFrame:
    """Typed features of raw GFF columns (with genome and ord)."""
    return rows.where("type is not null and start is not null and stop is not null").withColumns(
        {"contig": F.substring_index("accession", "|", -1), "start": F.col("start") - 1, "id": names.attribute(F.col("attrs"), "ID")}
    )


def features_table(gff: DataFrame, types: list[str], unique: bool = False) -> DataFrame:
    """``accession, start, end, locus_tag`` of some feature types, start from 1; with ``unique`` the first row of each locus tag."""
    rows = gff.where(F.col("type").isin(types)).select(
        "accession", (F.col("start") + 1).alias("start"), F.col("stop").alias("end"), names.attribute(F.col("attrs"), "locus_tag", required=True).alias("locus_tag")
    )
    if not unique:
        return rows
    return rows.groupBy("locus_tag").agg(F.min_by(F.struct("accession", "start", "end"), F.struct("start", "end", "accession")).alias("r")).select("r.*", "locus_tag")


def region_length(gff: DataFrame) -> DataFrame:
    """``genome, length``: the end of each genome's first region row."""
    return gff.where("type = 'region'").groupBy("genome").agg(F.min_by("stop", "ord").alias("length"))


def sliced(features: DataFrame, contigs: DataFrame, types: list[str] | None = None, flanking: tuple[int, int] = (0, 0)) -> DataFrame:
    """``genome, contig, id, seq`` of features with bases on either side, the reverse complement on the minus strand.

    Flanks are by position, not strand, and cut at the contig's ends.  Features of unknown contigs have no row (see
    :func:`unknown_contigs`).  Contigs (genome, contig, seq) join by an equi join.
    """
    rows = features if types is None else features.where(F.col("type").isin(types))
    start = F.greatest(F.lit(0), F.col("start") - flanking[0])
    joined = rows.select("genome", "contig", "id", "start", "stop", "strand").join(contigs.select("genome", "contig", "seq"), ["genome", "contig"])
    part = F.substring(F.col("seq"), start + 1, F.col("stop") + flanking[1] - start)
    return joined.select("genome", "contig", "id", F.when(F.col("strand") == "-", names.reverse_complement(part)).otherwise(part).alias("seq"))


def unknown_contigs(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """Features whose contig has no sequence."""
    return features.join(contigs.select("genome", "contig"), ["genome", "contig"], "left_anti")


def neighbours(features: DataFrame) -> DataFrame:
    """Features with ``before``, the previous CDS's stop, and ``after``, the next one's start, on their contig and strand.

    In file order; null at the ends.  A window holds one contig's features.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("genome", "contig", "strand").orderBy("ord")
    cds = features.where("type = 'CDS'")
    return cds.withColumns({"before": F.lag("stop").over(order), "after": F.lead("start").over(order)})


def proximal(features: DataFrame, contigs: DataFrame, side: str, limits: tuple[int, int], max_overlap: int = -1, fragments: bool = False) -> DataFrame:
    """``genome, ord, id, name, seq`` of the bases up- or downstream of features, with some coding ones.

    Upstream of (-x, y): x bases before the start and y from it; downstream: x before the end and y after; mirrored on the
    minus strand.  With ``max_overlap`` of 0 or more the part that reaches further than that into a neighbouring CDS is cut.
    Kept if longer than its coding part, and not cut off by the contig's end unless ``fragments``; windows that start before
    the contig start at it.
    """
    if side not in ("upstream", "downstream"):
        raise ValueError("side must be upstream or downstream")
    rows = neighbours(features) if max_overlap >= 0 else features
    plus = F.col("strand") != "-"
    from_start = plus if side == "upstream" else ~plus
    anchor = F.when(from_start, F.col("start")).otherwise(F.col("stop"))
    lo = F.when(plus, anchor + limits[0]).otherwise(anchor - limits[1])
    hi = F.when(plus, anchor + limits[1]).otherwise(anchor - limits[0])
    if max_overlap >= 0:
        lo = F.greatest(lo, F.coalesce(F.col("before") - max_overlap, lo))
        hi = F.least(hi, F.coalesce(F.col("after") + max_overlap, hi))
    joined = rows.withColumns({"lo": lo, "hi": hi}).join(contigs.select("genome", "contig", F.col("seq").alias("contig_seq")), ["genome", "contig"])
    first = F.greatest(F.col("lo"), F.lit(0))
    part = F.substring(F.col("contig_seq"), first + 1, F.greatest(F.col("hi") - first, F.lit(0)))
    cut = (F.col("lo") < 0) | (F.col("hi") > F.length("contig_seq"))
    shown = [limits[0], limits[1], max_overlap] if max_overlap >= 0 else list(limits)
    suffix = f"_{side}({','.join(map(str, shown))})"
    out = joined.select("genome", "ord", "id", F.concat("id", F.lit(suffix)).alias("name"), F.when(plus, part).otherwise(names.reverse_complement(part)).alias("seq"), cut.alias("cut"))
    coding = limits[1] if side == "upstream" else -limits[0]
    return out.where((F.length("seq") > coding) & (F.lit(fragments) | ~F.col("cut"))).drop("cut")


def undetected_windows(table: DataFrame, variants: DataFrame, contigs: DataFrame, width: int) -> DataFrame:
    """``genome, feature`` of a table whose sequence (feature, seq of one width) is nowhere in the genome, on either strand.

    Every window of a contig is looked up, so this is for audits: bases times genomes rows, semi-joined with the known sequences.
    """
    spots = F.sequence(F.lit(1), F.greatest(F.length("seq") - width + 1, F.lit(1)))
    windows = contigs.select("genome", F.explode(F.transform(spots, lambda i: F.substring(F.col("seq"), i, F.lit(width)))).alias("w"))
    known = variants.select("feature", "seq").where(F.length("seq") == width)
    both = known.unionByName(known.withColumn("seq", names.reverse_complement(F.col("seq")))).distinct()
    found = windows.join(both, windows["w"] == both["seq"]).select("genome", "feature").distinct()
    return table.join(known.select("feature"), "feature", "left_semi").join(found, ["genome", "feature"], "left_anti").select("genome", "feature")


def codon_counts(seqs: DataFrame, side: str, offset: int) -> DataFrame:
    """``codon, n`` of the three bases at a place (from 0) of proximal sequences: start codons upstream, stop codons downstream."""
    return seqs.groupBy(F.upper(F.substring("seq", offset + 1, 3)).alias("codon")).agg(F.count(F.lit(1)).alias("n"))


def representatives(members: DataFrame, seqs: DataFrame, name: str, kind: str = "C") -> DataFrame:
    """``allele, seq`` of the clusters' representatives."""
    own = members.where("is_rep").select("header", names.feature_name(F.lit(name), F.lit(kind), F.col("cluster"), F.lit("A"), F.col("member")).alias("allele"))
    return seqs.select("header", "seq").join(own, "header").select("allele", "seq")


def representatives_of(headers: DataFrame, seqs: DataFrame) -> DataFrame:
    """``allele, seq``: each allele's sequence, that of its first header in order."""
    named = seqs.where(F.col("seq") != "").join(headers, "header")
    return named.groupBy("allele").agg(F.min_by("seq", F.struct("genome", "ord")).alias("seq"))


def product_annotations(gff: DataFrame, alleles: DataFrame, types: list[str] | None = None, key: Callable[[Column], Column] = names.header_key) -> DataFrame:
    """``allele, ord, annotation``: decoded products of features by their id (or locus tag), a plus staying a plus."""
    rows = gff if types is None else gff.where(F.col("type").isin(types))
    product = names.percent_decoded(names.attribute(F.col("attrs"), "product"))
    ids = rows.select(F.coalesce(key(F.col("id")), names.attribute(F.col("attrs"), "locus_tag")).alias("header"), "ord", product.alias("annotation"))
    return ids.join(alleles, "header").select("allele", "ord", "annotation")
