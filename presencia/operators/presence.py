"""Presence tables in long form: a row (feature, genome) exists where the feature is present.

Null features and genomes are no presence; repeated rows count once; an empty table has no features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presencia.functions import names
from presencia.session import materialise

#: The default frequency bands in percent of the genomes.
BREAKPOINTS = (0, 25, 50, 75, 100)


def presence(df: DataFrame, feature: str = "gene", genome: str = "genome") -> DataFrame:
    """Distinct (gene, genome); combined map-side, so hot features shuffle one row per task and genome."""
    return df.select(F.col(feature).alias("gene"), F.col(genome).alias("genome")).na.drop().distinct()


def consolidated(seqs: DataFrame) -> DataFrame:
    """Distinct sequences: ``key, seq, representative, headers, genomes`` from (genome_ord, ord, genome, header, seq).

    Headers come in order of their genome and record, the first one represents; empty sequences are left out.
    ``headers`` grows with the copies of a sequence only.
    """
    rows = seqs.where(F.col("seq") != "").withColumn("key", names.sequence_key(F.col("seq")))
    copy = F.struct("genome_ord", "ord", "header", "genome")
    return rows.groupBy("key").agg(F.first("seq").alias("seq"), F.array_sort(F.collect_list(copy)).alias("copies")).select(
        "key", "seq", F.get("copies", F.lit(0))["header"].alias("representative"), F.col("copies.header").alias("headers"),
        F.array_distinct("copies.genome").alias("genomes"),
    )


def empty_headers(seqs: DataFrame) -> DataFrame:
    """Headers whose sequence is empty."""
    return seqs.where(F.coalesce(F.col("seq"), F.lit("")) == "").select("genome", "header")


def shared_headers(groups: DataFrame) -> DataFrame:
    """Sequences that several headers have: representative first."""
    return groups.where(F.size("headers") > 1).select("representative", "headers")


def header_alleles(clstr: DataFrame, shared: DataFrame | None, name: str, kind: str = "C") -> DataFrame:
    """``header, allele`` from cluster members (cluster, member, header), synonyms by their representative.

    A header that is a synonym goes by its representative even where it is a member itself.
    """
    own = clstr.select("header", names.feature_name(F.lit(name), F.lit(kind), F.col("cluster"), F.lit("A"), F.col("member")).alias("allele"))
    if shared is None:
        return own
    pairs = shared.select("representative", F.explode("headers").alias("header")).where("header <> representative").distinct()
    syn = pairs.join(own.withColumnRenamed("header", "representative"), "representative").select("header", "allele")
    return own.join(pairs.select("header"), "header", "left_anti").unionByName(syn)


def feature_tables(seqs: DataFrame, alleles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(allele, genome), (gene, genome) and the headers without an allele, from non-empty sequences."""
    named = seqs.where(F.col("seq") != "").join(alleles, "header", "left")
    table = named.where("allele is not null").select("allele", "genome").distinct()
    genes = table.select(names.gene_of_allele(F.col("allele")).alias("gene"), "genome").distinct()
    return table, genes, named.where("allele is null").select("genome", "header")


def gene_frequency(p: DataFrame) -> DataFrame:
    """``gene, freq``: in how many genomes."""
    return p.groupBy("gene").agg(F.count(F.lit(1)).alias("freq"))


def frequency_histogram(freq: DataFrame) -> DataFrame:
    """``freq, n_genes, cumulative`` by rising frequency; as many rows as there are frequencies, at most the genomes."""
    counts = freq.where("freq > 0").groupBy("freq").agg(F.count(F.lit(1)).alias("n_genes"))
    return counts.withColumn("cumulative", F.sum("n_genes").over(Window.orderBy("freq").rowsBetween(Window.unboundedPreceding, 0)))


def segments(freq: DataFrame, core_min: float, unique_max: float) -> DataFrame:
    """``segment``: core above floor(core_min), rare below ceil(unique_max), else accessory."""
    segment = F.when(F.col("freq") > F.floor(F.lit(core_min)), "core").when(F.col("freq") < F.ceil(F.lit(unique_max)), "rare").otherwise("accessory")
    return freq.withColumn("segment", segment)


def frequency_bands(freq: DataFrame, n_genomes: int, breakpoints: tuple[int, ...] = BREAKPOINTS) -> DataFrame:
    """``gene, lo, hi`` for every pair of breakpoints with lo < 100 freq / n <= hi; bands overlap.

    The bands are a constant array, so no join is needed.
    """
    bands = [(a, b) for i, a in enumerate(breakpoints) for b in breakpoints[i + 1 :]]
    all_ = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in bands])
    share = F.col("freq") * 100
    inside = F.filter(all_, lambda b: (share > b["lo"] * n_genomes) & (share <= b["hi"] * n_genomes))
    return freq.select("gene", "freq", F.explode(inside).alias("b")).select("gene", "freq", "b.*")


def of_genomes(p: DataFrame, genomes: DataFrame) -> DataFrame:
    """The presence in some genomes only; features in none of them vanish."""
    return p.join(genomes.select("genome").distinct(), "genome", "left_semi")


def inconsistent(genes: DataFrame, alleles: DataFrame) -> DataFrame:
    """``genome, gene, side``: genes of a genome that only the gene table or only its alleles have."""
    implied = alleles.select(names.gene_of_allele(F.col("allele")).alias("gene"), "genome").distinct()
    tagged = genes.select("gene", "genome", F.lit(1).alias("s")).distinct().unionByName(implied.withColumn("s", F.lit(2)))
    sums = tagged.groupBy("genome", "gene").agg(F.sum("s").alias("s")).where("s < 3")
    return sums.select("genome", "gene", F.when(F.col("s") == 1, "gene table").otherwise("alleles").alias("side"))


def inconsistent_genes(found: DataFrame) -> DataFrame:
    """``gene, n_genomes``: inconsistencies per gene."""
    return found.groupBy("gene").agg(F.countDistinct("genome").alias("n_genomes"))


def against_sequences(table: DataFrame, seqs: DataFrame, features: DataFrame) -> DataFrame:
    """``genome, feature, side``: a table (feature, genome) against the genomes' sequences.

    ``features`` (feature, seq) names each distinct sequence; sequences of a genome that no feature has count
    with a null feature on the side of the sequences.
    """
    keyed = features.select("feature", names.sequence_key(F.col("seq")).alias("key"))
    seen = seqs.where(F.col("seq") != "").select("genome", names.sequence_key(F.col("seq")).alias("key")).distinct()
    real = seen.join(keyed, "key", "left").select("feature", "genome").withColumn("s", F.lit(2))
    tagged = table.select("feature", "genome", F.lit(1).alias("s")).distinct().unionByName(real.distinct())
    sums = tagged.groupBy("genome", "feature").agg(F.sum("s").alias("s")).where("s < 3")
    return sums.select("genome", "feature", F.when(F.col("s") == 1, "table").otherwise("sequences").alias("side"))


def collapsed_annotations(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per gene the most common annotation of its alleles, and the alleles that have another.

    From (allele, ord, annotation): an allele's distinct annotations in order of ``ord`` are joined by ``; ``; the most
    common wins, ties go to the one seen first, then by text.  Null annotations do not count.
    """
    per = annotated.where("annotation is not null").groupBy("allele", "annotation").agg(F.min("ord").alias("ord"))
    per = per.groupBy("allele").agg(F.array_sort(F.collect_list(F.struct("ord", "annotation"))).alias("a"))
    per = per.select(
        "allele", names.gene_of_allele(F.col("allele")).alias("gene"), F.array_join("a.annotation", "; ").alias("annotation"), F.get("a", F.lit(0))["ord"].alias("ord")
    )
    per = materialise(per, "annotations")
    votes = per.groupBy("gene", "annotation").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    genes = votes.groupBy("gene").agg(F.min_by("annotation", F.struct((-F.col("n")).alias("n"), "ord", "annotation")).alias("annotation"))
    others = per.join(genes.withColumnRenamed("annotation", "gene_annotation"), "gene").where("annotation <> gene_annotation")
    return genes, others.select("allele", "annotation")


def annotate(features: DataFrame, annotations: DataFrame) -> DataFrame:
    """A feature's own annotation, else its cluster's, else null."""
    own = annotations.select(F.col("feature"), F.col("annotation").alias("own"))
    of_gene = annotations.select(F.col("feature").alias("gene"), F.col("annotation").alias("of_gene"))
    rows = features.select("feature").withColumn("gene", names.gene_of_allele(F.col("feature")))
    return rows.join(own, "feature", "left").join(of_gene, "gene", "left").select("feature", F.coalesce("own", "of_gene").alias("annotation"))


def first_non_null(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """Per key each column's first value that is not null, in an explicit order."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def numbered_variants(rows: DataFrame, letter: str) -> DataFrame:
    """``gene, seq, genome, prox_id``: a gene's distinct sequences numbered from 0 by first appearance.

    From (genome, ord, gene, seq), empty sequences left out; appearance goes by genome name, then record.
    The numbering orders one row per distinct sequence of a gene.
    """
    full = rows.where(F.col("seq") != "")
    first = full.groupBy("gene", "seq").agg(F.min(F.struct("genome", "ord")).alias("at"))
    number = F.row_number().over(Window.partitionBy("gene").orderBy("at")) - 1
    numbered = first.select("gene", "seq", F.concat("gene", F.lit(letter), number.cast("string")).alias("prox_id"))
    return full.select("gene", "seq", "genome").distinct().join(numbered, ["gene", "seq"])


def pan_core_curve(p: DataFrame, iterations: int, core: float = 0.987, rare: float = 0.037) -> DataFrame:
    """``iter, step, pan, core, acc, rare``: sizes as genomes are added in ``iterations`` seeded orders.

    With j genomes before, a gene seen in c is pan if c > 0, core if c >= (j + 1) core, accessory if c > j rare and
    c < (j + 1) core, rare if c > 0 and c < j rare (one exactly at j rare is neither).  Orders go by md5 of
    ``iter-genome``, the same in every partitioning.

    Never dense: a gene's count is constant between its genomes, so each (gene, iteration) adds an interval per
    genome it is in, and a class holds on a sub-interval of steps found by arithmetic; starts and ends are
    counted per step.
    """
    genomes = p.select("genome").distinct()
    # as many rows as genomes in each iteration's window
    order = Window.partitionBy("iter").orderBy(F.md5(F.concat_ws("-", F.col("iter").cast("string"), "genome")), "genome")
    placed = genomes.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("step", F.row_number().over(order))
    placed = materialise(placed, "orders")
    n = materialise(genomes, "genomes").count()
    steps = p.join(placed, "genome").groupBy("iter", "gene").agg(F.array_sort(F.collect_list("step")).alias("at"))
    runs = steps.select(
        "iter", F.posexplode("at").alias("i", "lo"), "at"
    ).select("iter", (F.col("i") + 1).alias("c"), "lo", (F.coalesce(F.get("at", F.col("i") + 1), F.lit(n + 1)) - 1).alias("hi"))
    c, lo, hi = F.col("c"), F.col("lo"), F.col("hi")  # count c on steps lo..hi (j + 1 = step)
    core_to = F.greatest(F.floor(c / core) - 1, F.lit(0))  # a lower bound of the last step that is core, corrected below
    for _ in range(3):
        core_to = F.when(c >= (core_to + 1) * F.lit(core), core_to + 1).otherwise(core_to)
    rare_from = F.floor(c / rare) + 1  # step - 1 = j; the first j with c < j rare
    for _ in range(2):
        rare_from = F.when(c < (rare_from - 1) * F.lit(rare), rare_from - 1).otherwise(rare_from)
    rare_from = F.when(c < rare_from * F.lit(rare), rare_from).otherwise(rare_from + 1)
    last_not_rare = F.when(c > (rare_from - 1) * F.lit(rare), rare_from - 1).otherwise(rare_from - 2)  # the last j with c > j rare
    spans = F.array(
        F.struct(F.lit("pan").alias("k"), lo.cast("bigint").alias("a"), hi.cast("bigint").alias("b")),
        F.struct(F.lit("core").alias("k"), lo.cast("bigint").alias("a"), F.least(hi, core_to).cast("bigint").alias("b")),
        F.struct(F.lit("acc").alias("k"), F.greatest(lo, core_to + 1).cast("bigint").alias("a"), F.least(hi, last_not_rare + 1).cast("bigint").alias("b")),
        F.struct(F.lit("rare").alias("k"), F.greatest(lo, rare_from + 1).cast("bigint").alias("a"), hi.cast("bigint").alias("b")),
    )
    ends = (
        runs.select("iter", F.explode(F.filter(spans, lambda s: s["a"] <= s["b"])).alias("s"))
        .select("iter", "s.k", F.explode(F.array(F.struct(F.col("s.a").alias("step"), F.lit(1).alias("d")), F.struct((F.col("s.b") + 1).alias("step"), F.lit(-1).alias("d")))).alias("e"))
        .groupBy("iter", "e.step").pivot("k", ["pan", "core", "acc", "rare"]).agg(F.sum("e.d"))
    )
    grid = placed.select("iter", F.col("step").cast("bigint").alias("step")).join(ends, ["iter", "step"], "left")
    upto = Window.partitionBy("iter").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("iter", "step", *[F.coalesce(F.sum(k).over(upto), F.lit(0)).alias(k) for k in ("pan", "core", "acc", "rare")])


def wide(p: DataFrame, genomes: list[str]) -> DataFrame:
    """A wide 0/1 table of some genomes, for export only."""
    return p.groupBy("gene").pivot("genome", genomes).agg(F.lit(1)).na.fill(0)


def validated_binary(df: DataFrame, value: str) -> DataFrame:
    """``df``, which fails when read if a value is neither 0 nor 1 (null is absence)."""
    v = F.coalesce(F.col(value), F.lit(0))
    return df.withColumn(value, F.when(v.isin(0, 1), v.cast("tinyint")).otherwise(F.raise_error(F.lit("values must be 0 or 1")).cast("tinyint")))

