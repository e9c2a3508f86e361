"""Queries of factor models, their scores, consensus and enrichment.

Where a model is only a means to test an operator that SQL can follow, components are taxa: a gene weighs in a taxon the share of
its genomes that have it, a genome its share of the taxon's frequent genes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presencia.operators import consensus, embed, enrich, factor, model, sets
from presencia.operators import presence as pr
from presencia.plans.presence_queries import P, genes_by_genome
from presencia.plans.registry import Registry
from presencia.session import materialise, table

R = Registry()

RANKS = [3, 4, 5, 6]

# weights: w(gene, taxon) = share of the taxon's genomes; h(genome, taxon) = the genome's share of the taxon's genes with w >= 0.4
_W = f"""{P}, t AS (SELECT genome, split_part(genome, '.', 1) AS component FROM p GROUP BY genome), n AS (SELECT component, count(*) AS n FROM t GROUP BY component),
w AS (SELECT 1 AS rank, gene, component, count(*) * 1.0::DOUBLE / any_value(n) AS w FROM p JOIN t USING (genome) JOIN n USING (component) GROUP BY gene, component),
l AS (SELECT rank, gene, component FROM w WHERE w >= 0.4),
ln AS (SELECT component, count(*) AS k FROM l GROUP BY component),
h AS (SELECT 1 AS rank, genome, component, count(*) * 1.0::DOUBLE / any_value(k) AS h FROM p JOIN l USING (gene) JOIN ln USING (component) GROUP BY genome, component),
a AS (SELECT rank, genome, component FROM h WHERE h >= 0.5)"""


def taxon_weights(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rank, gene, component, w) and (rank, genome, component, h) of the model by taxa."""
    p = p.withColumn("component", F.substring_index("genome", ".", 1))
    n = p.select("genome", "component").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    w = p.groupBy("gene", "component").agg(F.count(F.lit(1)).alias("c")).join(n, "component").select(F.lit(1).alias("rank"), "gene", "component", (F.col("c") / F.col("n")).alias("w"))
    w = materialise(w, "weights")
    frequent = w.where("w >= 0.4").select("gene", "component")
    k = frequent.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    h = p.select("gene", "genome").join(frequent, "gene").groupBy("genome", "component").agg(F.count(F.lit(1)).alias("c")).join(k, "component")
    return w, materialise(h.select(F.lit(1).alias("rank"), "genome", "component", (F.col("c") / F.col("k")).alias("h")), "affinities")


def _binary(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = materialise(genes_by_genome(spark, sf), "presence")
    w, h = taxon_weights(p)
    return p, w.where("w >= 0.4"), h.where("h >= 0.5")


@R.query("reconstruction", f"WITH {_W} SELECT rank, gene, genome, count(*) AS n FROM l JOIN a USING (rank, component) GROUP BY ALL")
def reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    _, l_bin, a_bin = _binary(spark, sf)
    return factor.reconstruction(l_bin, a_bin)


@R.query(
    "reconstruction_error",
    f"WITH {_W}, r AS (SELECT gene, genome, count(*) AS n FROM l JOIN a USING (rank, component) GROUP BY ALL) SELECT 1 AS rank, gene, genome, (p.gene IS NOT NULL)::INT - coalesce(n, 0) AS error "
    "FROM (SELECT gene, genome, max(n) AS n, max(i) AS i FROM (SELECT gene, genome, n, NULL AS i FROM r UNION ALL SELECT gene, genome, NULL, 1 FROM p) GROUP BY ALL) x LEFT JOIN p USING (gene, genome) "
    "WHERE (p.gene IS NOT NULL)::INT - coalesce(n, 0) <> 0",
)
def reconstruction_error(spark: SparkSession, sf: str) -> DataFrame:
    p, l_bin, a_bin = _binary(spark, sf)
    return factor.reconstruction_error(p, factor.reconstruction(l_bin, a_bin), [1])


@R.query(
    "reconstruction_metrics",
    f"""WITH {_W}, r AS (SELECT DISTINCT gene, genome FROM l JOIN a USING (rank, component)),
c AS (SELECT (SELECT count(*) FROM r SEMI JOIN p USING (gene, genome))::DOUBLE AS tp, (SELECT count(*) FROM p ANTI JOIN r USING (gene, genome))::DOUBLE AS fn,
  (SELECT count(*) FROM r ANTI JOIN p USING (gene, genome))::DOUBLE AS fp, (SELECT count(DISTINCT gene) * count(DISTINCT genome) FROM p)::DOUBLE AS t, (SELECT count(DISTINCT gene) + count(DISTINCT genome) FROM p) AS gs),
m AS (SELECT *, t - tp - fn - fp AS tn FROM c),
s AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, tp / (tp + fp + fn) AS jaccard FROM m)
SELECT 1 AS rank, tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp, tn::BIGINT AS tn, round(precision, 8) AS precision, round(recall, 8) AS recall, round(fp / (fp + tn), 8) AS fpr, round(fn / (tp + fn), 8) AS fnr,
  round(specificity, 8) AS specificity, round((tp + fn) / t, 8) AS prevalence, round((tp + tn) / t, 8) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round(jaccard, 8) AS jaccard,
  round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 8) AS mcc, round(recall + specificity - 1, 8) AS bm,
  round((sqrt(recall * (1 - specificity)) + specificity - 1) / (recall + specificity - 1), 8) AS prevalence_threshold, round(2 * 1 * gs + 2 * (1 - jaccard) * t, 4) AS aic FROM s""",
)
def reconstruction_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p, l_bin, a_bin = _binary(spark, sf)
    genes, genomes = factor.shape(p)
    out = factor.metrics(factor.confusion(p, l_bin, a_bin, [1], genes, genomes), genes, genomes)
    return out.withColumns({c: F.round(c, 4 if c == "aic" else 8) for c in out.columns if c not in ("rank", "tp", "fn", "fp", "tn")})


@R.query(
    "normalised_weights",
    f"WITH {_W}, q AS (SELECT component, quantile_cont(w, 0.99) AS q FROM w GROUP BY component) SELECT rank, gene, component, round(CASE WHEN q > 0 THEN w / q ELSE 0 END, 9) AS w FROM w JOIN q USING (component)",
)
def normalised_weights(spark: SparkSession, sf: str) -> DataFrame:
    w, h = taxon_weights(genes_by_genome(spark, sf))
    return factor.normalised(w, h)[0].withColumn("w", F.round("w", 9))


@R.query(
    "normalised_affinities",
    f"WITH {_W}, q AS (SELECT component, quantile_cont(w, 0.99) AS q FROM w GROUP BY component) SELECT rank, genome, component, round(h * q, 9) AS h FROM h JOIN q USING (component)",
)
def normalised_affinities(spark: SparkSession, sf: str) -> DataFrame:
    w, h = taxon_weights(genes_by_genome(spark, sf))
    return factor.normalised(w, h)[1].withColumn("h", F.round("h", 9))


# exact 3-means of each taxon's gene frequencies, by trying all pairs of cuts between distinct values
_KMEANS = f"""{P}, f AS (SELECT split_part(genome, '.', 1) AS component, gene, count(*) AS x FROM p GROUP BY ALL),
d AS (SELECT component, x, count(*) AS c FROM f GROUP BY ALL),
s AS (SELECT component, x, row_number() OVER v AS i, sum(c) OVER v AS n, sum(c * x) OVER v AS s1, sum(c * x * x) OVER v AS s2 FROM d WINDOW v AS (PARTITION BY component ORDER BY x)),
e AS (SELECT component, max(i) AS k, max(n) AS n, max(s1) AS s1, max(s2) AS s2 FROM s GROUP BY component),
c AS (SELECT e.component, b.x AS top_above, row_number() OVER (PARTITION BY e.component ORDER BY round(
    (a.s2 - a.s1 * a.s1 * 1.0::DOUBLE / a.n) + ((b.s2 - a.s2) - (b.s1 - a.s1) * (b.s1 - a.s1) * 1.0::DOUBLE / (b.n - a.n)) + ((e.s2 - b.s2) - (e.s1 - b.s1) * (e.s1 - b.s1) * 1.0::DOUBLE / (e.n - b.n)), 6), b.x, a.x) AS r
  FROM e JOIN s a USING (component) JOIN s b USING (component) WHERE a.i < b.i AND b.i < e.k)"""


def _frequency_by_taxon(spark: SparkSession, sf: str) -> DataFrame:
    p = genes_by_genome(spark, sf).withColumn("component", F.substring_index("genome", ".", 1))
    return p.groupBy("component", "gene").agg(F.count(F.lit(1)).cast("double").alias("x"))


@R.query("top_cluster", f"WITH {_KMEANS} SELECT f.component, gene, x::DOUBLE AS x, x > top_above AS top FROM f JOIN c ON c.component = f.component AND r = 1")
def top_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return factor.binarised(_frequency_by_taxon(spark, sf), "gene", "x", ("component",)).select("component", "gene", "x", "top")


@R.query("top_threshold", f"WITH {_KMEANS} SELECT f.component, min(x)::DOUBLE AS threshold FROM f JOIN c ON c.component = f.component AND r = 1 WHERE x > top_above GROUP BY f.component")
def top_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return factor.thresholds(factor.binarised(_frequency_by_taxon(spark, sf), "gene", "x", ("component",)), "x", ("component",))


# two weights per gene, by closed form: its share of the first and of the second half of the loads
_PAIR = """g AS (SELECT cluster AS gene, count_if(load_no <= 5) * 1.0::DOUBLE / count(*) AS a, count_if(load_no > 5) * 1.0::DOUBLE / count(*) AS b FROM locus_map WHERE cluster IS NOT NULL GROUP BY cluster)"""


@R.query(
    "affinities_of_two",
    f"""WITH {P}, {_PAIR}, m AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM g),
c AS (SELECT genome, sum(a) AS ca, sum(b) AS cb FROM p JOIN g USING (gene) GROUP BY genome),
s AS (SELECT *, (ca * bb - cb * ab) / (aa * bb - ab * ab) AS x, (cb * aa - ca * ab) / (aa * bb - ab * ab) AS y FROM c, m),
r AS (SELECT genome, CASE WHEN x >= 0 AND y >= 0 THEN x WHEN y < 0 THEN greatest(ca / aa, 0) ELSE 0 END AS x, CASE WHEN x >= 0 AND y >= 0 THEN y WHEN x < 0 THEN greatest(cb / bb, 0) ELSE 0 END AS y FROM s)
SELECT genome, 0 AS component, round(x, 7) AS affinity FROM r UNION ALL SELECT genome, 1, round(y, 7) FROM r""",
)
def affinities_of_two(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    loads = table(spark, sf, "locus_map").where("cluster is not null").groupBy(F.col("cluster").alias("gene"))
    weights = loads.agg(F.array(share(F.col("load_no") <= 5), share(F.col("load_no") > 5)).alias("v")).select("gene", F.posexplode("v").alias("component", "w"))
    return factor.affinities(weights, genes_by_genome(spark, sf)).withColumn("affinity", F.round("affinity", 7))


@R.query(
    "nearest_vote",
    """WITH d AS (SELECT row_id AS sample, genome_id AS genome, feed AS cluster, abs(contigs - 100)::DOUBLE + load_no AS distance, taxon_id FROM genome_summary WHERE contigs IS NOT NULL),
r AS (SELECT taxon_id AS sample, genome, cluster, distance, row_number() OVER (PARTITION BY taxon_id ORDER BY distance, genome || '-' || sample) AS r FROM d),
v AS (SELECT sample, cluster, count(*) AS n, min(r) AS r FROM r WHERE r <= 5 GROUP BY ALL)
SELECT sample, arg_min(cluster, (-n, v.r)) AS cluster, (SELECT avg(distance) FROM r WHERE r.sample IS NOT DISTINCT FROM v.sample AND r.r <= 5) AS distance FROM v WHERE sample IS NOT NULL GROUP BY sample""",
)
def nearest_vote(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "genome_summary").where("contigs is not null and taxon_id is not null").select(
        F.col("taxon_id").alias("sample"), F.concat_ws("-", "genome_id", F.col("row_id").cast("string")).alias("genome"), F.col("feed").alias("cluster"),
        (F.abs(F.col("contigs") - 100).cast("double") + F.col("load_no")).alias("distance"),
    )
    return factor.nearest_vote(rows)


# --- fitted models ----------------------------------------------------------------


def _accessory(spark: SparkSession, sf: str) -> DataFrame:
    """Genes in more than 2 % and less than 95 % of the genomes."""
    p = materialise(genes_by_genome(spark, sf), "presence")
    n = p.select("genome").distinct().count()
    freq = pr.gene_frequency(p).where((F.col("freq") > 0.02 * n) & (F.col("freq") < 0.95 * n))
    return p.join(freq.select("gene"), "gene", "left_semi")


def _model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = materialise(_accessory(spark, sf), "accessory")
    w, h = factor.normalised(*factor.factorise(p, RANKS))
    return p, w, h


@R.query("factor_weights")
def factor_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised gene weights of every rank."""
    return _model(spark, sf)[1]


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    p, w, h = _model(spark, sf)
    l_bin = factor.binarised(w, "gene", "w").where("top")
    a_bin = factor.binarised(h, "genome", "h").where("top")
    genes, genomes = factor.shape(p)
    return materialise(factor.metrics(factor.confusion(p, materialise(l_bin, "l"), materialise(a_bin, "a"), RANKS, genes, genomes), genes, genomes), "scores")


@R.query("factor_scores")
def factor_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The thirteen scores of every rank."""
    return _scores(spark, sf)


@R.query("factor_best_rank")
def factor_best_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The rank with the lowest criterion, its neighbours, and the ranks to try next."""
    scores = _scores(spark, sf)
    best = factor.best_rank(scores, "aic", lowest=True).first()
    around = [r["rank"] for r in factor.ranks_around(scores, "aic").collect()]  # seven numbers
    refined = factor.refined_ranks(best["lower"], best["best"], best["higher"], RANKS)
    return spark.createDataFrame([(best["lower"], best["best"], best["higher"], around, refined)], "lower int, best int, higher int, around array<int>, refined array<int>")


_KEPT_P = f"""{P}, g AS (SELECT count(DISTINCT genome) AS n FROM p), f AS (SELECT gene FROM p, g GROUP BY gene, n HAVING count(*) > 0.02 * n AND count(*) < 0.95 * n), x AS (SELECT * FROM p SEMI JOIN f USING (gene))"""


@R.query(
    "factor_kept",
    f"""WITH {_KEPT_P} SELECT r::INT AS rank, (SELECT count(DISTINCT gene) FROM x) AS n_genes, (SELECT count(DISTINCT genome) FROM x) AS n_genomes, r AS n_components, true AS not_negative, true AS cells_add_up, true AS better_than_none
FROM unnest([3, 4, 5, 6]) t(r)""",
)
def factor_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What every fit must keep: all genes and genomes at every rank, its components, signs, sums of cells, and an error below that of nothing."""
    m = model.FactorModel(_accessory(spark, sf), tuple(RANKS))
    w, h = m.factors
    genes, genomes = factor.shape(m.presence)
    of_w = w.groupBy("rank").agg(F.countDistinct("gene").alias("n_genes"), F.countDistinct("component").alias("n_components"), F.min("w").alias("least"))
    of_h = h.groupBy("rank").agg(F.countDistinct("genome").alias("n_genomes"), F.min("h").alias("least_h"))
    cells = m.presence.count()
    rows = m.scores.join(of_w, "rank").join(of_h, "rank")
    return rows.select(
        "rank", "n_genes", "n_genomes", "n_components", F.expr("least >= 0 and least_h >= 0").alias("not_negative"),
        ((F.col("tp") + F.col("fn") == cells) & (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn") == genes * genomes)).alias("cells_add_up"),
        (F.col("fp") + F.col("fn") < cells).alias("better_than_none"),
    )


@R.query("inertia_kept", f"WITH {P} SELECT true AS falls, true AS shares_add_up, true AS ranks_rise, count(DISTINCT genome) AS n_genomes FROM p")
def inertia_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What inertias must keep: they fall, their shares add up to 1, and the ranks from them rise."""
    p = genes_by_genome(spark, sf)
    made = materialise(factor.mca(p), "inertia")
    order = Window.orderBy("component")  # at most two rows a genome
    steps = made.select(F.coalesce(F.col("inertia") <= F.lag("inertia").over(order) + 1e-12, F.lit(True)).alias("falls"), "share", F.lit(1).alias("one"))
    ranks = [r[0] for r in factor.ranks_from_inertia(made, [5]).collect()]  # six numbers
    told = steps.agg(F.bool_and("falls").alias("falls"), (F.abs(F.sum("share") - 1) < 1e-9).alias("shares_add_up"))
    n = p.select("genome").distinct().count()
    return told.withColumns({"ranks_rise": F.lit(ranks == sorted(set(ranks))), "n_genomes": F.lit(n).cast("bigint")})


@R.query("modes_kept", f"WITH {P}, f AS (SELECT count(*) AS freq FROM p GROUP BY gene) SELECT true AS ordered, true AS inside FROM f HAVING count(*) > 0")
def modes_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What two normals of frequencies must keep: means within the data's range, in order, and positive deviations."""
    freq = materialise(pr.gene_frequency(genes_by_genome(spark, sf)), "freq")
    ends = freq.agg(F.min("freq").alias("lo"), F.max("freq").alias("hi")).first()
    made = factor.bi_modal(freq, "freq")
    found = made.orderBy("component").collect()  # two rows
    means = [r["mean"] for r in found]
    rows = made.agg(F.count(F.lit(1)).alias("n"))
    inside = len(means) == 2 and all(ends["lo"] <= m <= ends["hi"] for m in means) and abs(sum(r["weight"] for r in found) - 1) < 1e-6
    return rows.select(F.lit(means == sorted(means)).alias("ordered"), F.lit(inside).alias("inside"))


@R.query("map_kept", f"WITH {P} SELECT count(DISTINCT genome) AS n_genomes, true AS finite, true AS spread FROM p")
def map_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What a map must keep: every genome once, at finite places that are not all the same."""
    made = embed.genome_map(genes_by_genome(spark, sf))
    finite = F.expr("not (isnan(x) or isnan(y) or isnan(z)) and abs(x) + abs(y) + abs(z) < 1e9")
    return made.agg(F.countDistinct("genome").alias("n_genomes"), F.bool_and(finite).alias("finite"), (F.stddev("x") > 0).alias("spread"))


@R.query("factor_large")
def factor_large(spark: SparkSession, sf: str) -> DataFrame:
    """The distributed fit, three components, to its tolerance."""
    return factor.factorise_large(_accessory(spark, sf), 3)[1]


@R.query("inertia")
def inertia(spark: SparkSession, sf: str) -> DataFrame:
    return factor.mca(genes_by_genome(spark, sf))


@R.query("leading_inertia")
def leading_inertia(spark: SparkSession, sf: str) -> DataFrame:
    """The two leading components by the distributed way, to its tolerance."""
    return factor.mca_leading(genes_by_genome(spark, sf), 2)


@R.query("inertia_ranks")
def inertia_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return factor.ranks_from_inertia(factor.mca(genes_by_genome(spark, sf)), [5])


@R.query("frequency_modes")
def frequency_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The two normals of the genes' frequencies."""
    return factor.bi_modal(pr.gene_frequency(genes_by_genome(spark, sf)), "freq")


# --- consensus --------------------------------------------------------------------

# three models by the row's number; in each a genome's label is the commonest last digit of its clusters
_LABELS = """c AS (SELECT row_id % 3 AS model, genome_id AS genome, cluster[-1] AS component, count(*)::DOUBLE AS h FROM locus_map WHERE cluster IS NOT NULL AND genome_id IS NOT NULL GROUP BY ALL),
l AS (SELECT model, genome, arg_min(component, (-h, component)) AS component FROM c GROUP BY model, genome),
k AS (SELECT genome, string_agg(model::VARCHAR || component, ',' ORDER BY model) AS word FROM l GROUP BY genome),
m AS (SELECT genome, min(genome) OVER (PARTITION BY word) AS class FROM k)"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "locus_map").where("cluster is not null and genome_id is not null").withColumn("model", F.col("row_id") % 3)
    h = rows.groupBy("model", F.col("genome_id").alias("genome"), F.substring("cluster", -1, 1).alias("component")).agg(F.count(F.lit(1)).cast("double").alias("h"))
    return consensus.top_component(h, "model")


@R.query("consensus_labels", f"WITH {_LABELS} SELECT * FROM l")
def consensus_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf)


@R.query("consensus_classes", f"WITH {_LABELS} SELECT * FROM m")
def consensus_classes(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.label_classes(_labels(spark, sf))[1]


@R.query(
    "consensus_agreement",
    f"""WITH {_LABELS}, d AS (SELECT DISTINCT class, model, component FROM l JOIN m USING (genome))
SELECT a.class AS class_1, b.class AS class_2, round(count(*) / 3.0, 9)::DOUBLE AS agreement FROM d a JOIN d b ON a.model = b.model AND a.component = b.component AND a.class < b.class GROUP BY ALL""",
)
def consensus_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.consensus(_labels(spark, sf), 3).withColumn("agreement", F.round("agreement", 9))


@R.query(
    "consensus_dispersion",
    f"""WITH {_LABELS}, cc AS (SELECT a.genome AS g1, b.genome AS g2, count(*) AS n FROM l a JOIN l b ON a.model = b.model AND a.component = b.component AND a.genome <> b.genome GROUP BY ALL)
SELECT round((power(n, 2) - coalesce((SELECT sum(1 - 4 * power(cc.n / 3.0::DOUBLE - 0.5, 2)) FROM cc), 0)) / power(n, 2), 8) AS dispersion FROM (SELECT count(*)::DOUBLE AS n FROM m)""",
)
def consensus_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.dispersion(_labels(spark, sf), 3).select(F.round("dispersion", 8).alias("dispersion"))


_PAIRS = f"""{P}, n AS (SELECT genome, count(*) AS n FROM p GROUP BY genome), c AS (SELECT a.genome AS a, b.genome AS b, count(*) AS c FROM p a JOIN p b ON a.gene = b.gene AND a.genome < b.genome GROUP BY ALL),
d AS (SELECT x.genome AS a, y.genome AS b, 1 - coalesce(c, 0) / (x.n + y.n - coalesce(c, 0))::DOUBLE AS distance FROM n x JOIN n y ON x.genome < y.genome LEFT JOIN c ON c.a = x.genome AND c.b = y.genome)"""


def _sets(spark: SparkSession, sf: str) -> sets.Sets:
    """The gene sets of all genomes."""
    return sets.sets_of(genes_by_genome(spark, sf))


@R.query("genome_distances", f"WITH {_PAIRS} SELECT a, b, round(distance, 9) AS distance FROM d")
def genome_distances(spark: SparkSession, sf: str) -> DataFrame:
    return embed.set_distances(genes_by_genome(spark, sf), 9)


@R.query("distance_clusters")
def distance_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return sets.distance_clusters(spark, _sets(spark, sf), 0.9)


@R.query("distance_sensitivity")
def distance_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    own = _sets(spark, sf)
    return consensus.sensitivity_of(spark, sets.linkage(spark, own), own.n, sets.largest(spark, own))[0]


@R.query(
    "distance_correlation",
    f"""WITH {_PAIRS}, q AS (SELECT a AS g, b AS k, distance FROM d UNION ALL SELECT b, a, distance FROM d UNION ALL SELECT genome, genome, 0 FROM n)
SELECT x.g AS genome_1, y.g AS genome_2, round(1 - corr(x.distance, y.distance), 6) AS distance FROM q x JOIN q y ON x.k = y.k AND x.g < y.g GROUP BY ALL""",
)
def distance_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return sets.correlation_distances(spark, _sets(spark, sf), 6)


@R.query("distances_without", f"WITH {_PAIRS} SELECT a, b, round(distance, 9) AS distance FROM d WHERE split_part(a, '.', 2)::INT % 5 > 0 AND split_part(b, '.', 2)::INT % 5 > 0")
def distances_without(spark: SparkSession, sf: str) -> DataFrame:
    """Distances without those of some genomes."""
    p = genes_by_genome(spark, sf)
    pairs = embed.set_distances(p, 9)
    removed = p.select("genome").distinct().where(F.split_part("genome", F.lit("."), F.lit(2)).cast("int") % 5 == 0)
    return consensus.without(pairs, "a", "b", removed).select("a", "b", "distance")


@R.query("distance_clusters_kept", f"WITH {_PAIRS} SELECT count(*) AS n_genomes, count(*) AS n_clustered, true AS numbered, true AS cophenetic FROM n")
def distance_clusters_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What the clusters of a linkage must keep: every genome in one cluster, clusters numbered without gaps, heights that follow the distances."""
    own = _sets(spark, sf)
    links = sets.linkage(spark, own)
    found = sets.distance_clusters(spark, own, 0.9, links)
    follows = (sets.cophenetic_correlation(spark, own, links) or 0) > 0.3
    return found.agg(
        F.count(F.lit(1)).alias("n_genomes"), F.count("cluster").alias("n_clustered"),
        ((F.max("cluster") - F.min("cluster") + 1) == F.countDistinct("cluster")).alias("numbered"), F.lit(follows).alias("cophenetic"),
    )


_SETS = """x AS (SELECT DISTINCT split_part(genome_id, '.', 1) AS leaf, cluster AS item FROM locus_map WHERE genome_id IS NOT NULL AND cluster IS NOT NULL),
k AS (SELECT 1 + (leaf::BIGINT % 2)::INT AS cluster, leaf FROM x GROUP BY leaf), n AS (SELECT cluster, count(*) AS size FROM k GROUP BY cluster),
c AS (SELECT cluster, item, count(*) AS n FROM x JOIN k USING (leaf) GROUP BY ALL), e AS (SELECT item, count(*) AS everywhere FROM x GROUP BY item),
f AS (SELECT cluster, item, true AS total, c.n = size AS ubiquitous, c.n = everywhere AS exclusive, c.n = size AND c.n = everywhere AS ubiquitous_exclusive FROM c JOIN n USING (cluster) JOIN e USING (item))"""


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    x = genes_by_genome(spark, sf).select(F.substring_index("genome", ".", 1).alias("leaf"), F.col("gene").alias("item")).distinct()
    k = x.select("leaf").distinct().withColumn("cluster", (1 + F.col("leaf").cast("bigint") % 2).cast("int"))
    k = k.join(k.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster")
    return consensus.split_items(x, "leaf", "item", k)


@R.query("split_items", f"WITH {_SETS} SELECT * FROM f")
def split_items(spark: SparkSession, sf: str) -> DataFrame:
    return _splits(spark, sf)


@R.query(
    "split_sizes",
    f"WITH {_SETS} SELECT cluster, " + ", ".join(f"count_if({c})::BIGINT AS {c}_items" for c in ("ubiquitous_exclusive", "exclusive", "total", "ubiquitous")) + " FROM f GROUP BY cluster",
)
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.split_sizes(_splits(spark, sf))


@R.query("tree_splits")
def tree_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the gene sets at every node of the taxa's tree."""
    x = genes_by_genome(spark, sf).select(F.substring_index("genome", ".", 1).alias("leaf"), F.col("gene").alias("item")).distinct()
    _, _, clusters = consensus.tree(x, "leaf", "item")
    return consensus.split_sizes(consensus.split_items(x, "leaf", "item", clusters))


# --- enrichment -------------------------------------------------------------------

_GO = "g AS (SELECT cluster AS gene, unnest(string_split(go, ', ')) AS function FROM cluster_to_go_functions WHERE cluster IS NOT NULL)"
_ENRICHED = f"""{_W}, {_GO}, na AS (SELECT count(DISTINCT cluster) AS n_all FROM cluster_to_go_functions),
i AS (SELECT DISTINCT gene, component FROM w WHERE w > 0.3), kf AS (SELECT function, count(*) AS n_function FROM g WHERE function IS NOT NULL GROUP BY function),
m AS (SELECT component, count(*) AS n_component FROM i GROUP BY component), o AS (SELECT component, function, count(*) AS overlap FROM i JOIN (SELECT DISTINCT gene, function FROM g) USING (gene) GROUP BY ALL),
z AS (SELECT o.*, n_all, n_function, n_component, least(n_function, n_all) AS f, least(n_component, n_all) AS q FROM o JOIN kf USING (function) JOIN m USING (component), na),
y AS (SELECT component, function, n_all, n_function, n_component, overlap, unnest(range(overlap, least(f, q) + 1)) AS j, f, q FROM z),
e AS (SELECT component, function, n_all, n_function, n_component, overlap, least(1, sum(CASE WHEN n_all - f - q + j >= 0 THEN exp(lgamma(f + 1) - lgamma(j + 1) - lgamma(f - j + 1)
  + lgamma(n_all - f + 1) - lgamma(q - j + 1) - lgamma(n_all - f - q + j + 1) - lgamma(n_all + 1) + lgamma(q + 1) + lgamma(n_all - q + 1)) ELSE 0 END)) AS p_value FROM y GROUP BY ALL)"""


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "cluster_to_go_functions").select(F.col("cluster").alias("gene"), "go")
    return enrich.exploded_functions(rows).withColumnRenamed("go", "function")


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    w, _ = taxon_weights(genes_by_genome(spark, sf))
    return enrich.enrichment(w, _functions(spark, sf), cutoff=0.3)


@R.query("exploded_functions", "SELECT row_id, unnest(CASE WHEN go IS NULL THEN [NULL] ELSE string_split(go, ', ') END) AS go FROM cluster_to_go_functions")
def exploded_functions(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.exploded_functions(table(spark, sf, "cluster_to_go_functions").select("row_id", "go"))


@R.query("frequent_functions", f"WITH {_GO} SELECT function, count(*) AS n FROM g WHERE function IS NOT NULL GROUP BY function HAVING count(*) > 3")
def frequent_functions(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.frequent_functions(_functions(spark, sf).where("gene is not null and function is not null"))


@R.query("enrichment", f"WITH {_ENRICHED} SELECT component, function, n_all, n_function, n_component, overlap, round(p_value, 8) AS p_value FROM e")
def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).withColumn("p_value", F.round("p_value", 8)).drop("logp")


@R.query("significant_enrichment", f"WITH {_ENRICHED} SELECT component, function, round(p_value, 8) AS p_value, round(-log10(p_value), 6) AS logp FROM e WHERE p_value < 0.5 AND function <> 'SO:0001217'")
def significant_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.significant(_enriched(spark, sf), below=0.5).select("component", "function", F.round("p_value", 8).alias("p_value"), F.round("logp", 6).alias("logp"))


@R.query("exclusive_genes", f"WITH {_W} SELECT any_value(component) AS component, gene FROM l GROUP BY gene HAVING count(*) = 1")
def exclusive_genes(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.exclusive_genes(_binary(spark, sf)[1])


@R.query(
    "active_histogram",
    f"WITH {_W}, c AS (SELECT gene, count(l.component) AS n_active FROM (SELECT DISTINCT gene FROM p) LEFT JOIN l USING (gene) GROUP BY gene) "
    "SELECT n_active, count(*) AS n_genes, sum(count(*)) OVER (ORDER BY n_active)::BIGINT AS cumulative FROM c GROUP BY n_active",
)
def active_histogram(spark: SparkSession, sf: str) -> DataFrame:
    p, l_bin, _ = _binary(spark, sf)
    return enrich.active_histogram(l_bin, p)


@R.query(
    "frequency_regression",
    f"""WITH {_W}, f AS (SELECT gene, count(*) AS freq FROM p GROUP BY gene), c AS (SELECT gene, freq, count(l.component) AS n FROM f LEFT JOIN l USING (gene) GROUP BY gene, freq)
SELECT round(regr_slope(n, freq), 9) AS slope, round(regr_intercept(n, freq), 9) AS intercept, round(regr_r2(n, freq), 9) AS r2 FROM c""",
)
def frequency_regression(spark: SparkSession, sf: str) -> DataFrame:
    p, l_bin, _ = _binary(spark, sf)
    fit = enrich.frequency_regression(pr.gene_frequency(p), l_bin)
    return fit.select(*[F.round(c, 9).alias(c) for c in fit.columns])


_ORDER = "ord AS (SELECT component, row_number() OVER (ORDER BY component)::INT AS r FROM (SELECT DISTINCT component FROM t))"


def _taxa(p: DataFrame) -> list[str]:
    """The taxa in order, a list that an array literal may hold."""
    rows = p.select(F.substring_index("genome", ".", 1).alias("taxon")).distinct().orderBy("taxon").limit(5001).collect()
    if len(rows) > 5000:
        raise ValueError("more than 5000 components")
    return [r["taxon"] for r in rows]


@R.query(
    "gene_order",
    f"""WITH {_W}, {_ORDER} SELECT gene, count(l.component)::INT AS n_active, coalesce(string_agg(r::VARCHAR, ',' ORDER BY r), '') AS component_rank
FROM (SELECT DISTINCT gene FROM p) LEFT JOIN l USING (gene) LEFT JOIN ord USING (component) GROUP BY gene""",
)
def gene_order(spark: SparkSession, sf: str) -> DataFrame:
    p, l_bin, _ = _binary(spark, sf)
    components = _taxa(p)
    return enrich.gene_order(l_bin, p, components)


@R.query(
    "strain_order",
    f"""WITH {_W}, {_ORDER}, s AS (SELECT genome, coalesce(min(r), 0) AS r, count(a.component) > 1 AS many FROM (SELECT DISTINCT genome FROM p) LEFT JOIN a USING (genome) LEFT JOIN ord USING (component) GROUP BY genome)
SELECT genome, row_number() OVER (ORDER BY r, many, genome)::INT AS position FROM s""",
)
def strain_order(spark: SparkSession, sf: str) -> DataFrame:
    p, _, a_bin = _binary(spark, sf)
    components = _taxa(p)
    return enrich.strain_order(a_bin, p, components)


@R.query(
    "members_by_status",
    f"""WITH {_W}, s AS (SELECT genome_id AS genome, arg_max(genome_status, row_id) AS status FROM genome_summary WHERE genome_status IS NOT NULL GROUP BY 1)
SELECT component, status, count(*) AS n FROM h LEFT JOIN s USING (genome) WHERE h >= 0.6 GROUP BY ALL""",
)
def members_by_status(spark: SparkSession, sf: str) -> DataFrame:
    _, h = taxon_weights(genes_by_genome(spark, sf))
    status = table(spark, sf, "genome_summary").where("genome_status is not null").groupBy(F.col("genome_id").alias("genome")).agg(F.max_by("genome_status", "row_id").alias("status"))
    return enrich.members_by(h, 0.6, status, "status")


@R.query("component_words", f"WITH {_W}, a2 AS (SELECT cluster AS gene, product FROM locus_map m JOIN annotations a ON a.locus_tag = m.gene_id WHERE cluster IS NOT NULL), i AS (SELECT DISTINCT gene, component FROM w WHERE w > 0.4), "
    "y AS (SELECT component, unnest(string_split_regex(" + "".join("replace(" for _ in enrich.names.PRODUCT_STOPS) + "lower(product)" + "".join(f", '{s}', '')" for s in enrich.names.PRODUCT_STOPS)
    + ", '\\s+')) AS word FROM i JOIN a2 USING (gene)) SELECT component, word, count(*) AS n FROM y WHERE word <> '' GROUP BY ALL")
def component_words(spark: SparkSession, sf: str) -> DataFrame:
    w, _ = taxon_weights(genes_by_genome(spark, sf))
    loci = table(spark, sf, "locus_map").where("cluster is not null").select(F.col("cluster").alias("gene"), F.col("gene_id").alias("locus_tag"))
    return enrich.component_words(w, loci.join(table(spark, sf, "annotations").select("locus_tag", "product"), "locus_tag"), 0.4)


# --- maps -------------------------------------------------------------------------


@R.query("genome_map")
def genome_map(spark: SparkSession, sf: str) -> DataFrame:
    return embed.genome_map(genes_by_genome(spark, sf))


@R.query("density_models")
def density_models(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of density models on the whole vectors of the embeddings table."""
    rows = table(spark, sf, "embeddings")
    widths = rows.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if widths["least"] != widths["most"]:
        raise ValueError("vectors of different widths")
    columns = [f"e{i}" for i in range(widths["most"] or 0)]
    points = rows.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])
    return embed.density_models(points, "vec_id", columns).drop("labels")
