"""Queries of gene order, on the genomes of the annotations: every gene at its first locus of a genome's main contig.

The reference is the genome with the most genes; its genes that most genomes have are the anchors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.operators import synteny as sy
from presencia.plans.registry import Registry
from presencia.session import materialise, table

R = Registry()

# --- genomes ----------------------------------------------------------------------

_LOCI = """m AS (SELECT gene_id, min(cluster) AS gene FROM locus_map WHERE cluster IS NOT NULL AND gene_id IS NOT NULL GROUP BY gene_id),
a AS (SELECT locus_tag AS locus, genome_id AS strain, min_by(sequence_id, row_id) AS contig, min_by(start_pos, row_id) AS start FROM annotations WHERE locus_tag IS NOT NULL GROUP BY ALL),
l AS (SELECT strain, contig, start, locus, gene FROM a LEFT JOIN m ON gene_id = locus)"""
_MAIN = _LOCI + """, c AS (SELECT strain, contig, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT strain, arg_min(contig, (-n, contig)) AS contig FROM c GROUP BY strain)"""


def _loci(spark: SparkSession, sf: str) -> DataFrame:
    genes = table(spark, sf, "locus_map").where("cluster is not null and gene_id is not null").groupBy(F.col("gene_id").alias("locus")).agg(F.min("cluster").alias("gene"))
    rows = table(spark, sf, "annotations").where("locus_tag is not null").groupBy(F.col("locus_tag").alias("locus"), F.col("genome_id").alias("strain"))
    first = rows.agg(F.min_by("sequence_id", "row_id").alias("contig"), F.min_by("start_pos", "row_id").alias("start"))
    return first.join(genes, "locus", "left")


def _text(genes: str = "genes") -> F.Column:
    return F.array_join(genes, ",", "-")


@R.query("strain_vectors", f"WITH {_MAIN} SELECT strain, string_agg(coalesce(gene, '-'), ',' ORDER BY start, locus) AS genes, count(*)::INT AS n_genes FROM l JOIN b USING (strain, contig) GROUP BY strain")
def strain_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = sy.strain_vectors(_loci(spark, sf))
    return vectors.select("strain", _text().alias("genes"), F.size("genes").alias("n_genes"))


@R.query("strain_lengths", f"WITH {_LOCI} SELECT strain, count(*)::INT AS n_genes FROM l GROUP BY strain HAVING count(*) <= 120")
def strain_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return sy.lengths(sy.up_to(sy.strain_vectors(_loci(spark, sf), main_contig=False), 120))


_COMMON = _LOCI + ", k AS (SELECT gene, strain, count(*) AS n FROM l WHERE gene IS NOT NULL GROUP BY ALL), s AS (SELECT count(DISTINCT strain) AS s FROM l)"


@R.query("common_gene_counts", f"WITH {_COMMON} SELECT gene, strain, n FROM k SEMI JOIN (SELECT gene FROM k, s GROUP BY gene, s HAVING count(*) = s) USING (gene)")
def common_gene_counts(spark: SparkSession, sf: str) -> DataFrame:
    vectors = materialise(sy.strain_vectors(_loci(spark, sf), main_contig=False), "vectors")
    return sy.common_gene_counts(vectors, vectors.count())


# --- orders compared --------------------------------------------------------------

ANCHORS = 12
#: Genes that all strains have are looked for among the genomes of the taxon with the most of them.
_V = f"""{_MAIN}, f AS (SELECT strain, gene, start, locus, row_number() OVER (PARTITION BY strain, gene ORDER BY start, locus) AS k FROM l JOIN b USING (strain, contig) WHERE gene IS NOT NULL),
v0 AS (SELECT strain, gene, row_number() OVER (PARTITION BY strain ORDER BY start, locus) AS start FROM f WHERE k = 1),
r0 AS (SELECT strain FROM v0 GROUP BY strain ORDER BY count(*) DESC, strain LIMIT 1),
n0 AS (SELECT gene, count(*) AS n FROM v0 GROUP BY gene),
ch AS (SELECT gene FROM v0 JOIN n0 USING (gene) WHERE strain = (SELECT strain FROM r0) ORDER BY n DESC, gene LIMIT {ANCHORS}),
w AS (SELECT strain, gene, start, gene IN (SELECT gene FROM ch) AS chosen FROM v0),
v AS (SELECT strain, list(gene ORDER BY start) AS genes FROM w GROUP BY strain),
o AS (SELECT strain, coalesce(list(gene ORDER BY start) FILTER (chosen), []) AS own FROM w GROUP BY strain)"""
_REF = "(SELECT strain FROM r0)"


def _genomes(spark: SparkSession, sf: str) -> DataFrame:
    vectors = sy.strain_vectors(_loci(spark, sf)).select("strain", F.array_distinct(F.array_compact("genes")).alias("genes"))
    return materialise(vectors.where(F.size("genes") > 0), "vectors")


def _reference(vectors: DataFrame) -> tuple[str, list[str]]:
    """The reference strain and the genes chosen from it."""
    (strain,) = vectors.orderBy(F.desc(F.size("genes")), "strain").limit(1).select("strain").first()
    counts = vectors.select(F.explode("genes").alias("gene")).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    own = vectors.where(F.col("strain") == strain).select(F.explode("genes").alias("gene"))
    return strain, [r["gene"] for r in own.join(counts, "gene").orderBy(F.desc("n"), "gene").limit(ANCHORS).collect()]


def _largest_taxon(vectors: DataFrame) -> DataFrame:
    taxon = F.substring_index("strain", ".", 1)
    largest = vectors.groupBy(taxon.alias("t")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "t").limit(1)
    return vectors.join(F.broadcast(largest), taxon == F.col("t"), "left_semi")


_TAXON = f"""{_MAIN}, g AS (SELECT strain, gene FROM l JOIN b USING (strain, contig)), t AS (SELECT split_part(strain, '.', 1) AS t FROM (SELECT DISTINCT strain FROM g) GROUP BY t ORDER BY count(*) DESC, t LIMIT 1),
q AS (SELECT * FROM g WHERE split_part(strain, '.', 1) = (SELECT t FROM t)), k AS (SELECT gene, strain, count(*) AS n FROM q WHERE gene IS NOT NULL GROUP BY ALL)"""


@R.query("once_genes", f"WITH {_TAXON} SELECT gene FROM k GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT strain) FROM q) AND max(n) = 1")
def once_genes(spark: SparkSession, sf: str) -> DataFrame:
    """Genes that are once in every genome of the largest taxon."""
    vectors = materialise(_largest_taxon(sy.strain_vectors(_loci(spark, sf))), "vectors")
    return sy.once_genes(vectors, vectors.count())


@R.query("ordered_genes", f"WITH {_V} SELECT gene, (row_number() OVER (ORDER BY start NULLS LAST, gene))::INT AS position FROM n0 LEFT JOIN (SELECT gene, start FROM w WHERE strain = {_REF}) USING (gene)")
def ordered_genes(spark: SparkSession, sf: str) -> DataFrame:
    """All genes by their places in the reference."""
    vectors = _genomes(spark, sf)
    return sy.ordered_in(vectors, vectors.select(F.explode("genes").alias("gene")).distinct(), _reference(vectors)[0])


_TURN = "list_concat({l}[list_position({l}, {g}):], {l}[:list_position({l}, {g}) - 1])"


@R.query(
    "standard_orders",
    f"""WITH {_V}, r AS (SELECT own AS ref FROM o WHERE strain = {_REF}),
t AS (SELECT strain, ref, list_reverse(ref) AS rev, {_TURN.format(l="own", g="ref[1]")} AS x, {_TURN.format(l="own", g="ref[-1]")} AS y FROM o, r),
s AS (SELECT strain, CASE WHEN x = ref OR y = ref THEN 'same' WHEN x = rev OR y = rev THEN 'flipped' ELSE 'problem' END AS state FROM t)
SELECT strain, state, list_aggregate(CASE WHEN state = 'flipped' THEN list_reverse(genes) ELSE genes END, 'string_agg', ',') AS genes FROM v JOIN s USING (strain)""",
)
def standard_orders(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _genomes(spark, sf)
    reference, chosen = _reference(vectors)
    out = sy.standardised(vectors, chosen, reference)
    return out.select("strain", "state", _text().alias("genes"))


_ORDERS = f"""{_V}, q AS (SELECT strain, own, list_reverse(own) AS back, list_aggregate(own, 'min') AS g FROM o),
y AS (SELECT strain, coalesce(least(array_to_string({_TURN.format(l="own", g="g")}, ','), array_to_string({_TURN.format(l="back", g="g")}, ',')), '') AS form FROM q),
s AS (SELECT form, row_number() OVER (ORDER BY count(*) DESC, min(strain))::INT AS strain_group FROM y GROUP BY form), z AS (SELECT strain, strain_group FROM y JOIN s USING (form))"""


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _genomes(spark, sf)
    return sy.order_groups(vectors, _reference(vectors)[1])


@R.query(
    "order_groups",
    f"""WITH {_ORDERS}
SELECT strain, strain_group FROM z""",
)
def order_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _grouped(spark, sf)


@R.query("largest_order_group", f"WITH {_ORDERS} SELECT strain FROM z WHERE strain_group = 1")
def largest_order_group(spark: SparkSession, sf: str) -> DataFrame:
    return sy.largest_group(_grouped(spark, sf))


# anchors: the chosen genes numbered by their order in the reference
_ANCHORED = f"""{_V}, n AS (SELECT gene, row_number() OVER (ORDER BY start)::INT AS anchor FROM w WHERE strain = {_REF} AND chosen),
e AS (SELECT w.strain, w.gene, n.anchor, start AS pos, count(*) OVER (PARTITION BY w.strain) AS len FROM w LEFT JOIN n USING (gene)),
d AS (SELECT strain, count_if(anchor > nxt) * 2 > count(*) AS reversed FROM (SELECT strain, anchor, coalesce(lead(anchor) OVER w, first_value(anchor) OVER w) AS nxt FROM e WHERE anchor IS NOT NULL WINDOW w AS (PARTITION BY strain ORDER BY pos)) GROUP BY strain),
g AS (SELECT e.* EXCLUDE (pos), CASE WHEN reversed THEN len + 1 - pos ELSE pos END AS pos, coalesce(reversed, false) AS reversed FROM e LEFT JOIN d USING (strain)),
h AS (SELECT g.* EXCLUDE (pos), (pos - coalesce(one, 1) + len) % len AS pos, coalesce(one, 1) > 1 AS changed FROM g LEFT JOIN (SELECT strain, pos AS one FROM g WHERE anchor = 1) USING (strain))"""


def _anchored(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _genomes(spark, sf)
    reference, genes = _reference(vectors)
    chosen = F.array(*[F.lit(g) for g in genes])
    own = vectors.where(F.col("strain") == reference).select(F.posexplode(sy.only(F.col("genes"), chosen)).alias("pos", "gene"))
    rising = sy.rising(sy.with_anchors(vectors, own.select("gene", (F.col("pos") + 1).alias("anchor"))))
    return materialise(sy.from_one(rising).join(rising.select("strain", "reversed"), "strain"), "anchored")


@R.query(
    "anchored_vectors",
    f"""WITH {_ANCHORED}, s AS (SELECT strain, list(anchor ORDER BY pos) AS n FROM h WHERE anchor IS NOT NULL GROUP BY strain)
SELECT strain, string_agg(coalesce(anchor::VARCHAR, gene), ',' ORDER BY pos) AS items, any_value(reversed) AS reversed, any_value(changed) AS changed, coalesce(any_value(n) = range(1, len(any_value(n)) + 1), false) AS strict FROM h LEFT JOIN s USING (strain) GROUP BY strain""",
)
def anchored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _anchored(spark, sf)
    items = F.array_join(F.transform("items", lambda x: F.coalesce(x["anchor"].cast("string"), x["gene"])), ",")
    return rows.join(sy.strictly_ordered(rows), "strain").select("strain", items.alias("items"), "reversed", "changed", "strict")


_PLACES = f"""{_ANCHORED}, k AS (SELECT strain, anchor, pos FROM h WHERE anchor IS NOT NULL),
p1 AS (SELECT h.strain, h.gene, arg_min(k.anchor, (h.pos - k.pos + len) % len) AS prev, min((h.pos - k.pos + len) % len) AS before,
  min((k.pos - h.pos + len) % len) AS after, arg_min(k.anchor, (k.pos - h.pos + len) % len) AS next FROM h JOIN k USING (strain) WHERE h.anchor IS NULL GROUP BY ALL)"""


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return sy.gene_places(_anchored(spark, sf))


@R.query("gene_places", f"WITH {_PLACES} SELECT strain, gene, prev || '_' || before || '_' || after || '_' || next AS place FROM p1")
def gene_places(spark: SparkSession, sf: str) -> DataFrame:
    return _places(spark, sf).select("strain", "gene", sy.place_name().alias("place"))


@R.query("genes_between_anchors", f"WITH {_PLACES} SELECT strain, prev || '-' || next AS anchors, count(*) AS n FROM p1 GROUP BY ALL")
def genes_between_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return sy.genes_between(_places(spark, sf))


@R.query(
    "missing_anchor_pairs",
    f"WITH {_PLACES}, wanted AS (SELECT DISTINCT strain, i || '-' || (i % {ANCHORS} + 1) AS anchors FROM p1, range(1, {ANCHORS + 1}) r(i)) SELECT * FROM wanted ANTI JOIN (SELECT strain, prev || '-' || next AS anchors FROM p1) USING (strain, anchors)",
)
def missing_anchor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sy.missing_anchor_pairs(_places(spark, sf), ANCHORS)


@R.query("anchor_pair_counts", f"WITH {_PLACES} SELECT gene, count(DISTINCT (least(prev, next), greatest(prev, next))) AS n_places FROM p1 GROUP BY gene")
def anchor_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sy.anchor_pair_counts(_places(spark, sf))


@R.query("genes_after_anchor", f"WITH {_PLACES} SELECT gene, arg_max(before, strain)::INT AS before FROM p1 WHERE prev = 1 AND next = 2 GROUP BY gene")
def genes_after_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return sy.between(_places(spark, sf), 1, 2)


@R.query("strain_genes_after_anchor", f"WITH {_PLACES} SELECT gene, before::INT AS before FROM p1 WHERE prev = 1 AND next = 2 AND strain = {_REF}")
def strain_genes_after_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return sy.between(_places(spark, sf), 1, 2, _reference(_genomes(spark, sf))[0])


@R.query(
    "variations",
    f"""WITH {_ANCHORED}, ranked AS (SELECT strain, pos, row_number() OVER (PARTITION BY strain ORDER BY anchor) AS r, count(*) OVER (PARTITION BY strain) AS k FROM h WHERE anchor IS NOT NULL),
stepped AS (SELECT strain, k, (coalesce(lead(r) OVER t, first_value(r) OVER t) - r + k) % k AS step FROM ranked WINDOW t AS (PARTITION BY strain ORDER BY pos)),
told AS (SELECT strain, count_if(step = 1) AS up, count_if(step = k - 1) AS down, count_if(step > 1 AND step < k - 1) AS breaks FROM stepped GROUP BY strain)
SELECT strain, CASE WHEN breaks = 0 THEN 'no variation' WHEN breaks = 2 THEN 'inversion' WHEN breaks = 3 AND least(up, down) = 0 THEN 'translocation' ELSE 'others' END AS variation FROM told""",
)
def variations(spark: SparkSession, sf: str) -> DataFrame:
    return sy.variations(_anchored(spark, sf))


# components: taxa; a taxon's genes are those that at least half of its genomes have

_GROUPS = f"""{_ORDERS}, tx AS (SELECT strain AS genome, split_part(strain, '.', 1) AS component FROM v),
g0 AS (SELECT component, strain_group, count(*) AS n FROM tx JOIN z ON strain = genome GROUP BY ALL)"""


def _taxa(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("strain").alias("genome"), F.substring_index("strain", ".", 1).alias("component"))


@R.query("group_counts", f"WITH {_GROUPS} SELECT * FROM g0")
def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    groups = _grouped(spark, sf)
    return sy.group_counts(groups, _taxa(groups))


@R.query("full_matches", f"WITH {_GROUPS} SELECT component, strain_group, g0.n FROM g0 JOIN (SELECT strain_group, count(*) AS s FROM z GROUP BY strain_group) USING (strain_group) WHERE g0.n = s")
def full_matches(spark: SparkSession, sf: str) -> DataFrame:
    groups = materialise(_grouped(spark, sf), "groups")
    return sy.full_matches(sy.group_counts(groups, _taxa(groups)), groups)


@R.query(
    "component_places",
    f"""WITH {_PLACES}, tx AS (SELECT strain AS genome, split_part(strain, '.', 1) AS component FROM v), cx AS (SELECT component, count(*) AS s FROM tx GROUP BY component ORDER BY s DESC, component LIMIT 1),
ux AS (SELECT gene FROM w JOIN tx ON genome = strain JOIN cx USING (component) GROUP BY gene, s HAVING 2 * count(*) >= s)
SELECT strain, gene, prev, next FROM p1 SEMI JOIN (SELECT genome FROM tx JOIN cx USING (component)) ON genome = strain SEMI JOIN ux USING (gene)""",
)
def component_places(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _genomes(spark, sf)
    taxa = _taxa(vectors)
    sizes = taxa.groupBy("component").agg(F.count(F.lit(1)).alias("s"))
    component = sizes.orderBy(F.desc("s"), "component").first()["component"]
    held = vectors.select(F.substring_index("strain", ".", 1).alias("component"), F.explode("genes").alias("gene")).groupBy("component", "gene").agg(F.count(F.lit(1)).alias("n"))
    l_bin = held.join(sizes, "component").where("2 * n >= s").select("gene", "component")
    return sy.of_component(_places(spark, sf), l_bin, taxa, component).select("strain", "gene", "prev", "next")
