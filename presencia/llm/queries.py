"""Queries of this subpackage on their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.llm import leaks, looks, mixture, similar, together
from presencia.plans.registry import Registry
from presencia.session import table

R = Registry()

# --- items that appear together ---------------------------------------------------

_TOGETHER = """
WITH p AS (SELECT DISTINCT split_part(genome_id, '.', 1) AS t, genome_id AS g, cluster AS c FROM locus_map
           WHERE genome_id IS NOT NULL AND cluster IS NOT NULL),
n AS (SELECT t, count(DISTINCT g) AS n FROM p GROUP BY t),
i AS (SELECT t, c, count(*) AS n_i FROM p GROUP BY t, c),
b AS (SELECT a.t, a.c AS c1, b.c AS c2, count(*) AS n_12 FROM p a JOIN p b ON a.t = b.t AND a.g = b.g AND a.c < b.c GROUP BY ALL HAVING count(*) >= 4),
f AS (SELECT b.t AS taxon_id, c1 AS cluster_1, c2 AS cluster_2, n_12, x.n_i AS n_1, y.n_i AS n_2, n.n
      FROM b JOIN i x ON x.t = b.t AND x.c = c1 JOIN i y ON y.t = b.t AND y.c = c2 JOIN n ON n.t = b.t
      WHERE n_12 * n.n >= 2.5 * x.n_i * y.n_i)
"""


def _together(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "locus_map").select(F.substring_index("genome_id", ".", 1).alias("taxon_id"), "genome_id", "cluster")
    found = together.associated_pairs(rows, "taxon_id", "genome_id", "cluster", min_together=4, min_lift=2.5)
    return found.withColumnsRenamed({"item_1": "cluster_1", "item_2": "cluster_2"})


@R.query("p4_found", _TOGETHER + "SELECT taxon_id, cluster_1, cluster_2 FROM f")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _together(spark, sf).select("taxon_id", "cluster_1", "cluster_2")


@R.query(
    "p4_scores",
    _TOGETHER
    + """SELECT taxon_id, cluster_1, cluster_2, n_12, n_1, n_2, n, round(n_12 * n * 1.0 / (n_1 * n_2), 6) AS lift,
       round(CASE WHEN n_1 > n_12 THEN n_1 * (n - n_2) * 1.0 / (n * (n_1 - n_12)) END, 6) AS conviction FROM f""",
)
def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _together(spark, sf).withColumns({"lift": F.round("lift", 6), "conviction": F.round("conviction", 6)})


# --- similar sets -----------------------------------------------------------------

_SIMILAR = """
WITH p AS (SELECT DISTINCT genome_id AS g, cluster AS c FROM locus_map WHERE genome_id IS NOT NULL AND cluster IS NOT NULL),
k AS (SELECT g, count(*) AS k, md5(string_agg(c, chr(9) ORDER BY c)) AS h FROM p GROUP BY g),
m AS (SELECT a.g AS g1, b.g AS g2, count(*) AS m FROM p a JOIN p b ON a.c = b.c AND a.g < b.g GROUP BY ALL),
f AS (SELECT g1, g2, x.h = y.h AS same, y.h AS h2, x.h AS h1 FROM m JOIN k x ON x.g = g1 JOIN k y ON y.g = g2 WHERE 5 * m >= 4 * (x.k + y.k - m))
"""


@R.query("p6_found", _SIMILAR + "SELECT g1 AS genome_1, g2 AS genome_2 FROM f")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = similar.similar_records(table(spark, sf, "locus_map"), "genome_id", "cluster")
    return found.select(F.col("record_1").alias("genome_1"), F.col("record_2").alias("genome_2"))


@R.query(
    "p6_classes",
    _SIMILAR
    + """, s AS (SELECT h, count(*) AS n_copies, min(g) AS class_id FROM k GROUP BY h),
l AS (SELECT h, count(DISTINCT o) AS n_links FROM (SELECT h1 AS h, h2 AS o FROM f WHERE NOT same UNION ALL SELECT h2, h1 FROM f WHERE NOT same) GROUP BY h)
SELECT g AS genome_id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM k JOIN s USING (h) LEFT JOIN l USING (h)""",
)
def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    return similar.similar_classes(table(spark, sf, "locus_map"), "genome_id", "cluster").withColumnRenamed("record", "genome_id")


# --- texts in SQL ---------------------------------------------------------------


# Letters by the one that they look like, as stored, and by the one that their small forms go by where case does not matter.
# Written out here for themselves, so that the SQL does not follow the operator's table.
_LOOK = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІӀΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УҮΥ", "Z": "Ζ", "Æ": "Ӕ", "Ə": "Ә", "Ɛ": "Ԑ", "Ɵ": "Ө", "Ʒ": "Ӡ", "Þ": "Ϸ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уү",
    "æ": "ӕ", "ə": "ә", "ɛ": "ԑ", "ɵ": "ө", "ʒ": "ӡ", "þ": "ϸ", "Γ": "Г", "Π": "П", "Φ": "Ф", "Ψ": "Ѱ", "κ": "к", "φ": "ф", "ψ": "ѱ", "μ": "µ",
}
_SMALL = {
    "a": "аα", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еε", "f": "ϝ", "g": "ԍ", "h": "нηһ", "i": "іι", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "мμϻ", "o": "оο", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "t": "тτ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уүυ", "z": "ζ", "æ": "ӕ", "ə": "ә", "ɛ": "ԑ", "ɵ": "ө", "ʒ": "ӡ", "þ": "ϸ",
    "γ": "г", "π": "п", "φ": "ф", "ψ": "ѱ",
}


def _translation(table: dict[str, str]) -> list[tuple[str, str]]:
    return [(other, form) for form, others in table.items() for other in others]


def _looks_sql(text: str) -> str:
    """The canonical form in SQL: the rules of TESTDATA over fixed characters, then NFC."""
    wide = [(chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F)]
    spaces = [(s, " ") for s in "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"]
    pairs = [*wide, *spaces, *_translation(_LOOK), ("ё", "ë"), ("Ё", "Ë"), ("ї", "ï"), ("Ї", "Ï")]
    old, new = ("".join(p[i] for p in pairs).replace("'", "''") for i in (0, 1))
    invisible = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
    return f"nfc_normalize(translate(regexp_replace({text}, '[{invisible}]', '', 'g'), '{old}', '{new}'))"


# --- leaked passages --------------------------------------------------------------


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def _grams_sql(name: str, key: str) -> str:
    """Runs of 12 words of a table's texts: case and the differences of problem 10 removed."""
    pairs = dict(_translation(_SMALL))
    folded = f"translate(replace(lower({_looks_sql('text')}), 'ß', 'ss'), '{''.join(pairs)}', '{''.join(pairs.values())}')"
    words = f"SELECT {key}, regexp_extract_all({folded}, '[\\p{{L}}\\p{{N}}]+') AS v FROM {name} WHERE text IS NOT NULL"
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(v) - 10), lambda i: array_to_string(v[i:i + 11], ' '))) AS gram FROM ({words})"


@R.query("p8_found", f"SELECT DISTINCT item_id, doc_id FROM ({_grams_sql('eval_items', 'item_id')}) JOIN ({_grams_sql('documents', 'doc_id')}) USING (gram)")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    found = _leaks(spark, sf)
    return found.where(leaks.leaked(found)).select("item_id", "doc_id")


@R.query("p8_contained", f"SELECT DISTINCT item_id, doc_id FROM ({_grams_sql('eval_items', 'item_id')}) JOIN ({_grams_sql('documents', 'doc_id')}) USING (gram)")
def p8_contained(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs whose best overlap scores at least their longest equal run: all pairs of ``p8_found`` must be among them."""
    score = f"{leaks.EQUAL} * (overlap_words - substitutions) + ({leaks.SUBSTITUTED}) * substitutions"
    found = _leaks(spark, sf)
    return found.where(leaks.leaked(found)).where(f"overlap_words >= 12 and substitutions >= 0 and {score} >= equal_words").select("item_id", "doc_id")


@R.query("p8_overlaps")
def p8_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps of at least 12 words of which some may be substituted."""
    return _leaks(spark, sf).where("overlap_words >= 12")


# --- mixtures ---------------------------------------------------------------------


def _mixture(spark: SparkSession, sf: str) -> mixture.Mixture:
    counts = mixture.token_counts(table(spark, sf, "documents"), "doc_id", "source", "text")
    return mixture.mix(counts, table(spark, sf, "mix_targets"))


@R.query("p9_mixture")
def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).documents


@R.query(
    "p9_kept",
    """WITH d AS (SELECT source, count(*) AS n_docs FROM documents WHERE source IS NOT NULL AND text <> '' GROUP BY source)
SELECT coalesce(d.source, t.source) AS source, coalesce(n_docs, 0) AS n_docs, coalesce(n_docs > 0 AND target_share > 0 AND max_repeats > 0, false) AS takes_part,
       true AS share_met, true AS repeats_kept, true AS tokens_add_up FROM d FULL JOIN mix_targets t ON d.source = t.source""",
)
def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What every mixture must keep: shares within a percentage point, repeats, tokens, and which sources take part."""
    made = _mixture(spark, sf)
    docs = made.documents.groupBy("source").agg(F.max("copies").alias("most"), F.count(F.lit(1)).alias("used"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    rows = made.shares.join(docs, "source", "left")
    return rows.select(
        "source", "n_docs", (F.col("wanted_share") > 0).alias("takes_part"), (F.abs(F.col("actual_share") - F.col("wanted_share")) < 0.01).alias("share_met"),
        (F.coalesce("most", F.lit(0)) <= F.coalesce("max_repeats", F.lit(0))).alias("repeats_kept"),
        ((F.coalesce("tokens", F.lit(0)) == F.col("used_tokens")) & (F.coalesce("used", F.lit(0)) <= F.col("n_docs"))).alias("tokens_add_up"),
    )


@R.query("p9_shares")
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).shares


# --- look-alikes ------------------------------------------------------------------


_CANON = f"WITH d AS (SELECT doc_id, text, md5({_looks_sql('text')}) AS c FROM documents WHERE text IS NOT NULL AND text <> '')"


@R.query(
    "p10_found",
    _CANON + "SELECT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM d a JOIN d b ON a.c = b.c AND a.doc_id < b.doc_id AND a.text <> b.text",
)
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return looks.look_alike_pairs(table(spark, sf, "documents"), "doc_id", "text")


@R.query("p10_classes", _CANON + "SELECT doc_id, min(doc_id) OVER w AS class_id, count(DISTINCT text) OVER w AS n_forms FROM d WINDOW w AS (PARTITION BY c)")
def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    return looks.look_alike_classes(table(spark, sf, "documents"), "doc_id", "text")


@R.query("p10_canonical", _CANON + "SELECT doc_id, c AS canonical_md5 FROM d")
def p10_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of every document's canonical text."""
    docs = table(spark, sf, "documents").where("text is not null and text <> ''")
    return docs.select("doc_id", F.md5(looks.canonical_text(F.col("text"))).alias("canonical_md5"))
