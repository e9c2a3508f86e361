"""Feature names, ids and sequences as Column expressions.

A feature name is ``<name>_<C|T><cluster>[<A|U|D><variant>]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of feature names.
GRAMMAR = r"^(.*)_([CT])(\d+)(?:([AUD])(\d+))?$"
# The complements of the nucleotide symbols in use.
SYMBOLS, COMPLEMENTS = "ACGTWSRYMKNacgtwsrymkn", "TGCAWSYRKMNtgcawsyrkmn"
# Thousands of base pairs in each unit.
UNITS = {"Kb": 1e3, "Mb": 1e6, "Gb": 1e9}


def feature_name(name: Column, kind: Column, cluster: Column, variant_kind: Column | None = None, variant: Column | None = None) -> Column:
    """The composed name; the variant only where it has a number of 0 or more."""
    base = F.concat(name, F.lit("_"), kind, cluster.cast("string"))
    if variant_kind is None:
        return base
    has = variant_kind.isNotNull() & variant.isNotNull() & (variant >= 0)
    return F.when(has, F.concat(base, variant_kind, variant.cast("string"))).otherwise(base)


def feature_parts(feature: Column) -> Column:
    """A struct of name, cluster_type, cluster, variant_type and variant; nulls where a part is absent."""
    part = lambda i: F.nullif(F.regexp_extract(feature, GRAMMAR, i), F.lit(""))
    return F.struct(
        part(1).alias("name"), part(2).alias("cluster_type"), part(3).cast("int").alias("cluster"),
        part(4).alias("variant_type"), part(5).cast("int").alias("variant"),
    )


def trim_variant(feature: Column) -> Column:
    """Cut from the right-most letter; a name without a letter after its first character stays."""
    return F.regexp_replace(feature, r"(?s)(?<=.)[A-Za-z][^A-Za-z]*$", "")


def gene_of_allele(allele: Column) -> Column:
    """Without the last ``A`` and what follows; empty where there is none."""
    return F.when(allele.contains("A"), F.regexp_replace(allele, "A[^A]*$", "")).when(allele.isNotNull(), "")


def cluster_of(feature: Column) -> Column:
    """The feature's cluster by the grammar, null if it does not fit (a name may hold any letter)."""
    return F.nullif(F.regexp_extract(feature, r"^(.*_[CT]\d+)(?:[AUD]\d+)?$", 1), F.lit(""))


def genome_of_path(path: Column) -> Column:
    """The base name without its last extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def genome_of_locus(tag: Column) -> Column:
    """A locus tag up to its last underscore."""
    return F.regexp_replace(tag, "_[^_]*$", "")


def short_header(line: Column) -> Column:
    """A header line's first word without the leading ``>``."""
    return F.regexp_extract(line, r"^>?\s*(\S*)", 1)


def header_key(header: Column) -> Column:
    """A header's first two fields of those that bars separate."""
    return F.substring_index(header, "|", 2)


def unit_number(text: Column) -> Column:
    """Numbers like ``4.6 Mb`` as BIGINT; an unknown unit raises."""
    value = F.split_part(text, F.lit(" "), F.lit(1)).cast("double")
    unit = F.split_part(text, F.lit(" "), F.lit(2))
    out = None
    for name, factor in UNITS.items():
        scaled = F.round(value * factor).cast("bigint")
        out = F.when(unit == name, scaled) if out is None else out.when(unit == name, scaled)
    return out.when(text.isNotNull(), F.raise_error(F.concat(F.lit("unknown unit in "), text)).cast("bigint"))


def reverse_complement(seq: Column) -> Column:
    """The reverse complement in the same letter case; other symbols raise."""
    made = F.reverse(F.translate(seq, SYMBOLS, COMPLEMENTS))
    bad = seq.rlike(f"[^{SYMBOLS}]")
    return F.when(bad, F.raise_error(F.concat(F.lit("no complement in "), F.substring(seq, 1, 60))).cast("string")).otherwise(made)


def wrapped(seq: Column, width: int = 70) -> Column:
    """A sequence with a line break after every ``width`` symbols."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def sequence_key(seq: Column) -> Column:
    """The digest by which sequences are compared."""
    return F.sha2(seq, 256)


def percent_decoded(text: Column) -> Column:
    """%xx sequences decoded; a plus stays a plus; a broken one leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def attribute(attrs: Column, key: str, required: bool = False) -> Column:
    """The value of ``key`` in ``k=v;k=v``; null, or an error if it is required, where absent."""
    pattern = rf"(?:^|;){key}=([^;]*)"
    value = F.when(attrs.rlike(pattern), F.regexp_extract(attrs, pattern, 1))
    if not required:
        return value
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"no {key} in "), F.coalesce(attrs, F.lit("null")))).cast("string")).otherwise(value)


# Texts taken out of product names before words are counted, in this order.
PRODUCT_STOPS = (
    "protein", "hypothetical", "uncharacterized", "putative", "domain", "containing", "family", "like", "protein", "related",
    "conserved", "possible", "unknown", "transcriptional regulator", "subunit", "type", "system",
)


def product_words(product: Column, stops: tuple[str, ...] = PRODUCT_STOPS) -> Column:
    """Lower-case words of a product text without the stop texts, which are removed in order."""
    out = F.lower(product)
    for s in stops:
        out = F.replace(out, F.lit(s), F.lit(""))
    return F.filter(F.split(out, r"\s+"), lambda w: w != "")
