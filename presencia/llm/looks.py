"""One consistent form for texts that look alike.

Canonical form: invisible characters dropped, every kind of space a space, full- and
half-width forms at their usual width, Greek and Cyrillic letters of a Latin
letter's shape as that letter, Cyrillic ones of a Greek letter's shape as that one, and the whole composed (NFC).  Only *unstable
segments*, found by normalization quick-check properties, are rewritten: each with the
character before it as context, spliced back between the unchanged parts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presencia.operators.skew import salted_lookup
from presencia.session import materialise, spread

# Letters of the same shape in two alphabets: Latin and Cyrillic, Latin and Greek, Greek and Cyrillic (or the micro sign)
# where neither has a Latin twin.  Letters of phonetic notation have none here.
LATIN_FOR_CYRILLIC = ("ABCEGHIIJKMOPQSTVWXYYÆƏƐƟƷacdehijlopqsvwxyyæəɛɵʒ", "АВСЕԌНІӀЈКМОРԚЅТѴԜХУҮӔӘԐӨӠасԁеһіјӏорԛѕѵԝхуүӕәԑөӡ")
LATIN_FOR_GREEK = ("ABCEFHIJKMMNOPTXYZÞcjopvþ", "ΑΒϹΕϜΗΙͿΚΜϺΝΟΡΤΧΥΖϷϲϳορνϸ")
GREEK_FOR_CYRILLIC = ("ΓΠΦΨκφψμ", "ГПФѰкфѱµ")
SAME_SHAPE = (LATIN_FOR_CYRILLIC, LATIN_FOR_GREEK, GREEK_FOR_CYRILLIC)
# Invisible characters that are not of the category of format characters.
INVISIBLE_TOO = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
# Format characters that are seen (signs around or before numbers).
SEEN_FORMATS = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"


@cache
def replacements() -> dict[int, str]:
    """What each visible-only-in-part character becomes; by rule from character properties."""
    table = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if (kind == "Cf" and ch not in SEEN_FORMATS) or ch in INVISIBLE_TOO or 0xFE00 <= cp <= 0xFE0F:
            table[cp] = ""
        elif kind == "Zs":
            table[cp] = " "
        elif (0xFF00 <= cp <= 0xFFEF) and unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            table[cp] = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(ch).split()[1:])
    for form, other in SAME_SHAPE:
        table |= {ord(o): f for f, o in zip(form, other, strict=True)}
    return table


def _class(points: list[int]) -> str:
    """The inside of a character class of code points, as ranges."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}" + (f"-\\U{points[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


@cache
def _unstable(astral: bool) -> re.Pattern[str]:
    """Runs that may change: replaced characters, and those whose quick check for NFC is not a plain yes.

    Texts without astral characters, nearly all, go by a pattern without them, which is a plain table lookup.
    """
    points = set(replacements())
    for cp in range(0x300, sys.maxunicode + 1):
        ch = chr(cp)
        # no: not NFC by itself; maybe: a mark or a jamo that can compose with what stands before it
        if unicodedata.combining(ch) or 0x1161 <= cp <= 0x11C2 or not unicodedata.is_normalized("NFC", ch):
            points.add(cp)
        elif unicodedata.category(ch) in ("Mn", "Mc") and unicodedata.normalize("NFD", ch) == ch:
            points.add(cp)
    # precomposed letters whose base has a twin
    for cp in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(cp))
        if ord(parts[0]) in replacements():
            points.add(cp)
    points -= {0xD800 + i for i in range(0x800)}
    return re.compile(f"[{_class(sorted(p for p in points if astral or p < 0x10000))}]+")


class _Segments(dict):
    """Canonical segments, kept as they recur."""

    def __missing__(self, segment: str) -> str:
        plain = unicodedata.normalize("NFD", segment.translate(replacements()))
        out = unicodedata.normalize("NFC", plain.translate(replacements()))
        if len(self) < 200_000:
            self[segment] = out
        return out


_SEGMENTS = _Segments()


def canonical(text: str) -> str:
    """The canonical form of one text."""
    if text.isascii():
        return text
    out, last = [], 0
    for m in _unstable(max(text) > "\uffff").finditer(text):
        start, end = m.span()
        start -= start > last  # with the character before it, unless that is in the last segment
        out += text[last:start], _SEGMENTS[text[start:end]]
        last = end
    return "".join(out) + text[last:] if out else text


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_text(text: Column) -> Column:
    """The canonical form of a text column.  Null stays null; plain ASCII texts never leave the JVM."""
    other = _canonical(F.when(text.rlike(r"[^\x00-\x7f]"), text))
    return F.coalesce(other, text)


def _hashed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Ids with 128-bit digests of the canonical and the stored form of the non-empty texts."""
    held = spread(df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    return held.select("id", F.md5(canonical_text(F.col("text"))).alias("canon"), F.md5("text").alias("raw"))


#: Documents of one stored form, and stored forms of one class, that one task joins at once.
PART_ROWS = 2000


def look_alike_pairs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id_1 < doc_id_2`` of texts that look the same but differ as stored.

    Null and empty texts take no part; a text of invisible characters only has the
    canonical form of nothing and pairs with its like.  Repeated ids give repeated pairs
    only where their texts differ.

    Scale: only digests are shuffled.  Documents first collapse to stored forms; only
    classes with two forms or more go on; forms are paired, and their documents joined,
    in parts of PART_ROWS on either side, so no pair of equal texts is ever made and a hot
    class is spread over tasks.  The output itself grows with the copies, as asked.
    """
    docs = materialise(_hashed(df, doc_id, text), "look_alikes")
    forms = docs.groupBy("canon", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = forms.groupBy("canon").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    forms = salted_lookup(forms, several, ["canon"], "k", F.col("raw"))
    forms = materialise(forms.withColumns({p: F.ceil(F.col(c) / PART_ROWS).cast("int") for p, c in (("parts", "n"), ("form_parts", "k"))}), "forms")
    members = (
        salted_lookup(docs.select("raw", "id"), forms.select("raw", "n", "parts"), ["raw"], "n", F.col("id"))
        .select("raw", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    )
    part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = {"a": F.pmod(F.xxhash64("raw"), F.col("form_parts")).cast("int"), "b": part("form_parts")}
    a, b = (forms.select("canon", deal[x].alias("deal"), F.col("raw").alias(f"raw_{x}"), F.col("parts").alias(f"parts_{x}")) for x in "ab")
    pairs = a.join(b, ["canon", "deal"]).where("raw_a < raw_b").drop("canon", "deal")
    pairs = pairs.withColumn("part_a", part("parts_a")).withColumn("part_b", part("parts_b")).drop("parts_a", "parts_b")
    for x in "ab":
        pairs = pairs.join(members.select(F.col("raw").alias(f"raw_{x}"), F.col("part").alias(f"part_{x}"), F.col("id").alias(f"id_{x}")), [f"raw_{x}", f"part_{x}"])
    return pairs.select(F.least("id_a", "id_b").alias("doc_id_1"), F.greatest("id_a", "id_b").alias("doc_id_2")).where("doc_id_1 < doc_id_2")


def look_alike_classes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``class_id`` (the least id of its class) and ``n_forms``, the class's stored forms.

    One row per document with a non-empty text.
    """
    docs = materialise(_hashed(df, doc_id, text), "look_alikes")
    classes = (
        docs.groupBy("canon", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        .groupBy("canon").agg(F.sum("n").alias("n"), F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_forms"))
    )
    return salted_lookup(docs.select("canon", "id"), classes, ["canon"], "n", F.col("id")).select(F.col("id").alias(doc_id), "class_id", "n_forms")
