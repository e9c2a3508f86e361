"""The corpus operators against plain versions, on small and awkward inputs."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from presencia.llm import leaks, looks, mixture, similar, together
from presencia.operators import skew
from tests.llm.brute import SAME_SHAPE, look, shared_runs


def got(df):
    return sorted(tuple(r) for r in df.collect())


# --- together ---------------------------------------------------------------------


def _pairs(rows, least, lift):
    baskets = defaultdict(set)
    for g, b, i in rows:
        if None not in (g, b, i):
            baskets[g, b].add(i)
    n, one, two = Counter(), Counter(), Counter()
    for (g, _), items in baskets.items():
        n[g] += 1
        one.update((g, i) for i in items)
        two.update((g, *p) for p in itertools.combinations(sorted(items), 2))
    return sorted((g, a, b, c, one[g, a], one[g, b], n[g]) for (g, a, b), c in two.items() if c >= least and c * n[g] >= lift * one[g, a] * one[g, b])


@pytest.mark.parametrize("block", [64, 3])
def test_associated_pairs_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(together, "BLOCK", block)
    rnd = random.Random(3)
    rows = []
    for g in "xy":
        for b in range(60):
            base = rnd.choice([["a", "b", "c"], ["d", "e"], ["f"], list("abcdefgh")])
            rows += [(g, f"{g}{b}", i) for i in [*base, rnd.choice("hijkl"), "all"]]
    rows += rows[:40] + [(None, "x1", "a"), ("x", None, "a"), ("x", "x1", None), ("x", "alone", None)]
    df = spark.createDataFrame(rows, "grp string, bk string, it string").withColumns({"n": F.lit(1), "items": F.lit("q"), "b": F.lit("r")})
    found = together.associated_pairs(df, "grp", "bk", "it", 4, 2.5)
    assert got(found.select("grp", "item_1", "item_2", "n_12", "n_1", "n_2", "n")) == _pairs(rows, 4, 2.5) != []
    for r in found.collect():
        assert r["lift"] == pytest.approx(r["n_12"] * r["n"] / (r["n_1"] * r["n_2"]))
        if r["n_1"] == r["n_12"]:
            assert r["conviction"] is None
    assert together.associated_pairs(df.limit(0), "grp", "bk", "it", 4, 2.5).count() == 0


# --- similar ----------------------------------------------------------------------


def _similar(rows):
    sets = defaultdict(set)
    for r, i in rows:
        if r is not None and i is not None:
            sets[r].add(i)
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


@pytest.mark.parametrize("hot", [1000, 3])
def test_similar_records_as_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(similar, "HOT_BUCKET", hot)
    monkeypatch.setattr(similar, "PART_SETS", max(hot // 2, 1))
    if hot == 3:
        monkeypatch.setattr(similar, "PART_RECORDS", 3)
        monkeypatch.setattr(similar, "PART_LINKS", 2)
        monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rnd = random.Random(4)
    rows = []
    for f in range(6):
        base = [f"i{rnd.randrange(400)}" for _ in range(30)]
        for k in range(15):
            items = [i for i in base if rnd.random() > 0.12] + [f"o{rnd.randrange(50)}" for _ in range(rnd.randrange(3))]
            rows += [(f"r{f}.{k}", i) for i in items]
    rows += [(f"copy{k}", i) for k in range(8) for i in ("a", "b", "c", "d")] + [("near", i) for i in ("a", "b", "c", "d", "e")]
    rows += rows[:30] + [(None, "a"), ("nothing", None), ("single1", "z"), ("single2", "z")]
    df = spark.createDataFrame(rows, "rec string, it string").withColumns({"set": F.lit(1), "items": F.lit(2), "record": F.lit(3)})
    want = _similar(rows)
    assert len(want) > 50
    assert got(similar.similar_records(df, "rec", "it")) == want
    classes = {r["record"]: r for r in similar.similar_classes(df, "rec", "it").collect()}
    assert classes["copy3"]["class_id"] == "copy0" and classes["copy3"]["n_copies"] == 8 and classes["copy3"]["n_links"] == 1
    assert similar.similar_records(df.limit(0), "rec", "it").count() == 0


def test_bands_miss_almost_nothing_at_the_threshold():
    assert (1 - 0.8**similar.ROWS) ** similar.BANDS < 2e-5
    rnd = np.random.default_rng(1)
    common, a, b = (rnd.integers(0, 2**63, n, dtype=np.uint64) for n in (80, 10, 10))
    sets = [np.concatenate([common, a]), np.concatenate([common, b])]
    items = np.concatenate(sets)
    h = similar.band_hashes(items, np.array([0, 90]), 400, 4, 1)
    share = (h[0] == h[1]).mean()
    assert share == pytest.approx(0.8**4, abs=0.08)


# --- leaks ------------------------------------------------------------------------


def _words(rnd, n):
    return [rnd.choice(["ba", "ke", "lo", "mi", "nu"]) + rnd.choice("xyzvw") + str(rnd.randrange(9)) for _ in range(n)]


def test_leaks_as_by_brute_force(spark):
    rnd = random.Random(6)
    items = {i: " ".join(_words(rnd, rnd.choice([5, 11, 12, 40, 90]))) for i in range(40)}
    items |= {90: None, 91: "", 92: items[3], 93: "word " * 60}
    docs = {}
    for d in range(150):
        w = _words(rnd, rnd.randrange(60))
        if d % 3 == 0:
            src = (items[rnd.choice([i for i in items if items[i]])]).split()
            n = rnd.choice([11, 12, 13, 30])
            at = rnd.randrange(max(1, len(src) - n + 1))
            part = src[at : at + n]
            part = [rnd.choice([p, p.upper(), p.replace("o", "о"), p + ",\n"]) for p in part]
            k = rnd.randrange(len(w) + 1)
            w[k:k] = part
        docs[d] = " ".join(w)
    docs |= {500: None, 501: "", 502: "word " * 3000, 503: " ".join(_words(rnd, 4000)) + " " + items[0 if len(items[0].split()) > 11 else 3]}
    c = spark.createDataFrame(list(docs.items()), "d long, t string").withColumns({"seed": F.lit(1), "hits": F.lit(2), "item_id": F.lit(3)})
    e = spark.createDataFrame(list(items.items()), "i long, t string")
    found = leaks.leaks(c, "d", "t", e, "i", "t")
    assert {(r["item_id"], r["doc_id"]) for r in found.where(leaks.leaked(found)).collect()} == shared_runs(docs, items) != set()
    assert leaks.leaks(c.limit(0), "d", "t", e, "i", "t").count() == 0
    assert leaks.leaks(c, "d", "t", e.limit(0), "i", "t").count() == 0


def test_shuffled_seed_join_gives_the_same(spark, monkeypatch):
    rnd = random.Random(8)
    item = " ".join(_words(rnd, 30))
    c = spark.createDataFrame([(1, "x " + item), (2, "y")], "d long, t string")
    e = spark.createDataFrame([(7, item)], "i long, t string")
    monkeypatch.setattr(leaks, "MAX_SEEDS", 0)
    monkeypatch.setattr(leaks, "HOT_PASSAGES", 1)
    assert got(leaks.leaks(c, "d", "t", e, "i", "t")) == [(7, 1, 30, 30, 0)]


def test_runs_longer_than_a_passage_are_measured_whole(spark):
    rnd = random.Random(10)
    item = _words(rnd, 1500)
    assert 4 * len(item) > leaks.PASSAGE
    doc = [*_words(rnd, 3), *item, *item, *_words(rnd, 9000), *item[:1400]]
    c = spark.createDataFrame([(1, " ".join(doc))], "d long, t string")
    e = spark.createDataFrame([(7, " ".join(item))], "i long, t string")
    assert got(leaks.leaks(c, "d", "t", e, "i", "t")) == [(7, 1, 1500, 1500, 0)]


def test_passages_share_the_longest_item():
    spans = list(leaks._passages(np.arange(0, 20_000), 20_011, 700))
    assert spans[0][0] == 0 and spans[-1][1] == 20_011
    assert all(b[0] < a[1] - 700 and a[1] - a[0] <= 2800 for a, b in itertools.pairwise(spans))


def test_bitmap_follows_the_seeds_within_bounds():
    assert leaks.bitmap_bits(0) == leaks.bitmap_bits(100) == leaks.LEAST_BITS
    assert leaks.bitmap_bits(10**6) == 1 << 25 and leaks.bitmap_bits(10**12) == leaks.MOST_BITS


def test_overlaps_tolerate_substituted_words(spark):
    rnd = random.Random(9)
    src = _words(rnd, 60)
    changed = list(src)
    for at in (14, 31, 45):
        changed[at] = "other"
    c = spark.createDataFrame([(1, " ".join(["head", *changed, "tail"]))], "d long, t string")
    e = spark.createDataFrame([(7, " ".join(src))], "i long, t string")
    assert got(leaks.leaks(c, "d", "t", e, "i", "t")) == [(7, 1, 16, 60, 3)]
    only = list(src[:12])
    only[2] = "other"  # the only window has a substitution where a mask does not look
    c = spark.createDataFrame([(1, " ".join(only))], "d long, t string")
    assert [r["equal_words"] for r in leaks.leaks(c, "d", "t", e, "i", "t").collect()] == [9]


def test_words_compare_without_case_in_any_alphabet():
    assert leaks.words("ВОДА, кот-Мир") == leaks.words("вода КОТ  мир") == leaks.words("Вода Кот Мир")
    assert leaks.words("STRASSE") == leaks.words("straße") and leaks.words("a_b") == ["a", "b"]
    assert leaks.words("ｆｕｌｌ wi­dth") == ["full", "width"]


# --- mixtures ---------------------------------------------------------------------


def test_sainte_lague_as_seat_by_seat():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randrange(1, 7)
        w = [rnd.choice([0.0, 1.0, 2.0, rnd.random()]) for _ in range(n)]
        caps = [rnd.randrange(8) for _ in range(n)]
        seats = rnd.randrange(25)
        want = [0] * n
        for _ in range(seats):
            q = [w[i] / (2 * want[i] + 1) if want[i] < caps[i] and w[i] > 0 else -1 for i in range(n)]
            if max(q) <= 0:
                break
            want[q.index(max(q))] += 1
        have = mixture.sainte_lague(w, seats, caps)
        assert sum(have) == sum(want)
        assert sorted(round(w[i] / (2 * k - 1), 9) for i in range(n) for k in range(1, have[i] + 1)) == sorted(round(w[i] / (2 * k - 1), 9) for i in range(n) for k in range(1, want[i] + 1))


def _counts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumns({"shard": F.lit(1), "block": F.lit(2)})


def test_mixture_meets_its_targets(spark):
    rnd = random.Random(2)
    rows = [(i, s, rnd.randrange(5, 400)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 600 + ["small"] * 150 + ["other"] * 50)] + [(9999, "mid", 0)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    made = mixture.mix(_counts(spark, rows), targets, block=500, shard=50_000)
    docs = made.documents.collect()
    limits = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r["copies"] <= limits[r["source"]] for r in docs) and len({r["doc_id"] for r in docs}) == len(docs)
    shares = {r["source"]: r for r in made.shares.collect()}
    for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert shares[s]["actual_share"] == pytest.approx(t, abs=0.01)
        assert shares[s]["used_tokens"] == sum(r["tokens"] * r["copies"] for r in docs if r["source"] == s)
    assert shares["absent"]["actual_share"] == 0 and shares["other"]["used_tokens"] == 0
    # the largest mixture: some source is used up
    assert max(shares[s]["used_tokens"] / (limits[s] * shares[s]["source_tokens"]) for s in limits) > 0.97
    again = mixture.mix(_counts(spark, rows[::-1]).repartition(7), targets, block=500, shard=50_000)
    assert got(again.documents) == sorted(tuple(r) for r in docs)


def test_mixture_beyond_the_limits_says_so(spark):
    rows = [(i, "a" if i % 10 else "b", 10) for i in range(1000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixture.mix(_counts(spark, rows), targets, total_tokens=6000, block=100).shares.collect()}
    assert shares["b"]["used_tokens"] == 2000 and shares["a"]["used_tokens"] == pytest.approx(4000, abs=100)
    assert mixture.mix(_counts(spark, []), targets).documents.count() == 0
    with pytest.raises(ValueError, match="once"):
        mixture.mix(_counts(spark, rows), targets.union(targets))
    with pytest.raises(ValueError, match="smaller block"):
        mixture.mix(_counts(spark, rows[:50]), targets)


def test_tokens_are_those_of_the_public_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello  world", "a" * 5000, "Ünïcode ☃ text\n\n1234", "<|endoftext|>", "", None, "x"]
    df = spark.createDataFrame([(i, "s" if t != "x" else None, t) for i, t in enumerate(texts)], "d long, s string, t string")
    plain.encode_special_tokens = True
    assert got(mixture.token_counts(df, "d", "s", "t")) == [(i, "s", len(plain.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts) if t and t != "x"]


# --- looks ------------------------------------------------------------------------

ODD = ["́", "̈", "­", "​", " ", "　", "é", "ё", "Ａ", "１", "ﾊ", "ﾞ", "가", "ᄀ", "ᅡ", "ᆨ", "가", "Å", "Ω", "ﬁ", "²", "Ά", "ї", "️", "ͅ", "ᾳ", "\r\n", "\t", *SAME_SHAPE]


def test_canonical_form_as_over_the_whole_text():
    rnd = random.Random(7)
    for _ in range(3000):
        text = "".join(rnd.choice([*ODD, "a", "e", "n", " ", "o", "Z"]) for _ in range(rnd.randrange(12)))
        if not set(text) & {"️"}:
            assert looks.canonical(text) == look(text), ascii(text)
    for other, form in SAME_SHAPE.items():
        assert looks.canonical(f"x{other}y") == f"x{form}y"
    assert looks.canonical("plain") == "plain" and looks.canonical("ﬁ ²") == "ﬁ ²"
    long = "обычный текст Ａé " * 20_000
    assert looks.canonical(long) == look(long)


def test_look_alike_pairs_and_classes(spark, monkeypatch):
    monkeypatch.setattr(looks, "PART_ROWS", 2)
    base = ["café one", "café one", "ｃafé one", "café one", "café one"]
    docs = [(i, base[i % 5]) for i in range(20)] + [(50, "Other"), (51, "Оther"), (52, "other"), (60, ""), (61, None), (62, "​"), (63, "­"), (64, "a  b"), (65, "a b"), (66, "a\nb")]
    df = spark.createDataFrame(docs, "d long, t string").withColumns({"raw": F.lit(1), "canon": F.lit(2), "n": F.lit(3), "id": F.lit(4)})
    want = sorted((a, b) for (a, x), (b, y) in itertools.combinations(docs, 2) if x and y and x != y and look(x) == look(y))
    assert got(looks.look_alike_pairs(df, "d", "t")) == want
    classes = {r["d"]: (r["class_id"], r["n_forms"]) for r in looks.look_alike_classes(df, "d", "t").collect()}
    assert classes[7] == (0, 4) and classes[51] == (50, 2) and classes[52] == (52, 1) and 60 not in classes
    assert looks.look_alike_pairs(df.limit(0), "d", "t").count() == 0
