"""Operators of the library on hand-made inputs: sequences, names, order, trees, models, sinks, streams."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from presencia.functions import names
from presencia.kernels import clustering, embedding
from presencia.kernels import factor as kernels
from presencia.operators import consensus, embed, enrich, factor, qc, sets, synteny
from presencia.operators import presence as pr
from presencia.plans import model_queries as mq
from presencia.sources import sequences as sq
from presencia.sources import tables as tb


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


# --- names ------------------------------------------------------------------------


def test_feature_names(spark):
    parts = {n: tuple(one(spark, n, names.feature_parts)) for n in ("X_C10A2", "SpA_T7", "a_b_C1U0", "plain")}
    assert parts == {"X_C10A2": ("X", "C", 10, "A", 2), "SpA_T7": ("SpA", "T", 7, None, None), "a_b_C1U0": ("a_b", "C", 1, "U", 0), "plain": (None,) * 5}
    assert one(spark, "A_C3A11", names.gene_of_allele) == "A_C3" and one(spark, "C3", names.gene_of_allele) == "" and one(spark, None, names.gene_of_allele) is None
    assert one(spark, "AlphA_C3A11", names.cluster_of) == "AlphA_C3" and one(spark, "AlphA_C3", names.cluster_of) == "AlphA_C3"
    assert [one(spark, x, names.trim_variant) for x in ("X_C10A2", "123", "A12", "")] == ["X_C10", "123", "A12", ""]
    made = spark.createDataFrame([(1, None), (2, -1), (3, 0)], "c int, v int").select(names.feature_name(F.lit("N"), F.lit("C"), F.col("c"), F.lit("A"), F.col("v")).alias("f"))
    assert [r["f"] for r in made.collect()] == ["N_C1", "N_C2", "N_C3A0"]


def test_paths_headers_units(spark):
    assert one(spark, "/a/b.c/286636.3.faa", names.genome_of_path) == "286636.3" and one(spark, "x", names.genome_of_path) == "x"
    assert one(spark, ">286636.3_00045 hypothetical protein", names.short_header) == "286636.3_00045"
    assert one(spark, "fig|1.2.peg.3|x y", names.header_key) == "fig|1.2.peg.3"
    assert one(spark, "4.6 Mb", names.unit_number) == 4_600_000 and one(spark, None, names.unit_number) is None
    with pytest.raises(PySparkException):
        one(spark, "4.6 Xb", names.unit_number)


def test_sequences_and_attributes(spark):
    assert one(spark, "ACGTNacgtnWSRYMK", names.reverse_complement) == "MKRYSWnacgtNACGT"
    with pytest.raises(PySparkException):
        one(spark, "ACX", names.reverse_complement)
    assert one(spark, "A" * 70 + "C" * 70 + "G", names.wrapped) == "A" * 70 + "\n" + "C" * 70 + "\nG" and one(spark, "A" * 70, names.wrapped) == "A" * 70
    assert one(spark, "a%2Cb+c", names.percent_decoded) == "a,b+c" and one(spark, "50% off", names.percent_decoded) == "50% off"
    assert one(spark, "ID=a;product=b=c", lambda c: names.attribute(c, "product")) == "b=c" and one(spark, "ID=a", lambda c: names.attribute(c, "D")) is None
    with pytest.raises(PySparkException):
        one(spark, "ID=a", lambda c: names.attribute(c, "locus_tag", True))
    assert one(spark, "Putative ABC-like Protein type II", names.product_words) == ["abc-", "ii"]


# --- sources ----------------------------------------------------------------------


@pytest.fixture
def files(tmp_path):
    (tmp_path / "g1.faa").write_text(">a one > two\nMKV\nLLT\n>b\nMKK\n>empty\n>a again\nMKVLLT\n")
    (tmp_path / "g2.faa").write_text("junk\r\n>c\r\nMKVLLT\r\n>d\r\nMAA\r\n")
    (tmp_path / "x.clstr").write_text(">Cluster 0\n0\t6aa, >a... *\n1\t6aa, >c... at 100.00%\n>Cluster 1\n0\t3aa, >b... *\n>Cluster 2\n0\t3aa, >d... *\n")
    (tmp_path / "g.gff").write_text(
        "##gff-version 3\naccn|k1\tx\tregion\t1\t40\t.\t+\t.\tID=r\naccn|k1\tx\tCDS\t6\t15\t.\t+\t0\tID=f1;locus_tag=L1;product=a%2Cb+c=d\n"
        "accn|k1\tx\tCDS\t18\t26\t.\t+\t0\tID=f2;locus_tag=L2\naccn|k1\tx\ttRNA\t30\t38\t.\t-\t.\tID=f3;locus_tag=L3\naccn|k2\tx\ttRNA\t1\t4\t.\t+\t.\tID=f4;locus_tag=L4\n##FASTA\n>k1\nACGT\n"
    )
    return tmp_path


def test_fasta_files(spark, files):
    rows = sq.read_fasta(spark, [str(files / "g1.faa"), str(files / "g2.faa")])
    assert got(rows) == [("g1", 1, "b", "MKK"), ("g1", 3, "a", "MKVLLT"), ("g2", 0, "c", "MKVLLT"), ("g2", 1, "d", "MAA")]
    every = sq.read_fasta(spark, str(files / "g1.faa"), header=lambda h: h, last_wins=False)
    assert got(every.select("header", "seq")) == [("a again", "MKVLLT"), ("a one > two", "MKVLLT"), ("b", "MKK"), ("empty", "")]
    some = sq.read_fasta(spark, str(files / "g2.faa"), seq=F.lower, keep=lambda h: h != "d")
    assert got(some) == [("g2", 0, "c", "mkvllt")]
    sq.write_fasta(rows.where("genome = 'g2'"), str(files / "out"), by_header=True, width=4)
    assert got(sq.read_fasta(spark, str(files / "out" / "*.txt")).select("header", "seq")) == [("c", "MKVLLT"), ("d", "MAA")]


def test_alleles_from_clusters(spark, files):
    members = sq.read_clstr(spark, str(files / "x.clstr"))
    assert got(members.select("cluster", "member", "len", "header", "is_rep", "pct")) == [(0, 0, 6, "a", True, None), (0, 1, 6, "c", False, 100.0), (1, 0, 3, "b", True, None), (2, 0, 3, "d", True, None)]
    seqs = sq.read_fasta(spark, [str(files / "g1.faa"), str(files / "g2.faa")], last_wins=False)
    ordered = seqs.withColumn("genome_ord", F.when(F.col("genome") == "g1", 0).otherwise(1))
    groups = pr.consolidated(ordered)
    assert got(groups.select("representative", F.array_join("headers", ","), F.array_join("genomes", ","))) == [("a", "a,a,c", "g1,g2"), ("b", "b", "g1"), ("d", "d", "g2")]
    assert got(pr.empty_headers(ordered)) == [("g1", "empty")]
    shared = pr.shared_headers(groups)
    # c is a synonym of a and has a line of its own: it goes by its representative; without the synonyms it keeps its own
    assert got(pr.header_alleles(members, shared, "X")) == [("a", "X_C0A0"), ("b", "X_C1A0"), ("c", "X_C0A0"), ("d", "X_C2A0")]
    assert ("c", "X_C0A1") in got(pr.header_alleles(members, None, "X"))
    alleles, genes, missing = pr.feature_tables(seqs, pr.header_alleles(members, shared, "X").where("header <> 'd'"))
    assert got(alleles) == [("X_C0A0", "g1"), ("X_C0A0", "g2"), ("X_C1A0", "g1")] and got(genes) == [("X_C0", "g1"), ("X_C0", "g2"), ("X_C1", "g1")] and got(missing) == [("g2", "d")]
    assert got(sq.representatives(members, seqs.where("seq <> ''").dropDuplicates(["header"]), "X")) == [("X_C0A0", "MKVLLT"), ("X_C1A0", "MKK"), ("X_C2A0", "MAA")]
    features = alleles.join(groups.select("seq", F.explode("headers").alias("header")).join(pr.header_alleles(members, shared, "X"), "header").select("allele", "seq").distinct(), "allele")
    audit = pr.against_sequences(alleles.withColumnRenamed("allele", "feature"), seqs, features.select(F.col("allele").alias("feature"), "seq").distinct())
    assert got(audit) == [("g2", None, "sequences")]


def test_features_of_gff(spark, files):
    gff = sq.read_gff(spark, str(files / "g.gff"))
    assert got(gff.select("genome", "contig", "type", "start", "stop", "id")) == [("g", "k1", "CDS", 17, 26, "f2"), ("g", "k1", "CDS", 5, 15, "f1"), ("g", "k1", "region", 0, 40, "r"), ("g", "k1", "tRNA", 29, 38, "f3"), ("g", "k2", "tRNA", 0, 4, "f4")]
    assert got(sq.region_length(gff)) == [("g", 40)]
    contig = "".join(random.Random(1).choices("ACGT", k=40))
    contigs = spark.createDataFrame([("g", "k1", contig)], "genome string, contig string, seq string")
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got(sq.sliced(gff, contigs, ["tRNA"]).select("id", "seq")) == [("f3", rc(contig[29:38]))]
    assert got(sq.sliced(gff, contigs, ["CDS"], (7, 20)).select("id", "seq")) == [("f1", contig[0:35]), ("f2", contig[10:46])]
    assert got(sq.unknown_contigs(gff, contigs).select("id")) == [("f4",)]
    up = sq.proximal(gff.where("type in ('CDS', 'tRNA')"), contigs, "upstream", (-6, 3))
    assert got(up.select("name", "seq")) == [("f2_upstream(-6,3)", contig[11:20])]
    parts = sq.proximal(gff.where("type in ('CDS', 'tRNA')"), contigs, "upstream", (-6, 3), fragments=True)
    assert got(parts.select("id", "seq")) == [("f1", contig[0:8]), ("f2", contig[11:20]), ("f3", rc(contig[35:44]))]
    cut = sq.proximal(gff.where("type = 'CDS'"), contigs, "upstream", (-6, 3), max_overlap=1)
    assert got(cut.select("name", "seq")) == [("f2_upstream(-6,3,1)", contig[14:20])]
    down = sq.proximal(gff.where("type = 'CDS'"), contigs, "downstream", (-3, 5), max_overlap=0)
    assert got(down.select("id", "seq")) == [("f1", contig[12:17]), ("f2", contig[23:31])]
    alleles = spark.createDataFrame([("f1", "X_C1A0")], "header string, allele string")
    assert got(sq.product_annotations(gff, alleles).select("allele", "annotation")) == [("X_C1A0", "a,b+c=d")]
    table = spark.createDataFrame([("g", "v1"), ("g", "v2"), ("g", "v3")], "genome string, feature string")
    variants = spark.createDataFrame([("v1", contig[3:13]), ("v2", rc(contig[20:30])), ("v3", "A" * 10)], "feature string, seq string")
    assert got(sq.undetected_windows(table, variants, contigs, 10)) == [("g", "v3")]


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("x/a.1.fna\ty/b.2.fna\t0.01\t0\t900/1000\n")
    assert got(tb.read_mash(spark, str(tmp_path / "m.tsv"))) == [("a.1", "b.2", 0.01, 0.0, 900, 1000)]
    (tmp_path / "mlst.tsv").write_text("r/g/286636.3.fna\tspy\t-\t1\t2\t3\t4\t5\t6\t7\n")
    mlst = tb.read_mlst(spark, str(tmp_path / "mlst.tsv"))
    assert got(mlst.select("genome_id", tb.sequence_type(F.col("mlst")), "allele7")) == [("286636.3", -1, "7")]
    (tmp_path / "b.tsv").write_text("q\tt1\t90\t1\t1\t1\t1\t1\t1\t1\t1e-5\t50\nq\tt0\t95\t1\t1\t1\t1\t1\t1\t1\t1e-5\t50\nq\tt2\t99\t1\t1\t1\t1\t1\t1\t1\t20\t70\nr\tt\t0\t1\t1\t1\t1\t1\t1\t1\t1\t1\n")
    hits = tb.read_blast(spark, str(tmp_path / "b.tsv"))
    assert got(tb.blast_hits(hits).select("query", "target")) == [("q", "t0")] and tb.blast_hits(hits, unique=False).count() == 2
    (tmp_path / "names.tsv").write_text("X_C1A0\th|1|z\th|2\nX_C1A1\th|1|y\n")
    alleles = tb.read_allele_names(spark, str(tmp_path / "names.tsv"))
    assert got(tb.feature_alleles(alleles)) == [("h|1", "X_C1A1"), ("h|2", "X_C1A0")] and got(tb.locus_clusters(alleles)) == [("X_C1", "h|1|y"), ("X_C1", "h|1|z"), ("X_C1", "h|2")]
    (tmp_path / "p.csv").write_text("gene,286636.3,530008.3\nA,1,\nB,1,1.0\nC,0,\n")
    assert got(tb.read_features(spark, str(tmp_path / "p.csv"))) == [("A", "286636.3"), ("B", "286636.3"), ("B", "530008.3")]
    for g in ("1.1", "2.2"):
        (tmp_path / "anno" / g).mkdir(parents=True)
        (tmp_path / "anno" / g / f"{g}.tsv").write_text("# x\n#Sequence Id\nc1\tcds\t1\t9\t+\tL1\tg\tkinase\tGO:1, GO:2\nc1\tcds\t1\t9\t+\tL1\tg\tkinase\tGO:1, GO:2\n")
    assert got(tb.read_annotations(spark, str(tmp_path / "anno" / "*" / "*.tsv"))) == [("1.1", "kinase", "GO:1, GO:2", "L1"), ("2.2", "kinase", "GO:1, GO:2", "L1")]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.faa").write_text("")
    (tmp_path / "empty" / "f.faa").write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in tb.empty_files(spark, str(tmp_path / "empty")).collect()] == ["e.faa"]
    (tmp_path / "c.yml").write_text("WORKDIR: x\nDEBUG: true\n")
    assert tb.load_config(str(tmp_path / "c.yml")) == {"WORKDIR": "x", "DEBUG": True}
    pairs = spark.createDataFrame([("g1", "s", 0.5), ("zz", "s", 0.1)], "genome string, sample string, distance double")
    assert got(tb.pivoted_distances(pairs, spark.createDataFrame([("g1",), ("g2",)], "genome string"), ["s"])) == [("g1", 0.5), ("g2", None)]


def test_models_are_kept_as_tables(spark, tmp_path):
    p = spark.createDataFrame([("a", "x"), ("b", "y")], "gene string, genome string")
    tb.save_tables({"p": p, "l": p.limit(1)}, str(tmp_path / "m"), {"ranks": [2, 3]})
    back, meta = tb.load_tables(spark, str(tmp_path / "m"))
    assert got(back["p"]) == [("a", "x"), ("b", "y")] and meta["ranks"] == [2, 3] and set(back) == {"p", "l"}


# --- quality ----------------------------------------------------------------------


def test_quality_bounds_and_nulls(spark):
    rows = [
        ("Complete", 1, 101, 1, 1.0, 99.0), ("Complete", 1, 100, 1, 1.0, 99.0), ("Complete", 2, 200, 1, 1.0, 99.0), ("Complete", None, 200, 1, 1.0, 99.0), ("WGS", 5, 5, 10, 1.9, 98.1), ("WGS", 5, 5, 11, 1.0, 99.0),
        ("WGS", 5, 5, 10, 2.0, 99.0), ("WGS", 5, 5, 10, 1.0, 98.0), ("WGS", 5, 5, None, 1.0, 99.0), ("WGS", 5, 5, 9, None, 99.0), ("Plasmid", 1, 500, 1, 0.0, 100.0), (None, 1, 500, 1, 0.0, 100.0),
    ]
    df = spark.createDataFrame(rows, "genome_status string, contig_l50 int, contig_n50 int, contigs int, checkm_contamination double, checkm_completeness double").withColumn("gc_content", F.lit("40.5"))
    out = qc.by_quality(df, 100, 10, 2.0, 98.0)
    assert got(out.rows.select("contig_n50", "contigs")) == [(101, 1), (5, 10)]
    assert [tuple(r)[1:] for r in out.stats.orderBy("ord").collect()] == [("prefiltration", 12, 0, 12), ("L50/N50", 12, 5, 7), ("contig_count", 7, 2, 5), ("CheckM_completeness_contamination", 5, 3, 2)]
    nothing = qc.by_quality(df.limit(0))
    assert nothing.rows.count() == 0 and nothing.stats.count() == 4


def test_low_outliers_go_until_none_is_left(spark):
    values = [10.0, 10.1, 9.9, 10.2, 9.8, 10.0, 3.0, 0.0, 30.0]
    kept, removed = qc.without_low_outliers(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"), "v")
    x, out = np.array(values), []
    while True:
        m = np.median(x)
        mad = np.median(np.abs(x - m)) or 1e-10
        bad = (0.6745 * np.abs(x - m) / mad > 3) & (x < m)
        if not bad.any():
            break
        out += x[bad].tolist()
        x = x[~bad]
    assert sorted(r["v"] for r in kept.collect()) == sorted(x.tolist()) and sorted(r["v"] for r in removed.collect()) == sorted(out) == [0.0, 3.0]


def test_first_of_each_key_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, o int")
    assert got(qc.first_by(df, ["k"], [F.col("o")])) == [("a", 3), (None, 1)]


# --- presence ---------------------------------------------------------------------


@pytest.mark.parametrize("core", [0.987, 0.6])
def test_pan_core_curve_as_step_by_step(spark, core):
    import hashlib

    rnd = random.Random(3)
    cells = {(f"g{i}", f"s{j}") for i in range(60) for j in range(23) if rnd.random() < [0.95, 0.5, 0.05][i % 3]}
    genomes = sorted({s for _, s in cells})
    want = []
    for it in (1, 2):
        order = sorted(genomes, key=lambda s: (hashlib.md5(f"{it}-{s}".encode()).hexdigest(), s))
        c = dict.fromkeys({g for g, _ in cells}, 0)
        for j, s in enumerate(order):
            for g in c:
                c[g] += (g, s) in cells
            v = list(c.values())
            want.append((it, j + 1, sum(x > 0 for x in v), sum(x >= (j + 1) * core for x in v if x), sum(j * 0.037 < x < (j + 1) * core for x in v), sum(0 < x < j * 0.037 for x in v)))
    p = spark.createDataFrame(list(cells), "gene string, genome string")
    assert got(pr.pan_core_curve(p, 2, core=core)) == sorted(want, key=repr)


def test_binary_values_are_checked(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 0)], "g string, v int")
    assert got(pr.validated_binary(df, "v")) == [("a", 1), ("b", 0), ("c", 0)]
    with pytest.raises(PySparkException):
        pr.validated_binary(spark.createDataFrame([("a", 2)], "g string, v int"), "v").collect()


# --- models -----------------------------------------------------------------------


def planted(spark, genes=30, genomes=12, blocks=3):
    cells = [(f"g{k}.{i}", f"s{k}.{j}") for k in range(blocks) for i in range(genes) for j in range(genomes)]
    return spark.createDataFrame(cells, "gene string, genome string")


def test_planted_factors_are_found_and_scored(spark):
    p = planted(spark)
    w, h = factor.normalised(*factor.factorise(p, [2, 3, 4], 500))
    l_bin, a_bin = factor.binarised(w, "gene", "w").where("top"), factor.binarised(h, "genome", "h").where("top")
    genes, genomes = factor.shape(p)
    scores = factor.metrics(factor.confusion(p, l_bin, a_bin, [2, 3, 4], genes, genomes), genes, genomes)
    best = {r["rank"]: r for r in scores.collect()}
    assert best[3]["tp"] == 1080 and best[3]["fn"] == best[3]["fp"] == 0 and best[3]["mcc"] == pytest.approx(1)
    assert tuple(factor.best_rank(scores, "aic", lowest=True).first()) == (2, 3, 4)
    assert [r["rank"] for r in factor.ranks_around(scores, "aic", 1).orderBy("rank").collect()] == [2, 3, 4]
    assert factor.reconstruction_error(p, factor.reconstruction(l_bin.where("rank = 3"), a_bin.where("rank = 3")), [3]).count() == 0
    blocks = l_bin.where("rank = 3").groupBy("component").agg(F.countDistinct(F.substring("gene", 1, 2)).alias("b"), F.count("*").alias("n"))
    assert got(blocks.select("b", "n")) == [(1, 30)] * 3


def test_distributed_factors_fit_as_well(spark):
    p = planted(spark, 8, 5)
    w, h = factor.factorise_large(p, 3, 60)
    made = w.join(h, ["rank", "component"]).groupBy("gene", "genome").agg(F.sum(F.col("w") * F.col("h")).alias("x"))
    real = made.join(p.withColumn("one", F.lit(1)), ["gene", "genome"], "left").select(F.pow(F.col("x") - F.coalesce("one", F.lit(0)), 2).alias("e"))
    assert real.agg(F.sum("e")).first()[0] < 0.05 * 120
    assert w.where("w < 0").count() == 0


def test_large_tables_get_the_same_fit(spark, monkeypatch):
    rnd = random.Random(3)
    cells = [(f"g{i:02d}", f"s{j:02d}") for i in range(40) for j in range(25) if rnd.random() < (0.85 if i % 3 == j % 3 and (i + j) % 7 else 0.15)]
    p = spark.createDataFrame(cells, "gene string, genome string")
    whole = [sorted(map(tuple, f.collect())) for f in factor.factorise(p, [3], 150)]
    monkeypatch.setattr(factor, "DENSE_CELLS", 0)
    w, h = factor.factorise(p, [3], 150)
    for a, b in zip(whole, (w, h), strict=True):
        b = sorted(map(tuple, b.collect()))
        assert [r[:3] for r in a] == [r[:3] for r in b]
        assert [r[3] for r in a] == pytest.approx([r[3] for r in b], abs=2e-3)
    sizes = w.groupBy("component").agg(F.sum("w").alias("w")).join(h.groupBy("component").agg(F.sum("h").alias("h")), "component").orderBy("component")
    sizes = [r["w"] * r["h"] for r in sizes.collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_large_tables_get_all_iterations_asked(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(factor, "DENSE_CELLS", 0)
    monkeypatch.setattr(factor, "factorise_large", lambda p, rank, iterations: asked.append(iterations) or (p, p))
    factor.factorise(planted(spark, 2, 2), [2], 500)
    assert asked == [500]


def test_rank_lists(spark):
    assert factor.refined_ranks(2, 10, 12, [2, 4, 10]) == [6, 8, 11]
    assert factor.refined_ranks(None, 3, None, []) == []
    with pytest.raises(ValueError):
        factor.factorise(planted(spark), [0])
    inertia = factor.mca(planted(spark))
    ranks = [r["rank"] for r in factor.ranks_from_inertia(inertia, [7]).collect()]
    assert ranks == sorted(set(ranks)) and {2, 7} <= set(ranks)
    assert inertia.orderBy(F.desc("component")).first()["cumulative"] == pytest.approx(1)


def test_affinities_of_known_genomes(spark):
    rows = [("a", 0, 0.5), ("a", 1, 0.3), ("b", 0, 0.2), ("b", 1, 0.7)]
    l = spark.createDataFrame(rows, "gene string, component int, w double")
    p = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("new", "z"), ("a", "z2"), ("b", "z2")], "gene string, genome string")
    out = {(r["genome"], r["component"]): r["affinity"] for r in factor.affinities(l, p).collect()}
    assert out["x", 0] == pytest.approx(0.5 / 0.29) and out["x", 1] == 0 and out["y", 1] == pytest.approx(0.7 / 0.58) and out["z", 0] == 0
    full = np.linalg.solve([[0.5, 0.3], [0.2, 0.7]], [1, 1])
    assert [out["z2", k] for k in (0, 1)] == pytest.approx(full.tolist())


def test_scores_of_arriving_genomes(spark, tmp_path):
    from presencia.streaming.affinity import score_arrivals

    l = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0)], "gene string, component int, w double")
    p = spark.createDataFrame([("a", "x"), ("b", "y")], "gene string, genome string")
    for g in ("x", "y"):
        p.where(F.col("genome") == g).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_arrivals(stream, l, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert got(out.select("genome", "component", "affinity")) == [("x", 0, 1.0), ("x", 1, 0.0), ("y", 0, 0.0), ("y", 1, 1.0)]
    assert out.select("batch").distinct().count() == 2


# --- distances, consensus, trees --------------------------------------------------


def _distances(spark, points):
    rows = [(f"n{i:02d}", f"n{j:02d}", float(np.linalg.norm(points[i] - points[j]))) for i in range(len(points)) for j in range(i)]
    return spark.createDataFrame(rows, "a string, b string, d double")


def test_distance_clusters(spark):
    rnd = np.random.default_rng(1)
    points = np.concatenate([rnd.normal(c, 0.2, (6, 2)) for c in (0, 5, 10)] + [np.array([[30.0, 30.0]])])
    pairs = _distances(spark, points)
    labels = {r["genome"]: r["cluster"] for r in consensus.distance_clusters(pairs, "a", "b", "d", 0.1).collect()}
    assert len(set(labels.values())) == 4 and len({labels[f"n{i:02d}"] for i in range(6)}) == 1
    kept = {r["genome"]: r["cluster"] for r in consensus.distance_clusters(pairs, "a", "b", "d", 0.2, min_size=2).collect()}
    assert kept["n18"] is None and len({v for v in kept.values() if v}) == 3
    table, threshold = consensus.sensitivity(pairs, "a", "b", "d")
    counts = [r["num_clusters"] for r in table.orderBy("threshold").collect()]
    assert len(counts) == 29 and counts == sorted(counts, reverse=True) and 0 < threshold <= 1
    assert consensus.cophenetic_correlation(pairs, "a", "b", "d") > 0.8
    assert consensus.correlation_distance(pairs, "a", "b", "d").count() == 19 * 9
    assert consensus.without(pairs, "a", "b", spark.createDataFrame([("n18",)], "genome string")).count() == 153


def test_tree_splits_as_by_sets(spark):
    rnd = random.Random(2)
    sets = {p: {f"g{i}" for i in range(40) if rnd.random() < 0.5} | {"all"} for p in range(5)}
    x = spark.createDataFrame([(p, g) for p, s in sets.items() for g in s], "component int, gene string")
    ids, links, clusters = consensus.tree(x, "component", "gene")
    leaves = {}
    for r in clusters.collect():
        leaves.setdefault(r["cluster"], set()).add(r["leaf"])
    assert len(leaves) == 9 and leaves[8] == set(sets)
    sizes = {r["cluster"]: tuple(r)[1:] for r in consensus.split_sizes(consensus.split_items(x, "component", "gene", clusters)).collect()}
    for c, members in leaves.items():
        inside, outside = [sets[m] for m in members], [s for p, s in sets.items() if p not in members]
        total, every, other = set().union(*inside), set.intersection(*inside), set().union(*outside)
        assert sizes[c] == (len(every - other), len(total - other), len(total), len(every))


# --- enrichment -------------------------------------------------------------------


def test_enrichment_with_products(spark):
    w = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.8), ("c", 1, 0.0), ("c", 2, 0.7)], "gene string, component int, w double")
    f = enrich.exploded_functions(spark.createDataFrame([("a", "F, G"), ("b", "F"), ("c", None), ("d", "F"), (None, "F")], "gene string, go string")).withColumnRenamed("go", "function")
    products = spark.createDataFrame([("b", "kinase"), ("a", "pump"), ("a", None)], "gene string, product string")
    out = {(r["component"], r["function"]): r for r in enrich.enrichment(w, f, products).collect()}
    assert set(out) == {(1, "F"), (1, "G")}
    r = out[1, "F"]
    assert (r["n_all"], r["n_function"], r["n_component"], r["overlap"], r["products"]) == (4, 3, 2, 2, "pump; kinase") and r["p_value"] == pytest.approx(0.5)
    named = enrich.named_functions(enrich.enrichment(w, f), spark.createDataFrame([("F", "folding")], "function string, name string"))
    assert got(named.select("function", "name")) == [("F", "folding"), ("G", "G")]
    assert got(enrich.component_by_function(enrich.enrichment(w, f), ["F", "G"]).select("component")) == [(1,)]


# --- order ------------------------------------------------------------------------


def vectors(spark, d):
    return spark.createDataFrame(list(d.items()), "strain string, genes array<string>")


def test_order_of_turned_and_mirrored_strains(spark):
    v = vectors(spark, {"r": list("abcde"), "turned": list("cdeab"), "mirror": list("edcba"), "both": list("baedc"), "odd": list("acbde"), "long": ["x", "a", "b", None, "c", "d", "e", "x"]})
    state = {r["strain"]: (r["state"], "".join(g or "-" for g in r["genes"])) for r in synteny.standardised(v, list("abcde"), "r").collect()}
    assert {k: s for k, (s, _) in state.items()} == {"r": "same", "turned": "same", "mirror": "flipped", "both": "flipped", "odd": "problem", "long": "same"}
    assert state["mirror"][1] == "abcde"
    groups = {r["strain"]: r["strain_group"] for r in synteny.order_groups(v, list("abcde")).collect()}
    assert groups.pop("odd") == 2 and set(groups.values()) == {1}
    assert got(synteny.largest_group(synteny.order_groups(v, list("abcde")))) == sorted([(k,) for k in groups])
    assert got(synteny.once_genes(v, 6)) == [(g,) for g in "abcde"]


def test_anchors_and_places(spark):
    v = vectors(spark, {"s": ["p", "c", "q", "b", "a", "r", None], "none": ["p", "q"], "empty": []})
    anchors = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "gene string, anchor int")
    up = synteny.rising(synteny.with_anchors(v, anchors))
    text = lambda df: {r["strain"]: [x["anchor"] or x["gene"] for x in r["items"]] for r in df.collect()}
    assert text(up)["s"] == [None, "r", 1, 2, "q", 3, "p"] and {r["strain"]: r["reversed"] for r in up.collect()} == {"s": True, "none": False}
    start = synteny.from_one(up)
    assert text(start)["s"] == [1, 2, "q", 3, "p", None, "r"]
    assert {r["strain"]: r["strict"] for r in synteny.strictly_ordered(start).collect()} == {"s": True, "none": False}
    assert got(synteny.gene_places(start)) == [("s", "p", 3, 1, 3, 1), ("s", "q", 2, 1, 1, 3), ("s", "r", 3, 3, 1, 1)]
    assert got(synteny.missing_anchor_pairs(synteny.gene_places(start), 3)) == [("s", "1-2")]


KINDS = {
    (1, 2, 3, 4): "no variation", (5, 7, 9): "no variation", (3, 4, 1, 2): "no variation", (4, 3, 2, 1): "no variation", (2, 1, 4, 3): "no variation", (1,): "no variation", (2, 1): "no variation",
    (1, 3, 2, 4): "inversion", (1, 2, 5, 4, 3, 6, 7): "inversion", (9, 1, 2, 5, 4, 3): "inversion", (1, 4, 5, 6, 2, 3, 7): "translocation", (7, 3, 2, 6, 5, 4, 1): "translocation",
    (1, 4, 5, 3, 2, 6, 7): "others", (1, 3, 5, 2, 4): "others", (2, 1, 3, 5, 4, 6, 8, 7): "others",
}


def _vectors(spark, orders):
    rows = [(str(i), [{"gene": None, "anchor": a} for a in p]) for i, p in enumerate(orders)]
    return spark.createDataFrame(rows, f"strain string, items array<{synteny.ITEM}>")


def test_kinds_of_variation(spark):
    found = {r["strain"]: r["variation"] for r in synteny.variations(_vectors(spark, [*KINDS, (1, 1, 2), ()])).collect()}
    assert found == {str(i): kind for i, kind in enumerate(KINDS.values())} | {str(len(KINDS)): "no variation"}


def test_planted_rearrangements_are_told(spark):
    rnd, orders, kinds = random.Random(5), [], []
    for _ in range(60):
        n = rnd.randrange(8, 15)
        a, b, c = sorted(rnd.sample(range(1, n), 3))
        x = list(range(1, n + 1))
        x, kind = (x[:a] + x[a:c][::-1] + x[c:], "inversion") if rnd.random() < 0.5 else (x[:a] + x[b:c] + x[a:b] + x[c:], "translocation")
        if kind == "inversion" and c - a > n - 2:
            continue  # a circle reversed but for one place is the circle
        if kind == "translocation" and sorted((b - a, c - b, n - c + a))[1] == 1:
            continue  # two neighbours that change places are also a block reversed
        at = rnd.randrange(n)
        x = x[at:] + x[:at]
        orders.append(x[::-1] if rnd.random() < 0.5 else x)
        kinds.append(kind)
    found = {int(r["strain"]): r["variation"] for r in synteny.variations(_vectors(spark, orders)).collect()}
    assert [found[i] for i in range(len(kinds))] == kinds


def test_nearest_vote_breaks_ties_by_the_nearer(spark):
    rows = [("s", f"g{i}", float(i), c) for i, c in enumerate("baabcc")] + [("t", "g", 1.0, "z")]
    df = spark.createDataFrame(rows, "sample string, genome string, distance double, cluster string")
    assert got(factor.nearest_vote(df)) == [("s", "b", 2.0), ("t", "z", 1.0)]


def test_frames_keep_nothing_of_empty_tables(spark):
    p = spark.createDataFrame([], "gene string, genome string")
    assert pr.gene_frequency(p).count() == 0 and pr.frequency_histogram(pr.gene_frequency(p)).count() == 0
    assert factor.factorise(p, [2])[0].count() == 0
    assert pr.pan_core_curve(p, 2).count() == 0
    assert synteny.strain_vectors(spark.createDataFrame([], "strain string, contig string, start int, locus string, gene string")).count() == 0


def test_maps_and_density_clusters(spark):
    from presencia.operators import embed

    rnd = random.Random(4)
    p = spark.createDataFrame([(f"g{i}", f"s{j:03d}") for j in range(60) for i in range(80) if rnd.random() < (0.9 if (i < 40) == (j < 30) else 0.05)], "gene string, genome string")
    ids = sorted({r["genome"] for r in p.collect()})
    g = embed.gram(p, ids)
    sets = {s: {r["gene"] for r in p.collect() if r["genome"] == s} for s in ids[:5]}
    assert [[len(sets[a] & sets[b]) for a in ids[:5]] for b in ids[:5]] == g[:5, :5].astype(int).tolist()
    y = embed.genome_map(p, 6)
    assert y.count() == 60 and y.where("x is null or isnan(x)").count() == 0
    models = embed.density_models(y, "genome", ["x", "y", "z"])
    assert models.count() == 25
    labels = {r["genome"]: r["label"] for r in embed.density_clusters(y, "genome", ["x", "y", "z"]).collect()}
    if labels:  # the two groups are told apart wherever they are labelled
        first, second = ({labels[s] for s in part if labels[s] >= 0} for part in (ids[:30], ids[30:]))
        assert not first & second
    with pytest.raises(ValueError):
        embed.neighbours((10, 10), 6)
    assert embed.neighbours((1000, 500)) == 5 and embed.neighbours((10, 10)) == 2


def test_density_models_use_whole_vectors(spark, tmp_path):
    from presencia.plans.model_queries import density_models

    rnd = np.random.default_rng(6)
    x = rnd.normal(0, 0.1, (80, 64))
    x[:40, 40:] += 5  # groups that differ only in the last elements
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["min_cluster_size"], r["min_samples"]): r["silhouette"] for r in density_models(spark, str(tmp_path)).collect()}
    assert len(got) == 25 and got[(28, 5)] > 0.9
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "other/embeddings.parquet"))
    with pytest.raises(ValueError):
        density_models(spark, str(tmp_path / "other"))


def test_leading_inertias_as_by_the_whole_decomposition(spark):
    rnd = random.Random(7)
    p = spark.createDataFrame([(f"g{i}", f"s{j}") for i in range(60) for j in range(12) if rnd.random() < [0.9, 0.2][(i % 3 == 0) == (j < 5)] or j == 11], "gene string, genome string")
    z = np.zeros((60, 12))
    for r in p.collect():
        z[int(r["gene"][1:]), int(r["genome"][1:])] = 1
    z = z[z.any(1)]
    x = np.concatenate([z, 1 - z], 1)
    x = x[:, x.any(0)] / x.sum()
    s = np.linalg.svd((x - np.outer(x.sum(1), x.sum(0))) / np.sqrt(np.outer(x.sum(1), x.sum(0))), compute_uv=False)
    lead = [r["inertia"] for r in factor.mca_leading(p, 5, 9).orderBy("component").collect()]
    assert lead[:2] == pytest.approx((s[:2] ** 2).tolist(), rel=0.02) and all(x <= y + 1e-9 for x, y in zip(lead, s**2))
    whole = [r["inertia"] for r in factor.mca(p).orderBy("component").collect()]
    assert whole[:4] == pytest.approx((s[:4] ** 2).tolist(), rel=1e-6)


def test_large_model_queries_are_whole_fits(spark, tmp_path):
    from presencia.plans import model_queries as mq

    def written(name, cells):
        rows = [(f"C{i:02d}A1", f"g.{j:02d}") for i, j in cells]
        spark.createDataFrame(rows, "cluster string, genome_id string").write.parquet(str(tmp_path / name / "locus_map.parquet"))
        return str(tmp_path / name)

    rnd = random.Random(9)
    noisy = written("noisy", [(i, j) for i in range(40) for j in range(20) if rnd.random() < (0.6 if (i < 20) == (j < 10) else 0.3)])
    lead = [r["inertia"] for r in mq.leading_inertia(spark, noisy).orderBy("component").collect()]
    whole = [r["inertia"] for r in mq.inertia(spark, noisy).orderBy("component").limit(2).collect()]
    assert lead == pytest.approx(whole, rel=1e-6)
    blocks = written("blocks", [(i, j) for i in range(24) for j in range(12) if (i > 11) + (i > 19) == (j > 4) + (j > 8)])
    h = mq.factor_large(spark, blocks).groupBy("genome").agg(F.collect_list("h").alias("h")).collect()
    assert len(h) == 12 and all(sorted(r["h"])[1] < 1e-6 * max(r["h"]) for r in h)


def test_two_normals_of_a_column(spark):
    rnd = np.random.default_rng(2)
    x = np.concatenate([rnd.normal(5, 1, 600), rnd.normal(20, 3, 400)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    low, high = factor.bi_modal(df, "x").orderBy("component").collect()
    assert (low["mean"], low["deviation"], low["weight"]) == pytest.approx((x[:600].mean(), x[:600].std(), 0.6), rel=0.03)
    assert (high["mean"], high["deviation"], high["weight"]) == pytest.approx((x[600:].mean(), x[600:].std(), 0.4), rel=0.03)
    with pytest.raises(ValueError):
        factor.bi_modal(df.where("x > 1e9"), "x")


# --- builds, sketches, files ------------------------------------------------------


def test_cds_build_from_files(spark, files):
    from presencia.operators import build

    paths = [str(files / "g2.faa"), str(files / "g1.faa")]
    made = build.cds_pangenome(spark, paths, str(files / "x.clstr"), "X")
    # in the order of the list c comes first and represents a, which has a line of its own
    assert got(made.headers) == [("a", "X_C0A1"), ("b", "X_C1A0"), ("c", "X_C0A1"), ("d", "X_C2A0")]
    assert got(made.genes) == [("X_C0", "g1"), ("X_C0", "g2"), ("X_C1", "g1"), ("X_C2", "g2")]
    own = build.cds_pangenome(spark, paths, str(files / "x.clstr"), "X", synonyms=False)
    assert got(own.alleles) == [("X_C0A0", "g1"), ("X_C0A1", "g2"), ("X_C1A0", "g1"), ("X_C2A0", "g2")]
    made.save(str(files / "saved"), {"name": "X"})
    back, meta = tb.load_tables(spark, str(files / "saved"))
    assert got(back["genes"]) == got(made.genes) and meta["name"] == "X"
    assert got(back["sequences"]) == [("X_C0A1", "MKVLLT"), ("X_C1A0", "MKK"), ("X_C2A0", "MAA")] and got(back["empty"]) == [("g1", "empty")]
    seqs = build.by_name(sq.read_fasta(spark, paths, last_wins=False))
    assert got(build.representatives(seqs)) == [("a", "MKVLLT"), ("b", "MKK"), ("d", "MAA")]


def test_noncoding_and_proximal_builds(spark, files):
    from presencia.operators import build

    contig = "".join(random.Random(1).choices("ACGT", k=40))
    (files / "g.fna").write_text(f">accn|k1\n{contig[:25]}\n{contig[25:]}\n>accn|k2\nACGTACGT\n")
    (files / "t.clstr").write_text(">Cluster 0\n0\t9nt, >f3... *\n>Cluster 1\n0\t4nt, >f4... *\n")
    made = build.noncoding_pangenome(spark, [str(files / "g.gff")], [str(files / "g.fna")], str(files / "t.clstr"), "N")
    assert got(made.genes) == [("N_T0", "g"), ("N_T1", "g")] and ("N_T1A0", "ACGT") in got(made.sequences)
    headers = spark.createDataFrame([("f1", "X_C1A0"), ("f2", "X_C1A1")], "header string, allele string")
    up = build.proximal_pangenome(spark, [str(files / "g.gff")], [str(files / "g.fna")], headers, "upstream", (-4, 3))
    assert got(up.select("gene", "seq", "prox_id")) == sorted([("X_C1", contig[1:8], "X_C1U0"), ("X_C1", contig[13:20], "X_C1U1")])
    coding = build.coding_nucleotide_pangenome(spark, [str(files / "g.gff")], [str(files / "g.fna")], str(files / "t.clstr"), "N", ("tRNA",))
    assert got(coding.genes) == [("N_C0", "g"), ("N_C1", "g")]


def test_sketch_distances(spark):
    from presencia.sources import sketches

    rnd = random.Random(5)
    base = "".join(rnd.choice("ACGT") for _ in range(20_000))
    near = "".join(c if rnd.random() > 0.02 else rnd.choice("ACGT") for c in base)
    rc = base[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("base", base[:9000]), ("base", base[9000:]), ("near", near), ("mirror", rc), ("far", "".join(rnd.choice("ACGT") for _ in range(20_000))), ("short", "ACGTN"), ("none", None)]
    df = spark.createDataFrame(rows, "genome string, seq string")
    d = {(r["genome1"], r["genome2"]): r["distance"] for r in sketches.distances(sketches.sketches(df)).collect()}
    assert d["base", "mirror"] < 0.002 and 0.01 < d["base", "near"] < 0.025 and d.get(("base", "far"), 1) > 0.2


def test_files_are_fetched_once_and_whole(tmp_path):
    import io

    from presencia.sources.fetch import fetch, genome_files

    asked = []

    def open_url(url):
        asked.append(url)
        if "bad" in url:
            raise OSError("no such file")
        return io.BytesIO(url.encode())

    wanted = genome_files(["1.1", "bad"], "ftp://host/{id}/{id}.{kind}", str(tmp_path))
    assert fetch(wanted, open_url=open_url) == ["bad", "bad"] and (tmp_path / "gff" / "1.1.gff").read_text() == "ftp://host/1.1/1.1.gff"
    assert fetch(wanted[:2], open_url=open_url) == [] and len(asked) == 4
    fetch(wanted[:1], force=True, open_url=open_url)
    assert len(asked) == 5 and not list(tmp_path.rglob("*.part"))


# --- models as a whole, look-ups --------------------------------------------------


def test_a_model_from_table_to_scores_and_back(spark, tmp_path):
    from presencia.operators import model

    rnd = random.Random(8)
    rows = [(f"g{i}", f"s{j}") for i in range(40) for j in range(24) if (i % 3 == j % 3) != (rnd.random() < 0.03)]
    p = spark.createDataFrame([*rows, rows[0], (None, "s0"), ("g0", None)], "gene string, genome string")
    m = model.FactorModel(p, (2, 3))
    assert m.presence.count() == len(rows)
    genes, genomes = factor.shape(m.presence)
    for r in m.scores.collect():
        assert r["tp"] + r["fn"] == len(rows) and r["tp"] + r["fn"] + r["fp"] + r["tn"] == genes * genomes
    assert m.best.first()["best"] == 3
    made = {(r["gene"], r["genome"]) for r in m.reconstruction.where("rank = 3").collect()}
    score = {r["rank"]: r for r in m.scores.collect()}[3]
    assert (len(made & set(rows)), len(made - set(rows))) == (score["tp"], score["fp"])
    assert m.thresholds.count() == 5
    model.check_decomposition(m.presence, *m.factors)
    m.save(str(tmp_path / "m"))
    again = model.FactorModel.load(spark, str(tmp_path / "m"))
    assert got(again.scores) == got(m.scores) and again.ranks == (2, 3)


def test_tables_that_do_not_fit_are_refused(spark):
    from presencia.operators import model

    p = spark.createDataFrame([("a", "s"), ("b", "t")], "gene string, genome string")
    w = spark.createDataFrame([(2, "a", 1, 0.5), (2, "b", 2, 0.5)], "rank int, gene string, component int, w double")
    h = spark.createDataFrame([(2, "s", 1, 0.5), (2, "t", 2, 0.5)], "rank int, genome string, component int, h double")
    model.Dataset(p, w=w, h=h, genes=p.select("gene"), genomes=p.select("genome")).check()
    model.check_shape(p, 2, 2)
    wrong = {
        "lacks": model.Dataset(p.drop("gene")), "come together": model.Dataset(p, w=w), "components differ": model.Dataset(p, w=w.where("component = 1"), h=h),
        "not in the presence": model.Dataset(p.where("gene = 'a'"), w=w, h=h), "more than once": model.Dataset(p, genes=p.select("gene").union(p.select("gene"))),
        "already": model.Dataset(p, new=p),
    }
    for said, d in wrong.items():
        with pytest.raises(ValueError, match=said):
            d.check()
    with pytest.raises(ValueError, match="shape"):
        model.check_shape(p, 3, 2)


def test_look_up_by_ids_keeps_their_order_and_raises_on_a_miss(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "id string, v int")
    assert got(tb.by_ids(df, "id", ["b", "a"]).select("id", "v", "ord")) == [("a", 1, 1), ("b", 2, 0), ("b", 3, 0)]
    with pytest.raises(KeyError, match="c"):
        tb.by_ids(df, "id", ["a", "c"])


def test_clusters_are_attached_and_texts_taken_out(spark, tmp_path):
    df = spark.createDataFrame([("a", "x.fna.fna"), ("b", None)], "id string, file string")
    c = spark.createDataFrame([("a", 7)], "genome string, cluster int")
    assert got(tb.without_text(tb.with_clusters(df, "id", c), "file", [".fna"]).select("id", "file", "cluster")) == [("a", "x", 7), ("b", None, None)]
    (tmp_path / "t.obo").write_text("format: 1\n\n[Term]\nid: GO:1\nname: first one\nname: later\n\n[Typedef]\nid: part\nname: no\n\n[Term]\nname: none\n\n[Term]\nid: GO:2\n")
    assert got(tb.read_terms(spark, str(tmp_path / "t.obo"))) == [("GO:1", "first one"), ("GO:2", None)]


def test_set_distances_of_all_pairs(spark):
    from presencia.operators import embed

    p = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "t"), ("b", "t"), ("c", "t"), ("d", "u")], "gene string, genome string")
    assert got(embed.set_distances(p)) == [("s", "t", pytest.approx(2 / 3)), ("s", "u", 1.0), ("t", "u", 1.0)]
    assert embed.set_distances(p.limit(0)).count() == 0


def test_what_was_written_can_be_cleared(spark, monkeypatch, tmp_path):
    from presencia import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file:{tmp_path}")
    one, two = (session.materialise(spark.range(5), x) for x in ("one", "two"))
    session.discard(one)
    (folder,) = (tmp_path / "presencia").iterdir()
    assert [f.name.partition("-")[0] for f in folder.iterdir()] == ["two"] and two.count() == 5
    session.clear(spark)
    session.clear(spark)
    assert not folder.exists()


def test_a_long_line_of_allele_names_is_split_once(spark, tmp_path):
    (tmp_path / "names.tsv").write_text("a\t" + "\t".join(f"h{i}" for i in range(30_000)) + "\nb\t\nc\n\nd\tx\t\ty\n")
    began = time.time()
    rows = tb.read_allele_names(spark, str(tmp_path / "names.tsv")).collect()
    assert time.time() - began < 20  # split again for each header it took over a minute
    assert [r["header"] for r in rows[:30_000]] == [f"h{i}" for i in range(30_000)] and {r["allele"] for r in rows[:30_000]} == {"a"}
    assert sorted(map(tuple, rows[30_000:])) == [("b", ""), ("d", ""), ("d", "x"), ("d", "y")]


def random_sets(spark, n, genes=40, seed=3):
    rnd = np.random.default_rng(seed)
    keep = rnd.random((n, genes)) < np.linspace(0.9, 0.05, genes)[None, :] * rnd.uniform(0.3, 1, n)[:, None]
    keep[:, 0] = True
    return keep, spark.createDataFrame([(f"c{g}", f"s{i:04}") for i, g in zip(*np.nonzero(keep), strict=True)], "gene string, genome string")


def square_of(keep):
    both = (keep.astype(int) @ keep.T.astype(int)).astype(float)
    return 1 - both / (keep.sum(1)[:, None] + keep.sum(1)[None, :] - both)


def test_set_distances_have_no_largest_number_of_genomes(spark):
    p = spark.range(5100).selectExpr("explode(array('core', concat('c', id % 700))) as gene", "concat('s', id) as genome")
    rows = embed.set_distances(p)  # over 5000 genomes were an error
    told = rows.agg(F.count(F.lit(1)), F.sum((F.col("distance") == 0).cast("int")), F.sum((F.abs(F.col("distance") - 2 / 3) < 1e-12).cast("int")), F.bool_and(F.col("a") < F.col("b"))).first()
    same = 200 * (8 * 7 // 2) + 500 * (7 * 6 // 2)
    assert tuple(told) == (5100 * 5099 // 2, same, 5100 * 5099 // 2 - same, True)
    keep, p = random_sets(spark, 60)
    d = square_of(keep)
    assert {(r["a"], r["b"]): r["distance"] for r in embed.set_distances(p).collect()} == {(f"s{i:04}", f"s{j:04}"): pytest.approx(d[i, j]) for i in range(60) for j in range(i + 1, 60)}


def test_pairs_without_some_genomes_are_not_shuffled(spark):
    pairs = embed.set_distances(random_sets(spark, 30)[1])
    rest = consensus.without(pairs, "a", "b", pairs.select(F.col("a").alias("genome")).where("a < 's0010'"))
    assert rest.count() == 20 * 19 // 2
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_linkage_in_rounds_as_whole(spark, monkeypatch):
    keep, p = random_sets(spark, 80, genes=5000)
    own, want = sets.sets_of(p), clustering.ward(square_of(keep))
    assert np.array_equal(sets.linkage(spark, own), want)
    up = np.triu_indices(80, 1)
    assert sets.cophenetic_correlation(spark, own, want) == pytest.approx(np.corrcoef(clustering.cophenetic(want)[up], square_of(keep)[up])[0, 1])
    monkeypatch.setattr(sets, "MAX_SQUARE", 15)
    assert sets.linkage(spark, own) == pytest.approx(want)
    ties = sets.sets_of(spark.range(100).selectExpr("concat('c', id) as gene", "concat('s', id) as genome"))  # all at 1: pairs by pairs, not one a round
    made = sets.linkage(spark, ties)
    assert len(made) == 99 and made[-1, 3] == 100 and made[0, 2] == 1


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """More genomes than one square of 5000, with many equal sets."""
    folder = str(tmp_path_factory.mktemp("crowd"))
    genes = "explode(array('core', concat('c', id % 700), concat('d', id % 37), concat('e', id % 11))) as cluster"
    spark.range(5050).selectExpr("id as row_id", genes, "concat(id % 12, '.', id) as genome_id").write.parquet(f"{folder}/locus_map.parquet")
    return folder


def test_clusters_of_more_genomes(spark, crowd):
    rows = mq.distance_clusters(spark, crowd)  # over 5000 leaves were an error
    assert rows.count() == 5050 and rows.where("cluster is null").count() == 0


def test_sensitivity_of_more_genomes(spark, crowd):
    counts = [r["num_clusters"] for r in mq.distance_sensitivity(spark, crowd).orderBy("threshold").collect()]
    assert counts == sorted(counts, reverse=True) and counts[0] == 5050 and counts[-1] >= 1


def test_kept_clusters_of_more_genomes(spark, crowd):
    told = mq.distance_clusters_kept(spark, crowd).first()
    assert (told["n_genomes"], told["n_clustered"], told["numbered"]) == (5050, 5050, True)


def test_distances_without_of_more_genomes(spark, crowd):
    n = 5050 * 4 // 5
    assert mq.distances_without(spark, crowd).count() == n * (n - 1) // 2


def test_correlations_of_more_genomes(spark, crowd):
    rows = mq.distance_correlation(spark, crowd)
    told = rows.agg(F.count(F.lit(1)), F.min("distance"), F.max("distance")).first()
    assert told[0] == 5050 * 5049 // 2 and 0 < told[1] < told[2] <= 2  # no two sets are equal here
    keep, p = random_sets(spark, 60)
    c = 1 - np.corrcoef(square_of(keep))
    found = sets.correlation_distances(spark, sets.sets_of(p)).collect()
    assert len(found) == 60 * 59 // 2 and all(r["distance"] == pytest.approx(c[int(r["genome_1"][1:]), int(r["genome_2"][1:])]) for r in found)


def test_leading_vectors_as_by_the_whole_decomposition(monkeypatch):
    rnd = np.random.default_rng(5)
    a = np.triu(rnd.random((300, 300)) < 0.05, 1) * rnd.random((300, 300))
    (i, j), w = np.nonzero(a), a[np.nonzero(a)]
    degree = np.bincount(i, w, 300) + np.bincount(j, w, 300)
    w = w / np.sqrt(degree[i] * degree[j])
    whole = embedding.leading_vectors(i, j, w, 300, 4, rnd)
    monkeypatch.setattr(embedding, "DENSE_POINTS", 10)
    found = embedding.leading_vectors(i, j, w, 300, 4, rnd)
    assert np.abs((whole * found).sum(0)) == pytest.approx(1, abs=1e-8)


def test_map_of_more_genomes(spark, crowd):
    rows = mq.genome_map(spark, crowd)  # over 5000 genomes were an error
    assert rows.select("genome").distinct().count() == 5050
    assert tuple(mq.map_kept(spark, crowd).first()) == (5050, True, True)


def test_inertias_as_by_the_burt_matrix(spark, crowd):
    keep, p = random_sets(spark, 50)
    keep[7] = True  # a genome with all genes has no second answer
    p = spark.createDataFrame([(f"c{g}", f"s{i:04}") for i, g in zip(*np.nonzero(keep), strict=True)], "gene string, genome string")
    z = np.hstack([keep.T, ~keep.T]).astype(float)
    want = kernels.mca_inertia(z.T @ z, 50)
    found = factor.mca(p).orderBy("component").collect()
    assert len(want) == 49 and [r["inertia"] for r in found] == pytest.approx(want, abs=1e-10) and found[-1]["cumulative"] == pytest.approx(1)
    a = np.random.default_rng(2).normal(size=(1600, 1600))
    a = a + a.T
    assert kernels.eigenvalues(a.copy()) == pytest.approx(np.linalg.eigvalsh(a), abs=1e-9)
    assert tuple(mq.inertia_kept(spark, crowd).first()) == (True, True, True, 5050)  # over 5000 genomes were an error


def test_ranks_from_inertias_of_more_genomes(spark, crowd):
    ranks = [r["rank"] for r in mq.inertia_ranks(spark, crowd).collect()]  # over 5000 genomes were an error
    assert ranks == sorted(set(ranks)) and ranks[:2] == [2, 5] and ranks[-1] <= 5050


def test_inertias_of_genomes_in_groups(spark):
    rnd = np.random.default_rng(4)
    keep = np.zeros((1201, 3 + 40 * 50), bool)  # genomes by genes: three that nearly all have, 50 of each group
    keep[:, :3] = rnd.random((1201, 3)) < [1, 0.98, 0.9]
    for g in range(1200):
        keep[g, 3 + g // 30 * 50 : 53 + g // 30 * 50] = rnd.random(50) < 0.4
    keep[7] = keep[8]  # two of the same genes; the last genome has none of a group
    p = spark.createDataFrame([(f"g{j}", f"s{i:04}") for i, j in zip(*np.nonzero(keep), strict=True)], "gene string, genome string")
    own = sets.sets_of(p)
    groups, across = sets.parted(own)  # before, one task held the square of all genomes
    assert sorted(map(len, groups)) == [1] + [30] * 40 and len(across) == 3
    x = keep[:, keep.any(0)].astype(float)
    r = np.corrcoef(x)
    found = sets.inertias(spark, own)
    assert found == pytest.approx(np.maximum(np.linalg.eigvalsh(r)[::-1], 0) / 1201, abs=1e-13) and found.sum() == pytest.approx(1)


def test_eigenvalues_changed_by_a_few_columns():
    rnd = np.random.default_rng(6)
    poles = np.concatenate([rnd.gamma(0.3, 1, 400), np.zeros(40), np.full(60, 0.25)])
    v, signs = rnd.normal(size=(500, 6)), np.array([-1.0, 1, 1, -1, 1, 1])
    v[:, 2], v[9] = v[:, 1], 0
    w, s = kernels.low_rank(v, signs)
    found = np.sort(np.concatenate([kernels.changed_eigenvalues(poles, w, s, k, 3) for k in range(3)]))
    assert w.shape == (500, 5) and found == pytest.approx(np.linalg.eigvalsh(np.diag(poles) + (v * signs) @ v.T), abs=1e-11)


def test_kept_inertias_of_a_hundred_thousand_genomes(spark, tmp_path):
    genes = "explode(array('core', concat('t', id % 5000), concat('c', id % 5000, '.', id % 3), concat('d', id % 5000, '.', id % 7), if(id % 50 = 0, 'often', 'most'))) as cluster"
    spark.range(100_000).selectExpr("id as row_id", genes, "concat(id % 5000, '.', id) as genome_id").write.parquet(f"{tmp_path}/locus_map.parquet")
    assert tuple(mq.inertia_kept(spark, str(tmp_path)).first()) == (True, True, True, 100_000)  # a square of 80 GB before


def test_map_takes_few_passes_over_its_edges():
    rnd, n, k = np.random.default_rng(8), 6000, 40
    near = (np.arange(n)[:, None] + np.argsort(rnd.random((n, 200)), axis=1)[:, :k] + 1) % n
    dist = np.sort(rnd.random((n, k)), axis=1)

    def took(f, times=1):
        start = time.thread_time()
        for _ in range(times):
            f()
        return time.thread_time() - start

    unit = took(lambda: np.bincount(near.ravel(), dist.ravel(), n), 100)
    assert took(lambda: embedding.of_neighbours(near, dist, epochs=90)) < 105 * unit  # 148 and 154 times before, now 54 and 67


def test_spectrum_of_a_matrix_held_once():
    rnd = np.random.default_rng(1)
    x = (rnd.random((1600, 700)) < 0.1).astype(float)
    x[1500:] = x[:100]  # many eigenvalues are 0
    a, v = x @ x.T / 700, rnd.normal(size=(1600, 5))
    want, vectors = np.linalg.eigh(a)
    found, w = kernels.spectrum(a, v)  # there was none before
    assert np.sort(found) == pytest.approx(want, abs=1e-11)
    sums = lambda poles, w, x: (w / (poles - x)[:, None]).T @ w
    for x in (-0.5, (want[-2] + want[-1]) / 2, want[-1] + 1):
        assert sums(found, w, x) == pytest.approx(sums(want, vectors.T @ v, x), rel=1e-8, abs=1e-8)
