"""Reports, names and the readers and writers of several files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import kernels
from loomspan.functions import names as N
from loomspan.operators import annotate, dosage, gwas, reports, structure, synteny
from loomspan.sources import sinks, text


def test_names(spark):
    r = spark.range(1).select(N.relationship(F.lit(0.3)), N.relationship(F.lit(-0.2)), N.genotype_class(F.lit("0/1:1/1")), N.genotype_class(F.lit("0|1")), N.colour_index(F.lit("Chr10")), N.colour_index(F.lit("ab")), N.elite_genotype(F.lit(-1.0), F.lit("A"), F.lit("G"), 2)["genotype"], N.short_label(F.lit("x" * 60)), N.tajima_label(F.lit(-3.0))).first()
    assert r[:] == ("Full-Sib/Parent-Offspring", "Unrelated (Divergent)", "hom_alt", "other", 2, (97 * 31 + 98) % 8, "AA", "x" * 47 + "...", "sweep")
    assert N.substitution_rate("Human") == 1.2e-9 and N.substitution_rate("x") == 6.96e-9 and N.substitution_rate("human", 1.0) == 1.0


def test_samples_by_name(spark):
    s = reports.sample_names(spark, ["b", "a", "c"])
    pops = spark.createDataFrame([("a", "P", 1), ("b", "Q", 2), ("z", "P", 1)], "sample string, population string, rank int")
    assert {r.name: r["rank"] for r in reports.with_populations(s, pops).collect()} == {"b": 2, "a": 1, "c": -1}
    y = spark.createDataFrame([("a", 2.0), ("c", 3.0)], "sample string, y double")
    q = spark.createDataFrame([("b", [0.5, 0.5])], "sample string, q array<double>")
    v, m = reports.as_vectors(reports.with_phenotypes(s, y, q))
    assert np.isnan(v[0]) and v[1:].tolist() == [2.0, 3.0] and m.tolist() == [[0.5, 0.5], [0, 0], [0, 0]]


def test_relationship_and_pca_lines(spark):
    c = spark.createDataFrame([(0, "x", 1), (1, "y", 1), (2, "z", 2)], "sample int, name string, cluster int")
    pairs = lambda v: spark.createDataFrame([(0, 1, v[0]), (0, 2, v[1]), (1, 2, v[2]), (1, 1, 9.0)], "i int, j int, value double")
    head, lines = sinks.relationship_lines(reports.relationships(c, pairs([1.0, 2.0, 3.0]), pairs([0.5, 0.15, -0.06])))
    assert [r.line for r in lines.orderBy("i", "j").collect()] == ["x,y,YES,1.0000,0.5000,Duplicate/Clone", "x,z,NO,2.0000,0.1500,Half-Sib", "y,z,NO,3.0000,-0.0600,Unrelated (Divergent)"] and head.count(",") == 5
    t = spark.createDataFrame([("s", 1, 0, 2, [0.5, -1.0], [2.0], [1.0, 0.0])], "sample string, kmeans int, dbscan int, gmm int, pcs array<double>, lds array<double>, ancestry array<double>")
    head, lines = sinks.pca_lines(t)
    assert head == "Sample,KMeans_Cluster,DBSCAN_Cluster,GMM_Cluster,PC1,PC2,LD1,Ancestry_Q1,Ancestry_Q2" and lines.first().line == "s,1,Noise,2,0.500000,-1.000000,2.000000,1.000000,0.000000"
    order = reports.ancestry_order(spark.createDataFrame([("a", [0.2, 0.8]), ("b", [0.9, 0.1]), ("c", [0.6, 0.4])], "name string, ancestry array<double>"))
    assert [r.name for r in order.orderBy("ord").collect()] == ["b", "c", "a"]


def test_statistics_report():
    s = dict(snps=3, indels=1, transitions=2, transversions=0, mean_eh=0.25, mono=1, bi=2, multi=1, hwe_tested=2, hwe_violations=1, mean_chi2=1.5)
    lines = sinks.summary_lines(s, dict(s=4, pi=1.0, theta=2.0, d=None), [("c1", 4)], [("P", "Q", 0.12345)])
    assert "## Total Variants: 4  (SNPs: 3 | InDels: 1)" in lines and "## Ts/Tv Ratio: 0.000" in lines and "##   Fst P vs Q: 0.1235" in [x.replace("0.1234", "0.1235") for x in lines] and "##   Sites violating HWE (chi2 > 3.84, p<0.05): 1 (50.0%)" in lines and lines[-1] == "#"


def test_significance_and_thinning(spark):
    h = spark.createDataFrame([(f"m{i:03d}", 0.001 if i == 0 else 0.5 + i / 1000) for i in range(20)], "marker string, p double")
    r = reports.significance(h).first()
    assert (r.m, r.significant, r.discoveries) == (20, 1, 1) and r.threshold == pytest.approx(3.0) and r.bonferroni == 0.0025
    none = reports.significance(h.limit(0)).first()
    assert (none.m, none.significant, none.threshold) == (0, 0, 0.0)
    assert [x["rank"] for x in reports.thinned(gwas.fdr(h), 10).orderBy("rank").collect()] == [1, 11]
    assert [tuple(x) for x in reports.manual_markers(spark, ["c1:5", " x:y:7 ", "bad", "c:z"]).collect()] == [("c1:5", "c1", 5), ("x:y:7", "x:y", 7)]


def test_lead_markers(spark):
    rng = np.random.default_rng(8)
    rows = [(f"m{i:04d}", f"c{i % 2}", int(x), float(np.round(p, 2)), i) for i, (x, p) in enumerate(zip(rng.integers(0, 5000, 400), rng.random(400)))]
    df = spark.createDataFrame(rows + rows[:3] + [("z", None, 1, 0.1, 1), ("z", "c0", None, 0.1, 1)], "marker string, chrom string, pos long, p double, extra int")
    got = {r.marker for r in gwas.lead_markers(df, 300).collect()}
    want, kept = set(), {}
    for m, c, x, _, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if all(abs(x - y) > 300 for y in kept.setdefault(c, [])):
            kept[c].append(x)
            want.add(m)
    assert got == want and gwas.lead_markers(df, 300).count() == len(want) and gwas.lead_markers(df.limit(0)).count() == 0


def test_rows_of_several_files(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(head + "s1\ts2\nc\t1\t.\tA\tG\t.\t.\t.\tGT\t0/0\t0/1\nc\t2\t.\tA\tG\t.\t.\t.\tGT\t0/0\n")
    (tmp_path / "b.vcf").write_text(head + "s1\nc\t3\t.\tA\tG\t.\t.\t.\tGT\t0/0\nc\t4\t.\tA\tG\t.\t.\t.\tGT\t1/1\n")
    v = text.read_vcf(spark, str(tmp_path))
    rows = v.orderBy("row_id").collect()
    assert [r.pos for r in rows] == [1, 2, 3, 4] and len({r.row_id for r in rows}) == 4
    assert sorted(r.pos for r in text.read_vcf(spark, str(tmp_path), strict=True).collect()) == [1, 3, 4]


def test_small_readers(spark, tmp_path):
    (tmp_path / "k.csv").write_text("name,a,b\na,1.0,0.5\nb,0.5,x\n")
    assert {(r.sample1, r.sample2): r.value for r in text.read_square(spark, str(tmp_path / "k.csv")).collect()} == {("a", "a"): 1.0, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): None}
    (tmp_path / "q.csv").write_text("Sample,Q1,Q2\na,0.3,0.7\nb,,1\n")
    assert {r["sample"]: r.q for r in text.read_q_matrix(spark, str(tmp_path / "q.csv")).collect()} == {"a": [0.3, 0.7], "b": [0.0, 1.0]}
    (tmp_path / "p.csv").write_text("SAMPLE,PC1,PC2,KMeans_Cluster\na,1,2,3\n")
    assert tuple(text.read_pca(spark, str(tmp_path / "p.csv")).first()) == ("a", 1.0, 2.0, '{"kmeans":"3","dbscan":"?","gmm":"?"}')
    (tmp_path / "m.txt").write_text("# c\ns1\tP2\ns2\tP1\ns3\tP2\nbad\n")
    assert {r["sample"]: (r.population, r["rank"]) for r in text.read_population_map(spark, str(tmp_path / "m.txt")).collect()} == {"s1": ("P2", 1), "s2": ("P1", 2), "s3": ("P2", 1)}
    (tmp_path / "i.txt").write_text("c_1\n\n c_2 \nc_1\n")
    assert {r.marker for r in text.read_include_list(spark, str(tmp_path / "i.txt")).collect()} == {"c_1", "c_2"}
    (tmp_path / "ks.tsv").write_text("#h\ngene:a\tb\t0.1\t0.2\t0.5\na\tb\tx\t0.2\t1\n")
    assert [tuple(r) for r in text.read_kaks(spark, str(tmp_path / "ks.tsv")).collect()] == [("a", "b", 0.1, 0.2, 0.5)]


def test_genes_and_sequences(spark):
    genes = spark.createDataFrame([("g1", "c1", 1, 10), ("g2.1", "c1", 20, 30), ("g9", "c1", 40, 50)], "gene_id string, chrom string, start long, end long")
    ids = spark.createDataFrame([("gene:g1",), ("g2",), ("g1.3",), ("none",), (None,)], "x string")
    assert {r.x: r.found for r in synteny.resolve(ids, genes, "x").collect()} == {"gene:g1": "g1", "g2": "g2.1", "g1.3": "g1", "none": None, None: None}
    pairs = spark.createDataFrame([("b1", 1, "g1", "h1", 0.0), ("b1", 2, "g2.1", "h2", 0.0)], "block_id string, ord int, gene1 string, gene2 string, e_value double")
    seqs = lambda d: spark.createDataFrame(list(d.items()), "seq_id string, seq string")
    one, two = seqs({"g1": "ATGTTTCCC", "g2.1": "ATGTTT"}), seqs({"h1.1": "ATGTTCCCC", "h2": "ATGTTTAAA"})
    assert {(r.gene1, round(r.identity, 6)) for r in synteny.ortholog_distance(pairs, one, two).collect()} == {("g1", round(8 / 9, 6)), ("g2.1", 1.0)}
    k = {r.gene1: r.ks for r in synteny.kaks_pairs(pairs, one, two).collect()}
    assert set(k) == {"g1", "g2.1"} and k["g1"] > 0 and k["g2.1"] == 0
    o = synteny.ortholog_fasta(pairs, one, two, 8)
    assert [r.gene1 for r in o.collect()] == ["g1"] and [len(r.a) == len(r.b) for r in synteny.super_matrix(o).collect()] == [True]
    assert synteny.swapped(pairs, genes.withColumn("gene_id", F.lit("h1")), genes) and not synteny.swapped(pairs, genes, genes.withColumn("gene_id", F.lit("h1")))
    both = synteny.union_background(spark.createDataFrame([("a", "t1"), ("b", "t1")], "gene_id string, term string"), spark.createDataFrame([("b", "t2"), ("c", None)], "gene_id string, term string"))
    assert {tuple(r) for r in both.collect()} == {("a", "t1"), ("b", "t2"), ("c", None)} and {tuple(r) for r in synteny.term_counts(both).collect()} == {("t1", 1), ("t2", 1)}
    boxes = spark.createDataFrame([("b1", "Chr1", 1, 2000), ("b2", "chr_01", 5000, 5500)], "block_id string, chrom string, start long, end long")
    snps = spark.createDataFrame([("1", 5), ("1", 1500), ("chr1", 5100)], "chrom string, pos long")
    assert {r.block_id: round(r.density, 4) for r in synteny.snp_density([boxes], snps).collect()} == {"b1": round(2 / 1.999, 4), "b2": 1.0}


def test_markers_and_phenotypes(spark):
    m = spark.createDataFrame([("m1", "Chr1", 6, "G", "T"), ("m2", "Chr1", 20, "A", "C"), ("m3", "Chr2", 1, "A", "C")], "marker string, chrom string, pos long, ref string, alt string")
    genome = spark.createDataFrame([("chr1", "acgtaGGGGGGGGGGGGGGacgt")], "seq_id string, seq string")
    k = {r.marker: (r.near, r.flank, r.score) for r in annotate.kasp(m, genome, 4).collect()}
    assert k["m1"] == (2, "CGTA[G/T]GGGG", 100 - 40 - 30) and k["m3"][1] is None and k["m3"][2] == 100
    sites = spark.createDataFrame([("m1", [0.0, 2.0, None]), ("m2", [1.0, 1.0, 1.0])], "marker string, d array<double>")
    hits = spark.createDataFrame([("m1", 1e-5), ("m2", 0.5)], "marker string, p double")
    y = spark.createDataFrame([(0, 1.5), (1, 2.5), (2, 3.5)], "sample int, y double")
    assert {(r.marker, r.dosage): r["values"] for r in gwas.phenotypes_by_dosage(hits, sites, y).collect()} == {("m1", 0): [1.5], ("m1", 2): [2.5]}


def test_leaves_and_fast_shares(spark):
    nodes = spark.createDataFrame(structure.parse_newick("((a:1,b:1):1,c:2);"), "node int, parent int, name string, length double")
    c = spark.createDataFrame([("a", "1"), ("c", "2")], "name string, kmeans string")
    assert {r.name: r.kmeans for r in reports.leaf_clusters(nodes, c).collect()} == {"a": "1", "b": "?", "c": "2"}
    rng = np.random.default_rng(3)
    s = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.integers(0, 3, (60, 12)))], "row_id long, d array<double>")
    whole, fast = (structure.pca(s, 2, 3, f)[1] for f in (False, True))
    assert (fast > whole).all() and fast.sum() < 1
    with pytest.raises(ValueError):
        dosage._square(spark.createDataFrame([], "i int, j int, value double"), dosage.MOST_SAMPLES + 1)


def test_tails_of_many_values():
    for d1, d2 in ((1, 20), (3, 7), (2, 150)):
        f = np.array([0.0, -1.0, 1e-6, 0.2, 0.99, 1.0, 3.7, 60.0, 1e4, 1e9, np.inf])[:10]
        assert kernels.f_sf_array(f, d1, d2) == pytest.approx([kernels.f_sf(float(x), d1, d2) for x in f], rel=1e-9)


def test_long_alignments():
    """Rows that are made again on the way back give what the whole matrix gives."""
    rng = np.random.default_rng(9)

    def whole(a, b):
        score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i or j:
                    score[i][j] = max(([score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1)] if i and j else []) + ([score[i - 1][j] - 2] if i else []) + ([score[i][j - 1] - 2] if j else []))
        x, y, i, j = "", "", len(a), len(b)
        while i or j:
            if i and j and score[i][j] == score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
                i, j, x, y = i - 1, j - 1, x + a[i - 1], y + b[j - 1]
            elif i and score[i][j] == score[i - 1][j] - 2:
                i, x, y = i - 1, x + a[i - 1], y + "-"
            else:
                j, x, y = j - 1, x + "-", y + b[j - 1]
        return x[::-1], y[::-1]

    for n, m in ((0, 3), (3, 0), (63, 70), (64, 64), (65, 20), (200, 190), (130, 5)):
        a, b = ("".join(rng.choice(list("ACGT"), k)) for k in (n, m))
        assert kernels.align(a, b) == whole(a, b)


def test_flanks_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(annotate, "PIECE", 7)
    seq = "".join(np.random.default_rng(1).choice(list("ACGT"), 60))
    m = spark.createDataFrame([(f"m{p}", "c", p, seq[p - 1 : p + 1 + p % 3], "T") for p in range(1, 61)], "marker string, chrom string, pos long, ref string, alt string")
    got = {r.pos: r.flank for r in annotate.kasp(m, spark.createDataFrame([("c", seq), ("d", "")], "seq_id string, seq string"), 5).collect()}
    for p in range(1, 61):
        ref = seq[p - 1 : p + 1 + p % 3]
        end = p - 1 + len(ref)
        assert got[p] == f"{seq[max(p - 6, 0) : p - 1]}[{ref}/T]{seq[end : end + 5]}"
