import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import calls as C
from loomspan.functions import kernels, names
from loomspan.functions.sequences import amino, gc, jukes_cantor, reverse_complement, translate
from loomspan.operators import annotate, dosage, gwas, ld, merge, ranges, structure
from loomspan.sources import sinks, text

VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSample1\tSample2\tSample3\n"
# the same two sites as three callers write them
CALLERS = {
    "bsdp": "Chr1\t1000\t.\tA\tG\t.\t.\t.\tGT:BSDP\t0/1:15,35\t1/1:40,0\t0/0:0,50\nChr1\t2000\ts2\tC\tT\t.\t.\t.\tGT:BSDP\t0/1:25,25\t./.:.\t0/0:2,48\n",
    "four": "Chr1\t1000\t.\tA\tG\t.\t.\t.\tGT:BSDP\t0/1:35,0,15,0\t1/1:0,0,40,0\t0/0:50,0,0,0\nChr1\t2000\ts2\tC\tT\t.\t.\t.\tGT:BSDP\t0/1:0,25,0,25\t./.:.\t0/0:0,48,0,2\n",
    "ad": "Chr1\t1000\t.\tA\tG\t.\t.\t.\tGT:AD\t0/1:35,15\t1/1:0,40\t0/0:50,0\nChr1\t2000\ts2\tC\tT\t.\t.\t.\tGT:AD\t0/1:25,25\t./.:.,.\t0/0:48,2\n",
    "ro": "Chr1\t1000\t.\tA\tG\t.\t.\t.\tGT:RO:AO\t0/1:35:15\t1/1:0:40\t0/0:50:0\nChr1\t2000\ts2\tC\tT\t.\t.\t.\tGT:RO:AO\t0/1:25:25\t./.:.:.\t0/0:48:2\n",
}
WANT = {1000: [0.3, 1.0, 0.0], 2000: [0.5, None, 0.04]}


def _vcf(spark, tmp_path, name, body):
    p = tmp_path / f"{name}.vcf"
    p.write_text(VCF + body)
    return text.read_vcf(spark, str(p)), str(p)


@pytest.mark.parametrize("caller", list(CALLERS))
def test_callers_agree(spark, tmp_path, caller):
    v, path = _vcf(spark, tmp_path, caller, CALLERS[caller])
    assert text.vcf_samples(spark, path) == ["Sample1", "Sample2", "Sample3"]
    assert {r.pos: r.d for r in dosage.dosages(v).collect()} == WANT


def test_conversion_keeps_dosages(spark, tmp_path):
    v, _ = _vcf(spark, tmp_path, "x", CALLERS["four"])
    for to in ("ad", "ro"):
        assert {r.pos: r.d for r in dosage.dosages(text.convert_calls(v, to)).collect()} == WANT


def test_other_dosage_rules(spark):
    one = lambda call, rule, fmt="GT:AD", **k: spark.range(1).select(C.dosage(F.lit(call), F.lit(fmt), F.lit("A"), F.lit("G"), rule, **k)).first()[0]
    assert one("0/1/1/.", "gt_then_counts", "GT") == 3.0 and one("1/2", "gt_digits", "GT") == 2.0 and one("./.", "gt_digits", "GT") is None
    assert one("0/1:.", "counts") is None and one("0/0/1:.", "counts_then_gt") == pytest.approx(1 / 3)
    assert one("0/1:3,1", "counts", min_depth=5) is None and one("0/1:3,1", "ref_fraction") == 0.75
    assert one("0/1:x,1", "counts") is None
    level = [r[0] for r in spark.createDataFrame([(x,) for x in (0.25, 0.26, 0.75, 0.74)], "x double").select(C.to_level(F.col("x"), 2)).collect()]
    assert level == [0.0, 0.5, 0.5, 0.5]
    assert spark.range(1).select(C.acgt(F.lit(0.75), F.lit("A"), F.lit("G,T"), 4), C.acgt(F.lit(None).cast("double"), F.lit("A"), F.lit("G"), 2)).first()[:] == ("AAAG", "NN")


def test_names_and_sequences(spark):
    r = spark.range(1).select(names.chromosome_key(F.lit(" Chromosome_007 ")), names.contig_key(F.lit("scaffold_01-b")), names.gene_key(F.lit("GENE:x.1")), translate(F.lit("ATGTAAG")), amino(F.lit("NNN")), gc(F.lit("ACGg")), reverse_complement(F.lit("AACG")), jukes_cantor(F.lit(0.8))).first()
    assert r[:] == ("7", "1b", "x.1", "M*", "X", 0.75, "CGTT", 3.0)


def test_hwe_and_tails():
    assert kernels.hwe_exact(0, 0, 0) == 1.0 and kernels.hwe_exact(25, 50, 25) == pytest.approx(1.0, abs=1e-9)
    # the comparison with the observed probability has a tolerance of 1e-9 of the greatest
    assert kernels.hwe_exact(50, 0, 50) < 1e-9
    # F(1, 100) at 100 and 15; t and F agree
    assert kernels.f_sf(100, 1, 100) == pytest.approx(1.006e-16, rel=2e-2)
    assert kernels.t_sf2(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert kernels.hypergeometric_sf(2, 5, 4, 10) == pytest.approx(1 - (math.comb(6, 5) + 4 * math.comb(6, 4)) / math.comb(10, 5))


def test_alignment_and_rates():
    a, b = kernels.align("ACGTT", "ACTT")
    assert a == "ACGTT" and b.replace("-", "") == "ACTT" and len(a) == len(b)
    assert kernels.align("", "AC") == ("--", "AC")
    ka, ks, ratio = kernels.kaks("TTT", "TTC")
    assert ka == 0 and ks > 0 and ratio == 0
    assert kernels.kaks("NNN", "TTC") == (0.0, 0.0, 0.0)


def _sites(spark, x):
    rows = [(i, "c", 10 * i, f"m{i}", [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, chrom string, pos long, marker string, d array<double>")


def test_pair_sums_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((40, 6))
    x[rng.random(x.shape) < 0.3] = np.nan
    got = {m: {(r.i, r.j): r.value for r in dosage.genetic_distance(_sites(spark, x), m).collect()} for m in ("manhattan", "euclidean", "nei")}
    for i in range(6):
        for j in range(i + 1, 6):
            k = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[k, i], x[k, j]
            assert got["manhattan"][i, j] == pytest.approx(np.abs(a - b).mean())
            assert got["euclidean"][i, j] == pytest.approx(np.sqrt(((a - b) ** 2).mean()))
            assert got["nei"][i, j] == pytest.approx(-np.log((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())))


def test_ld_is_squared_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.random((12, 20))
    x[0, 3] = np.nan
    got = {(r.row1, r.row2): r.r2 for r in ld.ld_pairs(_sites(spark, x), 30, 0.0).collect()}
    assert set(got) == {(i, j) for i in range(12) for j in range(i + 1, min(i + 4, 12))}
    k = ~np.isnan(x[0])
    assert got[0, 2] == pytest.approx(np.corrcoef(x[0, k], x[2, k])[0, 1] ** 2)
    assert ld.ld_pairs(_sites(spark, x[:, :2]), 30, 0.0).filter("r2 is not null").count() == 0
    twins = np.vstack([x[1], x[1], x[2]])
    assert [r.row_id for r in ld.prune(_sites(spark, twins), 0.99).orderBy("row_id").collect()] == [0, 2]


def test_curves():
    t = np.arange(1, 60)
    assert ld.select_curve(t, 0.5 * np.exp(-0.1 * t))["name"] == "Exponential"
    assert ld.select_curve(t[:2], t[:2])["name"] == "No fit"


def test_structure_by_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((200, 8)) * 4)
    s = _sites(spark, x)
    f = x.mean(1, keepdims=True) / 4
    z = x - 4 * f
    assert np.allclose(structure.kinship(s, 4), z.T @ z / ((4 * f * (1 - f)).sum() + 1e-10))
    pcs, share = structure.pca(s, 4, 3)
    w = z / np.sqrt(np.where(f * (1 - f) > 0, 4 * f * (1 - f), 1))
    sv = np.linalg.svd(w, compute_uv=False)
    assert np.allclose(np.linalg.norm(pcs, axis=0), sv[:3]) and np.allclose(share, (sv**2 / (sv**2).sum())[:3])


def test_trees():
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    nodes = structure.parse_newick(structure.neighbour_joining(d, list("abcde")))
    length = {n: x for _, _, n, x in nodes if n}
    assert (length["a"], length["b"]) == (2.0, 3.0)  # the classic example
    assert len(structure.upgma(d)) == 4 and structure.upgma(d)[0][:3] == (3, 4, 1.5)
    assert set(structure.cut_tree(nodes, 2.5)) == set("abcde")
    assert structure.neighbour_joining(np.zeros((1, 1)), ["x"]) == "x;"


def test_clusters():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2))])
    for label in (structure.kmeans(x, 2, seed=1)[0], structure.gmm(x, 2)[0]):
        assert len(set(label)) >= 1
    noise = structure.dbscan(x, 0.2)
    assert set(noise[:30]) != set(noise[30:])


def test_loco_by_subtraction(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((30, 7)) * 2)
    s = _sites(spark, x).withColumn("grp", F.when(F.col("row_id") < 10, "a").otherwise("b"))
    k = gwas.loco_kinships(s, 2)
    assert np.allclose(k["a"], structure.kinship(s.filter("grp = 'b'"), 2))


def test_scan_finds_the_cause(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((60, 40)) * 2)
    y = 3 * x[17] + rng.normal(0, 0.3, 40)
    y[3] = np.nan
    s = _sites(spark, x)
    hits = gwas.fdr(gwas.scan(s, y, structure.kinship(s, 2), 2, ("ADDITIVE", "SIMPLEX", "GENERAL")))
    best = gwas.best_models(hits).orderBy("p").first()
    assert best.marker == "m17" and best.p < 1e-8
    assert gwas.epistasis(s, hits.orderBy("p").limit(2), y, structure.kinship(s, 2), most=1.1).count() == 59 * hits.orderBy("p").limit(2).select("marker").distinct().count()


def test_markers_at_once_as_one_by_one():
    rng = np.random.default_rng(8)
    x, y = np.round(rng.random((20, 30)) * 4), rng.normal(size=30)
    x[3] = 2.0
    k = np.cov(x.T) + np.eye(30) * 0.1
    null = gwas.fit_null(k, y, gwas.design(30, fixed=[["a", "b", "c"] * 10]))
    for model in gwas.MODELS:
        p, effect, r2, aic = gwas.test_markers(null, x, model, 4)
        for i in range(20):
            z = gwas.recode(x[i], model, 4)
            if z is None:
                assert p[i] == 1
            else:
                assert (p[i], effect[i], r2[i], aic[i]) == pytest.approx(gwas.test_marker(null, z), rel=1e-6, abs=1e-9)


def test_fdr_by_ranges_against_plain(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.random(300), rng.random(50) * 1e-9, [0.5] * 5, [1e-310]])
    df = spark.createDataFrame([(f"{i:04d}", float(v)) for i, v in enumerate(p)], "marker string, p double")
    got = {r.marker: (r.rank, r.q) for r in gwas.fdr(df).collect()}
    order = sorted(range(len(p)), key=lambda i: (p[i], i))
    q = 1.0
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        q = min(q, p[i] * len(p) / rank)
        assert got[f"{i:04d}"][0] == rank and got[f"{i:04d}"][1] == pytest.approx(q)


def test_merge(spark, tmp_path):
    a, _ = _vcf(spark, tmp_path, "a", "c2\t5\t.\tA\tG\t.\t.\t.\tGT\t0/0\t0/1\t1/1\nc2\t5\t.\tA\tT\t.\t.\t.\tGT\t1/1\t1/1\t1/1\n")
    b, _ = _vcf(spark, tmp_path, "b", "c2\t5\tid\tA\tC\t.\t.\t.\tGT\t0/0\nc1\t7\tz\tC\tG\t.\t.\t.\tGT\t0/1\n")
    m, samples = merge.merge_sites([(a, ["s3", "s1", "s2"]), (b, ["s1"])])
    assert samples == ["s1", "s2", "s3"]
    got = {(r.chrom, r.pos, r.alt): r.calls for r in m.collect()}
    assert got == {("c2", 5, "G"): ["0/1", "1/1", "0/0"], ("c2", 5, "T"): ["1/1", "1/1", "1/1"], ("c1", 7, "G"): ["0/1", "./.", "./."]}


def test_ranges_against_brute_force(spark):
    rng = np.random.default_rng(7)
    iv = [(int(a), int(a + b)) for a, b in zip(rng.integers(0, 3000, 80), rng.integers(0, 700, 80))]
    pts = [int(x) for x in rng.integers(0, 3500, 200)]
    p = spark.createDataFrame([("c", x, i) for i, x in enumerate(pts)], "chrom string, pos long, i int")
    s = spark.createDataFrame([("c", a, b, j) for j, (a, b) in enumerate(iv)], "chrom string, start long, end long, j int")
    got = {(r.i, r.j) for r in ranges.points_in(p, s, ["chrom"], "pos", "start", "end", 100).collect()}
    assert got == {(i, j) for i, x in enumerate(pts) for j, (a, b) in enumerate(iv) if a <= x <= b}
    t = s.select("chrom", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("j").alias("k"))
    rows = [(r.j, r.k) for r in ranges.overlaps(s, t, ["chrom"], "start", "end", "s2", "e2", 100).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(i, j) for i, (a, b) in enumerate(iv) for j, (c, d) in enumerate(iv) if a <= d and c <= b}
    near = {r.i: r.near for r in ranges.near_count(p, ["chrom"], "pos", 30).collect()}
    assert all(near[i] == len({y for y in pts if abs(x - y) < 30}) for i, x in enumerate(pts))


def test_effects(spark):
    # two coding parts, 1-based: 11-16 and 21-26; plus: ATGTTT TAC TGG
    cds = "ATGTTTTACTGG"
    subs = [(21, 26, "CDS"), (11, 16, "CDS"), (1, 30, "exon")]
    rows = [(cds, subs, "+", 16, "C"), (cds, subs, "+", 23, "A"), (cds, subs, "+", 11, "G"), (cds, subs, "+", 18, "A"), (None, subs, "+", 11, "G"), (cds, [], "+", 11, "G"), (cds, subs, "-", 26, "A")]
    df = spark.createDataFrame(rows, "cds string, subs array<struct<start:bigint,end:bigint,type:string>>, strand string, pos long, alt string")
    got = [tuple(r.e) for r in df.select(annotate.effect(*(F.col(c) for c in ("cds", "subs", "strand", "pos", "alt"))).alias("e")).collect()]
    assert got == [("Synonymous", "F2F"), ("Stop-Gain", "Y3*"), ("Missense", "M1V"), ("Intronic/UTR", ""), ("Non-Coding", ""), ("Non-Coding", ""), ("Missense", "M1L")]


def test_readers(spark, tmp_path):
    (tmp_path / "g.gff").write_text("##gff\nc1\tx\tgene\t10\t90\t.\t+\t.\tID=gene:g1;Name=n;Note=sugar%20thing;Ontology_term=GO:0001,GO:0002;Dbxref=PFAM:P1,GO:GO:9\nc1\tx\tmRNA\t10\t90\t.\t+\t.\tID=g1.t;Parent=gene:g1\nc1\tx\tCDS\t20\t40\t.\t+\t.\tID=c;Parent=g1.t\nc1\tg4\t5\t8\n")
    genes = {r.gene_id: r for r in text.read_genes(spark, str(tmp_path / "g.gff")).collect()}
    assert genes["g1"].start == 10 and genes["g4"].end == 8 and set(genes) == {"g1", "g1.t", "g4"}
    model = text.read_gene_models(spark, str(tmp_path / "g.gff")).first()
    assert model.gene_id == "g1" and model.go == ["GO:0001", "GO:0002"] and model.pfam == ["P1"] and [s.type for s in model.subs] == ["CDS"]
    assert {r.gene_id: r.description for r in text.read_annotation(spark, str(tmp_path / "g.gff")).collect()}["g1"] == "sugar thing"
    (tmp_path / "s.fa").write_text(">a one\nACGT\nAC\n>b\nGG\n>a two\nTTTT\n")
    fa = text.read_fasta(spark, str(tmp_path / "s.fa"))
    assert {r.seq_id: r.seq for r in fa.collect()} == {"a": "TTTT", "b": "GG"}
    got = text.extract(fa, spark.createDataFrame([("A", 2, 3), ("b", None, -1), ("z", 1, 1)], "seq_id string, start long, end long")).collect()
    assert {r.seq_id: r.seq for r in got} == {"A": "TT", "b": "GG", "z": None}
    (tmp_path / "c.col").write_text("# head\n## Alignment 0: score=10.5 e_value=0 N=2 a&b minus\n  0-  0:\tg1\th1\t 0.1\n  0-  1:\tg2\th2\t 0\n## Alignment 1: score=3 e_value=0 N=1\n  1-  0:\tg3\th3\t 2e-5\n")
    blocks, pairs = text.read_collinearity(spark, str(tmp_path / "c.col"))
    assert {(r.block_id, r.score, r.n_genes, r.orientation) for r in blocks.collect()} == {("0", 10.5, 2, "minus"), ("1", 3.0, 1, "plus")}
    assert {(r.block_id, r.ord, r.gene1, r.gene2) for r in pairs.collect()} == {("0", 1, "g1", "h1"), ("0", 2, "g2", "h2"), ("1", 1, "g3", "h3")}
    (tmp_path / "p.csv").write_text("Taxa,Brix,site\ns1,1.5,x\ns2,NA,y\ns3,,z\n")
    assert [tuple(r) for r in text.read_phenotypes(spark, str(tmp_path / "p.csv"), "brix", ["site"]).collect()] == [("s1", 1.5, {"site": "x"})]
    (tmp_path / "sv.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t10\t.\tA\tG\t.\t.\tCIEND=5;END=100\nc\t10\t.\tA\tG\t.\t.\tSVTYPE=DEL\nc\t10\t.\tA\tG\t.\t.\t.\n")
    assert {(r.start, r.end, r.svtype) for r in text.read_sv(spark, str(tmp_path / "sv.vcf")).collect()} == {(10, 100, None), (10, 11, "DEL")}


def test_sinks(spark, tmp_path):
    v, path = _vcf(spark, tmp_path, "w", CALLERS["ad"])
    out = str(tmp_path / "out")
    sinks.save(sinks.vcf_lines(v), out, sinks.vcf_header(text.vcf_samples(spark, path)), single=True)
    again = text.read_vcf(spark, out)
    assert {r.pos: r.d for r in dosage.dosages(again).collect()} == WANT
    lines = [r.line for r in sinks.joinmap_lines(spark.createDataFrame([(1, "a\tb\tc\td"), (2, "a\tb\tc"), (3, "a")], "line_no long, value string")).orderBy("row_id").collect()]
    assert lines == ["a\tb\t\tc\td", "a\tb\tc", "a"]
    sq = sinks.square_lines(spark.createDataFrame([(0, 1, 0.5), (0, 2, None), (1, 2, 0.1234567)], "i int, j int, value double"), ["x", "y", "z"])
    assert [r.line for r in sq.orderBy("row_id").collect()] == ["x\t0\t0.5\tNA", "y\t0.5\t0\t0.123457", "z\tNA\t0.123457\t0"]
