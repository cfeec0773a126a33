"""Statistics and filters of calls with several alleles, on rows written by hand."""

from pyspark.sql import functions as F

from loomspan.operators import callset

SCHEMA = "row_id long, ref string, alt string, format string, calls array<string>, missing string"


def _sites(spark, *rows):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], SCHEMA)


ROWS = [
    ("A", "G", "GT", ["0/0", "0/1", "1|1", "./.", "0/1", "."]),
    ("A", "G,T", "GT", ["0/2", "1/2", "0/3", "./1", "0/."]),
    ("AC", ".", "GT", ["0/0", None]),
    ("C", None, "GT", None),
    ("C", "T", "GT", []),
    ("C", "A", "GT:AD", ["0/0:9,1", "./.:5,5", "0/1:0,0", "1/1:1,9", "0/1:5,5"]),
]


def test_counts_by_both_rules(spark):
    s = _sites(spark, *ROWS)
    loose = {r.row_id: (r.samples, r.missing, r.alleles, (r.n00, r.n01, r.n11)) for r in callset.genotype_counts(s).collect()}
    assert loose[0] == (6, 2, [4, 4], (1, 2, 1)) and loose[1] == (5, 1, [3, 1, 2], (0, 0, 0)) and loose[2] == (2, 1, [2], (0, 0, 0))
    assert loose[3] == (0, 0, [0], (0, 0, 0)) and loose[4] == (0, 0, [0, 0], (0, 0, 0))
    strict = {r.row_id: (r.samples, r.missing, r.alleles) for r in callset.genotype_counts(s, True).collect()}
    # 0/3 has an allele too many and 0/. a missing one: both are missing, but their 0s count
    assert strict[1] == (5, 3, [3, 1, 2])


def test_summary_and_histograms(spark):
    st = callset.statistics(_sites(spark, *ROWS))
    r = callset.summary(st).first()
    assert (r.variants, r.snps, r.indels, r.transitions, r.transversions, r.mono, r.bi, r.multi) == (6, 4, 1, 1, 1, 1, 3, 1)
    assert r.hwe_tested == 2 and r.segregating == 4
    h = {(x.kind, x.bin): x.n for x in callset.histograms(st).collect()}
    assert h["maf", 49] == 3 and h["missing", 3] == 1 and sum(n for (k, _), n in h.items() if k == "chi2") == 2
    assert callset.summary(st.limit(0)).first().variants == 0


def test_filters(spark):
    s = _sites(spark, *ROWS).drop("missing")
    keep = lambda **k: {r.row_id: round(r.missing, 3) for r in callset.filter_calls(s, **k).collect()}
    assert set(keep()) == {0, 1, 2, 5} and set(keep(biallelic_only=True)) == {0, 5} and set(keep(min_eh=0.1)) == {0, 1, 5}
    # by reads, ./. with reads is called unless strict; 0,0 isn't
    assert keep(ploidy=4, biallelic_only=True)[5] == 0.2 and keep(ploidy=4, biallelic_only=True, strict=True)[5] == 0.4
    assert 5 not in keep(ploidy=4, min_depth=11) and 1 in keep(ploidy=4, min_depth=11)
    assert callset.max_missing_of(10, 8) == 0.2


def test_samples(spark):
    s = _sites(spark, ("A", "G", "GT", ["0/0", "0/1", "./."]), ("A", "G", "GT", ["1/1", None, "0|1"]), ("A", "G", "GT", None))
    want = [(0, 2, 1, 1, 0, 1), (1, 1, 0, 0, 1, 1), (1, 1, 0, 0, 1, 1)]
    t = callset.sample_counts(s)
    assert [tuple(r)[1:] for r in t.orderBy("sample").collect()] == want
    eh = spark.createDataFrame([(0.5,)], "mean_eh double")
    lines = [r.line for r in callset.sample_report(t.withColumn("name", F.concat(F.lit("s"), "sample")), eh, 3).orderBy("sample").collect()]
    assert lines[0] == "s0\t0.00\t0\t0.00\t2\t1\t1\t0\t1\t0\t0\t0\t0.000\t0.0000\t1.0000" and len(lines[1].split("\t")) == 15
    by = callset.sample_counts(s.select(F.explode("calls").alias("c"), "row_id").select(F.array("c").alias("calls"), "row_id"), "row_id")
    assert {tuple(r) for r in by.collect()} == {(0, 1, 2, 1, 0, 1, 1), (1, 1, 2, 0, 1, 1, 2)}
