import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import percentiles as P


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    parts = {"a": rng.random(3000), "b": np.round(rng.normal(size=700), 1), "c": np.full(50, 7.0), "d": rng.random(3), None: np.array([1e300, -1e300, 5e-324])}
    rows = [(g, float(v), "z") for g, x in parts.items() for v in x] + [("a", None, "z"), ("a", float("nan"), "z"), ("a", float("inf"), "z"), ("e", None, "z")]
    df = spark.createDataFrame(rows, "g string, v double, pct string")
    got = {(r.g, r.pct): (r.n, r.percentile) for r in P.percentiles(df, ["g"], "v", [0, 10, 50, 99.5, 100]).collect()}
    assert len(got) == 25
    for (g, pct), (n, v) in got.items():
        assert n == len(parts[g]) and v == pytest.approx(np.percentile(parts[g], pct), rel=1e-12)
    few = P.percentiles(df, ["g"], "v", [50], at_least=50).select("g").collect()
    assert {r.g for r in few} == {"a", "b", "c"}
    assert P.percentiles(df.limit(0), ["g"], "v", [50]).count() == 0


def test_counts_of_parts_add_up(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000 / 10).alias("v"))
    spans = spark.createDataFrame([(g, [(0.0, 99.9), (20.0, 40.0)]) for g in range(3)], "g long, spans array<struct<lo:double,hi:double>>")
    whole = P.cell_counts(df, ["g"], "v", spans)
    a, b = (P.cell_counts(df.filter(c), ["g"], "v", spans) for c in ("v < 33", "v >= 33"))
    key = lambda t: sorted(tuple(r) for r in t.select("g", "lo", "hi", "cell", "n", "least", "greatest").collect())
    assert key(P.add_counts(a.unionByName(b), ["g"])) == key(whole)


def test_chromosome_names(spark):
    raw = ["chr1", " Chr01", "Chromosome-1", "1", "CHR_10", "scaffold 7", "SCAFFOLD-012", "scaffold_0001", "scaffold002", "plastid", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, c string").orderBy("i").select(P.chromosome_name(F.col("c"))).collect()]
    assert got == ["Chr01", "Chr01", "Chr01", "Chr01", "Chr10", "scaffold_007", "scaffold_012", "scaffold_001", "scaffold_002", "plastid", None]


def test_long_scaffold_numbers_stay_apart(spark):
    raw = ["scaffold_1000", "scaffold_1009", "Scaffold 00012345", "scaffold_100", "contig_53619"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, c string").orderBy("i").select(P.chromosome_name(F.col("c"))).collect()]
    assert got == ["scaffold_1000", "scaffold_1009", "scaffold_12345", "scaffold_100", "contig_53619"]


def test_smallest_and_widest_values(spark):
    """Neighbouring denormal numbers, and values over all exponents: few passes, and no division by 0."""
    parts = {"denormal": np.array([1e-323, 1.5e-323, 2e-323]), "wide": 10.0 ** -np.arange(0, 300, 0.37), "both": np.concatenate((-(10.0 ** -np.arange(0, 300, 1.1)), [0.0, 0.0], 10.0 ** -np.arange(0, 300, 0.9))), "ends": np.array([-1.7e308, -1e308, 0.0, 1e308, 1.7e308])}
    df = spark.createDataFrame([(g, float(v)) for g, x in parts.items() for v in x], "g string, v double")
    cut, passes = P.cut, []
    P.cut = lambda t: passes.append(1) or cut(t)
    try:
        got = {(r.g, r.pct): r.percentile for r in P.percentiles(df, ["g"], "v", [25, 50, 75]).collect()}
    finally:
        P.cut = cut
    assert len(passes) <= 22
    for (g, pct), v in got.items():
        x = np.sort(parts[g])
        h = (len(x) - 1) * pct / 100
        a, b = x[int(np.floor(h))], x[int(np.ceil(h))]
        assert v == pytest.approx(a + (b - a) * (h - np.floor(h)), rel=1e-9, abs=0)
