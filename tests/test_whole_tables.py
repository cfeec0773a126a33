"""Queries over small tables of their own: every row counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import ld, merge
from loomspan.plans import genomics


def _write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _parts(n, brand=lambda k: "B1", size=lambda k: 5):
    return [(k, brand(k), size(k)) for k in range(1, n + 1)], "p_partkey long, p_brand string, p_size int"


def _pairs(lines):
    return [(1, n, part, supp) for n, (part, supp) in enumerate(lines, 1)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"


def test_orphans_are_in_no_line(spark, tmp_path):
    """(7 l_suppkey + l_partkey) % 320 of these lines is 5 to 316, so no part of its range may be left out."""
    d = _write(spark, tmp_path, part=_parts(8), lineitem=_pairs([(2, 40), (4, 3), (5, 0), (8, 44), (8, 2)]))
    assert [r.gene_id for r in genomics.orphans_anti(spark, d).collect()] == ["G6"]
    got = {r.status: r.n for r in genomics.synteny_report_counts(spark, d).groupBy("status").agg(F.sum("n").alias("n")).collect()}
    assert got == {"Syntenic": 5, "Orphan_G1": 1, "Orphan_G2": 2}  # G6; G1 and G7, as the second genes are G3, G5, G6, G9


def test_every_marker_with_its_whole_window(spark, tmp_path):
    d = _write(spark, tmp_path, part=_parts(1200, lambda k: f"B{k % 2}", lambda k: k % 50 + 1))
    genes = [(k, k % 2, k * 10, k * 10 + k % 50 + 1) for k in range(1, 1201)]
    want = set()
    for k in range(1, 1201):
        pos = k * 10 + 3
        for g, brand, start, end in genes:
            if brand == k % 2 and start <= pos + 5000 and end >= max(pos - 5000, 1):
                want.add((f"m{k}", f"G{g}", "secondary" if g % 2 else "primary", 0 if start <= pos <= end else min(abs(pos - start), abs(pos - end))))
    got = [(r.marker, r.gene_id, r.source, r.distance) for r in genomics.window_gene_join(spark, d).collect()]
    assert len(got) == len(want) and set(got) == want


def test_linkage_of_the_whole_window(spark, tmp_path):
    """Three sites 1,000 to 50,001 apart: the pair at 50,001 is too far, that at 49,001 isn't."""
    lines = [(0, 2 * part + n, part, supp, float(10 + (part + supp * (n + 1)) % 7)) for part in (10, 1010, 50_011) for supp in range(1, 26) for n in (1, 2)]
    d = _write(spark, tmp_path, part=([(k, "B1", 5) for k in (10, 1010, 50_011)], "p_partkey long, p_brand string, p_size int"), lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"), supplier=([(k, k - 1) for k in range(1, 26)], "s_suppkey long, s_nationkey int"))
    assert {(r.pos1, r.pos2) for r in genomics.ld_pairs(spark, d).collect()} == {(10, 1010), (1010, 50_011)}
    assert {r.bin: r.n for r in genomics.ld_decay_bins(spark, d).collect()} == {1: 1, 49: 1}


def test_linkage_by_blocks_as_pair_by_pair(spark):
    rng = np.random.default_rng(3)
    n, width = 1300, 700  # sites of two chromosomes, several to a place, over more than one block and bucket
    x = rng.integers(0, 5, (n, 8)) / 4
    x[rng.random(x.shape) < 0.3] = np.nan
    pos = rng.integers(0, 2000, n)
    rows = [(i, f"c{i % 2}", int(pos[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    s = spark.createDataFrame(rows, "row_id long, chrom string, pos long, d array<double>")
    got = {(r.row1, r.row2): r.r2 for r in ld.ld_pairs(s, width, 0.0).collect()}
    a = s.selectExpr("row_id a", "chrom", "pos p", "d x").join(s.selectExpr("row_id b", "chrom", "pos q", "d y"), "chrom")
    a = a.filter(f"q - p between 0 and {width} and (p < q or a < b)").select("a", "b", ld.r2(F.col("x"), F.col("y")).alias("r2")).filter("r2 is not null")
    want = {(r.a, r.b): r.r2 for r in a.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_merge_holds_every_site(spark, tmp_path):
    """Places of 15, 3, 5 and 1: each is read whole, whichever of the two files holds its samples."""
    cells = [(15, 0), (15, 20), (3, 2), (5, 24), (1, 12)]
    lines = [(1, 1, part, supp, 4.0) for part, supp in cells]
    d = _write(spark, tmp_path, part=_parts(15), lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"), supplier=([(k, k) for k in range(25)], "s_suppkey long, s_nationkey int"))
    got = {r.pos: r.calls.split(" ") for r in genomics.merge_full_outer(spark, d).collect()}
    assert got == {part: ["4,0" if (part, k) in cells else "./." for k in range(25)] for part in (1, 3, 5, 15)}


def test_merge_of_sites_in_one_file_only(spark):
    def file(*rows):
        return spark.createDataFrame([(pos, "c", pos, ".", "A", "G", calls) for pos, calls in rows], "row_id long, chrom string, pos long, id string, ref string, alt string, calls array<string>")

    out, names = merge.merge_sites([(file((1, ["a1", "b1"]), (2, ["a2", None])), ["a", "b"]), (file((2, ["B2", "c2"]), (3, ["B3", "c3"])), ["b", "c"])])
    assert names == ["a", "b", "c"]
    assert {r.pos: r.calls for r in out.collect()} == {1: ["a1", "b1", "./."], 2: ["a2", "B2", "c2"], 3: ["./.", "B3", "c3"]}
