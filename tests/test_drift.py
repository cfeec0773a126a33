import itertools

import numpy as np

from loomspan.operators import drift


def test_matching_is_best():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 5, 2)
        s = rng.normal(size=(n, m)).round(2)
        got = drift.best_matching(s)
        k = int(min(n, m))
        best = max(sum(s[i, j] for i, j in zip(rows, cols)) for rows in itertools.permutations(range(n), k) for cols in itertools.combinations(range(m), k))
        assert len(got) == k and abs(sum(s[i, j] for i, j in got) - best) < 1e-9


def test_changes(spark):
    lines = spark.createDataFrame([(1, "s", 1, "GT:RO", ["0/0:1", "0/1:2"]), (1, "s", 1, "GT:RO", ["0/0:1", "0/1:2"]), (2, "s", 4, "GT:RDO:DP", ["0/0:1.5:.", None]), (3, "s", 5, "GT:RDO", ["0/0:1,2"]), (4, None, 1, "GT", None), (5, "s", 6, None, ["x"])], "file_id long, stream_id string, file_seq int, vcf_format string, calls array<string>")
    heads = spark.createDataFrame([(1, "RO", "Reference  observations"), (2, "RDO", "reference observations "), (2, "DP", ""), (2, "RDO", "reference observations"), (3, "RDO", None)], "file_id long, tag string, descr string")
    got = {(r.file_id, r.tag, r.change_kind) for r in drift.changes(drift.profile(lines, heads)).collect()}
    assert got == {(2, "RDO", "renamed"), (2, "RDO", "retyped"), (2, "DP", "added"), (3, "DP", "removed"), (3, "RDO", "retyped")}
    assert drift.changes(drift.profile(lines.limit(0), heads.limit(0))).count() == 0


def test_unified(spark):
    lines = spark.createDataFrame([(1, 1, "s", 1, "c", 5, "A", "GT:RO:AO", ["0/0:1:2"]), (2, 1, "s", 2, "c", 6, "A", "GT:AO:RDO:RO2", ["0/1:7:8:9", "0/1"])], "file_id long, line_no int, stream_id string, file_seq int, chrom string, pos long, ref_allele string, vcf_format string, calls array<string>")
    heads = spark.createDataFrame([(1, "RO", "ref"), (1, "AO", "alt"), (2, "RDO", "REF"), (2, "AO", "alt"), (3, "RO", "ref")], "file_id long, tag string, descr string")
    extra = spark.createDataFrame([(3, 1, "s", 3, "c", 7, "A", "GT:RO", ["1/1:4"])], lines.schema)
    every = lines.unionByName(extra)
    got = {(r.file_id, r.call_no): (r.ro, r.ao) for r in drift.unified_calls(every, drift.profile(every, heads)).collect()}
    assert got == {(1, 1): (1, 2), (2, 1): (8, 7), (2, 2): (None, None), (3, 1): (4, None)}


SCHEMA = "file_id long, line_no int, stream_id string, file_seq int, chrom string, pos long, ref_allele string, vcf_format string, calls array<string>"


def _line(file, seq, fmt, *calls, stream="s"):
    return file, 1, stream, seq, "c", 5, "A", fmt, list(calls)


def test_two_tags_of_one_description(spark):
    lines = spark.createDataFrame([_line(1, 1, "GT:X1:X2", "0/0:5:6"), _line(2, 2, "GT:X2:X1", "0/1:7:8")], SCHEMA)
    heads = spark.createDataFrame([(f, t, "same") for f in (1, 2) for t in ("X1", "X2")], "file_id long, tag string, descr string")
    got = {r.file_id: r.rest for r in drift.unified_calls(lines, drift.profile(lines, heads)).collect()}
    assert got == {1: {"X1": "5", "X2": "6"}, 2: {"X1": "8", "X2": "7"}}


def test_fields_follow_their_renames(spark):
    """RO becomes R1, R2 and R3 along a stream and is called so elsewhere; in the last file AO has no description of its own."""
    names = ["RO", "R1", "R2", "R3"]
    rows = [_line(k + 1, k, f"GT:{n}:AO", f"0/0:{k}:9") for k, n in enumerate(names)] + [_line(10, 1, "GT:RO", "1/1:4", stream="t"), _line(11, 2, "GT:RX", "1/1:5", stream="t"), _line(12, None, "GT:RX", "1/1:6", stream=None)]
    lines = spark.createDataFrame(rows, SCHEMA)
    heads = spark.createDataFrame([(k + 1, n, "reference reads") for k, n in enumerate(names)] + [(10, "RO", "Reference  Reads"), (11, "RX", "reference reads"), (12, "RX", None), (1, "AO", "alternate reads")], "file_id long, tag string, descr string")
    profiles = drift.profile(lines, heads)
    got = {r.file_id: (r.ro, r.ao, r.rest) for r in drift.unified_calls(lines, profiles).collect()}
    assert got == {1: (0, 9, {}), 2: (1, 9, {}), 3: (2, 9, {}), 4: (3, 9, {}), 10: (4, None, {}), 11: (5, None, {}), 12: (None, None, {"RX": "6"})}
    of = {(r.file_id, r.tag): r.field for r in drift.fields(profiles, drift.changes(profiles)).collect()}
    assert len({of[k + 1, n] for k, n in enumerate(names)}) == 1 and len({of[k, "AO"] for k in (1, 2, 3, 4)}) == 1 and of[12, "RX"] != of[11, "RX"]


def test_matching_without_descriptions(spark):
    """Values tell which of two new text fields continues the old one, numbers which number does."""
    lines = spark.createDataFrame([_line(1, 1, "GT:PHASE:QA", "0/0:left:30", "0/1:right:34"), _line(2, 2, "GT:PH:ZZ:QAL", "0/0:left:zzzz:31", "0/1:right:y:33")], SCHEMA)
    heads = spark.createDataFrame([], "file_id long, tag string, descr string")
    profiles = drift.profile(lines, heads)
    got = {(r.tag, r.change_kind, r.was) for r in drift.changes(profiles, by_descr=False).collect()}
    assert got == {("PH", "renamed", "PHASE"), ("QAL", "renamed", "QA"), ("ZZ", "added", None)}
    assert {r.change_kind for r in drift.changes(profiles).collect()} == {"added", "removed"}
