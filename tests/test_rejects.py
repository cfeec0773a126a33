from loomspan.operators import rejects

HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"
GOOD = "c\t5\t.\tA\tC\t1e3\tPASS\tNOTE=\"a\tb\"\tGT:BSDP\t0/1:1,2\t./.:."
LINES = [
    (HEAD + "\r", None), (GOOD + "\r", "ok"), ("", None), (" \t ", None), ("# note", None), (None, None),
    (GOOD.replace('b"', "b"), "quoting"), (GOOD + "\tx", "columns"), (GOOD.replace("GT:BSDP", "GT:bsdp"), "tags"), (GOOD.replace("GT:BSDP", "BSDP:GT"), "tags"),
    (GOOD.replace("GT:BSDP", "GT:A:A"), "tags"), (GOOD.replace("0/1:1,2", "0/1:1,2:3"), "tags"), (GOOD.replace("1,2", "1"), "bsdp"), (GOOD.replace("1,2", "1,x"), "bsdp"), (GOOD.replace("1,2", "1,2,3,4,5"), "bsdp"),
    (GOOD.replace("\t5\t", "\t0\t"), "fixed"), (GOOD.replace("\tA\t", "\tAX\t"), "fixed"), (GOOD.replace("1e3", "-1"), "fixed"), (GOOD.replace("1e3", "."), "ok"), (GOOD.replace("./.:.", "./."), "ok"), (GOOD.replace("\tA\t", "\tacgtn\t"), "ok"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(1, i, x, "z") for i, (x, _) in enumerate(LINES)] + [(1, 1, LINES[1][0], "again")], "file_id long, line_no int, raw_line string, errors string")
    c = rejects.check_lines(df)
    assert {r.line_no: r.reason for r in rejects.failed(c).collect()} == {i: why for i, (_, why) in enumerate(LINES) if why not in (None, "ok")}
    good = {r.line_no: r for r in rejects.loaded(c).collect()}
    assert set(good) == {i for i, (_, why) in enumerate(LINES) if why == "ok"}
    assert good[1].pos == 5 and good[1].qual == 1000 and good[1].info == 'NOTE="a\tb"' and good[1].calls == ["0/1:1,2", "./.:."]


def test_without_header_and_empty(spark):
    df = spark.createDataFrame([(1, 1, GOOD), (1, 2, "a\tb"), (1, 3, "x\t" * 30_000)], "file_id long, line_no int, raw_line string")
    assert {r.line_no: r.reason for r in rejects.failed(rejects.check_lines(df)).collect()}[2] == "columns"
    assert rejects.failed(rejects.check_lines(df.limit(0))).count() == 0
