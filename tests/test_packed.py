import random

import pyarrow as pa
import pytest

from loomspan.operators.packed import split_array, split_packed

CASES = [
    ('"<INS,ME>"', ["<INS,ME>"]), ('"<DUP;TANDEM>","C"', ["<DUP;TANDEM>", "C"]), ('T, "<DUP;TANDEM>", C', ["T", "<DUP;TANDEM>", "C"]),
    ('"T,C"', ["T", "C"]), ('"T","G"', ["T", "G"]), ("G]Chr02:1695497], T", ["G]Chr02:1695497]", "T"]), ("[2:3[A,A]2:3]", ["[2:3[A", "A]2:3]"]),
    ("[9, 9]", ["9", "9"]), ("(9|8)", ["9", "8"]), ("'9;8'", ["9", "8"]), ("9 ; 8", ["9", "8"]), ("9\t8", ["9", "8"]), (".,.", [".", "."]),
    ("A,", ["A"]), ("", []), ("  ", []), (None, []), ('"A,C",T', ["A,C", "T"]), ("-1 -1", ["-1", "-1"]), ("9, 8;7", ["9", "8", "7"]), ('["1","2"]', ["1", "2"]), ("ñ|é", ["ñ", "é"]),
]


@pytest.mark.parametrize("text,values", CASES)
def test_values(text, values):
    got = split_array(pa.array([text], pa.string())).to_pylist()[0]
    assert [v["val"] for v in got] == values


def test_places_are_kept_and_rows_dont_mix():
    texts = ["1,,3", ",x", "a", None, "p;;q;"]
    got = [[(v["val_pos"], v["val"]) for v in r] for r in split_array(pa.array(texts)).to_pylist()]
    assert got == [[(1, "1"), (3, "3")], [(2, "x")], [(1, "a")], [], [(1, "p"), (3, "q")]]


def test_plain_delimiters_against_python():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab12,;|/") for _ in range(rnd.randrange(12))) for _ in range(3000)]
    for text, got in zip(texts, split_array(pa.array(texts)).to_pylist()):
        for ch in ";|/":
            text = text.replace(ch, ",")
        assert [(v["val_pos"], v["val"]) for v in got] == [(i, p) for i, p in enumerate(text.split(","), 1) if p]


def test_frame_edge_cases(spark):
    rows = [(1, "A,C", "x"), (1, "A,C", "x"), (None, "G;T", "y"), (3, None, None), (4, "", None), (5, ",".join("ab" for _ in range(50_000)), None)]
    df = spark.createDataFrame(rows, "id long, f string, val string")  # `val` clashes with an output column
    got = split_packed(df, {"f": "fld"}, "id", 2).collect()
    assert sum(r.rec_id == 1 for r in got) == 4 and sum(r.rec_id is None for r in got) == 2 and sum(r.rec_id == 5 for r in got) == 50_000
    assert split_packed(df.limit(0), {"f": "fld"}, "id").count() == 0
