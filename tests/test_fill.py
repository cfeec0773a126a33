import math

from pyspark.sql import functions as F

from loomspan.operators.fill import between_numbers, fill_in_order, fill_vectors
from loomspan.plans.records import _between_depths


def _rows(df):
    return {r.id: r for r in df.collect()}


DATA = [(1, "a", 1, 1.0, "x"), (2, "a", 2, None, None), (3, "a", 3, None, None), (4, "a", 4, 4.0, "y"), (5, "a", 5, None, None), (6, "b", 1, None, None), (7, "b", 2, 7.0, "z"), (8, None, 1, None, None), (9, "c", 1, None, None)]


def test_interpolation_and_carry(spark):
    df = spark.createDataFrame(DATA, "id long, e string, t int, n double, c string")
    for hot in (1000, 2):  # whole entities, and entities cut into ranges
        got = _rows(fill_in_order(df, ["e"], ["t", "id"], ["n"], ["c"], hot_rows=hot))
        assert len(got) == len(DATA)
        assert (got[2].n_filled, got[3].n_filled, got[2].n_method, got[2].n_distance) == (2.0, 3.0, "interpolated", 1)
        assert (got[3].c_filled, got[3].c_method, got[3].c_distance) == ("x", "carried_forward", 2)
        assert (got[5].n_filled, got[5].n_method) == (4.0, "carried_forward")
        assert (got[6].c_filled, got[6].c_method, got[6].c_distance) == ("z", "carried_back", 1)
        assert got[1].n_method is None and got[1].n_filled == 1.0
        assert got[8].n_filled is None and got[9].c_method is None


def test_gap_limit_and_empty(spark):
    df = spark.createDataFrame(DATA, "id long, e string, t int, n double, c string")
    got = _rows(fill_in_order(df, ["e"], ["t", "id"], [], ["c"], max_gap=1))
    assert got[2].c_filled == "x" and got[3].c_filled == "y" and got[3].c_method == "carried_back"
    assert fill_in_order(df.limit(0), ["e"], ["t"], ["n"]).count() == 0


def test_vectors(spark):
    nan = math.nan
    df = spark.createDataFrame([(1, [0.2, nan, 0.6, -1.0]), (2, [nan, nan, 0.5, 0.1]), (3, None), (4, []), (5, [None, 0.4])], "id long, v array<double>")
    axis = [(0, "p", 0.0), (1, "p", 1.0), (2, "p", 4.0), (3, None, 0.0)]
    got = {(r.id, r.elem_idx): r for r in fill_vectors(df, "id", "v", axis).collect()}
    assert set(got) == {(1, 1), (2, 0), (2, 1), (5, 0)}
    assert abs(got[1, 1].value - 0.3) < 1e-12 and got[1, 1].method == "interpolated"
    assert got[2, 0].method == "carried_back" and got[2, 0].distance == 2


def test_time_lists_and_far_values(spark):
    rows = [(1, "a", 0.0, 1.0, "2,4"), (2, "a", 1.0, None, None), (3, "a", 10.0, 11.0, "4,8"), (4, "a", 10.0, None, None), (5, "a", 10.0, 21.0, "x"), (6, "a", None, None, None), (7, "a", 12.0, None, None)]
    df = spark.createDataFrame(rows, "id long, e string, t double, n double, c string")
    half = lambda a, b, share: F.when(~F.concat(a, b).contains("x"), F.concat(a, F.lit(">"), b))
    got = {}
    for hot in (1000, 2):
        out = fill_in_order(df, ["e"], ["id"], {"n": between_numbers, "c": half}, time="t", far_gap=1, hot_rows=hot)
        got[hot] = {r.id: (r.n_filled, r.n_method, r.c_filled, r.c_method, r.c_distance) for r in out.collect()}
    assert got[1000] == got[2]
    assert got[2][2] == (2.0, "interpolated", "2,4>4,8", "interpolated", 1)
    assert got[2][4] == (16.0, "interpolated", "4,8", "carried_forward", 1)  # one time on both sides; an x can't be divided
    assert got[2][6] == (21.0, "carried_forward", "x", "carried_forward", 1) and got[2][7][1] == "carried_forward_far"


def test_packed_depths(spark):
    df = spark.createDataFrame([("10,20", "20|40"), ('"1; .;3"', "(3,5,5)"), ("1,2", "1,2,3")], "a string, b string")
    assert [r[0] for r in df.select(_between_depths(F.col("a"), F.col("b"), F.lit(0.5))).collect()] == ["15,30", "2,.,4", None]
