"""Joins by place: bands, points in intervals, overlaps. All are equi-joins on buckets with a residual condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import fresh


def band_join(a: DataFrame, b: DataFrame, by: list[str], pos: str, width: int) -> DataFrame:
    """Pairs of rows with equal `by` and 0 <= b.pos - a.pos <= width; columns are prefixed a_ and b_, but for `by`.

    a is looked up from its bucket of that width, b stands in its own and in the one before."""
    width = max(int(width), 1)
    x = a.select(*(a[c] if c in by else a[c].alias(f"a_{c}") for c in a.columns)).withColumn("__b", F.floor(F.col(f"a_{pos}") / width))
    at = F.floor(F.col(f"b_{pos}") / width)
    y = b.select(*(b[c] if c in by else b[c].alias(f"b_{c}") for c in b.columns)).withColumn("__b", F.explode(F.array(at, at - 1)))
    gap = F.col(f"b_{pos}") - F.col(f"a_{pos}")
    return x.join(y, [*by, "__b"]).filter((gap >= 0) & (gap <= width)).drop("__b")


def _spans(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))


def points_in(points: DataFrame, intervals: DataFrame, by: list[str], pos: str, start: str, end: str, width: int = 100_000) -> DataFrame:
    """points joined with the intervals (both ends inclusive) that hold them; clashing names must be settled before."""
    b = fresh(points, "bucket")
    spans = _spans(intervals.filter(F.col(start) <= F.col(end)), start, end, width, b)
    return points.withColumn(b, F.floor(F.col(pos) / width)).join(spans, [*by, b]).filter(F.col(pos).between(F.col(start), F.col(end))).drop(b)


def overlaps(a: DataFrame, b: DataFrame, by: list[str], a_start: str, a_end: str, b_start: str, b_end: str, width: int = 100_000) -> DataFrame:
    """Pairs of overlapping intervals, each once: in the first bucket that both are in."""
    k = fresh(a, "bucket")
    x, y = _spans(a.filter(F.col(a_start) <= F.col(a_end)), a_start, a_end, width, k), _spans(b.filter(F.col(b_start) <= F.col(b_end)), b_start, b_end, width, k)
    first = F.floor(F.greatest(F.col(a_start), F.col(b_start)) / width)
    return x.join(y, [*by, k]).filter((F.col(a_start) <= F.col(b_end)) & (F.col(b_start) <= F.col(a_end)) & (F.col(k) == first)).drop(k)


def near_count(df: DataFrame, by: list[str], pos: str, reach: int) -> DataFrame:
    """df with `near`: the distinct positions nearer than `reach`, its own included."""
    places = df.select(*by, pos).distinct()
    pairs = band_join(places, places, by, pos, max(reach - 1, 1)).filter(F.col(f"b_{pos}") - F.col(f"a_{pos}") < reach)
    both = pairs.select(*by, F.explode(F.array_distinct(F.array(F.struct(F.col(f"a_{pos}").alias("p")), F.struct(F.col(f"b_{pos}").alias("p"))))).alias("x"))
    n = both.groupBy(*by, F.col("x.p").alias(pos)).agg(F.count(F.lit(1)).alias("near"))
    return df.join(n, [*by, pos], "left").withColumn("near", F.coalesce("near", F.lit(1)))
