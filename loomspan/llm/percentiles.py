"""Percentiles of large numeric columns by exact bisection.

Every group and percentile has an interval that holds its target rank. A pass counts the rows below the
midpoints of that interval, halved a few times at once, and narrows it to the part with the target; the
counts of separate partitions or days add up, so nothing but counts is ever shuffled. It ends when each
target is the least, the greatest or the only value of its interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import cut, release, small

#: Times an interval is halved in one pass.
HALVINGS = 4


def cell_counts(df: DataFrame, groups: Sequence[str], value: str, intervals: DataFrame, cells: int = 1 << HALVINGS) -> DataFrame:
    """(groups, lo, hi, cell, n, least, greatest): the rows of df in each cell of each of a group's intervals.

    intervals: groups and `spans`, an array of structs (lo, hi). Counts over parts of the data, made with
    the same intervals, are combined by `add_counts`."""
    hit = F.filter("spans", lambda s: (F.col(value) >= s["lo"]) & (F.col(value) <= s["hi"]))
    rows = df.select(*groups, value).join(small(intervals), [*groups]).select(*groups, value, F.explode(hit).alias("s"))
    cell = _cell(F.col(value), F.col("s.lo"), F.col("s.hi"), cells)
    return rows.groupBy(*groups, F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def _cell(v: Column, lo: Column, hi: Column, cells: int) -> Column:
    """The cell of v between lo < hi; greater values have no lesser cell.

    An interval around or beside 0 is cut into below, at and above it. One whose ends are far apart is halved in
    logarithms, so that the passes don't depend on how small the values are; else its width is."""
    wide = hi - lo
    # the width of the widest intervals isn't finite; neighbouring denormal numbers still differ by more than 0
    even = F.when(wide < float("inf"), F.try_divide(v - lo, wide)).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
    log = lambda x, a, b: (F.log(x) - F.log(a)) / (F.log(b) - F.log(a))
    part = F.when((lo > 0) & (hi / 16 > lo), log(v, lo, hi)).when((hi < 0) & (lo / 16 < hi), 1 - log(-v, -hi, -lo)).otherwise(even)
    sign = (v >= 0).cast("int") + (v > 0).cast("int")
    return F.when((lo <= 0) & (hi >= 0), sign).otherwise(F.greatest(F.least(F.floor(part * cells), F.lit(cells - 1)), F.lit(0)).cast("int"))


def add_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The counts of several parts as those of the whole."""
    return counts.groupBy(*groups, "lo", "hi", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def percentiles(df: DataFrame, groups: Sequence[str], value: str, pcts: Sequence[float], at_least: int = 1, valid: Column | None = None) -> DataFrame:
    """(groups, pct, n, percentile): exact percentiles, with linear interpolation between ranks, of each group.

    Values that are null, NaN or infinite, or don't meet `valid`, don't count; groups with fewer than
    at_least counting values give no rows. Null is a group like any other. Repeated rows count each; ties
    are ranks of one value; an empty df gives no rows. Columns other than groups and value aren't read.
    A pass reads df's values once; whatever the values, 20 passes at most are needed."""
    g = [f"__g{i}" for i in range(len(groups))]
    keep = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf"))
    base = df.filter(keep if valid is None else keep & valid).select(*(F.struct(F.col(c).alias("v")).alias(n) for n, c in zip(g, groups)), F.col(value).cast("double").alias("__v"))
    base = cut(base)
    ends = base.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).filter(F.col("n") >= at_least)
    h = (F.col("n") - 1) * F.col("pct") / 100
    targets = ends.withColumn("pct", F.explode(F.array(*(F.lit(float(p)) for p in pcts))))
    targets = targets.select(*g, "n", "pct", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))).alias("want")).withColumn("rank", F.col("want") + 1).withColumn("inside", F.col("n"))
    state = cut(_settle(targets))
    done: list[DataFrame] = []
    while True:
        done.append(state.filter(F.col("value").isNotNull()))
        open_ = state.filter(F.col("value").isNull())
        if open_.isEmpty():
            break
        spans = open_.groupBy(*g).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
        counts = add_counts(cell_counts(base, g, "__v", spans), g)
        upto = W.Window.partitionBy(*g, "lo", "hi").orderBy("cell").rowsBetween(W.Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumnRenamed("n", "here")
        found = open_.drop("value", "inside").join(counts, [*g, "lo", "hi"]).filter((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("here")))
        found = found.select(*g, "n", "pct", F.col("least").alias("lo"), F.col("greatest").alias("hi"), "want", (F.col("rank") - F.col("below")).alias("rank"), F.col("here").alias("inside"))
        state = cut(_settle(found))
    release(base)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    frac = (F.col("n") - 1) * F.col("pct") / 100 - F.floor((F.col("n") - 1) * F.col("pct") / 100)
    out = out.groupBy(*g, "pct", "n").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return out.select(*(F.col(n)["v"].alias(c) for n, c in zip(g, groups)), "pct", "n", (F.col("a") + (F.col("b") - F.col("a")) * frac).alias("percentile"))


def _settle(state: DataFrame) -> DataFrame:
    """state with `value`, where the interval's own ends tell it."""
    value = F.when((F.col("rank") == 1) | (F.col("lo") == F.col("hi")), F.col("lo")).when(F.col("rank") == F.col("inside"), F.col("hi"))
    return state.withColumn("value", value)


def chromosome_name(c: Column) -> Column:
    """One spelling of a chromosome's or scaffold's name: Chr01, scaffold_001; other names trimmed, as they are."""
    low = F.lower(F.regexp_replace(c, r"\s+", ""))
    number = F.regexp_extract(low, r"^(?:chromosome|chrom|chr|scaffold)?[_\-.:]*0*(\d+)\z", 1)
    return F.when(number == "", F.trim(c)).when(low.startswith("scaffold"), F.concat(F.lit("scaffold_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).otherwise(F.concat(F.lit("Chr"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))
