"""Filling missing values from records of the same entity, in time order.

Numbers are interpolated between the nearest observed neighbours, categories are carried from the
nearest one before (else after); every filled value is marked with the method and the distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..runtime import cut, fresh, small

#: Rows of one entity from which it is divided over several tasks.
HOT_ROWS = 500_000

#: The value at a share of the way between two others; null if there is none.
Between = Callable[[Column, Column, Column], Column]


def between_numbers(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def fill_in_order(df: DataFrame, entity: Sequence[str], order: Sequence[str], numeric: Sequence[str] | Mapping[str, Between] = (), categorical: Sequence[str] = (), max_gap: int | None = None, hot_rows: int = HOT_ROWS, time: str | None = None, far_gap: int | None = None) -> DataFrame:
    """df with, for each filled column c, also c_filled, c_method and c_distance.

    entity: columns of the group whose rows may fill each other. order: time and tie-breaking columns.
    A value is missing when it is null. c_method is `interpolated`, `carried_forward` or `carried_back`
    for a filled value, else null; c_distance counts rows of the entity to the nearest observed one used.
    Numbers between two observed ones are interpolated by `time` (a number or timestamp; halfway where the two
    have one time) or, without it or where it is null, by rank; others are carried. A mapping as `numeric` says how each
    column is interpolated; where it gives null, the value is carried. max_gap: values farther than so many
    rows stay missing; far_gap: they are filled, but their method ends in `_far`. Rows with a null in `entity` are never filled nor used; ties in
    `order` fall in some order, so give a unique last column; repeated rows count as rows; an empty df
    gives no rows. Entities of more than hot_rows rows are cut into ranges over several tasks."""
    if not isinstance(numeric, Mapping):
        numeric = dict.fromkeys(numeric, between_numbers)
    cols = [*numeric, *categorical]
    rule = _Rule(numeric, categorical, max_gap, far_gap, time)
    known = F.lit(True)
    for c in entity:
        known &= F.col(c).isNotNull()
    lone = df.filter(~known)
    rest = df.filter(known)
    hot = rest.groupBy(*entity).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).drop("__n")
    if hot.isEmpty():
        filled = _fill(rest, [*entity], order, rule)
    else:
        hot = cut(hot)
        filled = _fill(rest.join(small(hot), [*entity], "left_anti"), [*entity], order, rule)
        filled = filled.unionByName(_fill_hot(rest.join(small(hot), [*entity], "left_semi"), entity, order, rule))
    blank = lone.select("*", *(x for c in cols for x in (F.col(c).alias(f"{c}_filled"), F.lit(None).cast("string").alias(f"{c}_method"), F.lit(None).cast("long").alias(f"{c}_distance"))))
    return filled.unionByName(blank)


@dataclass
class _Rule:
    """How the columns are filled."""

    numeric: Mapping[str, Between]
    categorical: Sequence[str]
    max_gap: int | None
    far_gap: int | None
    time: str | None

    @property
    def cols(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def when(self) -> Column:
        return F.col(self.time).cast("timestamp").cast("double") if self.time else F.lit(None).cast("double")

    def seen(self, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("__rn").cast("long").alias("at"), self.when().alias("t"), F.col(c).alias("v")))


def _neighbours(df: DataFrame, part: list[str], order: Sequence[str], rule: _Rule) -> DataFrame:
    """df with __rn and, for each c, __p_c and __q_c: rank and value of the nearest observed row before and after."""
    up = W.Window.partitionBy(*part).orderBy(*order)
    down = W.Window.partitionBy(*part).orderBy(F.col("__rn").desc()).rowsBetween(W.Window.unboundedPreceding, 0)
    df = df.withColumn("__rn", F.row_number().over(up).cast("long"))
    so_far = W.Window.partitionBy(*part).orderBy("__rn").rowsBetween(W.Window.unboundedPreceding, 0)
    df = df.select("*", *(F.last(rule.seen(c), ignorenulls=True).over(so_far).alias(f"__p_{c}") for c in rule.cols))
    return df.select("*", *(F.last(rule.seen(c), ignorenulls=True).over(down).alias(f"__q_{c}") for c in rule.cols))


def _settle(df: DataFrame, rule: _Rule) -> DataFrame:
    out = []
    for c in rule.cols:
        p, q, rn = F.col(f"__p_{c}"), F.col(f"__q_{c}"), F.col("__rn")
        near = lambda x: x.isNotNull() if rule.max_gap is None else x.isNotNull() & (F.abs(rn - x["at"]) <= rule.max_gap)
        before, after = rn - p["at"], q["at"] - rn
        empty, value, method, far = F.col(c).isNull(), F.col(c), F.lit(None).cast("string"), F.lit(None).cast("long")
        steps = [(near(p), p["v"], "carried_forward", before), (near(q), q["v"], "carried_back", after)]
        if c in rule.numeric:
            by_time = F.when(q["t"] > p["t"], (rule.when() - p["t"]) / F.nullif(q["t"] - p["t"], F.lit(0.0))).when(q["t"] == p["t"], F.lit(0.5))
            made = rule.numeric[c](p["v"], q["v"], F.coalesce(by_time, before / (before + after)))
            steps.insert(0, (near(p) & near(q) & made.isNotNull(), made, "interpolated", F.least(before, after)))
        for cond, v, name, distance in reversed(steps):
            value, method, far = F.when(empty & cond, v).otherwise(value), F.when(empty & cond, F.lit(name)).otherwise(method), F.when(empty & cond, distance).otherwise(far)
        if rule.far_gap is not None:
            method = F.when(far > rule.far_gap, F.concat(method, F.lit("_far"))).otherwise(method)
        kind = "double" if rule.numeric.get(c) is between_numbers else df.schema[c].dataType
        out += [value.cast(kind).alias(f"{c}_filled"), method.alias(f"{c}_method"), far.cast("long").alias(f"{c}_distance")]
    return df.select("*", *out)


def _fill(df: DataFrame, part: list[str], order: Sequence[str], rule: _Rule) -> DataFrame:
    return _settle(_neighbours(df, part, order, rule), rule).drop("__rn", *(f"__{x}_{c}" for c in rule.cols for x in "pq"))


def carry_forward(df: DataFrame, entity: Sequence[str], order: Sequence[str], column: str, into: str) -> DataFrame:
    """df with `into`: the last value of `column` that isn't null, up to the row itself, in the entity's order; null before the first.

    Null entities are one of their own; ties in `order` fall in some order, so end it with a unique column."""
    upto = W.Window.partitionBy(*entity).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(column, ignorenulls=True).over(upto))


def _place(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.col("__rn"))


def _fill_hot(df: DataFrame, entity: Sequence[str], order: Sequence[str], rule: _Rule) -> DataFrame:
    """As _fill, with each entity in ranges of its order: a range knows its own neighbours, and of the other ranges their outermost observed values."""
    cols = rule.cols
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    part = fresh(df, "part")
    df = cut(df.repartitionByRange(n, *(F.col(c) for c in [*entity, *order])).withColumn(part, F.spark_partition_id()))
    key = [*entity, part]
    df = _neighbours(df, key, order, rule)
    ends = df.groupBy(*key).agg(F.max("__rn").alias("__n"), *(f for c in cols for f in (F.min_by(rule.seen(c), _place(c)).alias(f"__a_{c}"), F.max_by(rule.seen(c), _place(c)).alias(f"__z_{c}"))))
    before = W.Window.partitionBy(*entity).orderBy(part).rowsBetween(W.Window.unboundedPreceding, -1)
    ends = ends.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    moved = lambda x: F.when(F.col(x).isNotNull(), F.struct((F.col(x)["at"] + F.col("__off")).alias("at"), F.col(x)["t"].alias("t"), F.col(x)["v"].alias("v")))
    ends = ends.select(*key, "__off", *(moved(f"__{x}_{c}").alias(f"__{x}_{c}") for c in cols for x in "az"))
    back = W.Window.partitionBy(*entity).orderBy(F.col(part).desc()).rowsBetween(W.Window.unboundedPreceding, -1)
    ends = ends.select(*key, "__off", *(f for c in cols for f in (F.last(f"__z_{c}", ignorenulls=True).over(before).alias(f"__zp_{c}"), F.last(f"__a_{c}", ignorenulls=True).over(back).alias(f"__aq_{c}"))))
    df = df.join(small(ends), key)
    df = df.withColumn("__rn", F.col("__rn") + F.col("__off"))
    for c in cols:
        df = df.withColumn(f"__p_{c}", F.coalesce(moved(f"__p_{c}"), f"__zp_{c}")).withColumn(f"__q_{c}", F.coalesce(moved(f"__q_{c}"), f"__aq_{c}"))
    return _settle(df, rule).drop("__rn", "__off", part, *(f"__{x}_{c}" for c in cols for x in ("p", "q", "zp", "aq")))


def fill_vectors(df: DataFrame, key: str, column: str, axis: Sequence[tuple[int, str | None, float]], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The missing elements of an array column that other elements of the same row can fill.

    axis: (index, group, time) of each element; those of one group that isn't None may fill each other,
    in the order of time, then index. An element is missing unless it is a number from low to high.
    Gives (key, elem_idx from 0, value, method, distance), one row per filled element: `interpolated` by
    time between the observed neighbours, `carried_forward` or `carried_back` at the ends; distance counts
    elements. Null and empty arrays give no rows; arrays may be shorter or longer than the axis (elements
    without an entry aren't filled); repeated rows give repeated rows; other columns aren't read."""
    groups: dict[str, list[tuple[float, int]]] = {}
    for i, g, t in axis:
        if g is not None:
            groups.setdefault(g, []).append((t, i))
    plan = [(np.array([i for _, i in sorted(v)]), np.array([t for t, _ in sorted(v)], float)) for v in groups.values() if len(v) > 1]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("elem_idx", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("method", T.StringType()), T.StructField("distance", T.LongType())])
    names = pa.array(["interpolated", "carried_forward", "carried_back"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column(1))
            ok = (x >= low) & (x <= high)
            for index, time in plan:
                here = index < x.shape[1]
                cols, t = index[here], time[here]
                if len(cols) < 2:
                    continue
                v, o = x[:, cols], ok[:, cols]
                place = np.arange(len(cols))
                prev = np.maximum.accumulate(np.where(o, place, -1), axis=1)
                nxt = np.minimum.accumulate(np.where(o, place, len(cols))[:, ::-1], axis=1)[:, ::-1]
                r, k = np.nonzero(~o & ((prev >= 0) | (nxt < len(cols))))
                if not len(r):
                    continue
                p, q = prev[r, k], nxt[r, k]
                has_p, has_q = p >= 0, q < len(cols)
                a, b = v[r, np.maximum(p, 0)], v[r, np.minimum(q, len(cols) - 1)]
                ta, tb = t[np.maximum(p, 0)], t[np.minimum(q, len(cols) - 1)]
                share = np.where(tb > ta, (t[k] - ta) / np.where(tb > ta, tb - ta, 1), 0.5)
                value = np.where(has_p & has_q, a + (b - a) * share, np.where(has_p, a, b))
                how = np.where(has_p & has_q, 0, np.where(has_p, 1, 2))
                far = np.minimum(np.where(has_p, k - p, 1 << 30), np.where(has_q, q - k, 1 << 30))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(cols[k].astype(np.int32)), pa.array(value), names.take(pa.array(how)), pa.array(far.astype(np.int64))], names=schema.names)

    return df.select(key, F.col(column).cast("array<double>")).filter(F.size(column) > 0).mapInArrow(run, schema)


def dense(lists: pa.Array) -> np.ndarray:
    """The lists as the rows of a matrix, with NaN for null elements and beyond a list's end."""
    n = len(lists)
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    flat = np.asarray(pc.fill_null(pc.list_flatten(lists).cast(pa.float64()), float("nan")))
    width = int(size.max()) if n else 0
    out = np.full((n, width), np.nan)
    if n and (size == width).all():
        return flat.reshape(n, width)
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
