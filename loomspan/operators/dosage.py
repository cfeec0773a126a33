"""Dosages: rounding, imputation, distances between samples, export."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls as C
from ..runtime import small
from .fill import dense

#: Most samples of a matrix on the driver.
MOST_SAMPLES = 20_000


def dosages(variants: DataFrame, ploidy: int = 2, rule: str = "counts_then_gt", caller: str = "any", min_depth: int = 0) -> DataFrame:
    """(row_id, chrom, pos, id, ref, alt, d) of variants with calls."""
    d = F.transform("calls", lambda c: C.dosage(c, F.col("format"), F.col("ref"), F.col("alt"), rule, ploidy, min_depth, caller))
    return variants.select("row_id", "chrom", "pos", "id", "ref", "alt", d.alias("d"))


def round_levels(sites: DataFrame, ploidy: int) -> DataFrame:
    return sites.withColumn("d", F.transform("d", lambda x: C.to_level(x, ploidy)))


def _kmeans_sites(x: np.ndarray, ploidy: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the cluster of each value, -1 where it is missing, and the centroids, from the levels of the ploidy.

    All rows move at once; one that has settled stays; an empty cluster keeps its centroid."""
    k = max(ploidy, 2) + 1
    centre = np.tile(np.arange(k) / (k - 1), (len(x), 1))
    row, col = np.nonzero(~np.isnan(x))
    v, of = x[row, col], np.zeros(len(row), int)
    moves = np.ones(len(x), bool)
    for _ in range(rounds):
        at = np.flatnonzero(moves[row])
        if not len(at):
            break
        r, w = row[at], v[at]
        of[at] = np.abs(w[:, None] - centre[r]).argmin(1)
        place = r * k + of[at]
        n = np.bincount(place, minlength=len(x) * k).reshape(len(x), k)
        new = np.where(n > 0, np.bincount(place, w, len(x) * k).reshape(len(x), k) / np.maximum(n, 1), centre)
        moves &= (np.abs(new - centre) > 1e-12).any(1)
        centre = np.where(moves[:, None], new, centre)
    out = np.full(x.shape, -1)
    out[row, col] = of
    return out, centre


def adaptive_levels(sites: DataFrame, ploidy: int) -> DataFrame:
    """sites with each dosage replaced by the level of its cluster; clusters are found per site."""
    place = sites.columns.index("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column(place))
            of, _ = _kmeans_sites(x, ploidy)
            y = np.where(of >= 0, of / max(ploidy, 2), np.nan)
            size = np.asarray(pc.list_value_length(batch.column(place)).fill_null(0))
            inside = np.arange(y.shape[1]) < size[:, None]
            flat = y[inside]
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            col = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float64(), mask=np.isnan(flat)), mask=pc.is_null(batch.column(place)))
            yield pa.RecordBatch.from_arrays([col if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return sites.mapInArrow(run, sites.schema)


def snp_clusters(sites: DataFrame, ploidy: int, include: DataFrame | None = None, limit: int | None = 1000, marker: str = "marker") -> DataFrame:
    """(row_id, marker, histogram of 50 bins, centroids, sizes) of the first `limit` included sites; missing calls don't count."""
    if include is not None:
        sites = sites.join(small(include), marker, "left_semi")
    if limit is not None:
        sites = sites.orderBy("row_id").limit(limit)

    def counts(place: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
        row = np.nonzero(held)[0]
        return np.bincount(row * n + place[held], minlength=len(held) * n).reshape(len(held), n)

    def lists(a: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column(2))
            held = ~np.isnan(x)
            of, centre = _kmeans_sites(x, ploidy)
            bins = (np.where(held, x, 0) * 49).astype(int).clip(0, 49)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists(counts(bins, held, 50), pa.int32()), lists(centre, pa.float64()), lists(counts(of, held, centre.shape[1]), pa.int32())], names=["row_id", marker, "histogram", "centroids", "sizes"])

    return sites.select("row_id", marker, "d").mapInArrow(run, f"row_id long, {marker} string, histogram array<int>, centroids array<double>, sizes array<int>")


def impute(sites: DataFrame, how: str, ploidy: int = 2, k: int = 5, distances: DataFrame | None = None) -> DataFrame:
    """sites with missing dosages filled. mode: the commonest (the least of equals); mean: the mean, of 6 decimals;
    knn: the mean of the k nearest genotyped samples by `distances` (i, j, value), at its level; none: as they are.
    A site without any dosage stays missing."""
    held = F.filter("d", lambda x: x.isNotNull())
    if how == "none":
        return sites
    if how == "mean":
        mean = F.bround(F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.size(held), 6)
        fill = F.when(F.size(held) > 0, mean)
        return sites.withColumn("d", F.transform("d", lambda x: F.coalesce(x, fill)))
    if how == "mode":
        kinds = F.array_sort(F.array_distinct(held))
        most = F.array_max(F.transform(kinds, lambda v: F.size(F.filter(held, lambda x: x == v))))
        fill = F.get(F.filter(kinds, lambda v: F.size(F.filter(held, lambda x: x == v)) == most), F.lit(0))
        return sites.withColumn("d", F.transform("d", lambda x: F.coalesce(x, fill)))
    if how == "knn":
        return _impute_knn(sites, ploidy, k, distances)
    raise ValueError(how)


def _square(pairs: DataFrame, n: int) -> np.ndarray:
    """Pairs (i, j, value) of n samples as a symmetric matrix on the driver; an error for more than MOST_SAMPLES."""
    if n > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    m = np.full((n, n), np.nan)
    t = pairs.select("i", "j", F.col("value").cast("double").alias("value")).toArrow()  # n * n / 2 rows
    i, j, v = (t.column(c).to_numpy() for c in t.column_names)
    m[i, j] = m[j, i] = v
    return m


def _impute_knn(sites: DataFrame, ploidy: int, k: int, distances: DataFrame) -> DataFrame:
    n = sites.select(F.size("d").alias("n")).agg(F.max("n")).first()[0] or 0
    m = _square(distances, n)
    np.fill_diagonal(m, np.nan)
    order = np.argsort(np.where(np.isnan(m), np.inf, m), axis=1, kind="stable")
    usable = ~np.isnan(np.take_along_axis(m, order, 1))
    levels = max(ploidy, 2)
    place = sites.columns.index("d")
    schema = sites.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column(place))
            y = x.copy()
            for col in np.flatnonzero(np.isnan(x).any(0)):
                rows = np.flatnonzero(np.isnan(x[:, col]))
                v = x[rows][:, order[col][usable[col]]]
                held = ~np.isnan(v)
                held &= np.cumsum(held, 1) <= k
                n_held = held.sum(1)
                mean = np.where(held, v, 0.0).sum(1) / np.maximum(n_held, 1)
                # the last digits of a mean don't decide which level it is halfway to
                y[rows, col] = np.where(n_held > 0, np.ceil(np.round(mean * levels, 9) - 0.5) / levels, np.nan)
            flat = pa.array(y.reshape(-1), pa.float64(), mask=np.isnan(y.reshape(-1)))
            col = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([col if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return sites.mapInArrow(run, schema)


#: What is summed over the sites for each pair of samples.
PAIR_SUMS = ("shared", "abs", "sq", "xy", "xx", "yy")


def pair_sums(sites: DataFrame) -> DataFrame:
    """(i, j, shared, abs, sq, xy, xx, yy), i < j, over the sites where both samples have a dosage.

    Every task reduces its sites to matrices of samples by samples (products of matrices, but for the
    absolute differences), which alone are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = dense(batch.column(0))
            m, z = ~np.isnan(x), np.nan_to_num(x)
            f = m.astype(float)
            n = x.shape[1]
            if total is None:
                total = np.zeros((6, n, n))
            xx = (z * z).T @ f
            xy = z.T @ z
            total[0] += f.T @ f
            total[2] += xx + xx.T - 2 * xy
            total[3] += xy
            total[4] += xx
            total[5] += xx.T
            for i in range(n):
                total[1, i] += (np.abs(z - z[:, i : i + 1]) * m * m[:, i : i + 1]).sum(0)
        if total is not None:
            i, j = np.triu_indices(total.shape[1], 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(t[i, j]) for t in total)], names=["i", "j", *PAIR_SUMS])

    parts = sites.select("d").mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in PAIR_SUMS))
    return parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in PAIR_SUMS))


def distance(sums: DataFrame, method: str = "manhattan") -> DataFrame:
    """(i, j, value, shared); null without shared sites. manhattan = ibs = p-distance; euclidean = rogers; nei."""
    n = F.col("shared")
    if method in ("manhattan", "ibs", "p-distance"):
        v = F.col("abs") / n
    elif method in ("euclidean", "rogers"):
        v = F.sqrt(F.greatest(F.col("sq"), F.lit(0.0)) / n)
    elif method == "nei":
        same = F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))
        v = -F.log(F.greatest(F.when((F.col("xx") > 0) & (F.col("yy") > 0), same).otherwise(0.0), F.lit(1e-10)))
    else:
        raise ValueError(method)
    return sums.select("i", "j", F.when(n > 0, v).alias("value"), n.cast("long").alias("shared"))


def genetic_distance(sites: DataFrame, method: str = "manhattan") -> DataFrame:
    return distance(pair_sums(sites), method)


def to_acgt(sites: DataFrame, ploidy: int, samples: list[str] | None = None) -> DataFrame:
    """Genotype texts of biallelic sites (an alternate `.` passes): sites hold ref, alt and d, the fraction of the alternate."""
    keep = sites.filter((F.length("ref") == 1) & (F.length("alt") == 1))
    return keep.withColumn("genotypes", F.transform("d", lambda x: C.acgt(1 - x, F.col("ref"), F.col("alt"), ploidy)))


def ploidy_estimate(sites: DataFrame, candidates: tuple[int, ...] = (2, 4, 6, 8, 10, 12)) -> DataFrame:
    """(sample, ploidy, confidence, sites): by the least mean squared distance to the levels; confidence is 1 - best / second."""
    long = sites.select(F.posexplode("d").alias("sample", "x")).filter(F.col("x").isNotNull() & (F.col("x") > 0.05) & (F.col("x") < 0.95))
    fit = long.groupBy("sample").agg(F.count(F.lit(1)).alias("sites"), *(F.avg(F.pow(F.col("x") - F.round(F.col("x") * p) / p, 2) * p * p).alias(f"m{p}") for p in candidates))
    ranked = fit.withColumn("r", F.array_sort(F.array(*(F.struct(F.col(f"m{p}").alias("m"), F.lit(p).alias("p")) for p in candidates))))
    a, b = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return ranked.select("sample", a["p"].alias("ploidy"), F.when(b["m"] > 0, 1 - a["m"] / b["m"]).otherwise(0.0).alias("confidence"), "sites")
