"""Linkage disequilibrium: pairs within a window, decay by distance, curves, pruning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .fill import dense


def r2(x: Column, y: Column) -> Column:
    """Squared correlation over the elements present in both arrays; null under 3, 0 without variance."""
    both = F.filter(F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")))
    add = lambda s, p: F.struct((s["n"] + 1).alias("n"), (s["a"] + p["a"]).alias("a"), (s["b"] + p["b"]).alias("b"), (s["aa"] + p["a"] * p["a"]).alias("aa"), (s["bb"] + p["b"] * p["b"]).alias("bb"), (s["ab"] + p["a"] * p["b"]).alias("ab"))

    def done(s: Column) -> Column:
        va, vb, c = s["n"] * s["aa"] - s["a"] * s["a"], s["n"] * s["bb"] - s["b"] * s["b"], s["n"] * s["ab"] - s["a"] * s["b"]
        return F.when(s["n"] < 3, F.lit(None).cast("double")).when((va <= 1e-9) | (vb <= 1e-9), 0.0).otherwise(c * c / (va * vb))

    return F.aggregate(both, zero, add, done)


def mean_maf(d: Column) -> Column:
    held = F.filter(d, lambda x: x.isNotNull())
    f = F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.size(held)
    return F.when(F.size(held) > 0, F.least(f, 1 - f))


#: Most bins that a curve is fitted to.
MOST_BINS = 1_000_000
#: Sites of one side of a block whose pairs are computed at once.
BLOCK = 512


def _block_r2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`r2` of each row of x with each of y, NaN where it is null: the sums over the common elements are matrix products."""
    mx, my = (~np.isnan(v) for v in (x, y))
    zx, zy = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    n, a, b = mx @ my.T, zx @ my.T, mx @ zy.T
    va, vb, c = n * ((zx * zx) @ my.T) - a * a, n * (mx @ (zy * zy).T) - b * b, n * (zx @ zy.T) - a * b
    flat = (va <= 1e-9) | (vb <= 1e-9)
    out = np.where(flat, 0.0, c * c / np.where(flat, 1.0, va * vb))
    out[n < 3] = np.nan
    return out


def _by_blocks(sites: DataFrame, max_bp: int, min_maf: float, give: Callable[..., pa.Table], schema: str) -> DataFrame:
    """What `give` makes of every block of r2 between a site of a bucket and the later ones within max_bp.

    A site is looked up from its bucket of that width and stands in the one before too, as in `band_join`; a
    bucket is one task, which holds its sites and goes over their pairs block by block."""
    width = max(int(max_bp), 1)
    s = sites.filter((mean_maf(F.col("d")) >= min_maf) & F.col("chrom").isNotNull() & F.col("pos").isNotNull()).select("chrom", "pos", "row_id", "d")
    at = F.floor(F.col("pos") / width)
    s = s.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("bucket", F.when(F.col("own"), at).otherwise(at - 1))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pos", "ascending"), ("row_id", "ascending")]).combine_chunks()
        pos, row, own = (table.column(c).to_numpy() for c in ("pos", "row_id", "own"))
        mine = int(own.sum())  # those of the next bucket lie behind
        parts = [give(None, None, None, None, None, None)]  # the columns, without rows
        x = dense(table.column("d").chunk(0)) if len(table) else None
        for i in range(0, mine, BLOCK):
            to = min(i + BLOCK, mine)
            end = int(np.searchsorted(pos, pos[to - 1] + width, "right"))
            for j in range(i, end, BLOCK):
                r = _block_r2(x[i:to], x[j : min(j + BLOCK, end)])
                gap = pos[None, j : j + r.shape[1]] - pos[i:to, None]
                later = (gap > 0) | (row[i:to, None] < row[None, j : j + r.shape[1]])
                a, b = np.nonzero((gap >= 0) & (gap <= width) & later & ~np.isnan(r))
                parts.append(give(table.column("chrom")[0].as_py(), pos, row, i + a, j + b, r[a, b]))
        return pa.concat_tables(parts)

    return s.groupBy("chrom", "bucket").applyInArrow(run, schema)


def ld_pairs(sites: DataFrame, max_bp: int, min_maf: float = 0.05, min_r2: float = 0.0) -> DataFrame:
    """(chrom, pos1, row1, pos2, row2, distance, r2) of the sites of one chromosome within max_bp, in file order; sites under min_maf are left out."""
    names = ("chrom", "pos1", "row1", "pos2", "row2", "distance", "r2")
    kinds = [pa.string(), *[pa.int64()] * 5, pa.float64()]

    def give(chrom: str, pos: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.ndarray) -> pa.Table:
        if pos is None:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        keep = r >= min_r2
        a, b, r = a[keep], b[keep], r[keep]
        values = [pos[a], row[a], pos[b], row[b], pos[b] - pos[a], r]
        return pa.table([pa.repeat(pa.scalar(chrom, pa.string()), len(a)), *(pa.array(v, k) for v, k in zip(values, kinds[1:]))], names=names)

    return _by_blocks(sites, max_bp, min_maf, give, "chrom string, pos1 long, row1 long, pos2 long, row2 long, distance long, r2 double")


def ld_decay(pairs: DataFrame, width: int = 1000) -> DataFrame:
    return pairs.groupBy(F.floor(F.col("distance") / width).alias("bin")).agg(F.avg("r2").alias("mean_r2"), F.count(F.lit(1)).alias("n"))


def decay(sites: DataFrame, max_bp: int, width: int = 1000, min_maf: float = 0.05) -> DataFrame:
    """(bin, mean_r2, n), as ld_decay of ld_pairs, without the pairs: the tasks send the sums of each block's bins."""
    kinds = [pa.int64(), pa.float64(), pa.int64()]

    def give(chrom: str, pos: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.ndarray) -> pa.Table:
        if pos is None:
            return pa.table([pa.array([], k) for k in kinds], names=["bin", "s", "n"])
        bins = (pos[b] - pos[a]) // width
        n, s = np.bincount(bins), np.bincount(bins, r)
        held = np.flatnonzero(n)
        return pa.table([pa.array(v, k) for v, k in zip((held, s[held], n[held]), kinds)], names=["bin", "s", "n"])

    sums = _by_blocks(sites, max_bp, min_maf, give, "bin long, s double, n long")
    return sums.groupBy("bin").agg((F.sum("s") / F.sum("n")).alias("mean_r2"), F.sum("n").alias("n"))


def ld_half_decay(decay: DataFrame) -> DataFrame:
    """(max_r2, half_bin): the first bin whose mean is at most half the greatest."""
    top = decay.agg(F.max("mean_r2").alias("max_r2"))
    return decay.join(F.broadcast(top)).groupBy("max_r2").agg(F.min(F.when(F.col("mean_r2") <= F.col("max_r2") / 2, F.col("bin"))).alias("half_bin"))


def _poly(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    return np.linalg.lstsq(np.vander(x, degree + 1), y, rcond=None)[0]


def select_curve(x: np.ndarray, y: np.ndarray, points: int = 300) -> dict:
    """The best of an exponential, a power, a hyperbola and polynomials of degree 2 and 3, by R2 less 0.5 if it doesn't fall over the first tenth."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(x) < 3:
        return {"name": "No fit", "equation": "", "r2": 0.0, "x": [], "y": []}
    out = []
    grid = np.linspace(x.min(), x.max(), points)
    pos, both = y > 0, (y > 0) & (x > 0)

    def offer(name: str, equation: str, f: object) -> None:
        ss = ((y - y.mean()) ** 2).sum()
        score = 1 - ((y - f(x)) ** 2).sum() / ss if ss > 0 else 0.0
        g = f(grid)
        first = g[: max(points // 10, 2)]
        out.append((score - (0.5 if first[-1] >= first[0] else 0), score, name, equation, g))

    if pos.sum() >= 3:
        b, a = _poly(x[pos], np.log(y[pos]), 1)
        offer("Exponential", f"y = {np.exp(a):.4g} * exp({b:.4g} x)", lambda t: np.exp(a + b * t))
    if both.sum() >= 3:
        q, p = _poly(np.log(x[both]), np.log(y[both]), 1)
        offer("Power", f"y = {np.exp(p):.4g} * x^{q:.4g}", lambda t: np.exp(p) * np.maximum(t, 1e-9) ** q)
    if pos.sum() >= 3:
        v, u = _poly(x[pos], 1 / y[pos], 1)
        offer("Hyperbolic", f"y = 1 / ({u:.4g} + {v:.4g} x)", lambda t: 1 / np.where(np.abs(u + v * t) < 1e-12, 1e-12, u + v * t))
    top = np.abs(x).max() or 1.0
    for degree in (2, 3):
        if len(x) > degree:
            c = _poly(x / top, y, degree)
            offer(f"Polynomial {degree}", " + ".join(f"{k:.4g} x^{degree - i}" for i, k in enumerate(c)), lambda t, c=c: np.polyval(c, t / top))
    _, score, name, equation, g = max(out, key=lambda o: o[0])
    return {"name": name, "equation": equation, "r2": float(score), "x": grid.tolist(), "y": g.tolist()}


def fit_decay(decay: DataFrame, width: int = 1000, points: int = 300) -> DataFrame:
    """One row with the curve that fits the bins best; bins are as many as the window over their width."""
    rows = decay.select("bin", "mean_r2").orderBy("bin").limit(MOST_BINS + 1).toPandas()
    if len(rows) > MOST_BINS:
        raise ValueError(f"more than {MOST_BINS} bins: use wider ones")
    c = select_curve((rows["bin"].to_numpy(float) + 0.5) * width, rows["mean_r2"].to_numpy(float), points)
    return decay.sparkSession.createDataFrame([(c["name"], c["equation"], c["r2"], c["x"], c["y"])], "name string, equation string, r2 double, x array<double>, y array<double>")


def prune(sites: DataFrame, threshold: float, batch_rows: int = 4096) -> DataFrame:
    """The sites left when each whose r2 with the last kept one of its chromosome is at least `threshold` goes, in row order.

    A chain of decisions from row to row, so a chromosome is one sorted stream; it passes through a window's
    order into a task that holds one kept site at a time, not the group."""
    schema = sites.schema
    names = sites.columns

    def run(frames: object) -> object:
        last_chrom, last = None, None
        for pdf in frames:
            keep = []
            for chrom, d in zip(pdf["chrom"], pdf["d"]):
                x = np.asarray(d, float)  # None is NaN
                if chrom == last_chrom and last is not None:
                    m = ~np.isnan(x) & ~np.isnan(last)
                    a, b = x[m], last[m]
                    r = 0.0 if len(a) < 3 or a.std() < 1e-12 or b.std() < 1e-12 else np.corrcoef(a, b)[0, 1] ** 2
                    if r >= threshold:
                        keep.append(False)
                        continue
                last_chrom, last = chrom, x
                keep.append(True)
            yield pdf[np.array(keep, bool)][names] if len(pdf) else pdf

    return sites.repartition("chrom").sortWithinPartitions("chrom", "row_id").mapInPandas(run, schema)


def windows(sites: DataFrame, size: int) -> DataFrame:
    """sites with `block`: consecutive groups of `size` sites of a chromosome, in row order."""
    return sites.withColumn("block", F.floor((F.row_number().over(W.Window.partitionBy("chrom").orderBy("row_id")) - 1) / size))


def haplotype_pc1(sites: DataFrame, size: int, ploidy: int) -> DataFrame:
    """(chrom, block, start, end, n, d): the first principal component of each group, scaled to 0..ploidy; a group of one is that site. Its sign is such that it agrees with the group's mean."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        x = np.array([np.asarray(d, float) for d in pdf.d])  # None is NaN
        mean = np.nanmean(np.where(np.isnan(x).all(1, keepdims=True), 0, x), 1, keepdims=True)
        z = np.where(np.isnan(x), mean, x) - mean
        if len(z) == 1:
            d = x[0]
        else:
            u, s, vt = np.linalg.svd(z, full_matrices=False)
            d = vt[0] * s[0]
            d = d if np.dot(d, z.mean(0)) >= 0 else -d
            d = (d - d.min()) / (np.ptp(d) or 1) * ploidy
        return pd.DataFrame({"chrom": [pdf.chrom.iloc[0]], "block": [int(pdf.block.iloc[0])], "start": [int(pdf.pos.iloc[0])], "end": [int(pdf.pos.iloc[-1])], "n": [len(pdf)], "d": [[None if np.isnan(v) else float(v) for v in d]]})

    return windows(sites, size).groupBy("chrom", "block").applyInPandas(run, "chrom string, block long, start long, end long, n int, d array<double>")
