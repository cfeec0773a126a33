"""Association by mixed models: variance fitted once per null model, markers tested in Arrow batches by all tasks."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.kernels import f_sf, f_sf_array, t_sf2
from ..runtime import small, tree_sum
from .fill import dense
from .structure import MOST_SAMPLES, _filled

MODELS = ("ADDITIVE", "SIMPLEX", "DUPLEX", "TRIPLEX", "SIMPLEX_REF", "DUPLEX_REF", "TRIPLEX_REF", "GENERAL")
#: Markers of a chromosome below which it shares a group with the others like it.
LEAST_MARKERS = 100
#: Most bytes of all groups' null models, which every executor holds.
MOST_NULL_BYTES = 2 << 30


@dataclass
class Null:
    """A null model: eigenvectors of the kinship, weights, rotated response and covariates."""

    u: np.ndarray
    w: np.ndarray
    y: np.ndarray
    x: np.ndarray
    delta: float


def _reml(log_delta: float, lam: np.ndarray, y: np.ndarray, x: np.ndarray) -> float:
    w = 1 / (np.maximum(lam, 1e-6) + math.exp(log_delta))
    a = x.T @ (w[:, None] * x)
    beta = np.linalg.lstsq(a, x.T @ (w * y), rcond=None)[0]
    rss = (w * (y - x @ beta) ** 2).sum()
    n, q = x.shape
    return (n - q) * math.log(max(rss, 1e-300)) - np.log(w).sum() + np.linalg.slogdet(a)[1]


def fit_null(kinship: np.ndarray, y: np.ndarray, x: np.ndarray, delta: float | None = None) -> Null:
    """delta, residual over genetic variance, by golden section on [1e-4, 1000] in logarithms unless given; all inputs are of the phenotyped samples only."""
    lam, u = np.linalg.eigh((kinship + kinship.T) / 2)
    ty, tx = u.T @ y, u.T @ x
    if delta is None:
        grid = np.linspace(math.log(1e-4), math.log(1000), 40)
        best = int(np.argmin([_reml(g, lam, ty, tx) for g in grid]))
        a, b = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
        g = (math.sqrt(5) - 1) / 2
        while b - a > 1e-4:
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if _reml(c, lam, ty, tx) < _reml(d, lam, ty, tx) else (c, b)
        delta = math.exp((a + b) / 2)
    return Null(u, 1 / (np.maximum(lam, 1e-6) + delta), ty, tx, delta)


def design(n: int, pcs: np.ndarray | None = None, q: np.ndarray | None = None, fixed: list[list[str]] | None = None) -> np.ndarray:
    """Intercept, components, ancestry and dummies of each fixed effect (its last level, in order, is left out)."""
    cols = [np.ones((n, 1))]
    cols += [m for m in (pcs, q) if m is not None and m.size]
    for values in fixed or []:
        levels = sorted(set(values))
        cols += [np.array([[float(v == lv) for lv in levels[:-1]] for v in values]).reshape(n, -1)]
    return np.concatenate(cols, axis=1)


def recode(d: np.ndarray, model: str, ploidy: int) -> np.ndarray | None:
    """The predictors of a marker: itself, a 0/1 of having so many copies, or one of each dosage but the last; None if it doesn't vary."""
    if model == "ADDITIVE":
        x = d[:, None]
    elif model == "GENERAL":
        r = np.round(d).astype(int)
        kinds = np.unique(r)
        x = (r[:, None] == kinds[None, :-1]).astype(float)
    else:
        k = {"SIMPLEX": 1, "DUPLEX": 2, "TRIPLEX": 3}[model.split("_")[0]]
        x = ((d <= ploidy - k) if model.endswith("_REF") else (d >= k)).astype(float)[:, None]
    return x if x.shape[1] and (np.ptp(x, axis=0) > 1e-12).any() else None


def test_marker(null: Null, x: np.ndarray) -> tuple[float, float, float, float]:
    """p of the F test, effect of the first predictor, partial R2, AIC, by weighted least squares with the null's weights."""
    z = np.concatenate((null.x, null.u.T @ x), axis=1)
    s = np.sqrt(null.w)
    b0 = np.linalg.lstsq(s[:, None] * null.x, s * null.y, rcond=None)[0]
    r0 = ((s * (null.y - null.x @ b0)) ** 2).sum()
    b1, _, rank, _ = np.linalg.lstsq(s[:, None] * z, s * null.y, rcond=None)
    r1 = ((s * (null.y - z @ b1)) ** 2).sum()
    n, q = null.x.shape
    df = max(rank - np.linalg.matrix_rank(null.x), 0)
    if df == 0 or n - q - df <= 0:
        return 1.0, 0.0, 0.0, n * math.log(max(r0, 1e-300) / n) + 2 * (q + 1)
    f = ((r0 - r1) / df) / max(r1 / (n - q - df), 1e-300)
    return f_sf(f, df, n - q - df), float(b1[q]), float(max(0.0, 1 - r1 / max(r0, 1e-300))), n * math.log(max(r1, 1e-300) / n) + 2 * (q + df + 1)


def test_markers(null: Null, d: np.ndarray, model: str, ploidy: int) -> tuple[np.ndarray, ...]:
    """test_marker for all rows of d: models of one predictor at once, by regression on what the covariates leave; p is 1 where nothing varies."""
    m = len(d)
    out = np.ones(m), np.zeros(m), np.zeros(m), np.zeros(m)
    if model == "GENERAL":
        for i in range(m):
            z = recode(d[i], model, ploidy)
            if z is not None:
                for o, v in zip(out, test_marker(null, z)):
                    o[i] = v
        return out
    k = {"SIMPLEX": 1, "DUPLEX": 2, "TRIPLEX": 3}.get(model.split("_")[0], 0)
    z = d if model == "ADDITIVE" else ((d <= ploidy - k) if model.endswith("_REF") else (d >= k)).astype(float)
    s = np.sqrt(null.w)
    q, _ = np.linalg.qr(s[:, None] * null.x)
    y = s * null.y
    y = y - q @ (q.T @ y)
    w = (z @ null.u) * s
    left = w - (w @ q) @ q.T
    zz, zy, r0 = (left * left).sum(1), left @ y, float(y @ y)
    n, c = null.x.shape
    ok = np.flatnonzero((np.ptp(z, axis=1) > 1e-12) & (zz > 1e-10 * (w * w).sum(1))) if n - c - 1 > 0 and m else np.zeros(0, int)
    gain = np.minimum(zy[ok] ** 2 / zz[ok], r0)
    r1 = np.maximum(r0 - gain, 1e-300)
    f = gain / (r1 / (n - c - 1))
    out[0][ok] = f_sf_array(f, 1, n - c - 1)
    out[1][ok] = zy[ok] / zz[ok]
    out[2][ok] = np.maximum(0, 1 - r1 / max(r0, 1e-300))
    out[3][ok] = n * np.log(r1 / n) + 2 * (c + 2)
    return out


def markers(sites: DataFrame, ploidy: int, maf: float = 0.05, max_missing: float = 0.1) -> DataFrame:
    """The sites that are tested; d counts copies."""
    held = F.filter("d", lambda x: x.isNotNull())
    f = F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / (F.size(held) * float(ploidy))
    return sites.filter((F.size(held) > 0) & (1 - F.size(held) / F.size("d") <= max_missing) & (F.least(f, 1 - f) >= maf))


def loco_groups(sites: DataFrame) -> DataFrame:
    """sites with `grp`: their chromosome, or a common name for those of few markers."""
    n = sites.groupBy("chrom").agg(F.count(F.lit(1)).alias("__n"))
    return sites.join(small(n), "chrom").withColumn("grp", F.when(F.col("__n") < LEAST_MARKERS, "__small__").otherwise(F.col("chrom"))).drop("__n")


def loco_kinships(sites: DataFrame, ploidy: int) -> dict[str, np.ndarray]:
    """The kinship without each group, from one pass: the sums of a group are taken from those of all."""
    n = sites.agg(F.max(F.size("d"))).first()[0] or 0
    if n > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            x, of = dense(batch.column(1)), np.array(batch.column(0).to_pylist())
            for g in set(of.tolist()):
                y = _filled(x[of == g])
                f = y.mean(1, keepdims=True) / ploidy
                z = y - ploidy * f
                sums = np.concatenate(((z.T @ z).ravel(), [(ploidy * f * (1 - f)).sum()]))
                held[g] = held.get(g, 0) + sums
        for g, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([sums.tobytes()])], names=["grp", "sums"])

    parts = sites.select("grp", "d").mapInArrow(run, "grp string, sums binary")
    rows = tree_sum(parts, ["grp"], ["sums"]).collect()
    parts = {r.grp: np.frombuffer(r.sums) for r in rows}  # samples by samples for each chromosome
    total = sum(parts.values())
    return {g: ((total - p)[:-1] / ((total - p)[-1] + 1e-10)).reshape(n, n) for g, p in parts.items()}


def impute_batch(x: np.ndarray, how: str = "mean", kin: np.ndarray | None = None, k: int = 5) -> np.ndarray:
    """Sites by samples without gaps: the site's mean, mode, or the mean of its k closest genotyped kin weighted by kinship + 1."""
    if how == "mean":
        return _filled(x)
    y = x.copy()
    for i in np.flatnonzero(np.isnan(x).any(1)):
        hole, held = np.isnan(x[i]), ~np.isnan(x[i])
        if how == "mode":
            values, counts = np.unique(x[i][held], return_counts=True)
            y[i][hole] = values[counts.argmax()]
        elif how == "knn" and kin is not None:
            for j in np.flatnonzero(hole):
                near = [m for m in np.argsort(-kin[j], kind="stable") if held[m] and m != j][:k]
                w = np.maximum(0.001, kin[j][near] + 1)
                y[i, j] = (w * x[i][near]).sum() / w.sum()
        else:
            y[i][hole] = np.nanmean(x[i])
    return y


HIT = "marker string, chrom string, pos long, model string, p double, effect double, r2 double, aic double"


def scan(sites: DataFrame, y: np.ndarray, kinship: np.ndarray | dict[str, np.ndarray], ploidy: int, models: tuple[str, ...] = ("ADDITIVE",), covariates: np.ndarray | None = None, impute: str = "mean", delta: float | None = None) -> DataFrame:
    """A hit for every marker and model: (marker, chrom, pos, model, p, effect, r2, aic); hits of p = 1 are left out.

    y: of each sample, NaN without a phenotype; those samples are left out of the kinship before it is
    decomposed. A dict of kinships is by the sites' `grp`. sites: marker, chrom, pos, d (copies)."""
    has = np.isfinite(y)
    x0 = covariates if covariates is not None else np.ones((len(y), 1))
    per = kinship if isinstance(kinship, dict) else {"": kinship}
    nulls = {g: fit_null(k[np.ix_(has, has)], y[has], x0[has], delta) for g, k in per.items()}
    grouped = isinstance(kinship, dict)
    size = sum(x.u.nbytes for x in nulls.values())
    if size > MOST_NULL_BYTES:
        raise ValueError(f"the null models take {size >> 20} MB: scan fewer groups at once")
    # sent to an executor once, not with each task; the kinships only where missing dosages need them
    sent = sites.sparkSession.sparkContext.broadcast((nulls, per if impute == "knn" else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nulls, kin = sent.value
        for batch in batches:
            x = dense(batch.column(3))
            of = np.array(batch.column(4).to_pylist()) if grouped else np.zeros(len(x), "U1")
            for g in np.unique(of):
                at = np.flatnonzero(of == g)
                d = impute_batch(x[at], impute, kin and kin[g])[:, has]
                for model in models:
                    p, effect, r2, aic = test_markers(nulls[g], d, model, ploidy)
                    hit = np.flatnonzero(p < 1)
                    own = batch.take(pa.array(at[hit]))
                    yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array([model] * len(hit), pa.string()), *(pa.array(v[hit]) for v in (p, effect, r2, aic))], names=["marker", "chrom", "pos", "model", "p", "effect", "r2", "aic"])

    return sites.select("marker", "chrom", "pos", "d", *(["grp"] if grouped else [])).mapInArrow(run, HIT)


def fdr(hits: DataFrame, p: str = "p", by: list[str] | None = None, tie: str = "marker") -> DataFrame:
    """hits with `rank` and `q`, the false discovery rates by Benjamini and Hochberg.

    Without groups the ranks are of the whole: hits are counted in 4096 ranges of p (in logarithms), a range's
    rank offset and least q so far come from those few rows, and only ranges are sorted, each in its task."""
    if by:
        up, all_ = W.Window.partitionBy(*by).orderBy(p, tie), W.Window.partitionBy(*by)
        out = hits.withColumn("rank", F.row_number().over(up)).withColumn("__m", F.count(F.lit(1)).over(all_))
        raw = F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("rank"))
        return out.withColumn("q", F.min(raw).over(W.Window.partitionBy(*by).orderBy(F.col("rank").desc()).rowsBetween(W.Window.unboundedPreceding, 0))).drop("__m")
    # half the ranges for p from 1 down to 0.1, the rest by logarithm
    slot = F.when(F.col(p) >= 0.1, 2048 + F.floor((F.col(p) - 0.1) / 0.9 * 2047)).otherwise(F.greatest(F.lit(0), 2047 + F.floor(F.log10(F.greatest(F.col(p), F.lit(1e-300))) * 6.8)))
    slotted = hits.withColumn("__s", slot.cast("int"))
    sizes = slotted.groupBy("__s").agg(F.count(F.lit(1)).alias("n"))  # at most 4096 rows
    sizes = sizes.withColumn("__off", F.coalesce(F.sum("n").over(W.Window.orderBy("__s").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__m", F.sum("n").over(W.Window.partitionBy())).drop("n")
    out = slotted.join(F.broadcast(sizes), "__s").withColumn("rank", (F.row_number().over(W.Window.partitionBy("__s").orderBy(p, tie)) + F.col("__off")).cast("long"))
    out = out.withColumn("__q", F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("rank")))
    later = out.groupBy("__s").agg(F.min("__q").alias("m")).withColumn("__later", F.min("m").over(W.Window.orderBy(F.col("__s").desc()).rowsBetween(W.Window.unboundedPreceding, -1))).drop("m")
    inside = F.min("__q").over(W.Window.partitionBy("__s").orderBy(F.col("rank").desc()).rowsBetween(W.Window.unboundedPreceding, 0))
    return out.withColumn("__in", inside).join(F.broadcast(later), "__s").withColumn("q", F.least("__in", F.coalesce("__later", F.lit(1.0)))).drop("__s", "__off", "__m", "__q", "__in", "__later")


def best_models(hits: DataFrame) -> DataFrame:
    """The hit of the least AIC of each marker, ties to the least p, then the model's name."""
    w = W.Window.partitionBy("marker").orderBy("aic", "p", "model")
    return hits.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def qq(best: DataFrame, total: Column) -> DataFrame:
    """best with its rank by p and the expected -log10 p, rank over all hits."""
    ranked = fdr(best).drop("q")
    return ranked.withColumn("expected", -F.log10(F.col("rank") / total)).withColumn("observed", -F.log10("p"))


def offsets(hits: DataFrame, gap: int = 5_000_000) -> DataFrame:
    """(chrom, max_pos, offset) for a plot: main chromosomes one after the other by number and name, all scaffolds after them."""
    from ..functions.names import chromosome_number, is_main_chromosome

    c = hits.groupBy("chrom").agg(F.max("pos").alias("max_pos")).withColumn("main", is_main_chromosome(F.col("chrom"))).withColumn("num", F.coalesce(chromosome_number(F.col("chrom")), F.lit(1 << 40)))
    w = W.Window.orderBy("num", "chrom")
    main = c.filter("main").withColumn("offset", F.coalesce(F.sum(F.col("max_pos") + gap).over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    end = c.filter("main").agg(F.coalesce(F.sum(F.col("max_pos") + gap), F.lit(0)).alias("offset"))
    rest = c.filter(~F.col("main")).crossJoin(F.broadcast(end))
    cols = ["chrom", "max_pos", "offset"]
    return main.select(*cols).unionByName(rest.select(*cols))


def lead_markers(hits: DataFrame, reach: int = 5_000_000) -> DataFrame:
    """The hits left when, by p and then marker, each within `reach` of a better one of its chromosome that is left goes.

    Hits without chromosome, position or p are left out; of equal hits one is left. Only places are sent to the chromosome's task,
    where a hit's neighbours among the kept are found by bisection; hits of one stretch of that width are all near each
    other, so a chromosome keeps no more than its length over `reach`, twice."""
    place = ["chrom", "p", "marker", "pos"]
    held = hits.filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("p").isNotNull())
    kinds = dict(hits.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "marker", "pos"], kind="stable")
        kept, chosen = [], []
        for i, x in enumerate(pdf["pos"].tolist()):
            at = bisect.bisect_left(kept, x)
            if (at == len(kept) or kept[at] - x > reach) and (at == 0 or x - kept[at - 1] > reach):
                kept.insert(at, x)
                chosen.append(i)
        return pdf.iloc[chosen]

    leads = held.select(*place).groupBy("chrom").applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in place))
    first = held.withColumn("__n", F.row_number().over(W.Window.partitionBy(*place).orderBy(F.lit(0)))).filter("__n = 1").drop("__n")
    return first.join(leads, place, "left_semi")


def epistasis(sites: DataFrame, leads: DataFrame, y: np.ndarray, kinship: np.ndarray, covariates: np.ndarray | None = None, most: float = 1e-4) -> DataFrame:
    """(marker1, marker2, p, effect) of the product of each lead (at most 5) with every other marker, with delta 1; p under `most`."""
    has = np.isfinite(y)
    x0 = covariates if covariates is not None else np.ones((len(y), 1))
    null = fit_null(kinship[np.ix_(has, has)], y[has], x0[has], 1.0)
    rows = leads.select("marker").distinct().limit(5)
    held = [(r.marker, impute_batch(np.array([[np.nan if v is None else v for v in r.d]]))[0][has]) for r in sites.join(F.broadcast(rows), "marker", "left_semi").select("marker", "d").collect()]
    s = np.sqrt(null.w)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for m, d in zip(pdf.marker, pdf.d):
                x2 = impute_batch(np.asarray(d, float)[None])[0][has]
                for lead, x1 in held:
                    if lead == m:
                        continue
                    z = s[:, None] * np.concatenate((null.x, null.u.T @ np.stack((x1, x2, x1 * x2), 1)), axis=1)
                    n, q = z.shape
                    b, _, rank, _ = np.linalg.lstsq(z, s * null.y, rcond=None)
                    if rank < q or n <= q:
                        continue
                    rss = ((s * null.y - z @ b) ** 2).sum()
                    se = math.sqrt(max(rss / (n - q) * np.linalg.inv(z.T @ z)[-1, -1], 1e-300))
                    p = t_sf2(b[-1] / se, n - q)
                    if p < most:
                        out.append((lead, m, p, float(b[-1])))
            yield pd.DataFrame(out, columns=["marker1", "marker2", "p", "effect"])

    return sites.select("marker", "d").mapInPandas(run, "marker1 string, marker2 string, p double, effect double").orderBy("p", "marker1", "marker2")


def phenotypes_by_dosage(hits: DataFrame, sites: DataFrame, pheno: DataFrame, most: float = 0.001) -> DataFrame:
    """(marker, dosage, samples, values) of the markers of hits under `most`; pheno: sample (its place), y."""
    top = hits.filter(F.col("p") < most).select("marker").distinct()
    long = sites.join(top, "marker", "left_semi").select("marker", F.posexplode("d").alias("sample", "x")).filter(F.col("x").isNotNull())
    return long.join(pheno, "sample").groupBy("marker", F.round("x").cast("int").alias("dosage")).agg(F.array_sort(F.collect_list("sample")).alias("samples"), F.transform(F.array_sort(F.collect_list(F.struct("sample", "y"))), lambda s: s["y"]).alias("values"))


def lambda_gc(hits: DataFrame) -> DataFrame:
    """(lambda, label): the median chi-square of one degree over its expectation; the median is the value of rank n / 2 from 0."""
    from statistics import NormalDist

    from ..functions.names import lambda_label

    ranked = fdr(hits).select("p", "rank")
    n = ranked.count()
    row = ranked.filter(F.col("rank") == n // 2 + 1).first()
    schema = T.StructType([T.StructField("lambda", T.DoubleType())])
    value = NormalDist().inv_cdf(1 - max(row.p, 1e-300) / 2) ** 2 / 0.4549 if row and 0 < row.p < 1 else None
    return hits.sparkSession.createDataFrame([(value,)], schema).withColumn("label", lambda_label(F.col("lambda")))
