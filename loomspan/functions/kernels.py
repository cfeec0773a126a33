"""Numeric kernels without a built-in: exact tests, tails, alignments. Plain numpy, wrapped as Arrow functions where needed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import CODONS


def _struct(*names: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def hwe_exact(aa: int, ab: int, bb: int) -> float:
    """Exact test of Hardy-Weinberg proportions: probability of heterozygote counts as rare as the observed one."""
    n, rare = aa + ab + bb, 2 * min(aa, bb) + ab
    if n == 0:
        return 1.0
    h = np.arange(rare % 2, rare + 1, 2)
    a, b = (rare - h) // 2, n - h - (rare - h) // 2
    log = h * math.log(2) - log_gamma(h + 1.0) - log_gamma(a + 1.0) - log_gamma(b + 1.0)
    p = np.exp(log - log.max())
    return float(min(1.0, p[p <= p[h == ab][0] + 1e-9].sum() / p.sum()))


@F.pandas_udf(T.DoubleType())
def _hwe(aa: pd.Series, ab: pd.Series, bb: pd.Series) -> pd.Series:
    keys = pd.DataFrame({"a": aa.fillna(0).astype(int), "b": ab.fillna(0).astype(int), "c": bb.fillna(0).astype(int)})
    known = {k: hwe_exact(*k) for k in set(map(tuple, keys.to_numpy().tolist()))}
    return pd.Series([known[k] for k in map(tuple, keys.to_numpy().tolist())], index=aa.index)


def hwe(aa: Column, ab: Column, bb: Column) -> Column:
    return _hwe(aa, ab, bb)


def chi2_sf_wh(x: Column, df: int) -> Column:
    """Upper tail of chi-square by Wilson and Hilferty's cube root; the normal tail by a rational approximation."""
    z = (F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    t = 1 / (1 + 0.5 * F.abs(z) / math.sqrt(2))
    # Coefficients of the published approximation of erfc.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = F.lit(k) + t * poly
    erfc = t * F.exp(-z * z / 2 + poly)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def hypergeometric_sf(k: int, draws: int, good: int, total: int) -> float:
    """P(X >= k) of good ones among the draws."""
    lo, hi = max(k, draws - (total - good), 0), min(draws, good)
    if lo > hi:
        return 0.0
    x = np.arange(lo, hi + 1)
    choose = lambda n, r: math.lgamma(n + 1) - log_gamma(r + 1.0) - log_gamma(n - r + 1.0)
    log = choose(good, x) + choose(total - good, draws - x) - choose(total, np.array([draws]))
    return float(min(1.0, np.exp(log).sum()))


def log_beta_sf(x: float, a: float, b: float) -> float:
    """log of 1 - I_x(a, b), by the continued fraction on the side where it converges fast."""

    def log_cf(x: float, a: float, b: float) -> float:
        front = a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        c, d, f = 1.0, 1 - (a + b) * x / (a + 1), 1.0
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        f = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
                f *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return front + math.log(f)

    if x <= 0:
        return 0.0
    if x >= 1:
        return -math.inf
    if 1 - x < (b + 1) / (a + b + 2):
        return log_cf(1 - x, b, a)
    low = math.exp(log_cf(x, a, b))
    return math.log1p(-low) if low < 1 else -math.inf


def f_sf(f: float, d1: float, d2: float, floor: float = 1e-300) -> float:
    """Upper tail of the F distribution."""
    if not f > 0:
        return 1.0
    log = log_beta_sf(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2)
    return max(math.exp(log) if log > -700 else 0.0, floor)


def _beta_cf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """log of I_x(a, b) by the continued fraction, for x on the side where it converges fast."""
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    front = a * np.log(x) + b * np.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    c, d = np.ones_like(x), 1 / fix(1 - (a + b) * x / (a + 1))
    f = d.copy()
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / fix(1 + num * d), fix(1 + num / c)
            step = d * c
            f = f * step
        if (np.abs(step - 1) < 1e-14).all():
            break
    return front + np.log(f)


def f_sf_array(f: np.ndarray, d1: float, d2: float, floor: float = 1e-300) -> np.ndarray:
    """f_sf of many values at once."""
    f = np.asarray(f, float)
    out = np.ones(len(f))
    up = np.flatnonzero(f > 0)
    x = d1 * f[up] / (d1 * f[up] + d2)
    a, b = d1 / 2, d2 / 2
    far = 1 - x < (b + 1) / (a + b + 2)
    log = np.full(len(x), -np.inf)
    some = far & (x < 1)
    if some.any():
        log[some] = _beta_cf(1 - x[some], b, a)
    if (~far).any():
        low = np.exp(_beta_cf(x[~far], a, b))
        log[~far] = np.where(low < 1, np.log1p(-np.minimum(low, 1 - 1e-17)), -np.inf)
    out[up] = np.maximum(np.where(log > -700, np.exp(np.maximum(log, -700)), 0.0), floor)
    return out


def t_sf2(t: float, df: float) -> float:
    """Both tails of Student's t."""
    return f_sf(t * t, 1, df)


def _score_rows(first: np.ndarray, at: int, x: np.ndarray, y: np.ndarray, match: int, mismatch: int, gap: int) -> Iterator[np.ndarray]:
    """The rows of scores that follow `first`, row `at`, for the letters x."""
    steps = np.arange(len(y) + 1) * gap
    row = first
    for k, letter in enumerate(x, at + 1):
        best = np.maximum(row[:-1] + np.where(y == letter, match, mismatch), row[1:] + gap)
        # a run of gaps in a: the maximum of what it can start from
        row = (np.maximum.accumulate(np.concatenate(([k * gap], best)) - steps) + steps).astype(np.int32)
        yield row


def align(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2) -> tuple[str, str]:
    """Global alignment; ties go to the diagonal, then to a gap in b.

    Only each k-th row of scores is kept, k about the root of the length; the rows between are made again on the
    way back, so that two sequences of 100,000 letters take some 200 MB, not 40 GB."""
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode("latin-1", "replace"), np.uint8), np.frombuffer(b.encode("latin-1", "replace"), np.uint8)
    every = max(int(math.sqrt(n)), 64)
    kept = [(np.arange(m + 1) * gap).astype(np.int32)]
    for k, row in enumerate(_score_rows(kept[0], 0, x, y, match, mismatch, gap), 1):
        if k % every == 0:
            kept.append(row)
    out_a, out_b, i, j = [], [], n, m
    while i or j:
        base = max(i - 1, 0) // every * every
        score = [kept[base // every], *_score_rows(kept[base // every], base, x[base:i], y, match, mismatch, gap)]
        while (i > base or base == 0) and (i or j):
            here, above = score[i - base], score[i - base - 1] if i > base else None
            if i and j and here[j] == above[j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
                i, j = i - 1, j - 1
                out_a.append(a[i])
                out_b.append(b[j])
            elif i and here[j] == above[j] + gap:
                i -= 1
                out_a.append(a[i])
                out_b.append("-")
            else:
                j -= 1
                out_a.append("-")
                out_b.append(b[j])
    return "".join(reversed(out_a)), "".join(reversed(out_b))


def _sites(codon: str) -> tuple[float, float]:
    """Synonymous and nonsynonymous sites of a codon."""
    syn = sum(sum(CODONS[codon[:k] + x + codon[k + 1 :]] == CODONS[codon] for x in "ACGT" if x != codon[k]) / 3 for k in range(3))
    return syn, 3 - syn


SITES = {c: _sites(c) for c in CODONS}


def kaks(a: str, b: str) -> tuple[float, float, float]:
    """Ka, Ks and their ratio of two aligned coding sequences.

    Codons with anything but ACGT in either are skipped. One difference is what it does to the amino acid; two or three are
    divided as the sites of the first codon are. A ratio over a Ks of 0 is 0."""
    s = n = sd = nd = 0.0
    for k in range(0, min(len(a), len(b)) - 2, 3):
        x, y = a[k : k + 3].upper(), b[k : k + 3].upper()
        if x not in CODONS or y not in CODONS:
            continue
        (sx, nx), (sy, ny) = SITES[x], SITES[y]
        s, n = s + (sx + sy) / 2, n + (nx + ny) / 2
        diff = sum(p != q for p, q in zip(x, y))
        if diff == 1:
            same = CODONS[x] == CODONS[y]
            sd, nd = sd + same, nd + (not same)
        elif diff:
            sd, nd = sd + diff * sx / 3, nd + diff * nx / 3
    correct = lambda p: -0.75 * math.log(1 - 4 * p / 3) if p < 0.75 else p
    ka, ks = correct(nd / n if n else 0.0), correct(sd / s if s else 0.0)
    return ka, ks, ka / ks if ks > 0 else 0.0


@F.pandas_udf(_struct("ka", "ks", "ratio", kind=T.DoubleType()))
def kaks_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kaks(x, y) if x is not None and y is not None else (None, None, None) for x, y in zip(a, b)], columns=["ka", "ks", "ratio"])


@F.pandas_udf(_struct("a", "b", kind=T.StringType()))
def align_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align(x, y) if x is not None and y is not None else (None, None) for x, y in zip(a, b)], columns=["a", "b"])


def register(spark: SparkSession) -> None:
    """The kernels as SQL functions: hwe_exact, kaks, nw_align."""
    for name, f in (("hwe_exact", _hwe), ("kaks", kaks_udf), ("nw_align", align_udf)):
        spark.udf.register(name, f)
