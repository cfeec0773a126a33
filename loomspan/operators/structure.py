"""Population structure: matrices of samples are summed by all tasks, decomposed and clustered on the driver.

The driver only ever holds matrices of samples by samples or samples by components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import tree_sum
from .dosage import MOST_SAMPLES
from .fill import dense



def _gram(sites: DataFrame, kernel: object, n: int, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The sum of kernel(x) over all sites; x is a batch of sites by samples. The tasks' sums are added in levels; the driver gets one of each row."""
    if n > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, e = np.zeros((n, n)), np.zeros(max(extra, 1))
        for batch in batches:
            if batch.num_rows:
                a, b = kernel(dense(batch.column(0)))
                g += a
                e += b
        # the last row is `extra`
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1, dtype=np.int32)), pa.array([*(r.tobytes() for r in g), e.tobytes()])], names=["i", "row"])

    dosages = sites.select("d")
    parts = dosages.mapInArrow(run, "i int, row binary")
    rows = tree_sum(parts, ["i"], ["row"]).orderBy("i").collect()
    if not rows:
        return np.zeros((n, n)), np.zeros(max(extra, 1))
    return np.array([np.frombuffer(r.row) for r in rows[:-1]]).reshape(n, n), np.frombuffer(rows[-1].row)


def sample_count(sites: DataFrame) -> int:
    return sites.agg(F.max(F.size("d"))).first()[0] or 0


def pca_sites(sites: DataFrame, ploidy: int, min_maf: float = 0.05, max_missing: float = 0.2) -> DataFrame:
    """The sites that a decomposition uses; d counts copies of the alternate."""
    held = F.filter("d", lambda x: x.isNotNull())
    f = F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / (F.size(held) * float(ploidy))
    return sites.filter((F.size(held) > 0) & (1 - F.size(held) / F.size("d") <= max_missing) & (F.least(f, 1 - f) >= min_maf))


def _filled(x: np.ndarray) -> np.ndarray:
    mean = np.nanmean(x, 1, keepdims=True)
    return np.where(np.isnan(x), mean, x)


def kinship(sites: DataFrame, ploidy: int) -> np.ndarray:
    """Sum of centred products over the sum of ploidy f (1 - f)."""
    def kernel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = _filled(x)
        f = x.mean(1, keepdims=True) / ploidy
        z = x - ploidy * f
        return z.T @ z, np.array([(ploidy * f * (1 - f)).sum()])

    g, scale = _gram(sites, kernel, sample_count(sites))
    return g / (scale[0] + 1e-10)


def matrix_pairs(spark: SparkSession, m: np.ndarray, diagonal: bool = False) -> DataFrame:
    i, j = np.triu_indices(len(m), 0 if diagonal else 1)
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), m[i, j].tolist())), "i int, j int, value double")


def pca(sites: DataFrame, ploidy: int, n_pcs: int = 10, fast: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Components (samples by n_pcs, scaled) and their shares of the variance, by the eigenvectors of the samples' Gram matrix: exact, whatever the number of sites. Signs are such that the largest entry of each is positive. fast: shares are of the n_pcs + 5 greatest eigenvalues only, as a truncated decomposition has them."""
    def kernel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = _filled(x)
        f = x.mean(1, keepdims=True) / ploidy
        sd = np.sqrt(ploidy * f * (1 - f))
        z = (x - ploidy * f) / np.where(sd > 0, sd, 1)
        return z.T @ z, np.zeros(1)

    g, _ = _gram(sites, kernel, sample_count(sites))
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)[:n_pcs]
    pcs = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    pcs *= np.where(pcs[np.abs(pcs).argmax(0), np.arange(pcs.shape[1])] < 0, -1, 1)
    whole = np.sort(np.maximum(values, 0))[::-1][: n_pcs + 5 if fast else None].sum()
    return pcs, np.maximum(values[order], 0) / max(whole, 1e-12)


def kmeans(x: np.ndarray, k: int, rounds: int = 100, seed: int = 42) -> tuple[np.ndarray, float]:
    """Labels and the sum of squares within; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centre = x[rng.integers(0, len(x), k)].copy()
    for _ in range(rounds):
        of = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        for c in range(k):
            if (of == c).any():
                centre[c] = x[of == c].mean(0)
    of = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
    return of, float(((x - centre[of]) ** 2).sum())


def elbow(x: np.ndarray, most: int = 9) -> int:
    """The last k whose gain over k - 1 is more than a tenth of the whole."""
    w = [kmeans(x, k, 50)[1] for k in range(1, min(most, len(x)) + 1)]
    return max([k for k in range(2, len(w) + 1) if w[0] > 0 and (w[k - 2] - w[k - 1]) / w[0] > 0.1], default=1)


def dbscan(x: np.ndarray, share: float = 0.05, least: int = 3) -> np.ndarray:
    """Labels, -1 for noise; the radius is that share's quantile of all pair distances, and `least` counts the point itself."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pairs = np.sort(d[np.triu_indices(len(x), 1)])
    eps = pairs[int(share * len(pairs))] if len(pairs) else 0.0
    near = d <= eps
    core, label, c = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                p = stack.pop()
                if label[p] < 0:
                    label[p] = c
                    if core[p]:
                        stack += np.flatnonzero(near[p] & (label < 0)).tolist()
            c += 1
    return label


def gmm(x: np.ndarray, k: int, rounds: int = 50, seed: int = 42, floor: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Labels and responsibilities of a diagonal mixture."""
    rng = np.random.default_rng(seed)
    mean = x[rng.integers(0, len(x), k)].copy()
    var, weight = np.tile(np.maximum(x.var(0), floor), (k, 1)), np.full(k, 1 / k)
    for _ in range(rounds):
        log = np.log(weight + 1e-300) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((x[:, None] - mean) ** 2 / var).sum(2))
        r = np.exp(log - log.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        n = r.sum(0) + 1e-12
        mean = (r.T @ x) / n[:, None]
        var = np.maximum((r.T @ (x * x)) / n[:, None] - mean * mean, floor)
        weight = n / len(x)
    return r.argmax(1), r


def dapc(pcs: np.ndarray, label: np.ndarray, most: int = 30) -> np.ndarray:
    """Discriminant axes of the cluster means (not centred), as many as clusters less one."""
    x = pcs[:, :most]
    groups = np.unique(label)
    means = np.array([x[label == g].mean(0) for g in groups])
    _, _, vt = np.linalg.svd(means, full_matrices=False)
    return x @ vt[: max(len(groups) - 1, 1)].T


def upgma(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of average linkage; merge k makes node n + k."""
    n = len(d)
    m = d.astype(float).copy()
    np.fill_diagonal(m, np.inf)
    node, size, out = list(range(n)), [1] * n, []
    alive = np.ones(n, bool)
    for k in range(n - 1):
        i, j = divmod(int(m.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((node[i], node[j], float(m[i, j]) / 2, size[i] + size[j]))
        row = (m[i] * size[i] + m[j] * size[j]) / (size[i] + size[j])
        m[i], m[:, i] = row, row
        m[i, i] = np.inf
        m[j], m[:, j] = np.inf, np.inf
        m[i, ~alive] = m[~alive, i] = np.inf
        alive[j] = False
        m[i, j] = m[j, i] = np.inf
        node[i], size[i] = n + k, size[i] + size[j]
    return out


def segments(merges: list[tuple[int, int, float, int]], n: int) -> list[tuple[float, float, float, float]]:
    """The lines (x0, y0, x1, y1) of the dendrogram; leaves stand in the order of the tree."""
    kids = {n + k: (a, b) for k, (a, b, _, _) in enumerate(merges)}
    order, stack = [], [n + len(merges) - 1] if merges else list(range(n))
    while stack:
        x = stack.pop()
        if x in kids:
            stack += [kids[x][1], kids[x][0]]
        else:
            order.append(x)
    place = {x: (float(i), 0.0) for i, x in enumerate(order)}
    out = []
    for k, (a, b, h, _) in enumerate(merges):
        (xa, ya), (xb, yb) = place[a], place[b]
        out += [(xa, ya, xa, h), (xb, yb, xb, h), (xa, h, xb, h)]
        place[n + k] = ((xa + xb) / 2, h)
    return out


def neighbour_joining(d: np.ndarray, labels: list[str]) -> str:
    """The tree in Newick form; branch lengths are not negative, the last pair's second is 0."""
    m, names = np.array(d, float), list(labels)
    if not names:
        return ";"
    if len(names) == 1:
        return f"{names[0]};"
    while len(names) > 2:
        n, r = len(names), m.sum(1)
        q = (n - 2) * m - r[:, None] - r[None]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(q.argmin()), n)
        i, j = min(i, j), max(i, j)
        a = max(0.0, m[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2)))
        b = max(0.0, m[i, j] - a)
        row = np.maximum((m[i] + m[j] - m[i, j]) / 2, 0)
        names[i] = f"({names[i]}:{a:.6f},{names[j]}:{b:.6f})"
        m[i], m[:, i], m[i, i] = row, row, 0
        m = np.delete(np.delete(m, j, 0), j, 1)
        names.pop(j)
    return f"({names[0]}:{max(m[0, 1], 0):.6f},{names[1]}:0.000000);"


def parse_newick(text: str) -> list[tuple[int, int, str, float]]:
    """Nodes (node, parent, name, length); the root has parent -1."""
    nodes, stack, at, cur = [[-1, "", 0.0]], [0], 0, 0
    while at < len(text) and text[at] != ";":
        ch = text[at]
        if ch in "(,":
            if ch == "(":
                stack.append(cur)
            nodes.append([stack[-1], "", 0.0])
            cur, at = len(nodes) - 1, at + 1
        elif ch == ")":
            cur, at = stack.pop(), at + 1
        else:
            end = at
            while end < len(text) and text[end] not in "(),;":
                end += 1
            name, _, length = text[at:end].partition(":")
            nodes[cur][1], nodes[cur][2] = name.strip() or nodes[cur][1], float(length) if length else nodes[cur][2]
            at = end
    return [(i, p, n, x) for i, (p, n, x) in enumerate(nodes)]


def cut_tree(nodes: list[tuple[int, int, str, float]], threshold: float) -> dict[str, int]:
    """Group of each leaf: a group begins at the first node of a path whose distance from the root reaches the threshold."""
    depth, group, out, k = {}, {}, {}, 0
    parents = {p for _, p, _, _ in nodes}
    for i, p, name, x in nodes:
        depth[i] = depth.get(p, 0.0) + (x if p >= 0 else 0.0)
        group[i] = group.get(p, -1)
        if group[i] < 0 and depth[i] >= threshold:
            group[i], k = k, k + 1
        if i not in parents:
            out[name] = group[i]
    return out


@dataclass
class Structure:
    """What an analysis of structure gives; arrays are over the samples."""

    pcs: np.ndarray
    explained: np.ndarray
    kmeans: np.ndarray
    dbscan: np.ndarray
    gmm: np.ndarray
    ancestry: np.ndarray
    discriminants: np.ndarray
    kinship: np.ndarray
    tree: list = field(default_factory=list)


def analyse(sites: DataFrame, ploidy: int, n_pcs: int = 10, min_maf: float = 0.05, max_missing: float = 0.2, fast: bool = False) -> Structure:
    """Everything at once; d counts copies. Two sites or more must pass."""
    used = pca_sites(sites, ploidy, min_maf, max_missing).persist()
    try:
        if used.limit(2).count() < 2:
            raise ValueError("fewer than two sites pass")
        pcs, explained = pca(used, ploidy, n_pcs, fast)
        k = elbow(pcs)
        label, _ = kmeans(pcs, k)
        mixed, r = gmm(pcs[:, :3], k)
        d = np.sqrt(((pcs[:, None] - pcs[None]) ** 2).sum(2))
        return Structure(pcs, explained, label, dbscan(pcs), mixed, r, dapc(pcs, label), kinship(used, ploidy), upgma(d))
    finally:
        used.unpersist()


def table(spark: SparkSession, s: Structure, samples: list[str]) -> DataFrame:
    """One row per sample: clusters (from 1; 0 is noise), components, discriminants, ancestry."""
    rows = [(n, int(s.kmeans[i]) + 1, int(s.dbscan[i]) + 1, int(s.gmm[i]) + 1, s.pcs[i].tolist(), s.discriminants[i].tolist(), s.ancestry[i].tolist()) for i, n in enumerate(samples)]
    return spark.createDataFrame(rows, "sample string, kmeans int, dbscan int, gmm int, pcs array<double>, lds array<double>, ancestry array<double>")
