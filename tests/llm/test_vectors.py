import math

import numpy as np
import pytest

from loomspan.llm import vectors


def brute(ids, x, k, most, least):
    out = {}
    for i in range(len(ids)):
        gap = np.abs(x - x[i])
        both = ~np.isnan(gap)
        n = both.sum(1)
        d = np.where(n >= least, np.where(both, gap, 0).sum(1) / np.maximum(n, 1), np.inf)
        d[i] = np.inf
        order = np.lexsort((ids, np.round(d, 9)))[:k]
        out[ids[i]] = [ids[j] for j in order if d[j] <= most]
    return out


def families(rng, n, size, noise, width=64, holes=0.06):
    base = rng.beta(0.4, 0.4, (n, width)).repeat(size, 0)
    x = np.clip(base + rng.normal(0, noise, base.shape), 0, 1)
    x[rng.random(x.shape) < holes] = np.nan
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r], "x") for i, r in enumerate(x)], "id long, v array<double>, distance string")


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id_a, []).append((round(r.distance, 9), r.id_b))
    return {k: [b for _, b in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("hot", [4096, 6])  # whole buckets, and nearly all buckets searched in blocks
def test_recall(spark, hot):
    x = families(np.random.default_rng(1), 150, 6, 0.03)
    want = brute(np.arange(len(x)), x, 4, 0.08, 32)
    have = got(vectors.similar_vectors(frame(spark, x), "id", "v", 4, 0.08, 0.0, 1.0, 32, hot_bucket=hot))
    total = sum(map(len, want.values()))
    assert total > 2000 and sum(len(set(want[i]) & set(have.get(i, []))) for i in want) / total >= 0.97


def test_copies_ties_and_dirt(spark):
    rng = np.random.default_rng(2)
    one, two = rng.random(8), rng.random(8)
    rows = [(i, one.tolist()) for i in range(40)] + [(100 + i, (one * 0.99).tolist()) for i in range(3)] + [(200, two.tolist()), (200, two.tolist()), (300, None), (301, []), (302, [math.nan] * 8), (303, [-1.0] * 8), (None, one.tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    have = got(vectors.similar_vectors(df, "id", "v", 3, 0.05, 0.0, 1.0, 4))
    assert have[0] == [1, 2, 3] and have[2] == [0, 1, 3] and have[39] == [0, 1, 2] and have[101] == [100, 102, 0]
    assert not {200, 300, 301, 302, 303} & set(have)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert vectors.similar_vectors(df, "id", "v").count() == 0


def test_vectors_are_never_broadcast(spark):
    """However small the tables are: joins of vectors are sorted and merged."""
    x = families(np.random.default_rng(3), 30, 3, 0.03)
    df = vectors.similar_vectors(frame(spark, x), "id", "v", 2, 0.08, 0.0, 1.0, 32)
    assert df.count() > 50
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "Broadcast" not in plan


def test_sparse_rows_and_any_range(spark):
    """Rows with many missing elements are found, too, and values needn't lie between 0 and 1."""
    rng = np.random.default_rng(4)
    x = families(rng, 80, 5, 0.02) * 1000 - 300
    x[::5][rng.random((80, 64)) < 0.3] = np.nan
    want = brute(np.arange(len(x)), x, 3, 60.0, 20)
    have = got(vectors.similar_vectors(frame(spark, x), "id", "v", 3, 60.0, least=20))
    total = sum(map(len, want.values()))
    assert total > 900 and sum(len(set(want[i]) & set(have.get(i, []))) for i in want) / total >= 0.97
