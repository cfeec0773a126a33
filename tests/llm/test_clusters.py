import math

import numpy as np

from loomspan.llm import clusters


def linked(x, width):
    near = (np.abs(x[:, None] - x[None]).max(2) <= width + 1e-9)
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            return label
        label = new


def average(x, width, least):
    """Average linkage, one best pair at a time; pairs that aren't alike count as 0."""
    d = np.abs(x[:, None] - x[None]).max(2)
    sim = np.where(d <= width + 1e-9, 1 - d / width / 2, 0)
    groups = {}
    cell = np.floor(x / width + 1e-9).astype(int)
    for i, c in enumerate(map(tuple, cell)):
        groups.setdefault(c, []).append(i)
    groups = {v[0]: v for v in groups.values()}
    while True:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    s = round(float(sim[np.ix_(groups[a], groups[b])].mean()), 9)
                    if s >= least and s > 0 and (best is None or (-s, a, b) < best):
                        best = (-s, a, b)
        if best is None:
            return {i: k for k, v in groups.items() for i in v}
        groups[best[1]] += groups.pop(best[2])


def frame(spark, x, run="r"):
    return spark.createDataFrame([(i, run, [float(v) for v in r], "z") for i, r in enumerate(x)], "id long, run string, v array<double>, cluster string").drop("cluster")


def test_both_linkages_on_both_ways(spark):
    x = np.random.default_rng(4).random((90, 2)) * 0.6
    components, tree = linked(x, 0.06), average(x, 0.06, 0.25)
    for part_links in (100_000, 0):  # one task for the part; rounds over all tasks
        a = {r.id: r.cluster for r in clusters.cluster(frame(spark, x), "id", ["run"], "v", 0.06, "ignore", 0.0, part_links).collect()}
        assert [a[i] for i in range(len(x))] == components.tolist()
        b = {r.id: r.cluster for r in clusters.cluster(frame(spark, x), "id", ["run"], "v", 0.06, "zero", 0.25, part_links).collect()}
        assert b == tree


def test_edge_cases(spark):
    rows = [(1, "a", [0.1, 0.9]), (1, "a", [0.1, 0.9]), (2, "a", [0.1, 0.9]), (3, "b", [0.1, 0.9]), (4, "a", [0.1]), (5, "a", None), (6, "a", []), (7, "a", [math.nan, 0.1]), (8, "a", [None, 0.1]), (9, None, [0.1, 0.9]), (10, None, [0.1, 0.9]), (None, "a", [0.1, 0.9]), (11, "a", [0.5, 0.5])]
    df = spark.createDataFrame(rows, "id long, run string, v array<double>")
    got = {r.id: r.cluster for r in clusters.cluster(df, "id", ["run"], "v", 0.06).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 9: 9, 10: 9, 11: 11}
    assert clusters.cluster(df.limit(0), "id", ["run"], "v", 0.06).count() == 0


def test_description(spark):
    df = spark.createDataFrame([(1, [0.0], "a", 1), (2, [0.1], "b", 2), (3, [0.05], "c", 2), (4, [9.0], "d", None)], "id long, v array<double>, name string, g int")
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, cluster long")
    got = {r.cluster: (r.size, r.typical, r.given) for r in clusters.describe(df, "id", "v", "name", "g", c, 2).collect()}
    assert got == {1: (3, ["c", "a"], 2), 4: (1, ["d"], None)}


def test_dense_cells_by_blocks(spark, monkeypatch):
    """A cell with most records: the links are those that are counted pair by pair."""
    monkeypatch.setattr(clusters, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = np.concatenate((0.12 + 0.06 * rng.random((150, 3)), 0.06 + 0.3 * rng.random((100, 3))))
    points = frame(spark, x).withColumnRenamed("run", "part")
    key = lambda t: {(r.a, r.b): (r.n, round(r.s, 9)) for r in t.collect()}
    plain, blocks, mixed = (key(clusters.links(points, 0.06, d)[1]) for d in (10**9, 0, 200))
    assert len(plain) > 50 and blocks == plain and mixed == plain
    cell = [tuple(c) for c in np.floor(x / 0.06 + 1e-9).astype(int)]
    near = np.abs(x[:, None] - x[None]).max(2) <= 0.06 + 1e-9
    assert sum(n for n, _ in plain.values()) == sum(near[i, j] for i in range(len(x)) for j in range(i) if cell[i] != cell[j])
