import random
import time

from loomspan.llm import mix

DOCS = [(i, ["a"], 10) for i in range(50)] + [(100 + i, ["b"], 7) for i in range(10)] + [(200 + i, ["a", "b"], 9) for i in range(5)] + [(300, ["other"], 1000), (301, [None], 5), (302, [], 5), (303, ["a"], 0)]
GOALS = [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 5), (None, 0.3, 1)]


def _frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, sources array<string>, n_tokens long"), spark.createDataFrame(GOALS, "source string, target_share double, max_repeats int")


def test_report(spark):
    r = {x.source: x for x in mix.report(*_frames(spark)).collect()}
    total = 50 * 10 + 10 * 7 + 5 * 9
    assert r["a"].quota == round(total / 2 + 0.01) and not r["a"].short
    assert r["b"].quota == 246 and not r["b"].short and r["b"].available == 115
    assert r["c"].short and r["c"].tokens == 0


def test_selection_keeps_to_plan(spark):
    docs, goals = _frames(spark)
    size = {d: n for d, _, n in DOCS}
    most = {s: k for s, _, k in GOALS}
    rows = mix.select(docs, goals, 3).collect()
    assert all(1 <= r.copies <= most[r.source] for r in rows)
    got = {s: sum(r.copies * size[r.doc_id] for r in rows if r.source == s) for s in "ab"}
    assert abs(got["a"] - 308) <= 20 and abs(got["b"] - 246) <= 20
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix.select(docs, goals, 3).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, mix.select(docs, goals, 4).collect()))


def test_flow_is_cheapest():
    # b alone can fill b; the shared documents are used once before any is used twice
    flow = mix.route([(("a",), 10), (("a", "b"), 10), (("b",), 10)], [mix.Target("a", 0.5, 2), mix.Target("b", 0.5, 2)], 30)
    assert flow[("a",), "a"] == 10 and flow[("b",), "b"] == 10 and flow[("a", "b"), "a"] == flow[("a", "b"), "b"] == 5


def test_empty(spark):
    docs, goals = _frames(spark)
    assert {r.source: (r.tokens, r.short) for r in mix.report(docs.limit(0), goals).collect()} == {s: (0, False) for s in "abc"}
    assert mix.select(docs.limit(0), goals).count() == 0 and mix.report(docs, goals.limit(0)).count() == 0


def _plain_cost(edges, n, s, t):
    """Flow and cost by one cheapest path at a time."""
    graph = [[a, b, c, w] for a, b, c, w in edges] + [[b, a, 0, -w] for a, b, _, w in edges]
    flow = cost = 0
    while True:
        dist, came = [float("inf")] * n, [None] * n
        dist[s] = 0
        for _ in range(n):
            for k, (a, b, c, w) in enumerate(graph):
                if c and dist[a] + w < dist[b]:
                    dist[b], came[b] = dist[a] + w, k
        if came[t] is None:
            return flow, cost
        path, x = [], t
        while x != s:
            path.append(came[x])
            x = graph[came[x]][0]
        most = min(graph[k][2] for k in path)
        for k in path:
            graph[k][2] -= most
            graph[(k + len(edges)) % len(graph)][2] += most
        flow, cost = flow + most, cost + most * dist[t]


def test_flow_against_path_by_path():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(4, 9)
        edges = [(a, b, rng.randint(0, 12), rng.randint(0, 4)) for a in range(n - 1) for b in range(1, n) if a != b and rng.random() < 0.5]
        f = mix.Flow(n)
        at = [f.edge(*e) for e in edges]
        f.run(0, n - 1)
        used = [f.used(e) for e in at]
        out = sum(u for u, e in zip(used, edges) if e[0] == 0) - sum(u for u, e in zip(used, edges) if e[1] == 0)
        assert (out, sum(u * e[3] for u, e in zip(used, edges))) == _plain_cost(edges, n, 0, n - 1)


def test_many_patterns_and_repeats():
    """All sets of 12 sources, a million repeats: some seconds at most, and no quota is short that could be filled."""
    names = [f"s{i:02d}" for i in range(12)]
    patterns = [(tuple(x for i, x in enumerate(names) if k >> i & 1), 50 + k % 37) for k in range(1, 1 << 12)]
    targets = [mix.Target(x, 0.02 * (i + 1), 10**6 if i % 2 else 1) for i, x in enumerate(names)]
    total, began = sum(n for _, n in patterns), time.time()
    flow = mix.route(patterns, targets, total)
    assert time.time() - began < 60
    for t in targets:
        assert sum(v for (_, s), v in flow.items() if s == t.source) == mix.quota(t, total)
    assert mix.levels(3) == [(1, 0), (1, 1), (1, 2)] and sum(n for n, _ in mix.levels(10**6)) == 10**6 and len(mix.levels(10**6)) < 40
