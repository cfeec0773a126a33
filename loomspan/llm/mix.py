"""Mixing sources to target weights as a min-cost flow from documents to sources.

Documents are summed by the set of sources that have them (their pattern). A pattern's tokens flow to the
quotas of its sources; using a pattern once costs nothing, twice one a token, and so on, so repetition
is spread as far as the quotas allow. (From the 16th time on, the cost of a token grows with each doubling, so
that a pattern has few edges however often it may be repeated.) What flows is then taken from the documents in seeded order.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..runtime import cut, small

#: Most sources with a target, and most patterns of them, that the flow is solved for on the driver.
MOST_SOURCES, MOST_PATTERNS = 10_000, 65_536
#: Parts of a pattern's seeded order whose sums are known before the documents in them are.
SLOTS = 4096


@dataclass
class Target:
    source: str
    share: float
    max_repeats: int


class Flow:
    """A min-cost flow; costs are whole and not negative at first.

    All cheapest paths of one cost are filled at once: with the nodes' distances as potentials, a blocking flow
    runs over the edges that lie on such paths. There are as many rounds as different costs of paths, which are few."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def used(self, edge: int) -> int:
        return self.left[edge ^ 1]

    def _distances(self, s: int) -> list[float]:
        dist, queue, waits = [math.inf] * len(self.out), deque([s]), {s}
        dist[s] = 0
        while queue:
            x = queue.popleft()
            waits.discard(x)
            for e in self.out[x]:
                y = self.to[e]
                if self.left[e] and dist[x] + self.cost[e] < dist[y]:
                    dist[y] = dist[x] + self.cost[e]
                    if y not in waits:
                        waits.add(y)
                        queue.append(y)
        return dist

    def _levels(self, s: int, dist: list[float]) -> list[int]:
        """Steps from s over the edges of cheapest paths, -1 for what they don't reach."""
        level, queue = [-1] * len(self.out), deque([s])
        level[s] = 0
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                y = self.to[e]
                if self.left[e] and level[y] < 0 and dist[x] + self.cost[e] == dist[y]:
                    level[y] = level[x] + 1
                    queue.append(y)
        return level

    def run(self, s: int, t: int) -> None:
        while True:
            dist = self._distances(s)
            if dist[t] == math.inf:
                return
            while (level := self._levels(s, dist))[t] >= 0:
                self._block(s, t, dist, level)

    def _block(self, s: int, t: int, dist: list[float], level: list[int]) -> None:
        """Fill paths of one step of level each until none is left; an edge that leads nowhere isn't tried again."""
        next_, path, x = [0] * len(self.out), [], s
        while True:
            if x == t:
                most = min(self.left[e] for e in path)
                for e in path:
                    self.left[e] -= most
                    self.left[e ^ 1] += most
                first = next(i for i, e in enumerate(path) if not self.left[e])
                x, path = self.to[path[first] ^ 1], path[:first]
                continue
            while next_[x] < len(self.out[x]):
                e = self.out[x][next_[x]]
                y = self.to[e]
                if self.left[e] and level[y] == level[x] + 1 and dist[x] + self.cost[e] == dist[y]:
                    path.append(e)
                    x = y
                    break
                next_[x] += 1
            else:
                if x == s:
                    return
                x = self.to[path.pop() ^ 1]
                next_[x] += 1


def levels(repeats: int) -> list[tuple[int, int]]:
    """(times, cost of a token) of using a pattern `repeats` times: each of the first 16 costs one more, then those of a doubling cost the same."""
    out, at, width, cost = [], 0, 1, 0
    while at < repeats:
        take = min(width, repeats - at)
        out.append((take, cost))
        at, cost = at + take, cost + 1
        width = at if at >= 16 else 1
    return out


def route(patterns: list[tuple[tuple[str, ...], int]], targets: list[Target], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens from each (pattern, source); patterns: sources and tokens of their documents, once each."""
    place = {t.source: i for i, t in enumerate(targets)}
    n, m = len(patterns), len(targets)
    flow, s, t = Flow(n + m + 2), n + m, n + m + 1
    pipes = {}
    for i, (names, size) in enumerate(patterns):
        mine = [targets[place[x]] for x in names]
        for times, cost in levels(max((x.max_repeats for x in mine), default=0)):
            flow.edge(s, i, size * times, cost)
        for x in mine:
            pipes[names, x.source] = flow.edge(i, n + place[x.source], size * max(x.max_repeats, 0))
    for i, x in enumerate(targets):
        flow.edge(n + i, t, quota(x, total))
    flow.run(s, t)
    return {k: flow.used(e) for k, e in pipes.items()}


def quota(target: Target, total: int) -> int:
    """The tokens that a source shall have."""
    return max(0, math.ceil(target.share * total - 1e-6))


def _targets(targets: DataFrame) -> list[Target]:
    rows = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    return sorted((Target(r.source, float(r.share or 0), int(r.max_repeats or 0)) for r in rows), key=lambda x: x.source)


def plan(docs: DataFrame, targets: DataFrame) -> tuple[list[Target], dict, dict, int]:
    """Targets, tokens by pattern, the flow, and the total. docs: doc_id, sources (an array), n_tokens."""
    goals = _targets(targets)
    names = F.array_sort(F.array_distinct(F.filter("sources", lambda s: s.isin([t.source for t in goals]))))
    sums = docs.select(names.alias("names"), "n_tokens").filter(F.size("names") > 0).groupBy("names").agg(F.sum("n_tokens").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"documents have more than {MOST_PATTERNS} sets of sources")
    sizes = {tuple(r.names): int(r.n or 0) for r in sums}
    total = sum(sizes.values())
    return goals, sizes, route(sorted(sizes.items()), goals, total), total


def report(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, quota, available, max_repeats, short) of each source with a target.

    docs: doc_id, sources array<string>, n_tokens; documents with no source that has a target don't count,
    nor do null sources. The total is that of the documents that count, once each. short: the quota can't be filled. Targets given twice
    count by their greatest values; without documents every actual share is 0 and no quota is short."""
    goals, sizes, flow, total = plan(docs, targets)
    got = {t.source: sum(v for (_, s), v in flow.items() if s == t.source) for t in goals}
    all_ = sum(got.values())
    rows = [(t.source, t.share, got[t.source] / all_ if all_ else 0.0, got[t.source], quota(t, total), sum(n for names, n in sizes.items() if t.source in names), t.max_repeats, got[t.source] < quota(t, total)) for t in goals]
    return docs.sparkSession.createDataFrame(rows, "source string, target_share double, actual_share double, tokens long, quota long, available long, max_repeats int, short boolean")


def select(docs: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, copies): how often each document is used for each source; documents not used are left out.

    A pattern's documents are put in seeded order, end to end and round again; each of its sources takes the
    stretch that flows to it, and a document is used as often as its middle lies in the stretch, so no more
    often than max_repeats."""
    goals, sizes, flow, _ = plan(docs, targets)
    docs = cut(docs.select("doc_id", F.array_sort(F.array_distinct(F.filter("sources", lambda s: s.isin([t.source for t in goals])))).alias("names"), "n_tokens").filter("size(names) > 0 and n_tokens > 0"))
    stretches, at = [], {}
    for (names, source), n in sorted(flow.items()):
        if n:
            start = at.get(names, 0)
            stretches.append((list(names), source, start, start + n, sizes[names]))
            at[names] = (start + n) % sizes[names]
    schema = T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("source", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("start", "stop", "size"))])
    stretches = docs.sparkSession.createDataFrame(stretches, schema)
    key = F.xxhash64("doc_id", F.lit(seed))
    docs = docs.withColumn("key", key).withColumn("slot", F.pmod(F.shiftright("key", 32), F.lit(SLOTS)).cast("int"))
    ahead = docs.groupBy("names", "slot").agg(F.sum("n_tokens").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(W.Window.partitionBy("names").orderBy("slot").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("n_tokens").over(W.Window.partitionBy("names", "slot").orderBy("key", "doc_id").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    placed = docs.withColumn("inside", inside).join(small(ahead), ["names", "slot"]).withColumn("middle", F.col("ahead") + F.col("inside") + F.floor(F.col("n_tokens") / 2))
    rows = placed.join(small(stretches), "names")
    # the whole numbers m with start <= middle + m * size < stop
    copies = F.ceil((F.col("stop") - F.col("middle")) / F.col("size")) - F.ceil((F.col("start") - F.col("middle")) / F.col("size"))
    return rows.select("doc_id", "source", copies.cast("int").alias("copies")).filter("copies > 0")
