"""Grouping records into clusters: average linkage by reciprocal nearest neighbours on a sparse graph.

Records of one part are alike when no component differs by more than a width. Records in one cell of
that width are alike at once and start as one node; the graph has the links between nodes. In each round all
pairs of nodes that are each other's best link merge, until no link is left (or none is similar enough).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import cut, release, small

#: Links of one part up to which one task merges them; a part with more is merged by all tasks, round by round.
PART_LINKS = 200_000
#: Pairs of records between two cells from which they are counted by blocks, and records of a block.
DENSE, BLOCK = 1 << 20, 1024
_EPS = 1e-9


def _cells(points: DataFrame, width: float) -> DataFrame:
    """points (part, id, v) with `cell`, the coordinates of its cell."""
    coord = F.transform("v", lambda x: F.floor(x / width + _EPS).cast("int"))
    return points.withColumn("cell", coord)


def links(points: DataFrame, width: float, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """The nodes (part, cell, node, size) and links (part, a, b, n, s) of the graph; a < b.

    node: the least id in the cell. n: the alike pairs between two nodes, s: the sum of their similarities,
    1 - (greatest difference of a component) / width / 2. Pairs are sought between cells whose coordinates
    differ by one at most, through blocks of three coordinates, and are counted where they are made; between two
    cells with more than `dense` of them, by blocks of records whose places are within reach, a task for each two."""
    placed = cut(_cells(points, width))
    box = placed.groupBy("part", "cell").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size"))
    nodes = cut(box)
    head = F.slice("cell", 1, 3)
    here = nodes.select("part", "cell", "node", "size", head.alias("at"))
    step = F.array(*(F.lit(x) for x in (-1, 0, 1)))
    around = F.flatten(F.transform(step, lambda x: F.flatten(F.transform(step, lambda y: F.transform(step, lambda z: F.array(x, y, z))))))
    # short vectors have fewer coordinates: the shifts are cut to their length
    shifts = F.array_distinct(F.transform(around, lambda s: F.slice(s, 1, F.size("at"))))
    asks = here.select("part", F.col("cell").alias("cell_a"), F.col("node").alias("a"), F.col("size").alias("size_a"), F.explode(F.transform(shifts, lambda s: F.zip_with("at", s, lambda x, y: x + y))).alias("at"))
    near = asks.join(here.select("part", "at", F.col("cell").alias("cell_b"), F.col("node").alias("b"), F.col("size").alias("size_b")), ["part", "at"]).filter(F.col("a") < F.col("b"))
    near = near.filter(F.forall(F.zip_with("cell_a", "cell_b", lambda x, y: F.abs(x - y)), lambda d: d <= 1)).select("part", "cell_a", "cell_b", "a", "b", (F.col("size_a") * F.col("size_b") > dense).alias("heavy"))
    many = not nodes.filter(F.col("size") * F.col("size") > dense).isEmpty()
    thin = near.filter(~F.col("heavy")) if many else near  # one of two cells with so many pairs is that large itself
    left, right = (placed.select("part", F.col("cell").alias(f"cell_{x}"), F.col("v").alias(f"v_{x}")) for x in "ab")
    gap = F.array_max(F.zip_with("v_a", "v_b", lambda x, y: F.abs(x - y)))
    pairs = thin.join(left, ["part", "cell_a"]).join(right, ["part", "cell_b"]).select("part", "a", "b", gap.alias("gap")).filter(F.col("gap") <= width + _EPS)
    found = pairs.groupBy("part", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("gap") / width / 2).alias("s"))
    if many:
        found = found.unionByName(_dense_links(placed, nodes, cut(near.filter("heavy").drop("heavy")), width))
    return nodes, found


def _dense_links(placed: DataFrame, nodes: DataFrame, near: DataFrame, width: float) -> DataFrame:
    """(part, a, b, n, s) of the pairs of cells `near` (part, cell_a, cell_b, a, b), counted between blocks of their records.

    A cell's records are divided by finer cells, and those of one finer cell by chance, into blocks of about
    BLOCK; only blocks whose boxes are within reach are compared, each two in a row of its own."""
    ends = [near.select("part", F.col(f"cell_{x}").alias("cell")) for x in "ab"]
    rows = placed.join(ends[0].unionByName(ends[1]).distinct(), ["part", "cell"]).select("part", "cell", "id", "v", F.transform(F.slice("v", 1, 3), lambda x: F.floor(x / width * 4)).alias("fine"))
    key = ["part", "cell", "fine"]
    sizes = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.v.tolist(), float)
        return pd.DataFrame({"part": [pdf.part.iloc[0]], "cell": [pdf.cell.iloc[0]], "dims": [x.shape[1]], "low": [x.min(0).tolist()], "high": [x.max(0).tolist()], "rows": [x.tobytes()]})

    blocks = rows.groupBy(*key, "block").applyInPandas(pack, f"part string, cell {dict(nodes.dtypes)['cell']}, dims int, low array<double>, high array<double>, rows binary")
    blocks = cut(blocks.withColumn("no", F.monotonically_increasing_id()))
    box = lambda x: blocks.select("part", F.col("cell").alias(f"cell_{x}"), F.col("no").alias(f"no_{x}"), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))
    apart = lambda p, q: F.exists(F.zip_with(p, q, lambda x, y: x - y), lambda d: d > width + _EPS)
    two = near.join(box("a"), ["part", "cell_a"]).join(box("b"), ["part", "cell_b"]).filter(~apart("low_a", "high_b") & ~apart("low_b", "high_a"))
    held = lambda x: blocks.select(F.col("no").alias(f"no_{x}"), F.col("dims").alias(f"dims_{x}"), F.col("rows").alias(f"rows_{x}")).hint("merge")
    two = two.select("part", "a", "b", "no_a", "no_b").join(held("a"), "no_a").join(held("b"), "no_b").select("part", "a", "b", "dims_a", "rows_a", "rows_b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s = [], []
            for dims, p, q in zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                x, y = (np.frombuffer(r.as_buffer()).reshape(-1, dims) for r in (p, q))
                gap = np.zeros((len(x), len(y)))
                for i in range(dims):
                    np.maximum(gap, np.abs(x[:, i, None] - y[None, :, i]), out=gap)
                gap = gap[gap <= width + _EPS]
                n.append(len(gap))
                s.append(float((1 - gap / width / 2).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(s, pa.float64())], names=["part", "a", "b", "n", "s"])

    kind = dict(nodes.dtypes)["node"]
    out = two.mapInArrow(count, f"part string, a {kind}, b {kind}, n long, s double")
    return out.groupBy("part", "a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > 0")


def _similarity(missing: str) -> Column:
    whole = F.col("s") / F.col("n") if missing == "ignore" else F.col("s") / (F.col("size_a") * F.col("size_b"))
    return F.round(whole, 9)


def merge_part(edges: pd.DataFrame, sizes: dict, missing: str, least: float) -> dict:
    """Cluster of each node of one part: rounds of merging all reciprocal best pairs."""
    graph: dict = {}
    for a, b, n, s in zip(edges.a, edges.b, edges.n, edges.s):
        graph.setdefault(a, {})[b] = graph.setdefault(b, {})[a] = (n, s)
    size = dict(sizes)
    into = {x: x for x in graph}
    best: dict = {}

    def choose(x: object) -> object:
        top = None
        for y, (n, s) in graph[x].items():
            sim = round(s / n if missing == "ignore" else s / (size[x] * size[y]), 9)
            if sim >= least and (top is None or (-sim, min(x, y), max(x, y)) < top[0]):
                top = ((-sim, min(x, y), max(x, y)), y)
        return top and top[1]

    stale = set(graph)
    while True:
        for x in stale:
            best[x] = choose(x)
        pairs = [(x, y) for x, y in best.items() if y is not None and x < y and best.get(y) == x]
        if not pairs:
            break
        stale = set()
        for x, y in pairs:
            for z, (n, s) in graph.pop(y).items():
                del graph[z][y]
                if z != x:
                    m, t = graph[x].get(z, (0, 0.0))
                    graph[x][z] = graph[z][x] = (n + m, s + t)
            size[x] += size[y]
            into[y] = x
            best.pop(y)
            stale.add(x)
        stale |= {z for x in list(stale) for z in graph[x]}
        stale |= {x for x, y in best.items() if y is not None and y not in graph}
        stale &= set(graph)
    out = {}
    for x in into:
        y = x
        while into[y] != y:
            y = into[y]
        out[x] = y
    return out


def _merge_rounds(edges: DataFrame, nodes: DataFrame, missing: str, least: float) -> DataFrame:
    """(part, node, cluster) of the parts too large for one task: the same rounds, over all tasks."""
    label = cut(nodes.select("part", "node", F.col("node").alias("cluster"), "size"))
    edges = cut(edges)
    while True:
        live = edges
        if missing != "ignore":
            sizes = label.groupBy("part", "cluster").agg(F.sum("size").alias("size"))
            live = live.join(sizes.select("part", F.col("cluster").alias("a"), F.col("size").alias("size_a")), ["part", "a"]).join(sizes.select("part", F.col("cluster").alias("b"), F.col("size").alias("size_b")), ["part", "b"])
        live = live.withColumn("sim", _similarity(missing)).filter(F.col("sim") >= least)
        ends = live.select("part", F.explode(F.array("a", "b")).alias("x"), F.struct((-F.col("sim")).alias("m"), "a", "b").alias("o"))
        best = ends.groupBy("part", "x").agg(F.min("o").alias("o"))
        merged = cut(best.groupBy("part", F.col("o.a").alias("a"), F.col("o.b").alias("b")).agg(F.count(F.lit(1)).alias("k")).filter("k = 2").select("part", "a", "b"))
        if merged.isEmpty():
            return label.select("part", "node", "cluster")
        move = merged.select(F.col("part").alias("__part"), F.col("b").alias("__old"), F.col("a").alias("__new"))
        at = lambda df, c: df.join(small(move), (F.col("part") == F.col("__part")) & (F.col(c) == F.col("__old")), "left").withColumn(c, F.coalesce("__new", c)).drop("__part", "__old", "__new")
        moved = at(at(edges, "a"), "b").filter("a <> b").select("part", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "s")
        new_edges, new_label = cut(moved.groupBy("part", "a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))), cut(at(label, "cluster"))
        for old in (edges, label, merged):
            release(old)
        edges, label = new_edges, new_label


def cluster(df: DataFrame, key: str, parts: Sequence[str], column: str, width: float, missing: str = "zero", least: float = 0.25, part_links: int = PART_LINKS, dense: int = DENSE) -> DataFrame:
    """(key, cluster): of each record of df, the least key of its cluster; lone records are clusters of one.

    Records of different `parts`, or with vectors of different lengths, are never alike. Vectors that are
    null, empty, or hold a null, NaN or infinite element are left out, as are records with a null key;
    repeated keys count once; an empty df gives no rows. The similarity of two clusters is the average over
    their pairs, in which a pair that isn't alike counts as 0 (missing='zero': average linkage), or isn't
    counted (missing='ignore': whatever is linked, directly or through others, ends in one cluster). Merging
    stops below `least`. Ties go to the smaller keys. Parts with more than part_links links are merged by
    all tasks; cells with more than `dense` pairs between them are compared by blocks."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    points = df.filter(F.col(key).isNotNull() & (F.size(column) > 0) & F.coalesce(fine, F.lit(False)))
    points = points.select(F.struct(*(F.col(c).alias(f"p{i}") for i, c in enumerate(parts)), F.size(column).alias("dims")).alias("part"), F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).dropDuplicates(["id"])
    points = cut(points.withColumn("part", F.xxhash64("part").cast("string")))
    nodes, edges = links(points, width, dense)
    edges = cut(edges)
    count = edges.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    large = cut(count.filter(F.col("k") > part_links).select("part"))
    kind = dict(points.dtypes)["id"]

    def run(e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        out = merge_part(e, dict(zip(n.node, n["size"])), missing, least) if len(e) else {}
        part = n.part.iloc[0] if len(n) else (e.part.iloc[0] if len(e) else None)
        return pd.DataFrame({"part": [part] * len(n), "node": n.node, "cluster": [out.get(x, x) for x in n.node]})

    rest = lambda t: t.join(small(large), "part", "left_anti")
    linked = nodes.join(edges.select("part", F.explode(F.array("a", "b")).alias("node")).distinct(), ["part", "node"], "left_semi")
    label = rest(edges).groupBy("part").cogroup(rest(linked).groupBy("part")).applyInPandas(run, f"part string, node {kind}, cluster {kind}")
    if not large.isEmpty():
        label = label.unionByName(_merge_rounds(edges.join(small(large), "part", "left_semi"), linked.join(small(large), "part", "left_semi"), missing, least))
    whole = nodes.join(label, ["part", "node"], "left").select("part", "cell", F.coalesce("cluster", "node").alias("c"))
    placed = _cells(points, width).join(whole, ["part", "cell"]).select("part", "id", "c")
    least_key = placed.groupBy("part", "c").agg(F.min("id").alias("cluster"))
    return placed.join(least_key, ["part", "c"]).select(F.col("id").alias(key), "cluster")


def describe(df: DataFrame, key: str, column: str, label: str, given: str, clusters: DataFrame, top: int = 3, least_size: int = 1) -> DataFrame:
    """(cluster, size, typical, given): per cluster its size, its most typical members (nearest to its mean, ties to the smaller key) and its commonest given label (ties to the smaller)."""
    rows = df.select(key, F.col(column).alias("v"), F.col(label).alias("name"), F.col(given).alias("given")).dropDuplicates([key]).join(clusters, key)
    mean = rows.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least_size)
    far = F.round(F.array_max(F.zip_with("v", "mean", lambda a, b: F.abs(a - b))), 9)
    near = rows.join(mean, "cluster").withColumn("far", far).withColumn("r", F.row_number().over(W.Window.partitionBy("cluster").orderBy("far", key))).filter(F.col("r") <= top)
    typical = near.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda s: s["name"]).alias("typical"))
    votes = rows.filter(F.col("given").isNotNull()).groupBy("cluster", "given").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.min_by("given", F.struct(-F.col("k"), "given")).alias("given"))
    return sizes.join(typical, "cluster").join(votes, "cluster", "left").select("cluster", "size", "typical", "given")
