"""The most similar vectors of every vector: multi-index hashing over learned binary codes.

A rotation learned on a bounded sample (principal axes, then iterative quantization) turns a vector into
bits. The code is cut into substrings of about log2(rows / 8) bits, which together are the whole code, and each
is indexed. Codes that differ in fewer bits than twice the substrings agree, but for one bit, in one substring
at least, so probing every substring and its one-bit neighbours finds them. A task holds the buckets whose keys
begin alike and is sent whatever probes them; there, candidates are bounded by bytes for floats, and only what
can be among the k nearest is ranked by its floats.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators.fill import dense
from ..runtime import cut, once_per, small

#: Rows on which the rotation is learned.
SAMPLE_ROWS = 8192
#: Share of a vector's elements that may be missing before it is probed two bits deep.
SPARSE = 0.1
#: Share of a code's bits in which two candidates may differ.
FLIPS = 0.33
#: Rows that a bucket holds on average.
BUCKET = 8
#: Rows in one bucket from which it is searched in blocks.
HOT_BUCKET = 4096
#: Rows that a task's buckets hold together: at least, at most, and the share of all rows between these.
LEAST_GROUP, MOST_GROUP, GROUP_SHARE = 1 << 14, 1 << 19, 1024
_BLOCK = 2048
_CANDIDATES = 1 << 18
_MISSING = 255


def learn_rotation(x: np.ndarray, bits: int, seed: int = 7, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Column means and a (columns, bits) matrix; NaN elements count as their column's mean."""
    width = x.shape[1]
    seen = np.isfinite(x)
    mean = np.where(seen, x, 0).sum(0) / np.maximum(seen.sum(0), 1)
    z = np.where(seen, x - mean, 0)
    values, axes = np.linalg.eigh(z.T @ z / max(len(z), 1))
    axes = axes[:, np.argsort(-values)]
    rng, parts = np.random.default_rng(seed), []
    for at in range(0, bits, width):
        take = min(width, bits - at)
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            p = z @ axes @ r
            u, _, vt = np.linalg.svd(np.where(p >= 0, 1.0, -1.0).T @ (z @ axes))
            r = (u @ vt).T
        parts.append((axes @ r)[:, :take])
    return mean, np.concatenate(parts, axis=1)


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    """x with exactly width columns."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=np.nan)


@dataclass
class Codes:
    """How vectors become codes, keys and bytes."""

    width: int
    words: int
    mean: np.ndarray
    rotation: np.ndarray
    low: float
    high: float
    least: int
    cuts: list[int]

    @property
    def step(self) -> float:
        """What one more in a byte stands for; a difference of bytes is wrong by no more than that."""
        return (self.high - self.low) / (_MISSING - 1)

    def bits(self, j: int) -> int:
        return self.cuts[j + 1] - self.cuts[j]

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """The substrings of codes given as 0s and 1s."""
        powers = [1 << np.arange(self.bits(j), dtype=np.int64) for j in range(len(self.cuts) - 1)]
        return np.stack([bits[:, a:b].astype(np.int64) @ p for a, b, p in zip(self.cuts, self.cuts[1:], powers)], axis=1)


def _flat(a: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).reshape(-1), kind))


def _blobs(a: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binaries."""
    ends = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(a).tobytes())])


def _rows(blobs: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binaries of one length as the rows of a matrix of bytes."""
    if isinstance(blobs, pa.ChunkedArray):
        blobs = blobs.combine_chunks()
    n = len(blobs)
    at = np.frombuffer(blobs.buffers()[1], np.int32, n + 1, blobs.offset * 4)
    return np.frombuffer(blobs.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(n, -1)


def encode(df: DataFrame, c: Codes) -> DataFrame:
    """(id, v) to (id, v, deep, h, code, keys, q): elements that don't count are NaN; vectors with fewer than `least` others are left out.

    deep: many elements are missing. h: a 128-bit hash of v. keys: the code's substrings. q: a byte for each element."""
    rng = np.random.default_rng(11)
    mix = rng.integers(1, 1 << 62, size=(2, c.width), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _fit(dense(batch.column(1)), c.width)
            ok = (x >= c.low) & (x <= c.high)
            keep = np.flatnonzero(ok.sum(1) >= c.least)
            if not len(keep):
                continue
            x, ok = x[keep], ok[keep]
            bits = (np.where(ok, x - c.mean, 0) @ c.rotation) >= 0
            code = np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(len(x), c.words)
            x = np.where(ok, x + 0.0, np.nan)
            q = np.where(ok, np.rint((np.where(ok, x, c.low) - c.low) / (c.step or 1.0)), _MISSING).astype(np.uint8)
            raw = x.view(np.uint64)
            raw = raw ^ (raw >> np.uint64(31))
            hashes = [((raw * m) ^ ((raw * m) >> np.uint64(29))).sum(1, dtype=np.uint64).view(np.int64) for m in mix]
            deep = pa.array((~ok).sum(1) > int(SPARSE * c.width))
            columns = [batch.column(0).take(pa.array(keep)), _flat(x, pa.float64()), deep, _flat(np.stack(hashes, 1), pa.int64()), _flat(code, pa.int64()), _flat(c.keys(bits), pa.int64()), _blobs(q)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "deep", "h", "code", "keys", "q"])

    kinds = {"v": "array<double>", "deep": "boolean", "h": "array<bigint>", "code": "array<bigint>", "keys": "array<bigint>", "q": "binary"}
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in kinds.items()))


def _distances(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Mean absolute difference over the elements present in both; NaN where there are fewer than `least`. Broadcasts over leading axes."""
    gap = np.abs(a - b)
    both = ~np.isnan(gap)
    n = both.sum(-1)
    return np.where(n >= least, np.where(both, gap, 0).sum(-1) / np.maximum(n, 1), np.nan)


def similar_vectors(df: DataFrame, key: str, column: str, k: int = 5, max_distance: float = math.inf, low: float = -math.inf, high: float = math.inf, least: int = 1, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(id_a, id_b, distance): the k nearest others of each vector, ties at 9 decimals to the smaller id.

    key: unique id; repeated ids count once, null ids are left out. The distance is the mean absolute
    difference over the elements that count in both, which exist and lie between low and high, and it
    exists with `least` of them or more; pairs farther than max_distance are left out. Null, empty and too
    sparse vectors have no neighbours. Vectors shorter than the longest are padded with missing elements.
    Exact copies are searched once and expanded to at most k neighbours each. Approximate: what is returned
    has exact distances, but a neighbour may be missed (tests hold the recall against brute force).
    Every vector is indexed and probed; buckets of more than hot_bucket rows are searched in blocks, exactly."""
    base = df.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    counts = [F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")]
    if not (math.isfinite(low) and math.isfinite(high)):  # bytes need a range
        fine = F.filter("v", lambda x: ~F.isnan(x) & (F.abs(x) < math.inf) & (x >= low) & (x <= high))
        counts += [F.min(F.array_min(fine)).alias("low"), F.max(F.array_max(fine)).alias("high")]
    size = base.agg(*counts).first()
    kind = base.schema["id"].dataType
    pair = f"id_a {kind.simpleString()}, id_b {kind.simpleString()}, distance double"
    if not size.n or "low" in size and size.low is None:
        return df.sparkSession.createDataFrame([], pair)
    if "low" in size:
        low, high = size.low, size.high
    span = min(max(int(math.log2(size.n / BUCKET)), 8), 30)
    words = math.ceil(4 * span / 64)
    m = math.ceil(64 * words / span)
    sample = base.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("v").toArrow().column(0).combine_chunks()
    x = _fit(dense(sample), size.w)
    mean, rotation = learn_rotation(np.where((x >= low) & (x <= high), x, np.nan), 64 * words)
    codes = Codes(size.w, words, mean, rotation, low, high, least, [64 * words * j // m for j in range(m + 1)])
    coded = cut(encode(once_per(base, "id"), codes))

    # copies of one vector are one class, whose least id stands for it
    members = coded.select("id", "h")
    first = members.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    many = cut(first.filter("copies > 1"))
    reps = coded
    if copied := not many.isEmpty():
        reps = coded.join(many.select(F.col("rep").alias("id_c"), F.col("h").alias("h_c")).hint("merge"), F.col("h") == F.col("h_c"), "left")
        reps = cut(reps.filter("id_c is null or id = id_c").drop("id_c", "h_c"))
    near = _rank(_pairs(reps, codes, size.n, k, max_distance, hot_bucket, pair), k)
    return _expand(near, members, many, k) if copied else near.select("id_a", "id_b", "distance")


@dataclass
class Groups:
    """Which task holds a bucket: the one of the key's first bits, more of them where a group would be too large."""

    codes: Codes
    first: int
    more: list[np.ndarray]
    hot: list[np.ndarray]

    def of(self, j: int, key: np.ndarray) -> np.ndarray:
        rest = self.codes.bits(j) - min(self.first, self.codes.bits(j))
        more = self.more[j][key >> rest].astype(np.int64)
        return (j << 56) | (more << 48) | (key >> (rest - more))


def _masks(bits: int, deep: bool) -> list[int]:
    """What a key is probed with: the key itself, its one-bit neighbours and, if deep, its two-bit ones."""
    one = [0] + [1 << b for b in range(bits)]
    return one + [(1 << a) | (1 << b) for a in range(bits) for b in range(a)] if deep else one


def _probing(key: np.ndarray, mask: int, deep: np.ndarray) -> np.ndarray:
    """The rows that look under key ^ mask: of two keys that differ in one bit, the one in which it is 0 looks for the other; deep ones always look."""
    if mask & (mask - 1):
        return np.flatnonzero(deep)
    return np.flatnonzero(deep | (key & mask == 0))


def _groups(reps: DataFrame, codes: Codes, n: int, hot_bucket: int) -> Groups:
    """The division of the buckets into groups. The driver gets a row for each group of the first bits, and no more than 2^20 hot keys."""
    m = len(codes.cuts) - 1
    hot_bucket = max(hot_bucket, n * m >> 20)
    most = min(max(n // GROUP_SHARE, LEAST_GROUP), MOST_GROUP)
    first = max(0, math.ceil(math.log2(n / most)))
    rest = [codes.bits(j) - min(first, codes.bits(j)) for j in range(m)]
    buckets = reps.select(F.posexplode("keys").alias("j", "key")).groupBy("j", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = F.col("n") > hot_bucket
    start = F.expr(f"shiftright(key, element_at(array({', '.join(map(str, rest))}), j + 1))")
    rows = buckets.groupBy("j", start.alias("at")).agg(F.sum(F.when(~hot, F.col("n"))).alias("n"), F.collect_list(F.when(hot, F.col("key"))).alias("hot")).collect()
    more = [np.zeros(1 << min(first, codes.bits(j)), np.int8) for j in range(m)]
    for r in rows:
        if (r.n or 0) > 2 * most:
            more[r.j][r["at"]] = min(rest[r.j], math.ceil(math.log2(r.n / most)) + 1)
    return Groups(codes, first, more, [np.array(sorted(k for r in rows if r.j == j for k in r.hot), np.int64) for j in range(m)])


def _pairs(reps: DataFrame, codes: Codes, n: int, k: int, max_distance: float, hot_bucket: int, pair: str) -> DataFrame:
    """(id_a, id_b, distance) of what may be among the k nearest, each pair once or, from hot buckets, perhaps in both directions."""
    groups = _groups(reps, codes, n, hot_bucket)
    kind = reps.schema["id"].dataType.simpleString()
    sent = reps.select("id", "deep", "code", "keys", "q").mapInArrow(_spread(groups), f"g bigint, id {kind}, blob binary")
    found = sent.groupBy("g").applyInArrow(_search(groups, max_distance), f"id_a {kind}, id_b {kind}, near float")
    found = found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "near").groupBy("id_a", "id_b").agg(F.min("near").alias("near"))
    # what is farther by bytes than the k-th by as much as bytes can be wrong isn't among the k nearest
    ends = found.select(F.explode(F.array(F.struct(F.col("id_a").alias("x"), F.col("id_b").alias("y")), F.struct(F.col("id_b").alias("x"), F.col("id_a").alias("y")))).alias("e"), "near").select("e.x", "e.y", "near")
    ends = ends.withColumn("r", F.row_number().over(W.Window.partitionBy("x").orderBy("near")))
    kth = F.min(F.when(F.col("r") >= k, F.col("near"))).over(W.Window.partitionBy("x"))
    close = ends.withColumn("kth", kth).filter(F.col("kth").isNull() | (F.col("near") <= F.col("kth") + F.lit(2 * codes.step + 1e-6)))
    pairs = close.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    # a side of vectors grows with the table: it is never broadcast
    ends = {x: reps.select(F.col("id").alias(f"id_{x}"), F.col("v").alias(f"v_{x}")).hint("merge") for x in "ab"}
    both = pairs.join(ends["b"], "id_b").join(ends["a"], "id_a").select("id_a", "id_b", "v_a", "v_b")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_fit(dense(batch.column(2)), codes.width), _fit(dense(batch.column(3)), codes.width), codes.least)
            keep = np.flatnonzero(d <= max_distance)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(d[keep])], names=["id_a", "id_b", "distance"])

    out = both.mapInArrow(measure, pair)
    return out.unionByName(_blocked(reps, groups, pair, k, max_distance)) if any(map(len, groups.hot)) else out


def _spread(groups: Groups) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sends each row to the group of its bucket and to those of the buckets that it probes."""
    codes = groups.codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deep = np.asarray(batch.column(1))
            code = np.asarray(pc.list_flatten(batch.column(2))).view(np.uint8).reshape(len(deep), -1)
            keys = np.asarray(pc.list_flatten(batch.column(3))).reshape(len(deep), -1)
            q = _rows(batch.column(4))
            for j in range(keys.shape[1]):
                key = keys[:, j]
                cold = ~np.isin(key, groups.hot[j])
                row, to = [np.flatnonzero(cold)], [groups.of(j, key[cold])]
                for mask in _masks(codes.bits(j), bool(deep.any()))[1:]:
                    who = _probing(key, mask, deep)
                    row.append(who)
                    to.append(groups.of(j, key[who] ^ mask))
                row, to = np.concatenate(row), np.concatenate(to)
                order = np.lexsort((to, row))
                row, to = row[order], to[order]
                fresh = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (to[1:] != to[:-1])))) if len(row) else order
                row, to = row[fresh], to[fresh]
                index = cold[row] & (to == groups.of(j, key[row]))
                flag = (index + 2 * deep[row]).astype(np.uint8)[:, None]
                blob = np.concatenate((flag, code[row], q[row]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(to), batch.column(0).take(pa.array(row)), _blobs(blob)], names=["g", "id", "blob"])

    return run


def _search(groups: Groups, max_distance: float) -> Callable[[pa.Table], pa.Table]:
    """The pairs of a group's buckets and what probes them, within max_distance for all that bytes can tell."""
    codes = groups.codes
    at, limit, reach = 1 + 8 * codes.words, int(64 * codes.words * FLIPS), max_distance + codes.step + 1e-6

    def run(table: pa.Table) -> pa.Table:
        j = table.column("g")[0].as_py() >> 56
        raw = _rows(table.column("blob"))
        index, deep = np.flatnonzero(raw[:, 0] & 1), raw[:, 0] >= 2
        code, q = raw[:, 1:at].copy().view(np.uint64), np.ascontiguousarray(raw[:, at:])
        bits = np.unpackbits(raw[:, 1:at], axis=1, bitorder="little")[:, codes.cuts[j] : codes.cuts[j + 1]]
        key = bits.astype(np.int64) @ (1 << np.arange(codes.bits(j), dtype=np.int64))
        order = index[np.argsort(key[index], kind="stable")]
        held, start, count = np.unique(key[order], return_index=True, return_counts=True)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for mask in _masks(codes.bits(j), bool(deep.any())) if len(held) else []:
            who = _probing(key, mask, deep) if mask else index
            target = key[who] ^ mask
            place = np.minimum(np.searchsorted(held, target), len(held) - 1)
            hit = held[place] == target
            who, place = who[hit], place[hit]
            ends = np.cumsum(count[place])
            lo = 0
            while lo < len(who):
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + _CANDIDATES, "right")))
                size = count[place[lo:hi]]
                a = np.repeat(who[lo:hi], size)
                b = order[np.arange(int(size.sum())) + np.repeat(start[place[lo:hi]] - (np.cumsum(size) - size), size)]
                near = np.bitwise_count(code[a] ^ code[b]).sum(1) <= limit
                if not mask:
                    near &= a < b
                a, b = a[near], b[near]
                x, y = q[a], q[b]
                both = (x != _MISSING) & (y != _MISSING)
                n = both.sum(1)
                d = ((np.maximum(x, y) - np.minimum(x, y)) * both).sum(1) * (codes.step / np.maximum(n, 1))
                ok = (n >= codes.least) & (d <= reach)
                out.append((a[ok], b[ok], d[ok]))
                lo = hi
        a, b, d = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ids = table.column("id").combine_chunks()
        return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(d.astype(np.float32))], names=["id_a", "id_b", "near"])

    return run


def _blocked(reps: DataFrame, groups: Groups, pair: str, k: int, max_distance: float) -> DataFrame:
    """The k nearest in each hot bucket of whatever probes it, and of whatever is in it among what probes it, by blocks against blocks."""
    spark, codes = reps.sparkSession, groups.codes
    hot = spark.createDataFrame([(j, int(x)) for j, keys in enumerate(groups.hot) for x in keys], "j int, key bigint")
    index = reps.select("id", F.posexplode("keys").alias("j", "key"))
    one, two = (F.array(*(F.lit(x).cast("long") for x in _masks(max(codes.bits(j) for j in range(len(codes.cuts) - 1)), deep))) for deep in (False, True))
    probes = reps.select("id", "deep", F.posexplode("keys").alias("j", "key")).select("id", "j", "key", F.explode(F.when(F.col("deep"), two).otherwise(one)).alias("mask"))
    probes = probes.select("id", "j", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    blocks = lambda name: F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias(name)
    inside, asking = (cut(t.join(small(hot), ["j", "key"])) for t in (index, probes))
    sizes = cut(inside.groupBy("j", "key").agg(blocks("inside")).join(asking.groupBy("j", "key").agg(blocks("asking")), ["j", "key"]))
    vectors = reps.select("id", "v").hint("merge")
    block = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asking.join(small(sizes), ["j", "key"]).join(vectors, "id").select("j", "key", "id", "v", block("asking").alias("qb"), each("inside").alias("ib"))
    right = inside.join(small(sizes), ["j", "key"]).join(vectors, "id").select("j", "key", F.col("id").alias("id"), F.col("v").alias("v"), block("inside").alias("ib"), each("asking").alias("qb"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            mine, ids, y = a.id.to_numpy(), b.id.to_numpy(), np.array(b.v.tolist(), float)
            d = np.concatenate([_distances(np.array(a.v.iloc[at : at + 64].tolist(), float)[:, None], y[None], codes.least) for at in range(0, len(a), 64)])
            d[(mine[:, None] == ids[None]) | ~(d <= max_distance)] = np.nan
            for ones, others, table in ((mine, ids, d), (ids, mine, d.T)):
                for x, line in zip(ones, table):
                    for c in np.lexsort((others, np.round(line, 9)))[:k]:
                        if not np.isnan(line[c]):
                            rows.append((x, others[c], line[c]))
        return pd.DataFrame(rows, columns=["id_a", "id_b", "distance"])

    cols = ["j", "key", "qb", "ib"]
    return left.groupBy(*cols).cogroup(right.groupBy(*cols)).applyInPandas(search, pair)


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    """Both directions of the pairs, the k nearest of each."""
    both = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "distance")).distinct()
    order = W.Window.partitionBy("id_a").orderBy(F.round("distance", 9), "id_b")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def _expand(near: DataFrame, members: DataFrame, many: DataFrame, k: int) -> DataFrame:
    """From classes to their members: a member's neighbours are among the k + 1 least ids of its own class and of the k nearest classes."""
    heads = members.withColumn("r", F.row_number().over(W.Window.partitionBy("h").orderBy("id"))).filter(F.col("r") <= k + 1)
    rep = F.coalesce("rep", "id").alias("rep")
    heads = heads.join(many, "h", "left").select("id", rep).groupBy("rep").agg(F.collect_list("id").alias("ids"))
    of = members.join(many, "h", "left").select("id", rep)
    classes = near.select(F.col("id_a").alias("rep"), F.col("id_b").alias("other"), "distance")
    own = many.select("rep", F.col("rep").alias("other"), F.lit(0.0).alias("distance"))
    options = classes.unionByName(own).join(heads.select(F.col("rep").alias("other"), "ids"), "other").select("rep", "distance", F.explode("ids").alias("id_b"))
    # k + 1 options of each class do for all its members: at most one of them is the member itself
    options = options.withColumn("r", F.row_number().over(W.Window.partitionBy("rep").orderBy(F.round("distance", 9), "id_b"))).filter(F.col("r") <= k + 1).drop("r")
    wide = options.groupBy("rep").agg(F.collect_list(F.struct("distance", "id_b")).alias("o"))
    rows = of.join(wide, "rep").select(F.col("id").alias("id_a"), F.explode("o").alias("o")).select("id_a", "o.id_b", "o.distance").filter("id_a <> id_b")
    return rows.withColumn("r", F.row_number().over(W.Window.partitionBy("id_a").orderBy(F.round("distance", 9), "id_b"))).filter(F.col("r") <= k).drop("r")
