"""Schemas that drift between files: profiles of each file's fields, matching with the file before, one unified table.

Matched fields of successive files are one field, however often it is renamed along a stream; the fields of
different streams that are described alike get one name, under which the unified table has them."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import cut, once_per, release, small

WHOLE = r"[+-]?\d+"
NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
#: The types in the order in which they are tried.
KINDS = ("whole", "number", "whole_list", "number_list", "text")
#: Least hashes of a field's values that are kept, each under a seed of its own.
HASHES = 8


def fits(value: Column) -> Column:
    """A bit for each of KINDS that the value fits; all bits for `.`, empty and null."""
    one = lambda p: value.rlike(rf"^{p}\z")
    many = lambda p: value.rlike(rf"^{p}(,{p})*\z")
    return F.when(value.isNull() | value.isin("", "."), 31).when(one(WHOLE), 31).when(one(NUMBER), 0b11010).when(many(WHOLE), 0b11100).when(many(NUMBER), 0b11000).otherwise(0b10000)


def profile(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per file and tag: (stream_id, file_seq, file_id, tag, kind, descr, n, mean, spread, length, hashes).

    lines: file_id, stream_id, file_seq, vcf_format, calls. headers: file_id, tag, descr. kind: index in
    KINDS of the first type that all values fit. descr: without blanks and in lower case; null if the file
    declares none. n, mean, spread: a sketch of the numeric values. length, hashes: of all values that aren't
    missing, the mean length and the least hash under each of HASHES seeds; null without any. Lines with a null format or file are
    left out; null or empty calls give tags without values; repeated lines change n only."""
    base = lines.filter(F.col("vcf_format").isNotNull() & F.col("file_id").isNotNull()).select("file_id", "stream_id", "file_seq", F.split("vcf_format", ":", -1).alias("tags"), F.explode_outer("calls").alias("call"))
    cells = base.select("file_id", "stream_id", "file_seq", F.posexplode("tags").alias("at", "tag"), F.split("call", ":", -1).alias("parts")).select("file_id", "stream_id", "file_seq", "tag", F.get("parts", F.col("at")).alias("value"))
    number = F.when(F.col("value").rlike(rf"^{NUMBER}\z"), F.col("value").try_cast("double"))
    held = F.when(~F.col("value").isin("", "."), F.col("value"))
    tags = cells.groupBy("file_id", "tag").agg(F.min("stream_id").alias("stream_id"), F.min("file_seq").alias("file_seq"), F.bit_and(fits(F.col("value"))).alias("bits"), F.count(number).alias("n"), F.avg(number).alias("mean"), F.stddev_pop(number).alias("spread"), F.avg(F.length(held)).alias("length"), F.array(*(F.min(F.when(held.isNotNull(), F.xxhash64(F.lit(i), held))) for i in range(HASHES))).alias("hashes"))
    kind = F.lit(4)
    for k in (3, 2, 1, 0):
        kind = F.when(F.col("bits").bitwiseAND(1 << k) != 0, k).otherwise(kind)
    said = headers.groupBy("file_id", "tag").agg(F.min(F.lower(F.regexp_replace("descr", r"\s+", ""))).alias("descr"))
    return tags.join(small(said), ["file_id", "tag"], "left").select("stream_id", "file_seq", "file_id", "tag", kind.alias("kind"), "descr", "n", "mean", "spread", "length", "hashes")


def best_matching(score: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of the assignment with the greatest sum, by shortest augmenting paths; -inf bars a pair."""
    flip = score.shape[0] > score.shape[1]
    s = score.T if flip else score
    n, m = s.shape
    if n == 0:
        return []
    cost = np.where(np.isfinite(s), -s, 1e6)
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        owner[m], j = i, m
        dist, come, done = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while owner[j] != -1:
            done[j] = True
            r = owner[j]
            reach = cost[r] - u[r] - v[:m]
            better = ~done[:m] & (reach < dist[:m])
            dist[:m][better], come[:m][better] = reach[better], j
            open_ = np.where(done[:m], np.inf, dist[:m])
            k = int(open_.argmin())
            step = open_[k]
            u[owner[done]] += step
            v[done] -= step
            dist[:m][~done[:m]] -= step
            j = k
        while j != m:
            owner[j], j = owner[come[j]], come[j]
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] != -1 and np.isfinite(s[owner[j], j])]
    return [(b, a) for a, b in pairs] if flip else pairs


def likeness(a: dict, b: dict, by_descr: bool) -> float:
    """How well field b of the new file continues field a of the old one; -inf if it can't."""
    same = a["descr"] is not None and a["descr"] != "" and a["descr"] == b["descr"]
    if by_descr and not same:
        return -np.inf
    name = difflib.SequenceMatcher(None, a["tag"].lower(), b["tag"].lower()).ratio()
    sketch = 0.0
    if a["n"] and b["n"]:
        scale = max(a["spread"] or 0, b["spread"] or 0, abs(a["mean"]) * 0.1, 1e-9)
        sketch = float(np.exp(-abs(a["mean"] - b["mean"]) / scale))
    elif a["length"] and b["length"]:  # texts: shared values, which prove more than a like mean does, or at least values of one length
        shared = float(np.mean([x == y for x, y in zip(a["hashes"], b["hashes"])]))
        sketch = max(2 * shared, 0.5 * float(np.exp(-abs(a["length"] - b["length"]))))
    score = 2.0 * same + 0.5 * (a["kind"] == b["kind"]) + 0.5 * sketch + name
    return score if same or score >= 1.6 else -np.inf


def changes(profiles: DataFrame, by_descr: bool = True) -> DataFrame:
    """(file_id, tag, change_kind, was): each change of a file's fields against the file before it in its stream.

    `renamed` (was: the old name), `added`, `removed`, `retyped` (was: the old type; never of GT). New and gone
    fields are matched one to one by the greatest total likeness of description, name, type and value sketch;
    by_descr: only those of equal description. The file before is the one with the next lower file_seq (then
    file_id). Files with a null stream or sequence are compared with none, as is the first of a stream."""
    files = profiles.filter(F.col("stream_id").isNotNull() & F.col("file_seq").isNotNull()).groupBy("stream_id", "file_seq", "file_id").agg(F.collect_list(F.struct("tag", "kind", "descr", "n", "mean", "spread", "length", "hashes")).alias("now"))
    files = files.withColumn("old", F.lag("now").over(W.Window.partitionBy("stream_id").orderBy("file_seq", "file_id"))).filter(F.col("old").isNotNull()).select("file_id", "old", "now")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, old, now in zip(frame.file_id, frame.old, frame.now):
                a, b = {x["tag"]: x for x in map(_plain, old)}, {x["tag"]: x for x in map(_plain, now)}
                gone, new = sorted(set(a) - set(b)), sorted(set(b) - set(a))
                score = np.array([[likeness(a[g], b[n], by_descr) for n in new] for g in gone]).reshape(len(gone), len(new))
                pairs = {new[j]: gone[i] for i, j in best_matching(score)}
                out += [(file, n, "renamed", g) for n, g in pairs.items()]
                out += [(file, n, "added", None) for n in new if n not in pairs]
                out += [(file, g, "removed", None) for g in gone if g not in pairs.values()]
                for n, was in [*((t, t) for t in a.keys() & b.keys()), *pairs.items()]:
                    if n != "GT" and a[was]["kind"] != b[n]["kind"]:
                        out.append((file, n, "retyped", KINDS[a[was]["kind"]]))
            yield pd.DataFrame(out, columns=["file_id", "tag", "change_kind", "was"])

    return files.mapInPandas(run, "file_id long, tag string, change_kind string, was string")


def _plain(x: object) -> dict:
    d = x if isinstance(x, dict) else x.asDict()
    return {k: (None if isinstance(v, float) and np.isnan(v) else v) for k, v in d.items()}


def canonical_names(profiles: DataFrame) -> DataFrame:
    """(descr, name): of each description the tag that most files use for it (ties: the first in order)."""
    count = profiles.filter(F.col("descr").isNotNull() & (F.col("descr") != "")).groupBy("descr", "tag").agg(F.count(F.lit(1)).alias("n"))
    return count.groupBy("descr").agg(F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("name"))


def fields(profiles: DataFrame, matched: DataFrame) -> DataFrame:
    """(file_id, tag, descr, field): the field that each file's tag is, one along a stream through all its matched names.

    matched: `changes`. A tag kept from file to file is a run; a rename joins two runs. The runs' first ones are
    found by doubling, in as many rounds as the logarithm of the most renames of a field, over rows for runs only."""
    loose = F.col("stream_id").isNull() | F.col("file_seq").isNull()
    rows = profiles.select("file_id", "tag", "descr", F.when(loose, F.concat(F.lit("file "), F.col("file_id").cast("string"))).otherwise(F.concat(F.lit("stream "), "stream_id")).alias("stream"), "file_seq")
    place = rows.select("stream", "file_seq", "file_id").distinct().withColumn("r", F.row_number().over(W.Window.partitionBy("stream").orderBy("file_seq", "file_id"))).select("file_id", "r")
    rows = rows.drop("file_seq").join(place, "file_id")
    rows = rows.withColumn("island", F.col("r") - F.row_number().over(W.Window.partitionBy("stream", "tag").orderBy("r")))
    rows = cut(rows)
    runs = cut(rows.groupBy("stream", "tag", "island").agg(F.min("r").alias("first"), F.max("r").alias("last")).withColumn("run", F.monotonically_increasing_id()))
    renames = matched.filter("change_kind = 'renamed'").select("file_id", F.col("tag").alias("new"), F.col("was").alias("old"))
    renames = renames.join(rows.select("file_id", "stream", "r").distinct(), "file_id")
    later = runs.select("stream", F.col("tag").alias("new"), F.col("first").alias("r"), "run")
    before = runs.select("stream", F.col("tag").alias("old"), (F.col("last") + 1).alias("r"), F.col("run").alias("root"))
    links = cut(renames.join(later, ["stream", "new", "r"]).join(before, ["stream", "old", "r"]).select("run", "root"))
    while True:
        on = links.select(F.col("run").alias("root"), F.col("root").alias("next"))
        ahead = cut(links.join(on, "root", "left").select("run", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(links)
        links = ahead.select("run", "root")
        links._loomspan_path = ahead._loomspan_path
        if ahead.filter("moved").isEmpty():
            break
    named = rows.join(runs.select("stream", "tag", "island", "run"), ["stream", "tag", "island"])
    return named.join(links, "run", "left").select("file_id", "tag", "descr", F.coalesce("root", "run").alias("field"))


def unified_names(profiles: DataFrame, matched: DataFrame) -> DataFrame:
    """(file_id, tag, name): the name of each file's tag in the unified table; no two tags of a file share one.

    A field is described by what most of its files say; its name is that which most files use for this
    description, or its own first one in order if it has none. Of several fields of a file with one name that
    of the tag itself, else of the first tag, has it; the others keep their tags, with `~` if that is given away."""
    of = cut(fields(profiles, matched))
    said = of.filter(F.col("descr").isNotNull() & (F.col("descr") != "")).groupBy("field", "descr").agg(F.count(F.lit(1)).alias("n")).groupBy("field").agg(F.min_by("descr", F.struct(-F.col("n"), "descr")).alias("main"))
    names = canonical_names(profiles).withColumnRenamed("descr", "main")
    own = of.groupBy("field").agg(F.min("tag").alias("own"))
    wanted = of.join(own.join(said, "field", "left").join(names, "main", "left").select("field", F.coalesce("name", "own").alias("name")), "field").select("file_id", "tag", "name")
    first = F.row_number().over(W.Window.partitionBy("file_id", "name").orderBy((F.col("tag") != F.col("name")).cast("int"), "tag")) == 1
    wanted = wanted.withColumn("has", first).withColumn("given", F.collect_set(F.when(F.col("has"), F.col("name"))).over(W.Window.partitionBy("file_id")))
    rest = F.when(F.array_contains("given", F.col("tag")), F.concat("tag", F.lit("~"))).otherwise(F.col("tag"))
    return wanted.select("file_id", "tag", F.when(F.col("has"), F.col("name")).otherwise(rest).alias("name"))


def unified_calls(lines: DataFrame, profiles: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """All files' calls in one table, once per (file_id, line_no): fields under one name each, whatever a file calls them.

    matched: the `changes` of the profiles, made here if not given. Gives (file_id, line_no, chrom, pos, ref_allele, call_no from 1, gt,
    ro, ao bigint, rest map); `.`, empty and unreadable values are null, `rest` has the other fields by
    `unified_names`. Lines without calls give no rows."""
    names = unified_names(profiles, changes(profiles) if matched is None else matched).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "name"))).alias("names"))
    base = once_per(lines.select("file_id", "line_no", "chrom", "pos", "ref_allele", "vcf_format", "calls"), "file_id", "line_no").join(small(names), "file_id")
    rows = base.select("file_id", "line_no", "chrom", "pos", "ref_allele", F.transform(F.split("vcf_format", ":", -1), lambda t: F.coalesce(F.try_element_at("names", t), t)).alias("tags"), F.posexplode("calls").alias("call_no", "call"))
    pairs = F.zip_with("tags", F.split("call", ":", -1), lambda t, v: F.struct(t.alias("t"), F.when(~v.isin("", "."), v).alias("v")))
    rows = rows.withColumn("cells", F.filter(pairs, lambda x: x["t"].isNotNull() & x["v"].isNotNull()))
    cell = lambda t: F.get(F.filter("cells", lambda x: x["t"] == t), F.lit(0))["v"]
    rest = F.map_from_entries(F.filter("cells", lambda x, i: ~x["t"].isin("GT", "RO", "AO") & ~F.exists(F.slice("cells", 1, i), lambda y: y["t"] == x["t"])))
    return rows.select("file_id", "line_no", "chrom", "pos", "ref_allele", (F.col("call_no") + 1).alias("call_no"), cell("GT").alias("gt"), cell("RO").try_cast("double").try_cast("long").alias("ro"), cell("AO").try_cast("double").try_cast("long").alias("ao"), rest.alias("rest"))
