"""Merging of variant tables over (chrom, pos)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def merge_sites(tables: list[tuple[DataFrame, list[str]]]) -> tuple[DataFrame, list[str]]:
    """The sites of all tables and the sorted union of their samples: (chrom, pos, id, ref, alt, format, calls).

    tables: variants and the names of their calls. A sample's call is that of the first table that has the sample
    and the site, else `./.`; id, ref and alt are the first table's. Sites repeated within a table stay
    apart, the n-th with the n-th. Input order doesn't matter."""
    samples = sorted({s for _, names in tables for s in names})
    parts = []
    for k, (df, names) in enumerate(tables):
        n = F.row_number().over(W.Window.partitionBy("chrom", "pos").orderBy("row_id"))
        where = {s: i for i, s in reversed(list(enumerate(names)))}
        cells = F.array(*(F.get("calls", F.lit(where[s])) if s in where else F.lit(None).cast("string") for s in samples)) if samples else F.array().cast("array<string>")
        parts.append(df.select("chrom", "pos", n.alias("dup"), F.lit(k).alias("src"), "id", "ref", "alt", cells.alias("cells")))
    every = reduce(DataFrame.unionByName, parts)
    head = F.min_by(F.struct("id", "ref", "alt"), "src")
    rows = every.groupBy("chrom", "pos", "dup").agg(head.alias("h"), F.array_sort(F.collect_list(F.struct("src", "cells"))).alias("all"))
    pick = F.aggregate("all", F.array_repeat(F.lit(None).cast("string"), len(samples)), lambda s, x: F.zip_with(s, x["cells"], lambda a, b: F.coalesce(a, b)))
    return rows.select("chrom", "pos", "h.id", "h.ref", "h.alt", F.lit("GT").alias("format"), F.transform(pick, lambda c: F.coalesce(c, F.lit("./."))).alias("calls")), samples
