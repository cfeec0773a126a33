"""The driver's tables as genotypes: reads of line items by part (site) and nation (sample)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import small, table

#: Samples of the view: nations.
SAMPLES = 25
PLOIDY = 10


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, pos, sample, ref_d, alt_d)."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    supp = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    odd = F.col("l_linenumber") % 2 == 1
    by_part = lines.join(small(supp), lines.l_suppkey == supp.s_suppkey).groupBy("l_partkey", "s_nationkey").agg(F.sum(F.when(odd, F.col("l_quantity")).otherwise(0.0)).alias("ref_d"), F.sum(F.when(odd, 0.0).otherwise(F.col("l_quantity"))).alias("alt_d"))
    return by_part.join(small(parts), by_part.l_partkey == parts.p_partkey).select(F.col("p_brand").alias("chrom"), F.col("l_partkey").alias("pos"), F.col("s_nationkey").alias("sample"), "ref_d", "alt_d")


def sites(spark: SparkSession, d: str, min_depth: int = 0) -> DataFrame:
    """(row_id, chrom, pos, d, depth): arrays over the samples; d is the fraction of the alternate, null if missing."""
    c = cells(spark, d)
    total = F.col("ref_d") + F.col("alt_d")
    c = c.select("chrom", "pos", "sample", F.when((total >= min_depth) & (total > 0), F.col("alt_d") / total).alias("d"), total.alias("depth"))
    held = c.groupBy("chrom", "pos").agg(F.collect_list("sample").alias("s"), F.collect_list(F.coalesce("d", F.lit(float("nan")))).alias("d"), F.collect_list("depth").alias("depth"))
    return held.mapInArrow(_aligned, "row_id bigint, chrom string, pos bigint, d array<double>, depth array<double>")


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of samples and their values as arrays over all samples."""
    ends = lambda n: pa.array(np.arange(n + 1, dtype=np.int32) * SAMPLES)
    for batch in batches:
        chrom, pos, samples, *values = batch.columns
        n = batch.num_rows
        at = np.asarray(pc.list_parent_indices(samples)).astype(np.int64) * SAMPLES + np.asarray(pc.list_flatten(samples))
        out = []
        for v in values:
            flat = np.full(n * SAMPLES, np.nan)
            flat[at] = np.asarray(pc.list_flatten(v))
            out.append(pa.ListArray.from_arrays(ends(n), pa.array(flat, mask=np.isnan(flat))))
        yield pa.RecordBatch.from_arrays([pos, chrom, pos, *out], names=["row_id", "chrom", "pos", "d", "depth"])
