"""Queries of the statistics and filters of calls, over the tables of variants and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as C
from ..operators import callset, sites
from ..runtime import once_per, table

FORMAT = "GT:AD:BSDP:RO:AO"
_R = lambda c: F.round(c, 9).alias(c)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, sample_id, rep_no, call_id, call): each call as the text of FORMAT."""
    c = once_per(table(spark, d, "vcf_calls").select("call_id", "row_id", "sample_id", "rep_no", "gt", "ad", "bsdp", "ro", "ao"), "call_id")
    return c.select("row_id", "sample_id", "rep_no", "call_id", F.concat_ws(":", *(F.coalesce(x, F.lit(".")) for x in ("gt", "ad", "bsdp", "ro", "ao"))).alias("call"))


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, chrom, pos, ref, alt, format, calls): every variant with its calls in the order of samples."""
    v = once_per(table(spark, d, "variants").select("row_id", "chrom", "pos", F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt")), "row_id")
    c = _calls(spark, d).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "rep_no", "call_id", "call"))), lambda x: x["call"]).alias("calls"))
    return v.join(c, "row_id", "left").select("row_id", "chrom", "pos", "ref", "alt", F.lit(FORMAT).alias("format"), "calls")


def call_site_stats(spark: SparkSession, d: str) -> DataFrame:
    s = callset.statistics(call_sites(spark, d))
    return s.select("row_id", "samples", "missing", "n00", "n01", "n11", "alleles", "transition", *map(_R, ("maf", "eh", "chi2", "hwe_p")))


def call_summary(spark: SparkSession, d: str) -> DataFrame:
    return callset.summary(callset.statistics(call_sites(spark, d))).withColumns({c: F.round(c, 9) for c in ("mean_eh", "mean_chi2")})


def call_histograms(spark: SparkSession, d: str) -> DataFrame:
    return callset.histograms(callset.statistics(call_sites(spark, d)).withColumns({c: F.round(c, 12) for c in ("maf", "eh", "chi2")}))


def call_filter_diploid(spark: SparkSession, d: str) -> DataFrame:
    out = callset.filter_calls(call_sites(spark, d), 2, 0.05, 0.2, 0.1, 0.01)
    return out.select("row_id", *map(_R, ("missing", "maf", "eh")))


def call_filter_polyploid(spark: SparkSession, d: str) -> DataFrame:
    """Biallelic SNPs by reads: 10 or more, ploidy 4, samples without a genotype missing whatever their reads."""
    out = callset.filter_calls(call_sites(spark, d), 4, 0.05, 0.6, 0.1, 0.0, True, 10, True)
    return out.select("row_id", *map(_R, ("missing", "maf", "eh")))


def call_read_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reads of the reference and the alternate of every call by each way of decoding, and its dosages by each rule (ploidy 4)."""
    v = once_per(table(spark, d, "variants").select("row_id", F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt")), "row_id")
    c = _calls(spark, d).join(v, "row_id")
    call, fmt, ref, alt = F.col("call"), F.lit(FORMAT), F.col("ref"), F.col("alt")
    kinds = {k: C.read_counts(call, fmt, ref, alt, k) for k in ("any", "bsdp", "ad", "ro")}
    reads = [f.alias(f"{k}_{a}") for k, x in kinds.items() for a, f in (("ref", x["ref"]), ("alt", x["alt"]))]
    rules = [F.round(C.dosage(call, fmt, ref, alt, r, 4), 9).alias(r) for r in C.RULES]
    return c.select("call_id", *reads, *rules)


def call_sample_report(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the samples' table, of the calls of each sample of the table of samples, in the order of names."""
    c = _calls(spark, d)
    counts = callset.sample_counts(c.select(F.array("call").alias("calls"), "sample_id"), "sample_id")
    variants = table(spark, d, "variants").select("row_id").distinct().count()
    eh = sites.mean_heterozygosity(c.select("row_id", F.split("call", ":")[0].alias("gt")), ["row_id"], "gt")
    return callset.sample_report(counts.withColumn("name", F.col("sample")), eh, variants).select("line")


QUERIES = {f.__name__: f for f in (call_site_stats, call_summary, call_histograms, call_filter_diploid, call_filter_polyploid, call_read_counts, call_sample_report)}
