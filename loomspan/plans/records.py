"""Queries of record preparation: packed fields, filling, drifting schemas, failing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, fill, packed, rejects
from ..runtime import cut, once_per, small, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of every field of alternates and depths that holds two or more."""
    sites = once_per(table(spark, d, "variants").select("row_id", "alt_allele").filter(F.length("alt_allele") > 2), "row_id")
    calls = once_per(table(spark, d, "vcf_calls").select("call_id", "ad", "bsdp").filter((F.length("ad") > 2) | (F.length("bsdp") > 2)), "call_id")
    return packed.split_packed(sites, {"alt_allele": "alt"}, "row_id", 2).unionByName(packed.split_packed(calls, {"ad": "ad", "bsdp": "bsdp"}, "call_id", 2))


#: A whole number that stands alone between delimiters, quotes or brackets.
_WHOLE = r"""(^|[,;|/\s"'()\[\]{}])\d+($|[,;|/\s"'()\[\]{}])"""


#: Most places of a panel; records between a filled value and the one that fills it from which the fill counts as far.
MOST_PANEL, FAR = 1 << 20, 16


def _between_depths(a: Column, b: Column, share: Column) -> Column:
    """Packed depths of equally many values, each interpolated and rounded; one that is missing in either stays `.`."""
    parts = lambda x: F.transform(F.split(F.regexp_replace(F.trim(F.regexp_replace(x, r"""["'()\[\]{}]""", "")), r"\s*[,;|/]\s*", ","), r"[,\s]", -1), lambda v: v.try_cast("double"))
    one = lambda x, y: F.coalesce(F.round(x + (y - x) * share).cast("long").cast("string"), F.lit("."))
    return F.when(F.size(parts(a)) == F.size(parts(b)), F.array_join(F.zip_with(parts(a), parts(b), one), ","))


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    """(src, rec_id, elem_idx, value, method, distance) of every value that could be filled."""
    samples = table(spark, d, "samples").select("sample_id", "panel_idx", "population", "registered_at").dropDuplicates(["sample_id"])
    places = samples.filter(F.col("panel_idx") >= 0).select("panel_idx", "population", F.unix_micros(F.col("registered_at").cast("timestamp")).cast("double").alias("t"))
    panel = [(r.panel_idx, r.population, r.t) for r in places.limit(MOST_PANEL + 1).collect()]  # one row per panel place
    if len(panel) > MOST_PANEL:
        raise ValueError(f"more than {MOST_PANEL} samples have a place in the panel")
    dosages = once_per(table(spark, d, "dosage_results").select("dosage_id", "dosages"), "dosage_id")
    whole = fill.fill_vectors(dosages, "dosage_id", "dosages", panel).select(F.lit("dosages").alias("src"), F.col("dosage_id").alias("rec_id"), "elem_idx", F.format_string("%.6f", "value").alias("value"), "method", "distance")

    sites = table(spark, d, "variants").select("row_id", F.split("vcf_format", ":").alias("tags")).select("row_id", F.coalesce(F.array_contains("tags", "AD"), F.lit(False)).alias("has_ad"), F.coalesce(F.array_contains("tags", "BSDP"), F.lit(False)).alias("has_bsdp")).filter("has_ad or has_bsdp").dropDuplicates(["row_id"])
    calls = table(spark, d, "vcf_calls").select("call_id", "row_id", "sample_id", "ad", "bsdp", "loaded_at")
    calls = calls.join(small(samples.select("sample_id", "population")), "sample_id", "left").drop("sample_id").join(sites, "row_id").dropDuplicates(["row_id", "call_id"])
    calls = calls.select("call_id", "row_id", "population", "loaded_at", "has_ad", "has_bsdp", *(F.when(F.col(f"has_{c}") & F.col(c).rlike(_WHOLE), F.col(c)).alias(c) for c in ("ad", "bsdp")))
    done = fill.fill_in_order(calls, ["row_id", "population"], ["loaded_at", "call_id"], {"ad": _between_depths, "bsdp": _between_depths}, time="loaded_at", far_gap=FAR)
    both = F.array(*(F.struct(F.lit(c).alias("src"), F.col(f"{c}_filled").alias("value"), F.col(f"{c}_method").alias("method"), F.col(f"{c}_distance").alias("distance"), F.col(f"has_{c}").alias("has")) for c in ("ad", "bsdp")))
    depths = done.select("call_id", F.explode(F.filter(both, lambda x: x["has"] & x["method"].isNotNull())).alias("x")).select("x.src", F.col("call_id").alias("rec_id"), F.lit(0).alias("elem_idx"), "x.value", "x.method", "x.distance")
    return whole.unionByName(depths)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_fill(spark, d).select("src", "rec_id", "elem_idx")


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return drift.profile(table(spark, d, "vcf_batches"), table(spark, d, "vcf_format_headers"))


def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_profiles(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_changes(spark, d).select("file_id", "tag", "change_kind")


def p6_matched(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, tag, change_kind, was): the changes with fields matched by names, types and values too, not by descriptions alone."""
    return drift.changes(_profiles(spark, d), by_descr=False)


def p6_calls(spark: SparkSession, d: str) -> DataFrame:
    out = drift.unified_calls(table(spark, d, "vcf_batches"), cut(_profiles(spark, d)))
    return out.withColumn("rest", F.to_json("rest"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.failed(rejects.check_lines(table(spark, d, "vcf_raw_lines")))


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded(rejects.check_lines(table(spark, d, "vcf_raw_lines")))


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p5_fill, p6_found, p6_changes, p6_matched, p6_calls, p7_found, p7_valid)}
