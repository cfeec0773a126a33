"""The queries of the problems on vectors, percentiles, clusters and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, once_per, table
from . import clusters, mix, percentiles, queries_sql, subject, tokens, vectors


def p1_similar(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b, distance): up to 5 nearest markers of each marker, within 0.08."""
    return vectors.similar_vectors(table(spark, d, "dosage_results"), "dosage_id", "dosages", 5, 0.08, 0.0, 1.0, 32)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = p1_similar(spark, d)
    return near.select(F.least("id_a", "id_b").alias("dosage_id_a"), F.greatest("id_a", "id_b").alias("dosage_id_b")).distinct()


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """(chromosome, run_day, pct, n, percentile) of every chromosome and day with 50 counting values or more."""
    hits = once_per(table(spark, d, "gwas_hits").select("hit_id", "chromosome", "run_day", "p_value").filter("p_value > 0 and p_value <= 1"), "hit_id")
    hits = hits.select(percentiles.chromosome_name(F.col("chromosome")).alias("chromosome"), "run_day", "p_value")
    out = percentiles.percentiles(hits, ["chromosome", "run_day"], "p_value", [25, 50, 75], 50)
    return out.select("chromosome", "run_day", F.col("pct").cast("int").alias("pct"), "n", F.round("percentile", 9).alias("percentile"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_percentiles(spark, d).filter(F.col("percentile") < F.col("pct") * 0.8 / 100).select("chromosome", "run_day", "pct")


#: Greatest difference of a component between alike samples.
LIKE = 0.06


def _ancestry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pca_results").select("pca_id", "run_id", "sample_name", "cluster_assignments", F.col("ancestry_proportions").alias("q")).filter(F.size("q") > 0)
    total = F.aggregate("q", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("q", F.transform("q", lambda x: x / total))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, size, typical, given): average-linkage clusters of 3 samples or more."""
    rows = _ancestry(spark, d)
    found = clusters.cluster(rows, "pca_id", ["run_id"], "q", LIKE)
    return clusters.describe(rows, "pca_id", "q", "sample_name", "cluster_assignments", found, least_size=3)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = clusters.cluster(_ancestry(spark, d), "pca_id", ["run_id"], "q", LIKE, "ignore", 0.0)
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return found.join(sizes, "cluster").select(F.col("cluster").alias("cluster_key"), "pca_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents").select("doc_id", "text"), "text")


def _sized(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their source and tokens, and the targets."""
    name = F.lower(F.trim("source"))
    docs = tokens.count_tokens(table(spark, d, "documents").select("doc_id", name.alias("source"), "text"), "text")
    targets = table(spark, d, "source_targets").select(name.alias("source"), "target_share", "max_repeats")
    return once_per(docs, "doc_id").select("doc_id", F.array_compact(F.array("source")).alias("sources"), "n_tokens"), targets


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix.report(*_sized(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = _sized(spark, d)
    return mix.select(cut(docs), targets)


def _shared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The different texts, each once with all sources that it came from, and the targets."""
    name = F.lower(F.trim("source"))
    docs = once_per(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id").filter(F.length("text") > 0)
    # the texts themselves aren't shuffled: two of 128 equal bits are taken for one
    of = docs.select("doc_id", F.array(F.xxhash64("text"), F.xxhash64(F.reverse("text"))).alias("h"), name.alias("source"))
    of = of.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("sources"))
    sizes = tokens.count_tokens(docs.select("doc_id", "text"), "text").select(F.col("doc_id").alias("__doc"), "n_tokens")
    targets = table(spark, d, "source_targets").select(name.alias("source"), "target_share", "max_repeats")
    return of.join(sizes, F.col("doc_id") == F.col("__doc")).select("doc_id", "sources", "n_tokens"), targets


def p9_shared_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mix of the different texts: copies under several sources may serve any of them."""
    return mix.report(*_shared(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).filter("short").select("source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, subject) of every document that is about a subject."""
    names = [r.subject for r in table(spark, d, "subject_areas").select("subject").filter("subject is not null").distinct().orderBy("subject").limit(subject.MOST_SUBJECTS + 1).collect()]
    return subject.subject_areas(table(spark, d, "documents").select("doc_id", "text", "lang"), table(spark, d, "subject_labels"), names)


QUERIES = {f.__name__: f for f in (p1_found, p1_similar, p2_found, p2_percentiles, p3_found, p3_clusters, p8_ids, p9_found, p9_report, p9_shared_report, p9_mix, p10_found)}
SQL = queries_sql.SQL
