"""Tables of a report: relationships, significance, thinned plots, samples with their phenotypes and populations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..runtime import small
from .gwas import fdr
from .structure import MOST_SAMPLES, Structure, matrix_pairs


def sample_names(spark: SparkSession, samples: list[str]) -> DataFrame:
    """(sample, name): places and names."""
    return spark.createDataFrame(list(enumerate(samples)), "sample int, name string")


def with_populations(samples: DataFrame, populations: DataFrame) -> DataFrame:
    """samples (sample, name) with `population` and `rank`, -1 for a name without one; populations: sample, population, rank. Of a repeated name the least rank counts."""
    of = populations.groupBy(F.col("sample").alias("name")).agg(F.min_by("population", "rank").alias("population"), F.min("rank").alias("rank"))
    return samples.join(small(of), "name", "left").select("sample", "name", "population", F.coalesce("rank", F.lit(-1)).alias("rank"))


def with_phenotypes(samples: DataFrame, phenotypes: DataFrame, q: DataFrame | None = None) -> DataFrame:
    """samples (sample, name) with `y`, NaN for a name without one, and with the ancestry `q`, zeros for a name without it."""
    y = phenotypes.groupBy(F.col("sample").alias("name")).agg(F.max("y").alias("y"))
    out = samples.join(small(y), "name", "left").withColumn("y", F.coalesce("y", F.lit(float("nan"))))
    if q is not None:
        of = q.groupBy(F.col("sample").alias("name")).agg(F.max("q").alias("q"))
        width = q.agg(F.max(F.size("q"))).first()[0] or 0
        out = out.join(small(of), "name", "left").withColumn("q", F.coalesce("q", F.array_repeat(F.lit(0.0), width)))
    return out.select("sample", "name", "y", *(["q"] if q is not None else []))


def as_vectors(samples: DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """y and q of with_phenotypes as arrays in the order of places, as an association needs them."""
    rows = samples.orderBy("sample").limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    return np.array([r.y for r in rows], float), np.array([r.q for r in rows], float) if "q" in samples.columns else None


def relationships(clusters: DataFrame, distances: DataFrame, kinship: DataFrame) -> DataFrame:
    """(i, j, sample1, sample2, same_cluster, distance, kinship, relation) of every two samples, i < j.

    clusters: sample (place), name, cluster. distances, kinship: i, j, value."""
    side = lambda x, k: clusters.select(F.col("sample").alias(x), F.col("name").alias(f"sample{k}"), F.col("cluster").alias(f"__c{k}"))
    pairs = kinship.filter("i < j").select("i", "j", F.col("value").alias("kinship")).join(distances.select("i", "j", F.col("value").alias("distance")), ["i", "j"])
    pairs = pairs.join(small(side("i", 1)), "i").join(small(side("j", 2)), "j")
    same = F.when(F.col("__c1") == F.col("__c2"), "YES").otherwise("NO")
    return pairs.select("i", "j", "sample1", "sample2", same.alias("same_cluster"), "distance", "kinship", N.relationship(F.col("kinship")).alias("relation"))


def structure_relationships(spark: SparkSession, s: Structure, samples: list[str]) -> DataFrame:
    """relationships of an analysis of structure: clusters by k-means, distances between components."""
    clusters = spark.createDataFrame([(i, n, int(s.kmeans[i])) for i, n in enumerate(samples)], "sample int, name string, cluster int")
    d = np.sqrt(((s.pcs[:, None] - s.pcs[None]) ** 2).sum(2))
    return relationships(clusters, matrix_pairs(spark, d), matrix_pairs(spark, s.kinship))


def significance(hits: DataFrame, level: float = 0.05) -> DataFrame:
    """One row: m, bonferroni (level / m), significant under it, discoveries of q under the level, and the least -log10 p of these (0 without any). hits: marker, p."""
    q = fdr(hits)
    m = hits.agg(F.count(F.lit(1)).alias("m"))
    bound = F.lit(level) / F.greatest(F.col("m"), F.lit(1))
    found = F.col("q") < level
    out = q.crossJoin(F.broadcast(m.limit(1))).groupBy().agg(F.max("m").alias("m"), F.count_if(F.col("p") < bound).alias("significant"), F.count_if(found).alias("discoveries"), F.min(F.when(found, -F.log10("p"))).alias("threshold"))
    return out.select(F.coalesce("m", F.lit(0)).alias("m"), (F.lit(level) / F.greatest(F.coalesce("m", F.lit(1)), F.lit(1))).alias("bonferroni"), "significant", "discoveries", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def thinned(ranked: DataFrame, every: int, rank: str = "rank", p: str = "p", over: float = 0.05) -> DataFrame:
    """What a plot shows: all points up to a p of `over`, and each `every`-th of the rest, by its rank from 1."""
    return ranked.filter((F.col(p) <= over) | ((F.col(rank) - 1) % every == 0))


def ancestry_order(samples: DataFrame) -> DataFrame:
    """samples (name, ancestry) with `ord` from 0: by the first greatest component, then by its value from high to low, then by name."""
    from pyspark.sql import window as W

    top = F.array_max("ancestry")
    w = W.Window.orderBy(F.array_position("ancestry", top), top.desc(), "name")  # samples are few: one sorted task
    return samples.withColumn("ord", F.row_number().over(w) - 1)


def leaf_clusters(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """The leaves of a tree (node, parent, name) with their sample's clusters, `?` where it has none; clusters: name and columns of text."""
    inner = nodes.select(F.col("parent").alias("node")).distinct()
    out = nodes.join(inner, "node", "left_anti").select("node", "name").join(small(clusters), "name", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("?")) for c in clusters.columns if c != "name"})


def manual_markers(spark: SparkSession, places: list[str]) -> DataFrame:
    """(marker, chrom, pos) of texts `chrom:pos`; others are left out."""
    split = [(t, *t.rsplit(":", 1)) for t in (x.strip() for x in places) if ":" in t]
    return spark.createDataFrame([(t, c, int(p)) for t, c, p in split if c and p.isdigit()], "marker string, chrom string, pos long")
