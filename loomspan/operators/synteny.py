"""Comparative genomics: synteny reports, intervals of blocks, Ks peaks, trees of chromosomes, term enrichment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import names as N
from ..functions.kernels import align_udf, hypergeometric_sf, kaks_udf
from ..functions.sequences import identity, jukes_cantor
from ..runtime import small
from .ranges import overlaps, points_in
from .structure import neighbour_joining


def resolve(ids: DataFrame, genes: DataFrame, id_: str, gene: str = "gene_id") -> DataFrame:
    """ids with `found`, the gene that its best form names: as it is, without prefix, without version, without suffix.

    The forms of an id are tried in the keys' join only if it isn't a gene's own, with or without a prefix."""
    every = genes.select(gene).filter(F.col(gene).isNotNull()).distinct()
    own = ids.select(id_).distinct().withColumn("__bare", N.gene_key(F.col(id_)))
    own = own.join(every.select(F.col(gene).alias(id_), F.col(gene).alias("__a")), id_, "left").join(every.select(F.col(gene).alias("__bare"), F.col(gene).alias("__b")), "__bare", "left").select(id_, F.coalesce("__a", "__b").alias("found"))
    tries = own.filter("found is null").select(id_, F.posexplode(N.base_keys(F.col(id_))).alias("prio", "k"))
    known = genes.select(gene).distinct().select(F.col(gene).alias("g"), F.explode(F.array_distinct(F.array(F.col(gene), N.gene_key(F.col(gene)), F.regexp_replace(N.gene_key(F.col(gene)), r"\.[^.]*$", "")))).alias("k"))
    best = tries.join(known, "k").groupBy(id_).agg(F.min_by("g", F.struct("prio", "g")).alias("found"))
    return ids.join(own.filter("found is not null").unionByName(best), id_, "left")


def orphans(genes: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The genes of one genome that are in no pair; side is `gene1` or `gene2`."""
    found = resolve(pairs.select(side).distinct(), genes, side).select(F.col("found").alias("gene_id")).filter(F.col("gene_id").isNotNull())
    return genes.join(found.distinct(), "gene_id", "left_anti")


def report(pairs: DataFrame, genes1: DataFrame, genes2: DataFrame, kaks: DataFrame | None = None) -> DataFrame:
    """Syntenic pairs with both genes' places and Ka/Ks, and the orphans of either genome: one table with `status`.

    A pair's genes are those that `resolve` finds; one that isn't found keeps its name, without places."""
    out = pairs.select("block_id", "ord", "gene1", "gene2", "e_value")
    more = [c for c in ("strand",) if c in genes1.columns and c in genes2.columns]
    side = lambda g, k: g.select(F.col("gene_id").alias(f"gene{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("chrom", "start", "end", *more)))
    for k, g in ((1, genes1), (2, genes2)):
        out = resolve(out, g, f"gene{k}").withColumn(f"gene{k}", F.coalesce("found", N.gene_key(F.col(f"gene{k}")))).drop("found").join(side(g, k), f"gene{k}", "left")
    if kaks is not None:
        out = out.join(kaks.select("gene1", "gene2", "ka", "ks", "ratio"), ["gene1", "gene2"], "left")
    out = out.withColumn("status", F.lit("Syntenic"))
    for k, g in ((1, genes1), (2, genes2)):
        lone = side(orphans(g, pairs, f"gene{k}"), k).withColumn("status", F.lit(f"Orphan_G{k}"))
        out = out.unionByName(lone, allowMissingColumns=True)
    return out


def block_boxes(placed: DataFrame) -> DataFrame:
    """(block_id, chrom, start, end) of (block_id, ord, chrom, start, end): the box of a block's genes, on the chromosome of its last one (of equals, the one that lies farthest)."""
    return placed.filter(F.col("chrom").isNotNull()).groupBy("block_id").agg(F.max_by("chrom", F.struct("ord", "start", "end", "chrom")).alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"))


def snp_density(boxes: list[DataFrame], snps: DataFrame) -> DataFrame:
    """(block_id, density): SNPs per 1000 bases, summed over the boxes of both genomes. snps: chrom, pos."""
    parts = []
    for k, b in enumerate(boxes):
        keyed = b.select(F.col("block_id"), N.contig_key(F.col("chrom")).alias("c"), "start", "end")
        hit = points_in(snps.select(N.contig_key(F.col("chrom")).alias("c"), "pos"), keyed, ["c"], "pos", "start", "end").groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
        parts.append(keyed.join(hit, "block_id", "left").select("block_id", (F.coalesce("n", F.lit(0)) / F.greatest(F.lit(1.0), (F.col("end") - F.col("start")) / 1000)).alias("d")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("block_id").agg(F.sum("d").alias("density"))


def sv_flags(boxes: DataFrame, svs: DataFrame) -> DataFrame:
    """The blocks that a structural variant overlaps."""
    b = boxes.select("block_id", N.contig_key(F.col("chrom")).alias("c"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    s = svs.select(N.contig_key(F.col("chrom")).alias("c"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return overlaps(b, s, ["c"], "b_start", "b_end", "s_start", "s_end").select("block_id").distinct()


def ks_histogram(kaks: DataFrame, low: float = 0.01, high: float = 3.0, width: float = 0.05) -> DataFrame:
    """(bin, n) of every bin, empty ones too."""
    bins = int(math.floor((high - low) / width)) + 1
    n = kaks.filter((F.col("ks") > low) & (F.col("ks") < high)).groupBy(F.floor((F.col("ks") - low) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = kaks.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(n.limit(bins)), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def ks_peaks(histogram: DataFrame, low: float = 0.01, width: float = 0.05, rate: float = 6.96e-9) -> DataFrame:
    """(bin, n, smooth, peak, ks, mya): 3-bin means, and whether one is above both neighbours and 1 % of the greatest. Bins are few."""
    w = W.Window.orderBy("bin")
    s = histogram.withColumn("smooth", F.avg("n").over(w.rowsBetween(-1, 1)))
    top = F.max("smooth").over(w.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing))
    peak = (F.col("smooth") > F.lag("smooth").over(w)) & (F.col("smooth") > F.lead("smooth").over(w)) & (F.col("smooth") >= top * 0.01)
    ks = low + (F.col("bin") + 0.5) * width
    return s.withColumn("peak", F.coalesce(peak, F.lit(False))).withColumn("ks", ks).withColumn("mya", N.divergence_mya(ks, rate))


def chromosome_ks(pairs: DataFrame, low: float = 0.01, high: float = 3.0) -> DataFrame:
    return pairs.filter((F.col("ks") > low) & (F.col("ks") < high)).groupBy("chrom1", "chrom2").agg(F.avg("ks").alias("mean_ks"), F.count(F.lit(1)).alias("n"))


def chromosome_tree(means: DataFrame, most: int = 2000) -> str | None:
    """Neighbour joining of chromosomes (G1_, G2_) by mean Ks; absent pairs are 1.5 times the greatest. None under 3, an error for more than `most` of a genome."""
    for k in (1, 2):
        if means.select(f"chrom{k}").distinct().limit(most + 1).count() > most:
            raise ValueError(f"more than {most} chromosomes")
    rows = means.collect()
    labels = sorted({f"G1_{r.chrom1}" for r in rows} | {f"G2_{r.chrom2}" for r in rows})
    if len(labels) < 3:
        return None
    place = {x: i for i, x in enumerate(labels)}
    d = np.full((len(labels),) * 2, max(r.mean_ks for r in rows) * 1.5)
    np.fill_diagonal(d, 0)
    for r in rows:
        i, j = place[f"G1_{r.chrom1}"], place[f"G2_{r.chrom2}"]
        d[i, j] = d[j, i] = r.mean_ks
    return neighbour_joining(d, labels)


def term_counts(background: DataFrame) -> DataFrame:
    """(term, n): the genes of each term, each once; of (gene_id, term)."""
    return background.filter(F.col("term").isNotNull()).groupBy("term").agg(F.countDistinct("gene_id").alias("n"))


def union_background(first: DataFrame, second: DataFrame) -> DataFrame:
    """(gene_id, term) of both genomes; a gene that is in both has the second's terms."""
    return first.join(second.select("gene_id").distinct(), "gene_id", "left_anti").select("gene_id", "term").unionByName(second.select("gene_id", "term"))


def go_enrichment(study: DataFrame, background: DataFrame, by: str = "block_id", most: float = 0.05) -> DataFrame:
    """(by, term, hits, draws, good, total, p, q): terms of (by, gene_id, term) against (gene_id, term); p under `most` before the rates are computed."""
    total = background.select("gene_id").distinct().count()
    good = term_counts(background).withColumnRenamed("n", "good")
    draws = study.groupBy(by).agg(F.countDistinct("gene_id").alias("draws"))
    k = study.filter(F.col("term").isNotNull()).groupBy(by, "term").agg(F.countDistinct("gene_id").alias("hits")).join(small(good), "term").join(small(draws), by)

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, good: pd.Series) -> pd.Series:
        known = {x: hypergeometric_sf(x[0], x[1], x[2], total) for x in set(zip(k.tolist(), n.tolist(), good.tolist()))}
        return pd.Series([known[x] for x in zip(k.tolist(), n.tolist(), good.tolist())])

    from .gwas import fdr

    found = k.withColumn("total", F.lit(total)).withColumn("p", tail("hits", "draws", "good")).filter(F.col("p") < most)
    return fdr(found, "p", [by], "term").drop("rank")


def super_matrix(ortho: DataFrame) -> DataFrame:
    """(block_id, ord, a, b): the aligned sequences of `ortholog_fasta`'s pairs; put end to end in this order, each side is one long sequence."""
    return ortho.withColumn("x", align_udf("seq1", "seq2")).select("block_id", "ord", "x.a", "x.b")


def top_terms(enriched: DataFrame, by: str = "block_id", n: int = 5) -> DataFrame:
    return enriched.withColumn("__r", F.row_number().over(W.Window.partitionBy(by).orderBy("p", "term"))).filter(F.col("__r") <= n).drop("__r")


def _sequences(pairs: DataFrame, s1: DataFrame, s2: DataFrame) -> DataFrame:
    """pairs with seq1 and seq2, by the gene's id or its first transcript's."""
    for k, s in ((1, s1), (2, s2)):
        plain = s.select(N.gene_key(F.col("seq_id")).alias("__k"), F.col("seq").alias("__a")).dropDuplicates(["__k"])
        pairs = pairs.withColumn("__k", N.gene_key(F.col(f"gene{k}"))).join(plain, "__k", "left").withColumn("__k", F.concat("__k", F.lit(".1"))).join(plain.withColumnRenamed("__a", "__b"), "__k", "left").withColumn(f"seq{k}", F.coalesce("__a", "__b")).drop("__k", "__a", "__b")
    return pairs


def kaks_pairs(pairs: DataFrame, cds1: DataFrame, cds2: DataFrame) -> DataFrame:
    """(gene1, gene2, ka, ks, ratio) of the pairs with both sequences; those of unequal length are aligned first."""
    p = _sequences(pairs.select("gene1", "gene2"), cds1, cds2).filter("seq1 is not null and seq2 is not null")
    same = p.filter(F.length("seq1") == F.length("seq2"))
    other = p.filter(F.length("seq1") != F.length("seq2")).withColumn("x", align_udf("seq1", "seq2")).select("gene1", "gene2", F.col("x.a").alias("seq1"), F.col("x.b").alias("seq2"))
    return same.select("gene1", "gene2", "seq1", "seq2").unionByName(other).withColumn("r", kaks_udf("seq1", "seq2")).select("gene1", "gene2", "r.ka", "r.ks", "r.ratio")


def ortholog_distance(pairs: DataFrame, s1: DataFrame, s2: DataFrame) -> DataFrame:
    """(gene1, gene2, identity, jukes_cantor)."""
    p = _sequences(pairs.select("gene1", "gene2"), s1, s2).filter("seq1 is not null and seq2 is not null")
    i = identity(F.col("seq1"), F.col("seq2"))
    return p.select("gene1", "gene2", i.alias("identity"), jukes_cantor(1 - i).alias("jukes_cantor"))


def ortholog_fasta(pairs: DataFrame, cds1: DataFrame, cds2: DataFrame, longer_than: int = 300, most: int = 5000) -> DataFrame:
    """(ord, gene1, gene2, seq1, seq2) of the first `most` pairs with a first sequence longer than that, for export."""
    p = _sequences(pairs.select("block_id", "ord", "gene1", "gene2"), cds1, cds2).filter((F.length("seq1") > longer_than) & F.col("seq2").isNotNull())
    return p.orderBy("block_id", "ord").limit(most)


def swapped(pairs: DataFrame, genes1: DataFrame, genes2: DataFrame, blocks: int = 100) -> bool:
    """Whether the first genes of some blocks are those of the second genome rather than the first."""
    first = pairs.filter(F.col("ord") == 1).orderBy("block_id").limit(blocks).select(N.gene_key(F.col("gene1")).alias("gene_id"))
    return first.join(genes2, "gene_id", "left_semi").count() > first.join(genes1, "gene_id", "left_semi").count()
