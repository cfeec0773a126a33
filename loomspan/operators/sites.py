"""Statistics and filters of sites. Sites are rows with arrays over the samples; nothing here shuffles but the group-bys of a summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions.kernels import chi2_sf_wh, hwe
from .fill import dense

_SUM = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def missing_share(d: Column) -> Column:
    return F.size(F.filter(d, lambda x: x.isNull())) / F.size(d)


def dosage_counts(d: Column, ploidy: int) -> Column:
    """(reference, alternate) copies over the samples, each dosage rounded to whole copies."""
    alt = _SUM(F.transform(F.filter(d, lambda x: x.isNotNull()), lambda x: C.copies(x, ploidy).cast("double")))
    n = F.size(F.filter(d, lambda x: x.isNotNull())) * float(ploidy)
    return F.array(n - alt, alt)


def gt_allele_counts(calls: Column, fmt: Column) -> Column:
    """Copies of each allele over the calls, in the order of allele numbers; calls that begin with a missing allele don't count."""
    place = C.tag_place(fmt, "GT")
    every = F.flatten(F.transform(calls, lambda c: F.when(C.subfield(c, place).startswith("."), F.array().cast("array<string>")).otherwise(C.alleles(C.subfield(c, place)))))
    kinds = F.array_sort(F.array_distinct(every))
    return F.transform(kinds, lambda k: F.size(F.filter(every, lambda x: x == k)).cast("double"))


def maf(counts: Column, strict: bool = False) -> Column:
    """The least allele count above 0, as a share: 1 for a site with one allele; strict: 0 for it."""
    held = F.filter(counts, lambda c: c > 0)
    m = F.array_min(held) / _SUM(counts)
    return F.when(F.size(held) > 1, m).otherwise(0.0) if strict else m


def expected_heterozygosity(counts: Column) -> Column:
    n = _SUM(counts)
    return F.when(n > 0, 1 - _SUM(F.transform(counts, lambda c: c / n * (c / n))))


def hwe_polyploid(d: Column, ploidy: int, least: int = 5) -> Column:
    """p of chi-square against the binomial spectrum of whole dosages; null under `least` samples."""
    k = F.transform(F.filter(d, lambda x: x.isNotNull()), lambda x: C.copies(x, ploidy).cast("int"))
    n = F.size(k)
    q = _SUM(F.transform(k, lambda x: x.cast("double"))) / (n * float(ploidy))
    from math import comb

    expect = lambda i: F.greatest(F.lit(float(comb(ploidy, i))) * F.pow(q, F.lit(i)) * F.pow(1 - q, F.lit(ploidy - i)) * n, F.lit(1e-5))
    x2 = sum((F.pow(F.size(F.filter(k, lambda x, i=i: x == i)) - expect(i), 2) / expect(i) for i in range(ploidy + 1)), F.lit(0.0))
    return F.when(n >= least, chi2_sf_wh(x2, ploidy - 1))


def site_stats(sites: DataFrame, ploidy: int) -> DataFrame:
    """sites with missing, maf, eh; columns of these names are replaced. A site without arrays has null in all three.

    The three come from one pass over the dosages of a batch, as a matrix, and no later filter computes them again."""
    kept = sites.select(*(c for c in sites.columns if c.lower() not in ("missing", "maf", "eh")))
    place = kept.columns.index("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column(place))
            size = np.asarray(pc.fill_null(pc.list_value_length(batch.column(place)), 0)).astype(float)
            held = ~np.isnan(x)
            n = held.sum(1)
            alt = np.floor(np.where(held, x, 0.0) * ploidy + 0.5).sum(1, where=held)
            total = n * float(ploidy)
            ref = total - alt
            with np.errstate(invalid="ignore", divide="ignore"):
                missing = (size - n) / size
                maf = np.where((alt > 0) & (ref > 0), np.minimum(alt, ref) / total, np.where(total > 0, 1.0, np.nan))
                eh = np.where(total > 0, 1 - (ref / total) ** 2 - (alt / total) ** 2, np.nan)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, mask=np.isnan(v)) for v in (missing, maf, eh))], names=[*batch.schema.names, "missing", "maf", "eh"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{kinds}, missing double, maf double, eh double")


def filter_sites(sites: DataFrame, ploidy: int, min_maf: float = 0.0, max_missing: float = 1.0, min_eh: float = 0.0, min_hwe_p: float = 0.0, biallelic_only: bool = False, top_n: int = -1, strict_maf: bool = False) -> DataFrame:
    """The sites that pass, with missing, maf and eh; cheap rules before those that decode samples.

    Sites need row_id and d; ref and alt for biallelic_only. top_n keeps those of the greatest eh (ties to the
    first row) in their original order. Without any genotyped sample a site fails min_eh."""
    if biallelic_only:
        sites = sites.filter(C.biallelic_snp(F.col("ref"), F.col("alt")))
    out = site_stats(sites, ploidy).filter((F.col("missing") <= max_missing) & (F.col("maf") >= min_maf) & F.col("eh").isNotNull() & (F.col("eh") >= min_eh))
    if min_hwe_p > 0:
        out = out.filter(F.coalesce(hwe_polyploid(F.col("d"), ploidy) >= min_hwe_p, F.lit(True)))
    return top_by_eh(out, top_n) if top_n >= 0 else out


def top_by_eh(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.col("eh").desc(), "row_id").limit(n).orderBy("row_id")


def histogram(stats: DataFrame, value: str, bins: int, top: float = 1.0) -> DataFrame:
    """(bin, n), the last bin closed; null values don't count."""
    b = F.greatest(F.least(F.floor(F.col(value) / top * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return stats.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(variants: DataFrame, ref: str = "ref", alt: str = "alt") -> DataFrame:
    """One row: variants, snps, indels, transitions, transversions, mono, bi, multi."""
    r, a = F.col(ref), F.col(alt)
    snp, two = C.is_snp(r, a), C.biallelic_snp(r, a)
    n = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    return variants.agg(F.count(F.lit(1)).alias("variants"), n(snp, "snps"), n(~snp, "indels"), n(two & C.transition(r, a), "transitions"), n(two & ~C.transition(r, a), "transversions"), *(n(C.allele_class(a) == k, k) for k in ("mono", "bi", "multi")))


def density(variants: DataFrame, width: int = 1_000_000) -> DataFrame:
    return variants.groupBy("chrom", F.floor(F.col("pos") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sample_summary(calls: DataFrame, sample: str, gt: str) -> DataFrame:
    """Per sample: calls, missing, het, hom_ref, hom_alt, observed heterozygosity."""
    z = calls.select(sample, C.zygosity(F.col(gt)).alias("z"))
    n = lambda k: F.count_if(F.col("z") == k)
    return z.groupBy(sample).agg(F.count(F.lit(1)).alias("calls"), n("missing").alias("missing"), n("het").alias("het"), n("hom_ref").alias("hom_ref"), n("hom_alt").alias("hom_alt"), F.when(F.count_if(F.col("z") != "missing") > 0, n("het") / F.count_if(F.col("z") != "missing")).alias("obs_het"))


def mean_heterozygosity(calls: DataFrame, site: list[str], gt: str) -> DataFrame:
    """One row: mean_eh, the mean over the sites of what is expected by the shares of their alleles; sites without a called allele don't count."""
    a = calls.select(*site, F.explode(C.alleles(F.col(gt))).alias("__a")).groupBy(*site, "__a").agg(F.count(F.lit(1)).alias("__n"))
    eh = a.groupBy(*site).agg((1 - F.sum(F.col("__n") * F.col("__n")) / (F.sum("__n") * F.sum("__n"))).alias("eh"))
    return eh.agg(F.avg("eh").alias("mean_eh"))


def inbreeding(summary: DataFrame, mean_eh: DataFrame) -> DataFrame:
    """summary with f = 1 - observed / mean expected heterozygosity (one row: mean_eh)."""
    return summary.crossJoin(F.broadcast(mean_eh.limit(1))).withColumn("f", F.when(F.col("mean_eh") > 0, 1 - F.col("obs_het") / F.col("mean_eh"))).drop("mean_eh")


def hwe_summary(calls: DataFrame, site: list[str], gt: str) -> DataFrame:
    """Per site of 5 diploid calls or more: counts, exact p and chi-square of heterozygotes."""
    a = C.alleles(F.col(gt))
    z = calls.filter((F.size(a) == 2) & F.forall(a, lambda x: x.isin("0", "1"))).select(*site, F.size(F.filter(a, lambda x: x == "1")).alias("k"))
    n = z.groupBy(*site).agg(*(F.count_if(F.col("k") == i).alias(f"n{i}") for i in range(3))).filter("n0 + n1 + n2 >= 5")
    p = (2 * F.col("n0") + F.col("n1")) / (2 * (F.col("n0") + F.col("n1") + F.col("n2")))
    e = 2 * p * (1 - p) * (F.col("n0") + F.col("n1") + F.col("n2"))
    return n.withColumn("chi2", F.when(e > 0, (F.col("n1") - e) * (F.col("n1") - e) / e)).withColumn("p", hwe(F.col("n0"), F.col("n1"), F.col("n2")))


def tajima(sites: DataFrame, ploidy: int) -> DataFrame:
    """One row: segregating sites, pi, copies n, Watterson's theta, D. A site of one allele counts as segregating, as its least share is 1."""
    c = dosage_counts(F.col("d"), ploidy)
    s = sites.select(c.alias("c")).select((F.get("c", F.lit(0)) + F.get("c", F.lit(1))).alias("n"), F.get("c", F.lit(0)).alias("r")).filter("n > 1").withColumn("p", F.col("r") / F.col("n"))
    t = s.agg(F.count(F.lit(1)).alias("s"), F.sum(2 * F.col("p") * (1 - F.col("p")) * F.col("n") / (F.col("n") - 1)).alias("pi"), F.round(F.avg("n")).cast("long").alias("n"))
    up = F.sequence(F.lit(1).cast("long"), F.greatest(F.col("n") - 1, F.lit(1)))
    t = t.withColumn("a1", _SUM(F.transform(up, lambda i: 1.0 / i))).withColumn("a2", _SUM(F.transform(up, lambda i: 1.0 / (i * i))))
    n, a1, a2 = F.col("n"), F.col("a1"), F.col("a2")
    e1 = ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1
    e2 = (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2)
    var = e1 * F.col("s") + e2 * F.col("s") * (F.col("s") - 1)
    return t.select("s", "pi", "n", (F.col("s") / a1).alias("theta"), F.when(var > 0, (F.col("pi") - F.col("s") / a1) / F.sqrt(var)).alias("d"))


def fst_pairs(long: DataFrame) -> DataFrame:
    """(pop1, pop2, ht, hs, fst) from (site, pop, copies, alt): means over the sites where both are observed, Ht of the whole panel."""
    by = long.groupBy("site", "pop").agg(F.sum("copies").alias("n"), F.sum("alt").alias("a")).filter("n > 0")
    sites = by.groupBy("site").agg((F.sum("a") / F.sum("n")).alias("q"), F.collect_list(F.struct("pop", (F.col("a") / F.col("n")).alias("f"))).alias("pops"))
    # populations are few; their pairs are made within a site, without a join
    pairs = sites.select("q", F.explode(F.flatten(F.transform("pops", lambda x: F.transform(F.filter("pops", lambda y: y["pop"] > x["pop"]), lambda y: F.struct(x["pop"].alias("pop1"), y["pop"].alias("pop2"), x["f"].alias("f1"), y["f"].alias("f2")))))).alias("x")).select("q", "x.*")
    h = lambda f: 2 * f * (1 - f)
    m = pairs.groupBy("pop1", "pop2").agg(F.avg(h(F.col("q"))).alias("ht"), F.avg((h(F.col("f1")) + h(F.col("f2"))) / 2).alias("hs"))
    return m.withColumn("fst", F.when(F.col("ht") > 0, (F.col("ht") - F.col("hs")) / F.col("ht")))


def fst_clusters(long: DataFrame) -> DataFrame:
    """(site, fst) among all populations of (site, pop, copies, alt); 0 where the whole is nearly of one allele."""
    by = long.groupBy("site", "pop").agg(F.sum("copies").alias("n"), F.sum("alt").alias("a")).filter("n > 0")
    q, f = F.sum("a") / F.sum("n"), F.col("a") / F.col("n")
    m = by.groupBy("site").agg((2 * q * (1 - q)).alias("ht"), (F.sum(2 * f * (1 - f) * F.col("n")) / F.sum("n")).alias("hs"))
    return m.select("site", F.when(F.col("ht") < 1e-4, 0.0).otherwise((F.col("ht") - F.col("hs")) / F.col("ht")).alias("fst"))
