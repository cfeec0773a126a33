"""Statistics and filters of sites with any number of alleles, from the texts of their calls.

A batch has few different genotype texts. They are read once each; whatever is counted of a site is then a sum over
the numbers of its calls' texts, so no call is handled by itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions.kernels import hwe
from .sites import hwe_polyploid

#: Samples that a site must have for the test of Hardy-Weinberg proportions.
LEAST_TESTED = 5
#: What is counted of each sample.
SAMPLE_COUNTS = ("missing", "genotyped", "hom_ref", "hom_alt", "het", "non_ref")
_COUNTS = ("samples", "missing", "n00", "n01", "n11")


class _Kinds:
    """The different genotype texts of a batch, read by one of two rules."""

    def __init__(self, texts: list[str], strict: bool):
        n = len(texts)
        self.missing, self.het, self.ref, self.two, self.dot = (np.zeros(n, bool) for _ in range(5))
        self.both_ref, self.both_alt = np.zeros(n, bool), np.zeros(n, bool)
        held: list[list[int]] = []
        for i, text in enumerate(texts):
            names = text.replace("|", "/").split("/")
            absent = text.startswith(".") if not strict else text == "." or text.startswith("./")
            self.missing[i] = absent
            seen = []
            for x in [] if absent else names:
                if x.isdigit():
                    seen.append(int(x))
                elif strict:  # what stands before a missing allele has been counted
                    self.dot[i] = True
                    break
            held.append(seen)
            self.het[i], self.ref[i] = len(set(names)) > 1, names[0] == "0"
            self.two[i] = len(names) == 2 and not absent and not self.dot[i]
            self.both_ref[i], self.both_alt[i] = names == ["0", "0"], names == ["1", "1"]
        self.top = np.array([max(x, default=-1) for x in held], int)
        self.copies = np.zeros((n, int(self.top.max(initial=-1)) + 1), np.int64)
        for i, seen in enumerate(held):
            for a in seen:
                self.copies[i, a] += 1


def _texts(calls: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of an array of calls' texts by site: the site and the kind of each call, and the kinds' genotypes."""
    flat = pc.list_flatten(calls)
    row = np.asarray(pc.list_parent_indices(calls)).astype(np.int64)
    gt = pc.list_element(pc.split_pattern(pc.fill_null(flat, "."), ":", max_splits=1), 0)
    kinds = gt.dictionary_encode()
    return row, np.asarray(kinds.indices).astype(np.int64), kinds.dictionary.to_pylist()


def genotype_counts(sites: DataFrame, strict: bool = False) -> DataFrame:
    """sites with `samples`, `missing`, `alleles` (copies of each allele, the reference's first), `n00`, `n01`, `n11`.

    sites: calls (an array of texts that begin with the genotype) and alt. A call that begins with `.` is missing.
    strict, the rule of filters: one that is `.` or begins with `./` is missing, and so is one with a later missing
    allele or an allele that the site doesn't have, though the alleles that it does have are counted. n00, n01,
    n11: calls of two alleles at sites with one alternate: both the reference, both the alternate, others. Null
    calls are missing; null or empty arrays give 0 samples."""
    columns = sites.columns
    extra = "samples long, missing long, n00 long, n01 long, n11 long, alleles array<long>"
    names = [c for c in columns if c.lower() not in {"samples", "missing", "n00", "n01", "n11", "alleles"}]
    at_calls, at_alt = names.index("calls"), names.index("alt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, kind, texts = _texts(batch.column(at_calls))
            k = _Kinds(texts, strict)
            alt = pc.fill_null(batch.column(at_alt), ".")
            others = np.where(np.asarray(pc.equal(alt, ".")), 0, np.asarray(pc.count_substring(alt, ",")) + 1)
            beyond = k.top[kind] > others[row]
            missing = k.missing[kind] | ((k.dot[kind] | beyond) if strict else False)
            total = lambda hit: np.bincount(row[hit], minlength=n)
            diploid = k.two[kind] & (others[row] == 1) & ~(missing if strict else k.missing[kind])
            ref, both = k.both_ref[kind], k.both_alt[kind]
            counts = [np.bincount(row, minlength=n), total(missing), total(diploid & ref), total(diploid & ~ref & ~both), total(diploid & both)]
            width = others + 1
            ends = np.concatenate(([0], np.cumsum(width)))
            copies = np.zeros(int(ends[-1]), np.int64)
            for a in range(k.copies.shape[1]):
                has = np.flatnonzero(width > a)
                copies[ends[:-1][has] + a] = np.bincount(row, k.copies[kind, a], n)[has].astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(copies))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.astype(np.int64)) for c in counts), lists], names=[*names, *_COUNTS, "alleles"])

    kept = sites.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{kinds}, {extra}")


def _shares(counts: Column) -> tuple[Column, Column, Column]:
    """Of allele counts their total, the least share of an allele that is there, and the expected heterozygosity."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda s, x: s + x)
    least = F.array_min(F.filter(counts, lambda x: x > 0)) / total
    return total, F.when(total > 0, least), F.when(total > 0, 1 - F.aggregate(counts, F.lit(0.0), lambda s, x: s + x / total * (x / total)))


def statistics(sites: DataFrame) -> DataFrame:
    """genotype_counts with `maf`, `eh`, `transition` (null unless a site of one alternate base has called alleles), `chi2` and `hwe_p` of those with LEAST_TESTED samples or more.

    maf is 1 for a site with one allele, as it is the least share that isn't 0."""
    g = genotype_counts(sites)
    total, maf, eh = _shares(F.col("alleles"))
    pair = C.biallelic_snp(F.col("ref"), F.col("alt")) & (total > 0)
    n = F.col("n00") + F.col("n01") + F.col("n11")
    p = (2 * F.col("n00") + F.col("n01")) / F.nullif(2.0 * n, F.lit(0.0))
    e = 2 * p * (1 - p) * n
    tested = F.coalesce(pair, F.lit(False)) & (F.col("samples") >= LEAST_TESTED)
    g = g.withColumn("maf", maf).withColumn("eh", eh).withColumn("transition", F.when(pair, C.transition(F.col("ref"), F.col("alt"))))
    g = g.withColumn("chi2", F.when(tested, F.coalesce(F.when(e > 0, F.pow(F.col("n01") - e, 2) / e), F.lit(0.0))))
    return g.withColumn("hwe_p", F.when(tested, hwe("n00", "n01", "n11")))


def summary(stats: DataFrame) -> DataFrame:
    """One row: variants, snps, indels, transitions, transversions, mono, bi, multi, mean_eh, hwe_tested, hwe_violations (exact p under 0.05), mean_chi2, segregating."""
    n = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    snp, kind, tv = C.is_snp(F.col("ref"), F.col("alt")), C.allele_class(F.col("alt")), F.col("transition")
    return stats.agg(
        F.count(F.lit(1)).alias("variants"), n(snp, "snps"), n(~snp, "indels"), n(tv, "transitions"), n(~tv, "transversions"),
        *(n(kind == k, k) for k in ("mono", "bi", "multi")),
        F.avg("eh").alias("mean_eh"), F.count("hwe_p").alias("hwe_tested"), n(F.col("hwe_p") < 0.05, "hwe_violations"), F.avg("chi2").alias("mean_chi2"), n(F.col("maf") > 0, "segregating"),
    )


def histograms(stats: DataFrame) -> DataFrame:
    """(kind, bin, n): missing by tenths, maf by hundredths (50 bins), eh by tenths, chi2 by 2, 3.84, 7 and 10; the last bin has what lies beyond."""
    share = F.when(F.col("samples") > 0, F.col("missing") / F.col("samples"))
    even = lambda c, step, bins: F.when(c.isNotNull(), F.least(F.floor(c * step), F.lit(bins - 1)).cast("int"))
    x = F.col("chi2")
    chi2 = F.when(x < 2, 0).when(x < 3.84, 1).when(x < 7, 2).when(x < 10, 3).when(x >= 10, 4)
    bins = {"missing": even(share, 10, 10), "maf": even(F.col("maf"), 100, 50), "eh": even(F.col("eh"), 10, 10), "chi2": chi2}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.when(b >= 0, b).alias("bin")) for k, b in bins.items())))
    return stats.select(each.alias("x")).select("x.*").filter("bin is not null").groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"))


def sample_counts(sites: DataFrame, by: str | None = None) -> DataFrame:
    """(sample, missing, genotyped, hom_ref, hom_alt, het, non_ref): by the place in `calls`, or by the column `by` that all calls of a row belong to.

    Every task sends one row a sample."""
    if by is not None:
        return _counts_by(sites, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, len(SAMPLE_COUNTS)), np.int64)
        for batch in batches:
            calls = batch.column(0)
            row, kind, texts = _texts(calls)
            if not len(row):
                continue
            k = _Kinds(texts, False)
            size = np.asarray(pc.fill_null(pc.list_value_length(calls), 0)).astype(np.int64)
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            if size.max() > len(total):
                total = np.pad(total, ((0, int(size.max()) - len(total)), (0, 0)))
            for i, hit in enumerate(_flags(k, kind)):
                total[:, i] += np.bincount(place[hit], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(c) for c in total.T.copy())], names=["sample", *SAMPLE_COUNTS])

    parts = sites.select("calls").mapInArrow(run, "sample int, " + ", ".join(f"{c} long" for c in SAMPLE_COUNTS))
    return parts.groupBy("sample").agg(*(F.sum(c).alias(c) for c in SAMPLE_COUNTS))


def _flags(k: _Kinds, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which calls count as each of SAMPLE_COUNTS."""
    called, het, ref = ~k.missing[kind], k.het[kind], k.ref[kind]
    return ~called, called, called & ~het & ref, called & ~het & ~ref, called & het, called & (het | ~ref)


def _counts_by(sites: DataFrame, by: str) -> DataFrame:
    schema = sites.select(F.col(by).alias("sample")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kind, texts = _texts(batch.column(1))
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            at = np.asarray(keys.indices)[row]
            flags = _flags(_Kinds(texts, False), kind)
            n = len(keys.dictionary)
            yield pa.RecordBatch.from_arrays([keys.dictionary, *(pa.array(np.bincount(at[hit], minlength=n).astype(np.int64)) for hit in flags)], names=["sample", *SAMPLE_COUNTS])

    parts = sites.select(by, "calls").mapInArrow(run, f"sample {schema[0].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in SAMPLE_COUNTS))
    return parts.groupBy("sample").agg(*(F.sum(c).alias(c) for c in SAMPLE_COUNTS))


def sample_report(counts: DataFrame, mean_eh: DataFrame, variants: int) -> DataFrame:
    """The table of samples as text of 15 columns: sample, line.

    counts: sample_counts with `name`. mean_eh: one row. Depths, rare alleles, transitions and
    transversions of a sample are 0, as they are in the format's model."""
    het = F.when(F.col("genotyped") > 0, F.col("het") / F.col("genotyped")).otherwise(0.0)
    t = counts.crossJoin(F.broadcast(mean_eh.select("mean_eh").limit(1)))
    f = F.when(F.col("mean_eh") > 0, 1 - het / F.col("mean_eh")).otherwise(0.0)
    number = lambda c, places: F.format_string(f"%.{places}f", c)
    zero = F.lit(0.0)
    columns = [F.col("name"), number(zero, 2), F.col("missing").cast("string"), number(F.col("missing") / F.lit(float(max(variants, 1))) * 100, 2)]
    columns += [F.col(c).cast("string") for c in ("genotyped", "hom_ref", "hom_alt", "het", "non_ref")]
    columns += [F.lit("0"), F.lit("0"), F.lit("0"), number(zero, 3), number(het, 4), number(f, 4)]
    return t.select("sample", F.concat_ws("\t", *columns).alias("line"))


def filter_calls(sites: DataFrame, ploidy: int = 2, min_maf: float = 0.0, max_missing: float = 1.0, min_eh: float = 0.0, min_hwe_p: float = 0.0, biallelic_only: bool = False, min_depth: int = 0, strict: bool = False) -> DataFrame:
    """The sites that pass, with `missing` (a share), `maf` and `eh`; sites without any called allele don't.

    Biallelic SNPs of a ploidy over 2 count copies by reads: a sample under min_depth, or without reads, is
    missing, and with strict one whose genotype begins with `.` is, whatever its reads. All other sites count the
    alleles of the genotypes. The test of proportions is made for biallelic SNPs with 5 genotypes or more.
    `max_missing_of` turns a least number of genotyped samples into max_missing."""
    pair = F.coalesce(C.biallelic_snp(F.col("ref"), F.col("alt")), F.lit(False))
    if biallelic_only:
        sites = sites.filter(pair)
    given = sites.columns
    by_reads = pair if ploidy > 2 else F.lit(False)
    if ploidy > 2:
        # before the genotypes are counted: what comes out of that is a column that no later step computes again
        reads = lambda c: C.alt_fraction(C.read_counts(c, F.col("format"), F.col("ref"), F.col("alt")), min_depth)
        kept = (lambda c: F.when(~c.startswith("."), reads(c))) if strict else reads
        sites = sites.withColumn("__d", F.when(by_reads, F.transform("calls", kept)))
    g = genotype_counts(sites, strict=True)
    counts, missing, p = F.transform("alleles", lambda x: x.cast("double")), F.col("missing"), F.when(pair & (F.col("n00") + F.col("n01") + F.col("n11") >= LEAST_TESTED), hwe("n00", "n01", "n11"))
    if ploidy > 2:
        held = F.filter("__d", lambda x: x.isNotNull())
        alt = F.aggregate(held, F.lit(0.0), lambda s, x: s + C.copies(x, ploidy))
        counts = F.when(by_reads, F.array(F.size(held) * float(ploidy) - alt, alt)).otherwise(counts)
        missing = F.when(by_reads, F.size("__d") - F.size(held)).otherwise(missing)
        p = F.when(by_reads, hwe_polyploid(F.col("__d"), ploidy))
    total, maf, eh = _shares(F.col("__n"))
    g = g.withColumn("__n", counts).withColumn("missing", F.when(F.col("samples") > 0, missing / F.col("samples")))
    g = g.withColumn("maf", maf).withColumn("eh", eh)
    out = g.filter((F.col("missing") <= max_missing) & (total > 0) & (F.col("maf") >= min_maf) & (F.col("eh") >= min_eh))
    if min_hwe_p > 0:
        out = out.filter(F.coalesce(p >= min_hwe_p, F.lit(True)))
    return out.select(*given, *(c for c in ("missing", "maf", "eh") if c not in given))


def max_missing_of(samples: int, least: int) -> float:
    """The greatest share of missing calls if `least` of so many samples must be genotyped."""
    return (samples - least) / samples if samples else 1.0
