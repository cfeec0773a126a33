"""Decoding of calls: counts of reads, dosages, zygosity, classes of sites. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of dosage; they differ on purpose, as their uses do.
RULES = ("counts_then_gt", "counts", "gt_then_counts", "gt_digits", "ref_fraction")


def tag_place(fmt: Column, tag: str) -> Column:
    """1-based place of a tag in FORMAT, 0 if it isn't there."""
    return F.coalesce(F.array_position(F.split(fmt, ":"), tag), F.lit(0)).cast("int")


def subfield(call: Column, place: Column) -> Column:
    return F.when(place > 0, F.get(F.split(call, ":"), place - 1))


def _count(x: Column, dot_is_zero: bool = False) -> Column:
    n = x.try_cast("double")
    return F.when(F.trim(x) == ".", F.lit(0.0)).otherwise(n) if dot_is_zero else n


def _base(parts: Column, allele: Column) -> Column:
    at = F.when(F.length(allele) == 1, F.instr(F.lit("ACGT"), F.upper(allele)))
    return F.when(at > 0, _count(F.get(parts, at - 1)))


def _pair(ref: Column, alt: Column) -> Column:
    return F.when(ref.isNotNull() & alt.isNotNull(), F.struct(ref.alias("ref"), alt.alias("alt")))


def read_counts(call: Column, fmt: Column, ref: Column, alt: Column, caller: str = "any") -> Column:
    """Struct (ref, alt) of read counts, or null.

    any: base counts, else ref and alternate depths, else observations, whichever is readable first. Base
    counts of four values are those of A, C, G, T; of other lengths, the alternate's and the reference's.
    auto: the kind is chosen by the tags that are there, with a fourth kind (ADP), and isn't changed if
    unreadable. bsdp, ad, ro: that kind only."""
    alt1 = F.get(F.split(alt, ","), F.lit(0))
    b, a, p, r, o = (subfield(call, tag_place(fmt, t)) for t in ("BSDP", "AD", "ADP", "RO", "AO"))
    parts = F.split(b, ",")
    four = F.size(parts) == 4
    bsdp = F.when(b.isNotNull() & (b != "."), F.when(four, _pair(_base(parts, ref), _base(parts, alt1))).when(F.size(parts) >= 2, _pair(_count(F.get(parts, F.lit(1))), _count(F.get(parts, F.lit(0))))))
    depth = lambda x, zero: F.when(x.isNotNull() & (x != "."), _pair(_count(F.get(F.split(x, ","), F.lit(0)), zero), _count(F.get(F.split(x, ","), F.lit(1)), zero)))
    seen = _pair(_count(r), _count(F.get(F.split(o, ","), F.lit(0))))
    has = lambda t: tag_place(fmt, t) > 0
    if caller == "any":
        return F.coalesce(bsdp, depth(a, True), seen)
    if caller == "auto":
        return F.when(has("BSDP"), bsdp).when(has("AD"), depth(a, False)).when(has("ADP"), depth(p, False)).when(has("RO") & has("AO"), seen)
    return {"bsdp": bsdp, "ad": depth(a, True), "ro": seen}[caller]


def alleles(gt: Column) -> Column:
    """The alleles of a genotype, missing ones left out."""
    return F.filter(F.split(gt, r"[/|]"), lambda x: (x != ".") & (x != ""))


def gt_counts(gt: Column) -> Column:
    """Struct (ref, alt) of allele copies in the genotype; null if it begins with a missing allele."""
    a = alleles(gt)
    return F.when(gt.isNotNull() & ~gt.startswith("."), F.struct(F.size(F.filter(a, lambda x: x == "0")).cast("double").alias("ref"), F.size(F.filter(a, lambda x: x != "0")).cast("double").alias("alt")))


def alt_fraction(counts: Column, min_depth: int = 0) -> Column:
    total = counts["ref"] + counts["alt"]
    return F.when((total >= min_depth) & (total > 0), counts["alt"] / total)


def dosage(call: Column, fmt: Column, ref: Column, alt: Column, rule: str, ploidy: int = 2, min_depth: int = 0, caller: str = "any") -> Column:
    """The dosage of a call by one of RULES; null is missing.

    counts_then_gt: fraction of the alternate by reads, else by genotype. counts: by reads only.
    gt_then_counts: copies of the alternate by genotype (a missing allele counts), else reads times ploidy.
    gt_digits: digits 1 to 9 in the first subfield. ref_fraction: of the reference, reads else genotype."""
    gt = subfield(call, tag_place(fmt, "GT"))
    reads = read_counts(call, fmt, ref, alt, caller)
    if rule == "counts_then_gt":
        return alt_fraction(F.coalesce(reads, gt_counts(gt)), min_depth)
    if rule == "counts":
        return alt_fraction(reads, min_depth)
    if rule == "gt_then_counts":
        copies = F.when(gt.isNotNull() & ~gt.startswith("."), F.size(F.filter(F.split(gt, r"[/|]"), lambda x: x != "0")).cast("double"))
        return F.coalesce(copies, alt_fraction(reads, min_depth) * ploidy)
    if rule == "gt_digits":
        first = F.get(F.split(call, ":"), F.lit(0))
        return F.when(~call.startswith("."), F.length(F.regexp_replace(first, "[^1-9]", "")).cast("double"))
    if rule == "ref_fraction":
        whole = F.size(F.split(gt, r"[/|]"))
        by_gt = F.when(gt.isNotNull() & ~gt.startswith("."), F.size(F.filter(F.split(gt, r"[/|]"), lambda x: x == "0")) / whole)
        return F.coalesce(1 - alt_fraction(reads), by_gt)
    raise ValueError(rule)


def to_level(d: Column, ploidy: int) -> Column:
    """The nearest k / n, n = max(ploidy, 2); halves go down."""
    n = max(ploidy, 2)
    return F.ceil(d * n - 0.5) / n


def copies(fraction: Column, ploidy: int) -> Column:
    """Copies of the alternate, halves up."""
    return F.floor(fraction * ploidy + 0.5)


def acgt(ref_fraction: Column, ref: Column, alt: Column, ploidy: int) -> Column:
    """The genotype as a text of ploidy letters, the reference's first; N if missing."""
    n = F.floor(ref_fraction * ploidy + 0.5).cast("int")
    return F.coalesce(F.concat(F.repeat(ref, n), F.repeat(F.get(F.split(alt, ","), F.lit(0)), F.lit(ploidy) - n)), F.lit("N" * ploidy))


def is_snp(ref: Column, alt: Column) -> Column:
    """One base against a first alternate of one base, or against none."""
    return (F.length(ref) == 1) & (F.length(F.get(F.split(alt, ","), F.lit(0))) == 1)


def allele_class(alt: Column) -> Column:
    """mono, bi or multi; null without a field."""
    return F.when(alt == ".", "mono").when(~alt.contains(","), "bi").when(alt.contains(","), "multi")


def biallelic_snp(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1) & (alt != ".")


def transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def zygosity(gt: Column) -> Column:
    """missing, het, hom_ref or hom_alt; missing alleles of a partly missing genotype are ignored."""
    a = alleles(gt)
    return F.when(gt.isNull() | (F.size(a) == 0), "missing").when(F.size(F.array_distinct(a)) > 1, "het").when(F.get(a, F.lit(0)) == "0", "hom_ref").otherwise("hom_alt")


def marker_id(vcf_id: Column, chrom: Column, pos: Column, sep: str = ":") -> Column:
    return F.when(vcf_id.isNull() | (vcf_id == "."), F.concat(chrom, F.lit(sep), pos.cast("string"))).otherwise(vcf_id)


def carriers(calls: Column) -> Column:
    """Share of the called samples whose genotype text has a 1."""
    gts = F.transform(calls, lambda c: F.get(F.split(c, ":"), F.lit(0)))
    called = F.size(F.filter(gts, lambda g: ~g.startswith(".")))
    return F.when(called > 0, F.size(F.filter(gts, lambda g: ~g.startswith(".") & g.contains("1"))) / called)
