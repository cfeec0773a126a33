"""Sequences: codons, complements, GC, identity, primer flanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code.
#: Amino acids in the order of codons over TCAG.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def amino(codon: Column, unknown: str = "X") -> Column:
    at = lambda k: F.instr(F.lit("TCAG"), F.substring(F.upper(codon), k, 1)) - 1
    known = F.upper(codon).rlike("^[TCAG]{3}$")
    return F.when(known, F.substring(F.lit(AMINO), 16 * at(1) + 4 * at(2) + at(3) + 1, 1)).otherwise(unknown)


def codons(seq: Column) -> Column:
    return F.regexp_extract_all(seq, F.lit("(...)"), 1)


def translate(seq: Column, unknown: str = "X") -> Column:
    return F.array_join(F.transform(codons(seq), lambda c: amino(c, unknown)), "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def gc(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.length(F.regexp_replace(seq, "[^GCgc]", "")) / F.length(seq))


def identity(a: Column, b: Column) -> Column:
    """Share of equal letters over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when(n > 0, same / n)


def jukes_cantor(p: Column) -> Column:
    """Distance from the share of differences; 3 from 0.75 on."""
    return F.when(p >= 0.75, 3.0).otherwise(-0.75 * F.log(1 - 4 * p / 3))


def kasp_score(neighbours: Column, gc_share: Column) -> Column:
    """100 less 20 for each SNP nearby (itself too) and 30 for extreme GC, at least 0."""
    return F.greatest(F.lit(0), 100 - 20 * neighbours - F.when((gc_share < 0.3) | (gc_share > 0.7), 30).otherwise(0))


def kasp_stars(score: Column) -> Column:
    return F.when(score >= 80, "★★★").when(score >= 50, "★★").otherwise("★")
