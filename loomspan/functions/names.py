"""Names: chromosomes, genes, descriptions, presets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chromosome_key(c: Column) -> Column:
    """Lower case without `chromosome` or `chr`, one separator and leading zeros."""
    low = F.regexp_replace(F.lower(F.trim(c)), "^(chromosome|chr)", "")
    bare = F.regexp_replace(F.regexp_replace(low, "^[_-]", ""), "^0+(?=.)", "")
    return bare


def contig_key(c: Column) -> Column:
    """As chromosome_key, but also of contigs and scaffolds, with nothing but letters and digits left."""
    low = F.regexp_replace(F.lower(F.trim(c)), "^(chromosome|chr|contig|scaffold)_?", "")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]", ""), "^0+(?=.)", "")


def gene_key(c: Column) -> Column:
    # The prefixes of ids.
    return F.regexp_replace(c, "(?i)^(gene:|mrna:|transcript:)", "")


def base_keys(c: Column) -> Column:
    """The forms under which a gene may be found, best first."""
    bare = gene_key(c)
    cut = F.regexp_replace(bare, r"[._-][a-zA-Z0-9]+$", "")
    return F.array_distinct(F.array(c, bare, F.regexp_replace(bare, r"\.[^.]*$", ""), cut, F.regexp_replace(cut, r"\.[^.]*$", "")))


def description(attrs: Column) -> Column:
    """The first attribute that describes a gene, decoded."""
    # Attributes in their order of priority.
    keys = ("description", "Description", "Note", "note", "product", "function", "Dbxref", "Ontology_term")
    found = F.coalesce(*(F.nullif(F.trim(F.try_element_at(attrs, F.lit(k))), F.lit("")) for k in keys))
    return F.coalesce(F.try_url_decode(found), found)


def short_label(note: Column) -> Column:
    return F.when(F.length(note) < 50, note).otherwise(F.concat(F.substring(note, 1, 47), F.lit("...")))


# The bounds and names of relationships, and the substitutions per site and year of organisms.
_RELATIONS = ((0.45, "Duplicate/Clone"), (0.20, "Full-Sib/Parent-Offspring"), (0.10, "Half-Sib"), (0.05, "Distant Relative"))
RATES = {"saccharum": 6.96e-9, "arabidopsis": 7.0e-9, "human": 1.2e-9, "populus": 2.5e-9, "drosophila": 1.5e-8}


def relationship(kinship: Column) -> Column:
    out = F.when(kinship < -0.05, "Unrelated (Divergent)").otherwise("Unrelated")
    for bound, name in reversed(_RELATIONS):
        out = F.when(kinship > bound, name).otherwise(out)
    return out


def substitution_rate(organism: str | None = None, given: float | None = None) -> float:
    """The given rate, else the organism's in any case, else that of grasses."""
    return given if given is not None else RATES.get((organism or "").lower(), RATES["saccharum"])


def genotype_class(gt: Column) -> Column:
    """How a haplotype map colours a call's text: hom_alt, het or hom_ref by the first of 1/1, 0/1 and 0/0 that it holds, else other."""
    return F.when(gt.contains("1/1"), "hom_alt").when(gt.contains("0/1"), "het").when(gt.contains("0/0"), "hom_ref").otherwise("other")


def colour_index(c: Column, colours: int = 8) -> Column:
    """A chromosome's place in a palette: by its number, else by the sum of its characters to the base 31 in 32 bits."""
    code = F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda s, x: (s * 31 + F.ascii(x)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    signed = F.when(code >= 1 << 31, code - (1 << 32)).otherwise(code)
    return (F.abs(F.coalesce(chromosome_number(c), signed)) % colours).cast("int")


def elite_genotype(effect: Column, ref: Column, alt: Column, ploidy: int) -> Column:
    """Struct (dosage, genotype): all copies of the alternate if its effect is above 0, else none."""
    best = F.when(effect > 0, ploidy).otherwise(0)
    return F.struct(best.alias("dosage"), F.concat(F.repeat(alt, best), F.repeat(ref, ploidy - best)).alias("genotype"))


def tajima_label(d: Column) -> Column:
    return F.when(d > 2, "balancing").when(d < -2, "sweep").when(d > 0, "slightly positive").otherwise("slightly negative")


def lambda_label(x: Column) -> Column:
    return F.when(x < 0.9, "conservative").when(x > 1.1, "inflated").otherwise("calibrated")


def is_main_chromosome(c: Column) -> Column:
    return F.lower(c).rlike("^(chr|ch|[0-9])")


def chromosome_number(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "").try_cast("long")


def divergence_mya(ks: Column, rate: float = 6.96e-9) -> Column:
    """Million years since the split, by substitutions per site and year."""
    return ks / (2 * rate) / 1e6
