"""Markers against genes: windows, effects on the protein, primer design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import chromosome_key, short_label
from ..functions.sequences import amino, gc, kasp_score, kasp_stars
from .ranges import near_count, overlaps


#: Bases of a sequence that a marker is looked up in at once.
PIECE = 10_000


def annotate(markers: DataFrame, genes: list[tuple[DataFrame, str]], window: int = 5000) -> DataFrame:
    """Each marker with every gene that its surroundings touch: columns of markers, g_*, source, distance (0 inside).

    markers: marker, chrom, pos. genes: gene models and the name of their source."""
    out = None
    m = markers.withColumn("__c", chromosome_key(F.col("chrom"))).withColumn("__from", F.greatest(F.col("pos") - window, F.lit(1))).withColumn("__to", F.col("pos") + window)
    for g, source in genes:
        x = g.select(chromosome_key(F.col("chrom")).alias("__c"), *(F.col(c).alias(f"g_{c}") for c in g.columns if c != "chrom"))
        hit = overlaps(m, x, ["__c"], "__from", "__to", "g_start", "g_end").drop("__c", "__from", "__to").withColumn("source", F.lit(source))
        out = hit if out is None else out.unionByName(hit, allowMissingColumns=True)
    inside = F.col("pos").between(F.col("g_start"), F.col("g_end"))
    return out.withColumn("distance", F.when(inside, 0).otherwise(F.least(F.abs(F.col("pos") - F.col("g_start")), F.abs(F.col("pos") - F.col("g_end")))))


def effect(cds: Column, subs: Column, strand: Column, pos: Column, alt: Column) -> Column:
    """Struct (type, detail): what a change at pos does to the protein of a gene.

    subs: array of (start, end, type); cds: the coding sequence, on the gene's strand. Non-Coding without either,
    Intronic/UTR outside the coding parts, Error beyond the sequence, else Synonymous, Stop-Gain or Missense
    with the amino acids and their place. Only the first base of alt counts."""
    parts = F.array_sort(F.filter(subs, lambda s: F.lower(s["type"]) == "cds"))
    length = F.aggregate(parts, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"] + 1)
    before = F.aggregate(parts, F.lit(0).cast("long"), lambda a, s: a + F.when(s["end"] < pos, s["end"] - s["start"] + 1).when(s["start"] <= pos, pos - s["start"]).otherwise(0))
    inside = F.exists(parts, lambda s: pos.between(s["start"], s["end"]))
    minus = strand == "-"
    at = F.when(minus, length - 1 - before).otherwise(before).cast("int")
    base = F.substring(F.upper(alt), 1, 1)
    new = F.when(minus, F.translate(base, "ACGT", "TGCA")).otherwise(base)
    first = (F.floor(at / 3) * 3).cast("int")
    codon = F.upper(F.substring(cds, first + 1, F.lit(3)))
    changed = F.concat(F.substring(codon, F.lit(1), at - first), new, F.substring(codon, at - first + 2, F.lit(3)))
    a, b = amino(codon, "?"), amino(changed, "?")
    detail = F.concat(a, (F.floor(at / 3) + 1).cast("string"), b)
    kind = F.when(cds.isNull() | (cds == "") | subs.isNull() | (F.size(parts) == 0), "Non-Coding").when(pos.isNull() | alt.isNull(), "Unknown").when(~inside, "Intronic/UTR").when(F.length(codon) < 3, "Error").when(a == b, "Synonymous").when(b == "*", "Stop-Gain").otherwise("Missense")
    return F.struct(kind.alias("type"), F.when(kind.isin("Synonymous", "Stop-Gain", "Missense"), detail).otherwise("").alias("detail"))


def kasp(markers: DataFrame, genome: DataFrame | None = None, flank: int = 50, reach: int = 30) -> DataFrame:
    """markers (marker, chrom, pos, ref, alt) with near, flank, gc, score and stars; 100 without a genome (seq_id, seq)."""
    m = near_count(markers, ["chrom"], "pos", reach)
    if genome is None:
        return m.withColumn("score", F.lit(100)).withColumn("stars", kasp_stars(F.lit(100)))
    # pieces of the sequences, each with the flank that may follow: a marker meets two of them, not its chromosome
    at = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / PIECE).cast("int"))
    pieces = F.transform(at, lambda k: F.struct(k.cast("long").alias("k"), F.substring(F.col("seq"), k * PIECE + 1, F.lit(PIECE + flank)).alias("s")))
    g = genome.filter(F.length("seq") > 0).select(chromosome_key(F.col("seq_id")).alias("__c"), F.explode(pieces).alias("p")).select("__c", "p.k", "p.s")
    left_at, right_at = F.greatest(F.col("pos") - flank, F.lit(1)), F.col("pos") + F.length("ref")
    side = lambda x: g.select("__c", F.col("k").alias(f"__k{x}"), F.col("s").alias(f"__s{x}"))
    place = lambda c: F.floor((c - 1) / PIECE)
    m = m.withColumn("__c", chromosome_key(F.col("chrom"))).withColumn("__ka", place(left_at)).withColumn("__kb", place(right_at))
    m = m.join(side("a"), ["__c", "__ka"], "left").join(side("b"), ["__c", "__kb"], "left")
    left = F.upper(F.substring(F.col("__sa"), (left_at - F.col("__ka") * PIECE).cast("int"), (F.col("pos") - left_at).cast("int")))
    right = F.upper(F.coalesce(F.substring(F.col("__sb"), (right_at - F.col("__kb") * PIECE).cast("int"), F.lit(flank)), F.when(F.col("__sa").isNotNull(), "")))
    m = m.withColumn("flank", F.concat(left, F.lit("["), F.col("ref"), F.lit("/"), F.col("alt"), F.lit("]"), right)).withColumn("gc", gc(F.concat(left, right))).drop("__c", "__ka", "__kb", "__sa", "__sb")
    score = F.when(F.col("flank").isNull(), 100).otherwise(kasp_score(F.col("near"), F.coalesce("gc", F.lit(0.5))))
    return m.withColumn("score", score).withColumn("stars", kasp_stars(score))


def terms(annotated: DataFrame) -> DataFrame:
    """The distinct short descriptions of the genes found, in order."""
    return annotated.filter(F.col("g_note").isNotNull()).select(short_label(F.col("g_note")).alias("term")).distinct().orderBy("term")


def high_impact(effects: DataFrame, text: str = "") -> DataFrame:
    """Rows of Missense or Stop-Gain whose gene's id, note or terms hold the text."""
    keep = effects.filter(F.col("effect.type").isin("Missense", "Stop-Gain"))
    low = F.lower(F.concat_ws(" ", "g_gene_id", "g_note", F.array_join("g_go", " ")))
    return keep.filter(low.contains(text.lower())) if text else keep
