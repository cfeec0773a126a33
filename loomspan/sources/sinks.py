"""Writers of the text formats. Each gives ordered lines; `save` writes them as one file, or as parts in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def save(body: DataFrame, path: str, header: list[str] | None = None, order: str = "row_id", single: bool = False) -> None:
    """Write `line` by `order`; the header is the first part. single: one file."""
    rows = body.select(F.col(order).cast("long").alias("__o"), F.col("line").alias("value"))
    if header:
        head = body.sparkSession.createDataFrame([(-(1 << 62) + i, h) for i, h in enumerate(header)], "__o long, value string")
        rows = head.unionByName(rows)
    rows = rows.coalesce(1).sortWithinPartitions("__o") if single else rows.orderBy("__o")
    rows.select("value").write.mode("overwrite").text(path)


def tabbed(*cols: Column | str) -> Column:
    return F.concat_ws("\t", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(".")) for c in cols))


def _plain(c: Column) -> Column:
    """A field's text with blanks for tabs and line ends, which would end it."""
    return F.translate(c, "\t\r\n", "   ")


def vcf_lines(variants: DataFrame) -> DataFrame:
    """Lines of variants; a field's own tabs and line ends become blanks, null fields `.`."""
    fixed = tabbed(*(_plain(F.col(c).cast("string")) for c in _FIXED))
    calls = F.transform("calls", lambda c: _plain(F.coalesce(c, F.lit("."))))
    return variants.select("row_id", F.concat_ws("\t", fixed, F.when(F.size("calls") > 0, F.array_join(calls, "\t"))).alias("line"))


def vcf_header(samples: list[str], notes: list[str] | None = None) -> list[str]:
    return ["##fileformat=VCFv4.2", *(notes or []), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def number(c: Column, places: int = 6) -> Column:
    """At most so many places, halves to even, without zeros at the end."""
    text = F.regexp_replace(F.bround(c, places).cast(f"decimal(30,{places})").cast("string"), r"\.?0+$", "")
    return F.when(text == "", "0").otherwise(text)


def dosage_lines(dosages: DataFrame) -> DataFrame:
    """`chrom pos values` with -1.0 for missing."""
    values = F.transform("d", lambda x: F.when(x.isNull(), F.lit("-1.0")).otherwise(x.cast("float").cast("string")))
    return dosages.select("row_id", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.array_join(values, "\t")).alias("line"))


def square_lines(pairs: DataFrame, labels: list[str], places: int = 6, sep: str = "\t", missing: str = "NA", diagonal: float = 0.0) -> DataFrame:
    """A symmetric matrix of (i, j, value), i < j, as lines with a name first."""
    both = pairs.select("i", "j", "value").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    rows = both.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("m"))
    every = pairs.sparkSession.createDataFrame(list(enumerate(labels)), "i int, name string").join(rows, "i", "left")
    cell = F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda j: F.when(j == F.col("i"), number(F.lit(diagonal), places)).otherwise(F.coalesce(number(F.try_element_at("m", j), places), F.lit(missing))))
    return every.select(F.col("i").alias("row_id"), F.concat_ws(sep, "name", F.array_join(cell, sep)).alias("line"))


def joinmap_lines(text: DataFrame) -> DataFrame:
    """Lines (line_no, value) with an empty field before the third, unless that is the last."""
    f = F.split("value", "\t", -1)
    wide = F.concat(F.slice(f, 1, 2), F.array(F.lit("")), F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0))))
    return text.select(F.col("line_no").alias("row_id"), F.array_join(F.when(F.size(f) > 3, wide).otherwise(f), "\t").alias("line"))


def table_lines(df: DataFrame, sep: str = "\t", order: str = "row_id") -> DataFrame:
    return df.select(order, F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in df.columns if c != order)).alias("line"))


def _fixed(c: Column | str, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.col(c) if isinstance(c, str) else c)


def pca_lines(samples: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines of the table of `structure.table`: clusters from 1, `Noise` for none, and a column for each component, discriminant and share."""
    widths = samples.agg(*(F.max(F.size(c)).alias(c) for c in ("pcs", "lds", "ancestry"))).first()
    head = ["Sample", "KMeans_Cluster", "DBSCAN_Cluster", "GMM_Cluster"]
    head += [f"{name}{i + 1}" for c, name in (("pcs", "PC"), ("lds", "LD"), ("ancestry", "Ancestry_Q")) for i in range(widths[c] or 0)]
    values = [F.transform(c, lambda x: F.format_string("%.6f", x)) for c in ("pcs", "lds", "ancestry")]
    noise = F.when(F.col("dbscan") == 0, "Noise").otherwise(F.col("dbscan").cast("string"))
    line = F.concat_ws(",", "sample", F.col("kmeans").cast("string"), noise, F.col("gmm").cast("string"), *(F.array_join(v, ",") for v in values))
    return ",".join(head), samples.select("sample", line.alias("line"))


def relationship_lines(pairs: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines (i, j, line) of the table of `reports.relationships`."""
    line = F.concat_ws(",", "sample1", "sample2", "same_cluster", _fixed("distance", 4), _fixed("kinship", 4), "relation")
    return "Sample1,Sample2,Same_PCA_Cluster,Distance_PC_Space,Kinship_VanRaden,Inferred_Relationship", pairs.select("i", "j", line.alias("line"))


# The columns of the table of syntenic pairs.
SYNTENY_COLUMNS = ("Block_ID", "Status", "Gene1_ID", "Chr1", "Start1", "End1", "Strand1", "Gene2_ID", "Chr2", "Start2", "End2", "Strand2", "E_Value", "CDS1_Len", "CDS2_Len", "Prot1_Len", "Prot2_Len")


def synteny_lines(report: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines (block_id, ord, line) of `synteny.report`; what a side lacks is NA, -1, `.` or a length of 0."""
    have = set(report.columns)
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in have else F.lit(other)
    sides = [[text(f"gene{k}", "NA"), text(f"chrom{k}", "NA"), text(f"start{k}", "-1"), text(f"end{k}", "-1"), text(f"strand{k}", ".")] for k in (1, 2)]
    e = F.when(F.col("status") == "Syntenic", F.format_string("%.2e", F.coalesce("e_value", F.lit(0.0)))).otherwise("NA")
    lengths = [text(c, "0") for c in ("cds1_len", "cds2_len", "prot1_len", "prot2_len")]
    line = F.concat_ws("\t", text("block_id", "None"), "status", *sides[0], *sides[1], e, *lengths)
    return "\t".join(SYNTENY_COLUMNS), report.select("block_id", "ord", line.alias("line"))


def summary_lines(s: dict, tajima: dict, chromosomes: list[tuple[str, int]], fst: list[tuple[str, str, float]] = ()) -> list[str]:
    """The commented part of a report of statistics: counts, alleles, proportions, Tajima's D, pairwise Fst, variants by chromosome.

    s: a row of `callset.summary`; tajima: of `sites.tajima`. Both come from one row each; chromosomes and populations are few."""
    ratio = s["transitions"] / s["transversions"] if s["transversions"] else 0.0
    share = 100.0 * s["hwe_violations"] / s["hwe_tested"] if s["hwe_tested"] else 0.0
    rule = "=" * 56
    out = [rule, "VCF Statistics Report", rule, f"Total Variants: {max(s['snps'] + s['indels'], 1)}  (SNPs: {s['snps']} | InDels: {s['indels']})", f"Transitions: {s['transitions']}  |  Transversions: {s['transversions']}"]
    out += [f"Ts/Tv Ratio: {ratio:.3f}", f"Mean Expected Heterozygosity (EH): {s['mean_eh'] or 0:.4f}", None]
    out += ["-- AN: Allele Number Distribution --", f"  Monomorphic sites: {s['mono']}", f"  Biallelic sites:   {s['bi']}", f"  Multiallelic sites:{s['multi']}", None]
    out += ["-- HWE Chi-square Test --", f"  Sites tested: {s['hwe_tested']}", f"  Sites violating HWE (chi2 > 3.84, p<0.05): {s['hwe_violations']} ({share:.1f}%)", f"  Mean chi-square: {s['mean_chi2'] or 0:.3f}", None]
    d = tajima.get("d")
    out += ["-- Tajima's D --", f"  Segregating sites (S): {tajima['s']}", f"  pi (avg pairwise diffs): {tajima['pi'] or 0:.5f}", f"  Watterson theta_W: {tajima['theta'] or 0:.5f}", "  Tajima's D: " + ("N/A (insufficient data)" if d is None else f"{d:.4f}"), None]
    if fst:
        out += ["-- Pairwise Fst --", *(f"  Fst {a} vs {b}: {x:.4f}" for a, b, x in fst), None]
    out += ["-- Variant Density per Chromosome --", *(f"  {c}: {n} variants" for c, n in chromosomes), None]
    return ["#" if x is None else f"## {x}" for x in out]


def fasta_lines(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.monotonically_increasing_id().alias("row_id"), F.concat(F.lit(">"), "seq_id", F.lit("\n"), "seq").alias("line"))


def kaks_lines(rates: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines (gene1, gene2, line) of Ka, Ks and their ratio."""
    line = F.concat_ws("\t", "gene1", "gene2", *(_fixed(c, 6) for c in ("ka", "ks", "ratio")))
    return "#Gene1\tGene2\tKa\tKs\tKa/Ks", rates.select("gene1", "gene2", line.alias("line"))


def block_lines(pairs: DataFrame) -> DataFrame:
    """(block_id, ord, line) of collinear blocks as text: a header before the first pair of each; pairs: block_id, ord from 1, gene1, gene2, e_value."""
    sizes = pairs.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.min("e_value").alias("e"))
    head = F.concat(F.lit("## Alignment "), F.col("block_id").cast("string"), F.format_string(": score=%.1f e_value=%s N=%d plus", F.col("n") * 50.0, F.col("e").cast("string"), F.col("n")))
    line = F.concat(F.col("block_id").cast("string"), F.lit("-"), F.lpad((F.col("ord") - 1).cast("string"), 3, " "), F.lit(":\t"), F.concat_ws("\t", "gene1", "gene2", F.col("e_value").cast("string")))
    return sizes.select("block_id", F.lit(0).cast("long").alias("ord"), head.alias("line")).unionByName(pairs.select("block_id", F.col("ord").cast("long").alias("ord"), line.alias("line")))


def write_newick(spark: SparkSession, newick: str, path: str) -> None:
    spark.createDataFrame([(newick,)], "value string").coalesce(1).write.mode("overwrite").text(path)
