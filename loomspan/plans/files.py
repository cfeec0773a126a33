"""Queries that write tables in a text format and read them again, and reports as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import names as N
from ..functions.kernels import kaks_udf
from ..operators import gwas, reports, synteny
from ..runtime import scratch, table
from ..sources import sinks, text
from . import callsets, genomics
from . import genotype as G


def vcf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The variants and calls as one folder of VCF text, read again."""
    v = callsets.call_sites(spark, d).select("row_id", "chrom", "pos", F.lit(".").alias("id"), "ref", "alt", F.lit(".").alias("qual"), F.lit(".").alias("filter"), F.lit(".").alias("info"), "format", "calls")
    path = scratch(spark)
    sinks.save(sinks.vcf_lines(v), path, sinks.vcf_header(["a"]))
    return text.read_vcf(spark, path).select("chrom", "pos", "ref", "alt", "format", "calls")


def genes_round_trip(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    attrs = F.concat(F.lit("ID=gene:G"), F.col("p_partkey").cast("string"), F.lit(";Name="), F.translate("p_name", ";=", "  "))
    line = F.concat_ws("\t", F.translate("p_brand", "#", "_"), F.lit("x"), F.lit("gene"), (F.col("p_partkey") * 10).cast("string"), (F.col("p_partkey") * 10 + F.col("p_size")).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    path = scratch(spark)
    sinks.save(p.select("p_partkey", line.alias("line")), path, ["##gff-version 3"], "p_partkey")
    g = text.read_genes(spark, path)
    return g.select("gene_id", "chrom", "start", "end", "strand", F.try_element_at("attrs", F.lit("Name")).alias("name"))


def collinearity_round_trip(spark: SparkSession, d: str) -> DataFrame:
    order = W.Window.partitionBy("block_id").orderBy("ord", "gene1", "k")  # lines of an order may have one number
    pairs = genomics._lines(spark, d).select("block_id", F.row_number().over(order).alias("ord"), "gene1", "gene2", (F.col("k") / 1000).alias("e_value"))
    path = scratch(spark)
    lines = sinks.block_lines(pairs).withColumn("row", F.col("block_id") * 64 + F.col("ord"))
    sinks.save(lines, path, ["############### Parameters ###############"], "row", single=True)
    return text.read_collinearity(spark, path)[1].select("block_id", F.col("ord").cast("long").alias("ord"), "gene1", "gene2", F.round("e_value", 9).alias("e_value"))


def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = genomics._bases(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("seq_id"), "seq")
    path = scratch(spark)
    sinks.save(sinks.fasta_lines(s), path)
    return text.read_fasta(spark, path)


def dosage_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    sinks.save(sinks.dosage_lines(G.sites(spark, d)), path, ["\t".join(["Chr", "pos", *(f"s{i}" for i in range(G.SAMPLES))])], single=True)
    return text.read_dosages(spark, path).select("pos", F.posexplode("d").alias("sample", "d")).select("pos", F.col("sample").cast("long").alias("sample"), F.round("d", 5).alias("d"))


def kaks_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the bases of documents that follow each other, written and read again."""
    n = genomics._next_documents(spark, d).filter("length(seq) = length(seq2)")
    r = n.select(F.concat(F.lit("gene:a"), F.col("doc_id").cast("string")).alias("gene1"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("gene2"), kaks_udf("seq", "seq2").alias("r")).select("gene1", "gene2", "r.ka", "r.ks", "r.ratio")
    head, lines = sinks.kaks_lines(r)
    path = scratch(spark)
    sinks.save(lines.withColumn("row", F.regexp_extract("gene2", r"(\d+)", 1).cast("long")), path, [head], "row")
    return text.read_kaks(spark, path)


def synteny_tsv(spark: SparkSession, d: str) -> DataFrame:
    """The table of syntenic pairs and orphans as its lines of 17 columns."""
    pairs = genomics._lines(spark, d).withColumn("e_value", F.col("k") / 1000)
    r = synteny.report(pairs, *(genomics._genes(spark, d, k).withColumn("strand", F.lit("+")) for k in (0, 1)))
    return sinks.synteny_lines(r)[1].select("line")


def relationship_report(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the table of relationships between the view's samples."""
    s = genomics._structure(spark, d)
    return sinks.relationship_lines(reports.structure_relationships(spark, s, [f"s{i}" for i in range(G.SAMPLES)]))[1].select("line")


def pca_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.pca_lines(genomics.pca(spark, d))[1].select("line")


def gwas_significance(spark: SparkSession, d: str) -> DataFrame:
    out = reports.significance(genomics._hits(spark, d))
    return out.select("m", F.round(F.col("bonferroni") * 1e6, 9).alias("bonferroni_millionths"), "significant", "discoveries", F.round("threshold", 9).alias("threshold"))


def qq_thinned(spark: SparkSession, d: str) -> DataFrame:
    return reports.thinned(gwas.fdr(genomics._hits(spark, d)), 40).select("hit_id", F.col("rank").cast("long").alias("rank"))


def elite_genotypes(spark: SparkSession, d: str) -> DataFrame:
    """The best dosage of each hit with an effect, and the colour of its chromosome."""
    h = genomics._hits(spark, d).filter("effect is not null and chrom is not null")
    e = N.elite_genotype(F.col("effect"), F.lit("A"), F.lit("G"), 4)
    return h.select("hit_id", e["dosage"].alias("dosage"), e["genotype"].alias("genotype"), N.colour_index(F.col("chrom")).alias("colour"))


def tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of the samples' tree with their clusters, every other sample's given."""
    nodes = genomics.nj_tree(spark, d)
    c = spark.range(0, G.SAMPLES, 2).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), (F.col("id") % 3).cast("string").alias("kmeans"))
    return reports.leaf_clusters(nodes, c).select("name", "kmeans")


def ancestry_bars(spark: SparkSession, d: str) -> DataFrame:
    """The samples of each run in the order of their ancestry's bars."""
    a = table(spark, d, "pca_results").select("pca_id", "ancestry_proportions").filter(F.size("ancestry_proportions") > 0).dropDuplicates(["pca_id"])
    return reports.ancestry_order(a.select(F.format_string("%012d", "pca_id").alias("name"), F.col("ancestry_proportions").alias("ancestry"))).select("name", F.col("ord").cast("long").alias("ord"))


QUERIES = {f.__name__: f for f in (vcf_round_trip, genes_round_trip, collinearity_round_trip, fasta_round_trip, dosage_round_trip, kaks_round_trip, synteny_tsv, relationship_report, pca_report, gwas_significance, qq_thinned, elite_genotypes, tree_leaves, ancestry_bars)}
