"""Queries of the genomic operators over the driver's tables: whole tables, one function each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import names as N
from ..functions import sequences as Q
from ..operators import dosage, fill, gwas, ld, merge, ranges, sites, structure, synteny
from ..runtime import cut, once_per, small, table
from . import genotype as G

P = G.PLOIDY
_R = lambda c, n=9: F.round(c, n)


def _stats(spark: SparkSession, d: str, min_depth: int = 0) -> DataFrame:
    return sites.site_stats(G.sites(spark, d, min_depth), P)


def site_missingness_maf_eh(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select("chrom", "pos", _R("missing").alias("missing"), _R("maf").alias("maf"), _R("eh").alias("eh"))


def top_n_eh(spark: SparkSession, d: str) -> DataFrame:
    return sites.top_by_eh(_stats(spark, d).withColumn("eh", _R("eh")), 100).select("chrom", "pos", "eh")


def site_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    out = sites.filter_sites(G.sites(spark, d, 20), P, min_maf=0.05, max_missing=0.6, min_eh=0.2)
    return out.select("chrom", "pos", _R("missing").alias("missing"), _R("maf").alias("maf"), _R("eh").alias("eh"))


def _histogram(name: str, bins: int) -> object:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return sites.histogram(_stats(spark, d).withColumn(name, _R(name)), name, bins)

    return f


def tajima_components(spark: SparkSession, d: str) -> DataFrame:
    t = sites.tajima(G.sites(spark, d), P)
    return t.select("s", _R("pi").alias("pi"), "n", _R("theta").alias("theta"), _R("d").alias("d"))


def _populations(spark: SparkSession, d: str) -> DataFrame:
    """(site, pop, copies, alt) of every cell; a sample's population is its nation's region."""
    s = G.sites(spark, d).select(F.col("pos").alias("site"), F.posexplode("d").alias("sample", "x")).filter(F.col("x").isNotNull())
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("sample"), F.col("n_regionkey").alias("pop"))
    return s.join(small(n), "sample").select("site", "pop", F.lit(float(P)).alias("copies"), C.copies(F.col("x"), P).cast("double").alias("alt"))


def fst_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return sites.fst_pairs(_populations(spark, d)).select("pop1", "pop2", *(_R(c).alias(c) for c in ("ht", "hs", "fst")))


def fst_clusters(spark: SparkSession, d: str) -> DataFrame:
    return sites.fst_clusters(_populations(spark, d)).select("site", _R("fst").alias("fst"))


def _long(s: DataFrame) -> DataFrame:
    return s.select("pos", F.posexplode("d").alias("sample", "d")).select("pos", F.col("sample").cast("long").alias("sample"), _R("d").alias("d"))


def dosage_matrix_round(spark: SparkSession, d: str) -> DataFrame:
    return _long(dosage.round_levels(G.sites(spark, d), P))


def dosage_mode_impute(spark: SparkSession, d: str) -> DataFrame:
    return _long(dosage.impute(dosage.round_levels(G.sites(spark, d), P), "mode"))


def dosage_mean_impute(spark: SparkSession, d: str) -> DataFrame:
    return _long(dosage.impute(G.sites(spark, d), "mean"))


def dosage_knn_impute(spark: SparkSession, d: str) -> DataFrame:
    s = cut(dosage.round_levels(G.sites(spark, d), P))
    return _long(dosage.impute(s, "knn", P, 5, dosage.genetic_distance(s)))


def dosage_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return _long(dosage.adaptive_levels(G.sites(spark, d), P))


def _distance(method: str) -> object:
    def f(spark: SparkSession, d: str) -> DataFrame:
        out = dosage.genetic_distance(G.sites(spark, d), method)
        return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _R("value").alias("value"), "shared")

    return f


#: Window and bin of the linkage queries, the reference's defaults.
LD_WINDOW, LD_BIN = 50_000, 1000


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return ld.ld_pairs(G.sites(spark, d, 5), LD_WINDOW, 0.05)


def ld_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("chrom", "pos1", "pos2", "distance", _R("r2").alias("r2"))


def ld_decay_bins(spark: SparkSession, d: str) -> DataFrame:
    return ld.decay(G.sites(spark, d, 5), LD_WINDOW, LD_BIN, 0.05).select("bin", _R("mean_r2").alias("mean_r2"), "n")


def ld_half_decay(spark: SparkSession, d: str) -> DataFrame:
    return ld.ld_half_decay(ld_decay_bins(spark, d))


def ld_prune(spark: SparkSession, d: str) -> DataFrame:
    return ld.prune(G.sites(spark, d).select("row_id", "chrom", "pos", "d"), 0.5).select("chrom", "pos")


def curve_fit(spark: SparkSession, d: str) -> DataFrame:
    return ld.fit_decay(ld.decay(G.sites(spark, d, 5), LD_WINDOW, LD_BIN, 0.05), LD_BIN).select("name", "equation", _R("r2").alias("r2"))


def haplotype_windows(spark: SparkSession, d: str) -> DataFrame:
    w = ld.windows(G.sites(spark, d).select("row_id", "chrom", "pos"), 5)
    return w.groupBy("chrom", "block").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n"))


def haplotype_pc1(spark: SparkSession, d: str) -> DataFrame:
    return ld.haplotype_pc1(G.sites(spark, d), 5, P).select("chrom", "block", "start", "end", F.col("n").cast("long").alias("n"), F.transform("d", lambda x: F.round(x, 9)).alias("d"))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    """Sites with dosages in copies."""
    return G.sites(spark, d).withColumn("d", F.transform("d", lambda x: C.copies(x, P).cast("double"))).withColumn("marker", F.concat_ws(":", "chrom", F.col("pos").cast("string")))


def kinship_vanraden(spark: SparkSession, d: str) -> DataFrame:
    m = structure.kinship(structure.pca_sites(_copies(spark, d), P, 0.05, 0.6), P)
    return structure.matrix_pairs(spark, m, True).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _R("value").alias("value"))


def relationship_class(spark: SparkSession, d: str) -> DataFrame:
    return kinship_vanraden(spark, d).filter("i < j").select("i", "j", N.relationship(F.col("value")).alias("relation"))


def _structure(spark: SparkSession, d: str) -> structure.Structure:
    return structure.analyse(_copies(spark, d), P, 10, 0.05, 0.6)


def pca(spark: SparkSession, d: str) -> DataFrame:
    """Samples' clusters, components, discriminants and ancestry."""
    return structure.table(spark, _structure(spark, d), [str(i) for i in range(G.SAMPLES)])


def upgma(spark: SparkSession, d: str) -> DataFrame:
    s = _structure(spark, d)
    return spark.createDataFrame(structure.segments(s.tree, len(s.pcs)), "x0 double, y0 double, x1 double, y1 double")


def nj_tree(spark: SparkSession, d: str) -> DataFrame:
    m = dosage._square(dosage.genetic_distance(G.sites(spark, d)), G.SAMPLES)
    np.fill_diagonal(m, 0)
    newick = structure.neighbour_joining(np.nan_to_num(m, nan=np.nanmax(m)), [f"s{i}" for i in range(G.SAMPLES)])
    return spark.createDataFrame(structure.parse_newick(newick), "node int, parent int, name string, length double")


def snp_clusters(spark: SparkSession, d: str) -> DataFrame:
    s = G.sites(spark, d).withColumn("marker", F.concat_ws("_", "chrom", F.col("pos").cast("string")))
    return dosage.snp_clusters(s, P, limit=None).withColumn("centroids", F.transform("centroids", lambda x: F.round(x, 9)))


def ploidy_estimate(spark: SparkSession, d: str) -> DataFrame:
    return dosage.ploidy_estimate(G.sites(spark, d)).select("sample", "ploidy", _R("confidence").alias("confidence"), "sites")


def acgt_export(spark: SparkSession, d: str) -> DataFrame:
    s = G.sites(spark, d).withColumn("ref", F.when(F.col("pos") % 2 == 0, "A").otherwise("C")).withColumn("alt", F.lit("G"))
    return dosage.to_acgt(s, 4).select("pos", F.posexplode("genotypes").alias("sample", "genotype")).select("pos", F.col("sample").cast("long").alias("sample"), "genotype")


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return once_per(table(spark, d, "variants"), "row_id")


def variant_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return sites.class_counts(_variants(spark, d), "ref_allele", "alt_allele")


def density_bins(spark: SparkSession, d: str) -> DataFrame:
    return sites.density(_variants(spark, d).withColumn("chrom", N.chromosome_key(F.col("chrom"))))


def marker_ids(spark: SparkSession, d: str) -> DataFrame:
    v = _variants(spark, d)
    return v.select("row_id", C.marker_id(F.col("vcf_id"), F.col("chrom"), F.col("pos")).alias("marker"), N.chromosome_key(F.col("chrom")).alias("key_a"), N.contig_key(F.col("chrom")).alias("key_b"))


def _gts(spark: SparkSession, d: str) -> DataFrame:
    return once_per(table(spark, d, "vcf_calls").select("call_id", "row_id", "sample_id", "gt"), "call_id")


def sample_call_summary(spark: SparkSession, d: str) -> DataFrame:
    return sites.sample_summary(_gts(spark, d), "sample_id", "gt").withColumn("obs_het", _R("obs_het"))


def sample_inbreeding(spark: SparkSession, d: str) -> DataFrame:
    """Observed heterozygosity of each sample against the mean expected one of the sites."""
    g = _gts(spark, d)
    return sites.inbreeding(sites.sample_summary(g, "sample_id", "gt"), sites.mean_heterozygosity(g, ["row_id"], "gt")).select("sample_id", _R("f").alias("f"))


def hwe_counts(spark: SparkSession, d: str) -> DataFrame:
    h = sites.hwe_summary(_gts(spark, d), ["row_id"], "gt")
    return h.select("row_id", "n0", "n1", "n2", _R("chi2").alias("chi2"))


def hwe_exact(spark: SparkSession, d: str) -> DataFrame:
    return sites.hwe_summary(_gts(spark, d), ["row_id"], "gt").select("row_id", _R("p").alias("p"))


def merge_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """The view as two files that share samples 10 to 14, over all sites, merged; calls are read counts as text."""
    c = G.cells(spark, d).withColumn("call", F.concat_ws(",", F.col("ref_d").cast("long").cast("string"), F.col("alt_d").cast("long").cast("string")))
    parts = []
    for names, keep in (([f"s{i:02d}" for i in range(15)], "sample < 15"), ([f"s{i:02d}" for i in range(10, 25)], "sample >= 10")):
        m = c.filter(keep).groupBy("chrom", "pos").agg(F.map_from_entries(F.collect_list(F.struct(F.format_string("s%02d", "sample"), "call"))).alias("m"))
        calls = F.transform(F.array(*(F.lit(n) for n in names)), lambda n: F.try_element_at("m", n))
        parts.append((m.select(F.col("pos").alias("row_id"), "chrom", "pos", F.lit(".").alias("id"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), calls.alias("calls")), names))
    out, _ = merge.merge_sites(parts)
    return out.select("chrom", "pos", F.array_join("calls", " ").alias("calls"))


# association results


def _hits(spark: SparkSession, d: str) -> DataFrame:
    h = once_per(table(spark, d, "gwas_hits").filter("p_value > 0 and p_value <= 1"), "hit_id")
    return h.select("hit_id", F.format_string("%012d", "hit_id").alias("marker"), F.col("marker_id"), "trait", F.col("chromosome").alias("chrom"), "pos", F.col("p_value").alias("p"), "aic", F.col("gwas_model").alias("model"), "r2", "effect")


def fdr_bh(spark: SparkSession, d: str) -> DataFrame:
    return gwas.fdr(_hits(spark, d)).select("hit_id", F.col("rank").cast("long").alias("rank"), _R("q", 9).alias("q"))


def fdr_by_trait(spark: SparkSession, d: str) -> DataFrame:
    return gwas.fdr(_hits(spark, d), "p", ["trait"]).select("hit_id", F.col("rank").cast("long").alias("rank"), _R("q", 9).alias("q"))


def best_model(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).withColumn("hit", F.col("marker")).withColumn("marker", F.concat_ws("|", "trait", "marker_id")).withColumn("model", F.concat_ws("|", "model", "hit"))
    return gwas.best_models(h).select("marker", "hit_id", "aic", "p")


def qq_ranks(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    best = h.withColumn("m", F.col("marker")).withColumn("marker", F.col("marker_id")).withColumn("model", F.concat_ws("|", "model", "m"))
    best = gwas.best_models(best)
    n = F.lit(h.count())
    return gwas.qq(best, n).select("hit_id", F.col("rank").cast("long").alias("rank"), _R("expected").alias("expected"), _R("observed").alias("observed"))


def lambda_median_pick(spark: SparkSession, d: str) -> DataFrame:
    return gwas.lambda_gc(_hits(spark, d)).select(_R("lambda", 3).alias("lambda"), "label")


def chrom_offsets(spark: SparkSession, d: str) -> DataFrame:
    return gwas.offsets(_hits(spark, d).filter("chrom is not null").withColumn("chrom", N.chromosome_key(F.col("chrom"))))


def lead_snps(spark: SparkSession, d: str) -> DataFrame:
    """The leads among all hits of a chromosome, whatever its spelling."""
    return gwas.lead_markers(_hits(spark, d).withColumn("chrom", N.chromosome_key(F.col("chrom")))).select("hit_id", "chrom", "pos", "p")


def _phenotype(spark: SparkSession, d: str) -> np.ndarray:
    """The mean order of each nation."""
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    y = np.full(G.SAMPLES, np.nan)
    for r in o.groupBy("c_nationkey").agg(F.avg("o_totalprice").alias("y")).collect():  # one row per nation
        y[r.c_nationkey] = r.y
    return y


def gwas_scan(spark: SparkSession, d: str) -> DataFrame:
    """Additive and simplex models over the view, without each chromosome's own kinship."""
    s = cut(gwas.markers(_copies(spark, d), P, 0.05, 0.6).select("marker", "chrom", "pos", "d"))  # read by each step
    s = gwas.loco_groups(s)
    hits = gwas.scan(s, _phenotype(spark, d), gwas.loco_kinships(s, P), P, ("ADDITIVE", "SIMPLEX"))
    return gwas.fdr(hits, tie="marker").select("marker", "model", "p", "q", "effect", "r2", "aic")


def epistasis(spark: SparkSession, d: str) -> DataFrame:
    s = cut(gwas.markers(_copies(spark, d), P, 0.05, 0.6).select("marker", "chrom", "pos", "d"))
    y, k = _phenotype(spark, d), structure.kinship(s, P)
    leads = gwas.scan(s, y, k, P).orderBy("p", "marker").limit(5)
    return gwas.epistasis(s, leads, y, k, most=0.01)


# comparative genomics: parts are genes, order lines are collinear pairs


def _genes(spark: SparkSession, d: str, odd: int) -> DataFrame:
    p = table(spark, d, "part").filter(F.col("p_partkey") % 2 == odd)
    return p.select(F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene_id"), F.col("p_brand").alias("chrom"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("end"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("block_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("gene:G"), F.col("l_partkey").cast("string")).alias("gene1"), F.concat(F.lit("G"), (F.col("l_partkey") + 1).cast("string")).alias("gene2"), ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 320).alias("k"))


def orphans_anti(spark: SparkSession, d: str) -> DataFrame:
    return synteny.orphans(_genes(spark, d, 0), _lines(spark, d), "gene1").select("gene_id")


def synteny_report_counts(spark: SparkSession, d: str) -> DataFrame:
    r = synteny.report(_lines(spark, d).withColumn("e_value", F.lit(0.0)), _genes(spark, d, 0), _genes(spark, d, 1))
    return r.groupBy("status", "chrom1", "chrom2").agg(F.count(F.lit(1)).alias("n"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    every = _genes(spark, d, 0).unionByName(_genes(spark, d, 1)).withColumnRenamed("gene_id", "g")
    return _lines(spark, d).select("block_id", "ord", N.gene_key(F.col("gene1")).alias("g")).join(every, "g")


def block_bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return synteny.block_boxes(_placed(spark, d)).select("block_id", "chrom", "start", "end")


def interval_overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    g = _genes(spark, d, 0)
    s = table(spark, d, "supplier")
    sv = s.select(F.format_string("Brand#%d%d", (F.col("s_suppkey") % 5 + 1).cast("int"), (F.col("s_nationkey") % 5 + 1).cast("int")).alias("chrom"), (F.col("s_suppkey") * 200).alias("start"), (F.col("s_suppkey") * 200 + F.col("s_nationkey") * 10).alias("end"))
    return synteny.sv_flags(g.withColumnRenamed("gene_id", "block_id"), sv).withColumnRenamed("block_id", "gene_id")


def snp_in_interval_count(spark: SparkSession, d: str) -> DataFrame:
    iv = _genes(spark, d, 0).select("gene_id", "chrom", (F.col("start") - 500).alias("start"), (F.col("end") + 500).alias("end"))
    pts = table(spark, d, "part").select(F.col("p_brand").alias("chrom"), (F.col("p_partkey") * 10).alias("pos"))
    return ranges.points_in(pts, iv, ["chrom"], "pos", "start", "end", 2000).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))


def window_gene_join(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.annotate import annotate

    m = table(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("marker"), F.col("p_brand").alias("chrom"), (F.col("p_partkey") * 10 + 3).alias("pos"))
    out = annotate(m, [(_genes(spark, d, 0), "primary"), (_genes(spark, d, 1), "secondary")])
    return out.select("marker", F.col("g_gene_id").alias("gene_id"), "source", "distance")


def nearby_snp_count(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("pos"))
    return ranges.near_count(m, ["chrom"], "pos", 30).select("p_partkey", "near")


def ks_histogram_smooth_peaks(spark: SparkSession, d: str) -> DataFrame:
    ks = _lines(spark, d).select(((F.col("k") + 0.5) / 100).alias("ks"))
    return synteny.ks_peaks(synteny.ks_histogram(ks)).select(F.col("bin").cast("long").alias("bin"), "n", _R("smooth").alias("smooth"), "peak", _R("mya", 3).alias("mya"))


def chrom_pair_mean_ks(spark: SparkSession, d: str) -> DataFrame:
    every = _genes(spark, d, 0).unionByName(_genes(spark, d, 1))
    g = lambda k: every.select(F.col("gene_id").alias(f"gene{k}"), F.col("chrom").alias(f"chrom{k}"))
    p = _lines(spark, d).select(N.gene_key(F.col("gene1")).alias("gene1"), "gene2", ((F.col("k") + 0.5) / 100).alias("ks")).join(g(1), "gene1").join(g(2), "gene2")
    return synteny.chromosome_ks(p).select("chrom1", "chrom2", _R("mean_ks").alias("mean_ks"), "n")


def chromosome_tree(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(structure.parse_newick(synteny.chromosome_tree(chrom_pair_mean_ks(spark, d)) or ";"), "node int, parent int, name string, length double")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene_id"), F.explode(F.split("p_type", " ")).alias("term"))


def go_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return synteny.term_counts(_terms(spark, d))


def go_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the genes on each chromosome against all."""
    genes = table(spark, d, "part").select(F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene_id"), F.col("p_brand").alias("block_id"))
    back = _terms(spark, d)
    return synteny.go_enrichment(genes.join(back, "gene_id"), back).select("block_id", "term", "hits", "draws", "good", _R("p", 9).alias("p"), _R("q", 9).alias("q"))


def forward_fill_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the last `purchase` of its user up to it."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("head"))
    return fill.carry_forward(e, ["user_id"], ["ts", "event_id"], "head", "block_id").select("event_id", "block_id")


def _bases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "").alias("seq"))


def codon_translate(spark: SparkSession, d: str) -> DataFrame:
    return _bases(spark, d).select("doc_id", Q.translate(F.col("seq")).alias("protein"))


def gc_content(spark: SparkSession, d: str) -> DataFrame:
    return _bases(spark, d).select("doc_id", _R(Q.gc(F.col("seq"))).alias("gc"), F.length(Q.reverse_complement(F.col("seq"))).cast("long").alias("n"))


def _next_documents(spark: SparkSession, d: str) -> DataFrame:
    b = _bases(spark, d)
    return b.join(b.select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq").alias("seq2")), "doc_id").filter((F.length("seq") > 0) & (F.length("seq2") > 0))


def jukes_cantor(spark: SparkSession, d: str) -> DataFrame:
    i = Q.identity(F.col("seq"), F.col("seq2"))
    return _next_documents(spark, d).select("doc_id", _R(i).alias("identity"), _R(Q.jukes_cantor(1 - i)).alias("distance"))


def kaks(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.kernels import kaks_udf

    return _next_documents(spark, d).select("doc_id", kaks_udf("seq", "seq2").alias("r")).select("doc_id", _R("r.ka").alias("ka"), _R("r.ks").alias("ks"), _R("r.ratio").alias("ratio"))


def nw_align(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.kernels import align_udf

    return _next_documents(spark, d).select("doc_id", align_udf("seq", "seq2").alias("r")).select("doc_id", "r.a", "r.b")


_PLAIN = (site_missingness_maf_eh, top_n_eh, site_filter_chain, tajima_components, fst_pairwise, fst_clusters, dosage_matrix_round, dosage_mode_impute, dosage_mean_impute, dosage_knn_impute, dosage_adaptive, ld_pairs, ld_decay_bins, ld_half_decay, ld_prune, curve_fit, haplotype_windows, haplotype_pc1, kinship_vanraden, relationship_class, pca, upgma, nj_tree, snp_clusters, ploidy_estimate, acgt_export, variant_class_counts, density_bins, marker_ids, sample_call_summary, sample_inbreeding, hwe_counts, hwe_exact, merge_full_outer, fdr_bh, fdr_by_trait, best_model, qq_ranks, lambda_median_pick, chrom_offsets, lead_snps, gwas_scan, epistasis, orphans_anti, synteny_report_counts, block_bounding_box, interval_overlap_semi, snp_in_interval_count, window_gene_join, nearby_snp_count, ks_histogram_smooth_peaks, chrom_pair_mean_ks, chromosome_tree, go_term_counts, go_enrichment, forward_fill_blocks, codon_translate, gc_content, jukes_cantor, kaks, nw_align)
QUERIES = {f.__name__: f for f in _PLAIN} | {f"{n}_histogram": _histogram(n, b) for n, b in (("maf", 50), ("eh", 10), ("missing", 10))} | {f"dist_{m}": _distance(m) for m in ("manhattan", "euclidean", "nei")}
