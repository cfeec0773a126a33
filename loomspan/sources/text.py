"""Readers of genomic text formats as typed DataFrames. Compressed files are read as they are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.names import gene_key
from ..operators.fill import carry_forward
from ..runtime import small

_AT = lambda c, i: F.get(c, F.lit(i))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): every line with its place in its file, carriage returns dropped.

    The place is where the line's block of the file begins and the line's number in its task: a task holds fewer
    lines than a block has bytes, so places ascend and are unique within a file, however it is split."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("value"))
    return df.select("file", (F.col("block") + F.col("id") % F.lit(1 << 33)).alias("line_no"), "value")


def with_row_ids(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """rows (file, line_no, ...) with `row_id`: unique over all files of the path, in the order of their names, then of lines."""
    files = sorted(spark.read.text(path).inputFiles())
    if len(files) == 1:
        return rows.withColumn("row_id", F.col("line_no"))
    # one file is written file:/x or file:///x
    places = spark.createDataFrame([(re.sub("^([a-z0-9]+):/+", r"\1:/", f), i) for i, f in enumerate(files)], "__f string, __i long")
    missing = F.raise_error(F.concat(F.lit("a file came while it was read: "), "file")).cast("long")
    rows = rows.withColumn("__f", F.regexp_replace("file", "^([a-z0-9]+):/+", "$1:/")).join(small(places), "__f", "left")
    return rows.withColumn("row_id", F.coalesce("__i", missing) * F.lit(1 << 40) + F.col("line_no")).drop("__i", "__f")


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """The sample names of the first #CHROM line; an error if there is none."""
    head = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError(f"no #CHROM line in {path}")
    return head.value.rstrip("\r").split("\t")[9:]


def java_split(c: Column, sep: str = "\t") -> Column:
    """Split without the empty fields at the end."""
    return F.split(F.regexp_replace(c, f"(?:{sep})+$", ""), sep)


def read_vcf(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(row_id, chrom, pos, id, ref, alt, qual, filter, info, format, calls). strict: lines shorter than their own file's header are dropped; else their calls are short."""
    every = lines(spark, path)
    rows = every.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select("file", "line_no", java_split(F.col("value")).alias("f"))
    if strict:
        heads = every.filter(F.col("value").startswith("#CHROM")).groupBy("file").agg(F.min_by(F.size(F.split("value", "\t", -1)), "line_no").alias("__width"))
        rows = rows.join(small(heads), "file").filter(F.size("f") >= F.col("__width")).drop("__width")
    rows = with_row_ids(rows, spark, path)
    names = ("id", "ref", "alt", "qual", "filter", "info", "format")
    return rows.select("row_id", _AT("f", 0).alias("chrom"), _AT("f", 1).try_cast("long").alias("pos"), *(_AT("f", i + 2).alias(n) for i, n in enumerate(names)), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("calls"))


def info_value(info: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(info, f"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def read_sv(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, svtype) of structural variants: longer than 50 or with a type."""
    v = read_vcf(spark, path)
    kind, end = info_value(F.col("info"), "SVTYPE"), info_value(F.col("info"), "END").try_cast("long")
    v = v.select("chrom", F.col("pos").alias("start"), F.coalesce(end, F.col("pos") + F.greatest(F.length("ref"), F.length("alt"))).alias("end"), kind.alias("svtype"))
    return v.filter((F.col("end") - F.col("start") > 50) | F.col("svtype").isNotNull())


def attributes(c: Column) -> Column:
    """Map of the `k=v` pairs between semicolons; other pieces are left out, the first of a key counts."""
    pairs = F.transform(F.filter(F.split(c, ";"), lambda x: F.size(F.split(x, "=")) == 2), lambda x: F.struct(F.trim(F.get(F.split(x, "="), F.lit(0))).alias("k"), F.trim(F.get(F.split(x, "="), F.lit(1))).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, 1, i), lambda y: y["k"] == x["k"])))


def _gff(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select("line_no", F.split("value", "\t").alias("f")).filter(F.size("f") >= 4)


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, chrom, start, end, strand, type, attrs): genes and mRNAs of nine columns, or all of four."""
    rows = _gff(spark, path).withColumn("attrs", F.when(F.size("f") >= 9, attributes(_AT("f", 8))))
    nine = F.size("f") >= 9
    rows = rows.filter(~nine | _AT("f", 2).isin("gene", "mRNA"))
    name = F.coalesce(F.try_element_at("attrs", F.lit("ID")), F.try_element_at("attrs", F.lit("Name")), F.concat(F.lit("unknown_"), F.col("line_no").cast("string")))
    return rows.select(F.when(nine, F.regexp_replace(name, "^(gene:|mRNA:|transcript:)", "")).otherwise(_AT("f", 1)).alias("gene_id"), _AT("f", 0).alias("chrom"), F.when(nine, _AT("f", 3)).otherwise(_AT("f", 2)).try_cast("long").alias("start"), F.when(nine, _AT("f", 4)).otherwise(_AT("f", 3)).try_cast("long").alias("end"), F.when(nine, _AT("f", 6)).alias("strand"), F.when(nine, _AT("f", 2)).alias("type"), "attrs")


def _lower(attrs: Column) -> Column:
    return F.transform_keys(attrs, lambda k, v: F.lower(k))


def read_gene_models(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, chrom, start, end, strand, note, go, pfam, interpro, subs): genes with the exons, CDS and UTRs of their mRNAs, subs by start."""
    f = _gff(spark, path).filter(F.size("f") >= 9).select(_AT("f", 0).alias("chrom"), _AT("f", 2).alias("type"), _AT("f", 3).try_cast("long").alias("start"), _AT("f", 4).try_cast("long").alias("end"), _AT("f", 6).alias("strand"), _lower(attributes(_AT("f", 8))).alias("a"))
    get = lambda *ks: F.coalesce(*(F.try_element_at("a", F.lit(k)) for k in ks))
    f = f.select("*", get("id").alias("id"), get("parent").alias("parent"))
    roots = f.filter((F.col("type") == "gene") | ((F.col("type") == "mRNA") & F.col("parent").isNull()))
    mrna = f.filter(F.col("type") == "mRNA").select(F.col("id").alias("m"), F.coalesce("parent", "id").alias("g"))
    subs = f.filter(F.lower("type").rlike("exon|cds|utr")).select(F.col("parent").alias("m"), F.struct("start", "end", "type").alias("sub"))
    subs = subs.join(mrna, "m", "left").select(F.coalesce("g", "m").alias("id"), "sub").groupBy("id").agg(F.array_sort(F.collect_list("sub")).alias("subs"))
    ref = F.split(F.coalesce(get("dbxref"), F.lit("")), ",")
    of = lambda db: F.array_distinct(F.transform(F.filter(ref, lambda x: (F.size(F.split(x, ":")) == 2) & F.lower(x).startswith(db)), lambda x: F.get(F.split(x, ":"), F.lit(1))))
    go = F.regexp_extract_all(F.coalesce(get("ontology_term", "go"), F.lit("")), F.lit(r"(GO:\d+)"), 1)
    return roots.join(subs, "id", "left").select(gene_key(F.col("id")).alias("gene_id"), "chrom", "start", "end", "strand", get("note", "description", "product").alias("note"), F.array_distinct(F.concat(go, F.transform(of("go"), lambda x: F.concat(F.lit("GO:"), x)))).alias("go"), of("pfam").alias("pfam"), of("interpro").alias("interpro"), F.coalesce("subs", F.array().cast("array<struct<start:bigint,end:bigint,type:string>>")).alias("subs"))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, description, go): from GFF by its extension, else from a table id, description, terms."""
    from ..functions.names import description

    if path.lower().split(".gz")[0].endswith((".gff", ".gff3")):
        g = read_genes(spark, path)
        text = F.concat_ws(",", *(F.try_element_at("attrs", F.lit(k)) for k in ("Ontology_term", "GO", "go", "Dbxref")))
        return g.select("gene_id", description(F.col("attrs")).alias("description"), F.array_distinct(F.regexp_extract_all(text, F.lit(r"(GO:\d+)"), 1)).alias("go"))
    t = lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 2)
    return t.select(gene_key(_AT("f", 0)).alias("gene_id"), _AT("f", 1).alias("description"), F.array_distinct(F.regexp_extract_all(F.coalesce(_AT("f", 2), F.lit("")), F.lit(r"(GO:\d+)"), 1)).alias("go"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): id is the first word of a header; of repeated ids the last counts."""
    rec = spark.read.option("lineSep", ">").text(path).select(F.monotonically_increasing_id().alias("n"), "value").filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s+", "")
    rows = rec.select("n", F.regexp_extract(head, r"^\s*(\S*)", 1).alias("seq_id"), seq.alias("seq"))
    return rows.groupBy("seq_id").agg(F.max_by("seq", "n").alias("seq"))


def extract(fasta: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (seq_id, start, end) with `seq`: the piece from start to end, from 1, both inclusive; end -1 or null is the whole. Ids match after normalising on both sides."""
    from ..functions.names import chromosome_key

    piece = F.when(F.col("end").isNull() | (F.col("end") < 0), F.col("__s")).otherwise(F.substring(F.col("__s"), F.greatest(F.col("start"), F.lit(1)).cast("int"), (F.col("end") - F.greatest(F.col("start"), F.lit(1)) + 1).cast("int")))
    keyed = fasta.select(chromosome_key(F.col("seq_id")).alias("__k"), F.col("seq").alias("__s"))
    return wanted.withColumn("__k", chromosome_key(F.col("seq_id"))).join(keyed, "__k", "left").withColumn("seq", piece).drop("__k", "__s")


def read_collinearity(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks (block_id, score, e_value, n_genes, orientation) and pairs (block_id, ord, gene1, gene2, e_value), from block text or a table."""
    t = lines(spark, path).filter(F.trim("value") != "")
    if t.filter(F.col("value").startswith("## Alignment")).isEmpty():
        f = t.filter(~F.col("value").startswith("#")).select("line_no", F.split("value", "\t").alias("f")).filter((F.size("f") >= 3) & (_AT("f", 0) != "block_id"))
        rows = f.select(_AT("f", 0).alias("block_id"), "line_no", _AT("f", 1).alias("gene1"), _AT("f", 2).alias("gene2"), _AT("f", 3).try_cast("double").alias("score"), _AT("f", 4).try_cast("double").alias("e_value"))
    else:
        head = F.regexp_extract("value", r"^## Alignment (\d+):", 1)
        marks = t.filter(F.col("value").startswith("## Alignment") | F.col("value").rlike(r"^\s*\d+-?\s*\d*:"))
        # a file is one ordered sequence; its blocks' headers are few, so the window is over the marks of one file
        filled = carry_forward(marks.withColumn("__h", F.when(head != "", F.col("value"))), ["file"], ["line_no"], "__h", "h")
        body = filled.filter(~F.col("value").startswith("##") & F.col("h").isNotNull())
        parts = F.split(F.regexp_replace("value", r"^[^:]*:\s*|\s+$", ""), r"\s+")
        rows = body.select(F.regexp_extract("h", r"Alignment (\d+):", 1).alias("block_id"), "line_no", _AT(parts, 0).alias("gene1"), _AT(parts, 1).alias("gene2"), F.regexp_extract("h", r"score=(\S+)", 1).try_cast("double").alias("score"), _AT(parts, 2).try_cast("double").alias("e_value"), F.when(F.col("h").contains("minus"), "minus").otherwise("plus").alias("o"))
    if "o" not in rows.columns:
        rows = rows.withColumn("o", F.lit("plus"))
    pairs = rows.select("block_id", F.row_number().over(W.Window.partitionBy("block_id").orderBy("line_no")).alias("ord"), "gene1", "gene2", "e_value")
    blocks = rows.groupBy("block_id").agg(F.max("score").alias("score"), F.min("e_value").alias("e_value"), F.count(F.lit(1)).alias("n_genes"), F.first("o").alias("orientation"))
    return blocks, pairs


def _table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    if sep is None:
        first = spark.read.text(path).first()
        sep = "," if first and "," in first.value else "\t"
    return spark.read.csv(path, sep=sep, header=True)


def read_phenotypes(spark: SparkSession, path: str, trait: str, fixed: list[str] | None = None) -> DataFrame:
    """(sample, y, fixed): rows whose trait is a number; fixed maps the named columns to their text."""
    t = _table(spark, path)
    by = {c.lower().strip(): c for c in t.columns}
    key = next((by[k] for k in ("id", "sample", "taxa") if k in by), t.columns[0])
    if trait.lower() not in by:
        raise ValueError(f"no trait {trait}")
    more = [by[c.lower()] for c in fixed or [] if c.lower() in by]
    extra = F.map_from_arrays(F.array(*(F.lit(c) for c in more)), F.array(*(t[c] for c in more))) if more else F.create_map().cast("map<string,string>")
    return t.select(F.trim(t[key]).alias("sample"), F.trim(t[by[trait.lower()]]).try_cast("double").alias("y"), extra.alias("fixed")).filter(F.col("y").isNotNull())


def read_population_map(spark: SparkSession, path: str) -> DataFrame:
    """(sample, population, rank): rank is the order in which populations are first seen."""
    t = lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select("line_no", F.split("value", "\t").alias("f")).filter(F.size("f") >= 2).select("line_no", F.trim(_AT("f", 0)).alias("sample"), F.trim(_AT("f", 1)).alias("population"))
    seen = t.groupBy("population").agg(F.min("line_no").alias("n"))
    # ranks are of populations, which are fewer than samples: one sorted task
    return t.join(small(seen.withColumn("rank", F.row_number().over(W.Window.orderBy("n", "population"))).drop("n")), "population").select("sample", "population", "rank")


def read_square(spark: SparkSession, path: str) -> DataFrame:
    """A square matrix with names in its first row and column as (sample1, sample2, value)."""
    t = spark.read.csv(path, header=True)
    names = t.columns[1:]
    return t.select(F.col(t.columns[0]).alias("sample1"), F.explode(F.arrays_zip(F.array(*(F.lit(n) for n in names)).alias("sample2"), F.array(*(t[n].try_cast("double") for n in names)).alias("value"))).alias("x")).select("sample1", "x.sample2", "x.value")


def read_q_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(sample, q array<double>)."""
    t = spark.read.csv(path, header=True)
    return t.select(F.col(t.columns[0]).alias("sample"), F.array(*(F.coalesce(t[c].try_cast("double"), F.lit(0.0)) for c in t.columns[1:])).alias("q"))


def read_pca(spark: SparkSession, path: str) -> DataFrame:
    """(sample, pc1, pc2, clusters as JSON); names of columns in any case, missing clusters are `?`."""
    t = spark.read.csv(path, header=True)
    by = {c.lower(): c for c in t.columns}
    col = lambda n: t[by[n]] if n in by else F.lit(None).cast("string")
    groups = F.to_json(F.struct(*(F.coalesce(col(f"{n}_cluster"), F.lit("?")).alias(n) for n in ("kmeans", "dbscan", "gmm"))))
    return t.select(col("sample").alias("sample"), col("pc1").try_cast("double").alias("pc1"), col("pc2").try_cast("double").alias("pc2"), groups.alias("clusters"))


def read_dosages(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, chrom, pos, d): negative values are missing."""
    t = spark.read.csv(path, sep="\t", header=True)
    cols = [c for c in t.columns[2:] if c and not c.startswith("_c")]
    d = F.transform(F.array(*(t[c].try_cast("double") for c in cols)), lambda x: F.when(x >= 0, x))
    return t.select(F.monotonically_increasing_id().alias("row_id"), t[t.columns[0]].alias("chrom"), t[t.columns[1]].try_cast("long").alias("pos"), d.alias("d"))


def read_kaks(spark: SparkSession, path: str) -> DataFrame:
    """(gene1, gene2, ka, ks, ratio); unreadable rows are left out."""
    f = lines(spark, path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 5)
    return f.select(gene_key(_AT("f", 0)).alias("gene1"), gene_key(_AT("f", 1)).alias("gene2"), *(_AT("f", i).try_cast("double").alias(n) for i, n in ((2, "ka"), (3, "ks"), (4, "ratio")))).filter("ka is not null and ks is not null and ratio is not null")


def read_include_list(spark: SparkSession, path: str) -> DataFrame:
    """(marker): one id a line."""
    return spark.read.text(path).select(F.trim("value").alias("marker")).filter(F.col("marker") != "").distinct()


def convert_calls(variants: DataFrame, to: str) -> DataFrame:
    """variants with base counts rewritten as reference and alternate depths: to 'ad' (GT:AD) or 'ro' (GT:RO:AO)."""
    from ..functions.calls import read_counts, subfield, tag_place

    def one(c: Column) -> Column:
        gt = F.coalesce(subfield(c, tag_place(F.col("format"), "GT")), F.lit("./."))
        n = read_counts(c, F.col("format"), F.col("ref"), F.col("alt"))
        ref, alt = n["ref"].cast("long").cast("string"), n["alt"].cast("long").cast("string")
        return F.when(n.isNull(), F.concat(gt, F.lit(":.,." if to == "ad" else ":.:."))).otherwise(F.concat(gt, F.lit(":"), ref, F.lit("," if to == "ad" else ":"), alt))

    return variants.withColumn("calls", F.transform("calls", one)).withColumn("format", F.lit("GT:AD" if to == "ad" else "GT:RO:AO"))
