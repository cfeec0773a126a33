"""Structured Streaming over a folder to which variant files are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import calls as C
from ..operators import rejects


def variant_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """(file, block, value, arrived) of the lines of new files, carriage returns dropped; block: where the line's part of the file begins; arrived: the file's time."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_modification_time").alias("arrived"))


def sites_of(stream: DataFrame) -> DataFrame:
    """(file, arrived, chrom, pos, ref, alt, format, calls) of the data lines."""
    f = F.split("value", "\t")
    rows = stream.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("file", "arrived", f.alias("f")).filter(F.size("f") >= 8)
    at = lambda i: F.get("f", F.lit(i))
    return rows.select("file", "arrived", at(0).alias("chrom"), at(1).try_cast("long").alias("pos"), at(3).alias("ref"), at(4).alias("alt"), at(8).alias("format"), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("calls"))


def class_counts(sites: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Sites, SNPs and transitions by chromosome and window of arrival; files later than `late` are left out."""
    snp = C.biallelic_snp(F.col("ref"), F.col("alt"))
    w = sites.withWatermark("arrived", late).groupBy(F.window("arrived", window), "chrom")
    return w.agg(F.count(F.lit(1)).alias("sites"), F.count_if(snp).alias("snps"), F.count_if(snp & C.transition(F.col("ref"), F.col("alt"))).alias("transitions"))


def load_valid(spark: SparkSession, folder: str, good: str, bad: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """Load each new file's valid lines into `good` and the others with their reason into `bad`, each file once.

    Files are whole within a batch, so that a line meets its own header; both tables are written under the
    batch's number, so that a batch that is run again replaces what it wrote."""
    lines = variant_stream(spark, folder, files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        # ascends within a file, whatever tasks its parts are read by (see sources.text.lines)
        place = F.col("block") + F.monotonically_increasing_id() % F.lit(1 << 33)
        numbered = batch.select("file", place.alias("line_no"), F.col("value").alias("raw_line"))
        checked = rejects.check_lines(numbered, "file").persist()
        try:
            rejects.loaded(checked, "file").write.mode("overwrite").parquet(f"{good}/batch={number}")
            rejects.failed(checked, "file").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            checked.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
