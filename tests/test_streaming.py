from loomspan.streaming import ingest

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n"


def test_valid_and_failed_lines(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.vcf").write_text(HEAD + "c\t1\t.\tA\tG\t.\t.\t.\tGT\t0/1\r\nc\t0\t.\tA\tG\t.\t.\t.\tGT\t0/1\n")
    paths = [str(tmp_path / x) for x in ("good", "bad", "cp")]
    ingest.load_valid(spark, str(src), *paths).awaitTermination()
    (src / "b.vcf").write_text(HEAD + "c\t2\t.\tA\tC\t.\t.\t.\tGT\t0/1\t1/1\n")
    ingest.load_valid(spark, str(src), *paths).awaitTermination()
    assert [r.pos for r in spark.read.parquet(paths[0]).select("pos").collect()] == [1]
    assert sorted(r.reason for r in spark.read.parquet(paths[1]).collect()) == ["columns", "fixed"]


def test_counts_by_window(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.vcf").write_text(HEAD + "c\t1\t.\tA\tG\t.\t.\t.\tGT\t0/1\nc\t2\t.\tA\tC\t.\t.\t.\tGT\t0/1\nd\t2\t.\tA\tCC\t.\t.\t.\tGT\t0/1\n")
    counts = ingest.class_counts(ingest.sites_of(ingest.variant_stream(spark, str(src))))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.chrom: (r.sites, r.snps, r.transitions) for r in spark.table("counts").collect()}
    assert got == {"c": (2, 2, 1), "d": (1, 0, 0)}
