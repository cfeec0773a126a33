import numpy as np
from pyspark.sql import functions as F

from loomspan import runtime


def test_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(runtime, "FAN_IN", 3)
    df = spark.range(0, 200, numPartitions=20).select((F.col("id") % 4).alias("g"), F.col("id").cast("double").alias("v"))
    pack = F.pandas_udf(lambda v: v.map(lambda x: np.array([x, 1.0]).tobytes()), "binary")
    pack_df = df.select("g", pack("v").alias("x"))
    out = {r.g: np.frombuffer(r.x).tolist() for r in runtime.tree_sum(pack_df, ["g"], ["x"]).collect()}
    assert out == {g: [float(sum(range(g, 200, 4))), 50.0] for g in range(4)}


def test_files_count_what_they_unpack_to(spark, tmp_path):
    spark.range(200_000).select((F.col("id") % 7).alias("x")).coalesce(1).write.option("compression", "zstd").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert runtime.plan_bytes(df) >= 4 * sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet")) * 0.9
