"""Session helpers: shared folder, lineage cuts, size-checked broadcasts, table loading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated plan size, in bytes, of a side that is broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes in memory for each byte of a file: Catalyst takes a file's compressed size for that of its rows.
FILE_EXPANSION = 4.0


def _true_sizes(spark: SparkSession) -> None:
    """Let Catalyst's estimates of files count what they unpack to, unless the session has set a factor of its own.

    Else joins of large tables in small files would be broadcast, by its own choice too."""
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key, "1.0")) == 1.0:
        spark.conf.set(key, str(FILE_EXPANSION))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _true_sizes(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in its absence (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loomspan-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended already
        pass


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: ends its lineage, survives the loss of executors.

    The files go when the Python driver ends, or by `release`."""
    spark = df.sparkSession
    _true_sizes(spark)
    path = f"{shared_dir(spark)}/loomspan-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomspan_path = path
    return out


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the Python driver ends."""
    path = f"{shared_dir(spark)}/loomspan-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def release(df: DataFrame | None) -> None:
    """Delete the files behind a table made by `cut`, once nothing reads it any more."""
    path = getattr(df, "_loomspan_path", None)
    if path:
        _remove(df.sparkSession, path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df, that of files raised by FILE_EXPANSION."""
    _true_sizes(df.sparkSession)
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size is at most `limit`; else as it is, for a shuffled join."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


#: Parts that one task adds up.
FAN_IN = 64


def tasks_of(df: DataFrame) -> int:
    """The tasks that give df: as many as its files' parts, or, after a shuffle, about as many as the session's. Nothing is run."""
    if "Adaptive" in df._jdf.queryExecution().executedPlan().nodeName():
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.rdd.getNumPartitions()


def tree_sum(parts: DataFrame, by: list[str], blobs: list[str]) -> DataFrame:
    """The sums of vectors of doubles given as binaries, by the columns `by`.

    Whatever the number of tasks that give parts, none adds more than FAN_IN of a sum (or a few more, if a shuffle made
    more tasks than the session's number): each level adds those of FAN_IN tasks."""
    kinds = dict(parts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "__k long", *(f"`{c}` binary" for c in blobs)])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {c: [pdf[c].iloc[0]] for c in [*by, "__k"]}
        for c in blobs:
            total = np.frombuffer(pdf[c].iloc[0]).copy()
            for x in pdf[c].iloc[1:]:
                total += np.frombuffer(x)
            out[c] = [total.tobytes()]
        return pd.DataFrame(out)

    left = max(tasks_of(parts), 1)
    parts = parts.withColumn("__k", F.spark_partition_id().cast("long"))
    while True:
        left = -(-left // FAN_IN)
        parts = parts.withColumn("__k", F.expr(f"__k div {FAN_IN}") if left > 1 else F.lit(0).cast("long")).groupBy(*by, "__k").applyInPandas(add, schema)
        if left == 1:
            return parts.drop("__k")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{base}", 0
    while name.lower() in taken:
        name, k = f"__{base}{k}", k + 1
    return name


def once_per(df: DataFrame, *ids: str) -> DataFrame:
    """One row per id (rows repeated under one id count once). Rows whose id is null stay, each for itself."""
    known = F.lit(True)
    for c in ids:
        known &= F.col(c).isNotNull()
    if not any(f.nullable for f in df.schema if f.name in ids):
        return df.dropDuplicates(list(ids))
    lone = fresh(df, "lone")
    return df.withColumn(lone, F.when(~known, F.monotonically_increasing_id())).dropDuplicates([*ids, lone]).drop(lone)
