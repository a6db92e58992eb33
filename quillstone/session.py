"""What the engine's Python functions need on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of an Arrow batch, where the session has no value of its own (then 64 MB, which both sides of a worker hold).
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, so that they need no installation of it; batches to them are bounded by bytes."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{64 << 20}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    if getattr(context, "_quillstone_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for file in sorted(files):
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.join(name, os.path.relpath(full, root)))
    context.addPyFile(target)
    context._quillstone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one below the warehouse, which all executors share too."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch").rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quillstone/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, evaluates df once."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table made by stored() that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with the number of each row, from 1, in an order over all rows: ranges of it are numbered by themselves, on from the counts of the ranges before. One number a range is gathered; no task sees all rows."""
    parts = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before = [sum(n for p, n in counts.items() if p < part) for part in range(max(counts, default=0) + 1)]
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn(out, (F.get(F.array(*map(F.lit, before)), F.col("__part")) + own).cast("long")).drop("__part")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is small: a table that fills fewer scan splits than there are cores is dealt out evenly; a larger one stays as its scan splits it."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    stated = spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")
    split = int(stated) if stated.isdigit() else 128 << 20
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df
