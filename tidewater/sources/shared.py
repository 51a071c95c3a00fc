"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: evaluated once, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop's classes: paths may be in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file so that readers see all of it or none: under another name first, then renamed. An existing file stays."""
    fs, target = file_system(spark, path)
    _, draft = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, target):
        fs.delete(draft, False)
        if not fs.exists(target):
            raise OSError(f"could not write {path}")


def published(spark: SparkSession, path: str) -> str | None:
    """The text of a published file, None where there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, none where there is no folder."""
    fs, p = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df written once, with __part: the number of its range partition in that order. Equal rows have one part, and parts are about equally large."""
    return write_once(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
