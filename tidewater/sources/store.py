"""Versioned feature tables: <root>/<version>/<split>.parquet, and one metadata row a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .shared import file_system, names_in

VERSION = re.compile(r"v(\d+)\.(\d+)\.(\d+)")
SPLIT = re.compile(r"[a-z][a-z0-9_]*")
FEATURE = r"^f\d+_.*"
META = "version string, split string, n_rows long, n_columns int, columns array<string>, source string, content_hash long, saved_at timestamp"


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.match(FEATURE, c)]


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, version: str, split: str) -> str:
        if not VERSION.fullmatch(version):
            raise ValueError(f"a version looks like v1.2.3, not {version!r}")
        if not SPLIT.fullmatch(split):
            raise ValueError(f"not a split name: {split!r}")
        return f"{self.root}/{version}/{split}.parquet"

    def _record(self, version: str, split: str, source: str, n_rows: int, columns: list[str], content_hash: int | None) -> None:
        row = (version, split, n_rows, len(columns), columns, source, content_hash)
        made = self.spark.createDataFrame([row], META.removesuffix(", saved_at timestamp")).withColumn("saved_at", F.current_timestamp())
        made.coalesce(1).write.mode("append").parquet(f"{self.root}/metadata")

    def _claim(self, version: str, split: str) -> str:
        """The path of a table that is not there yet. What a save that failed has left, data without a metadata row, is no table and is removed."""
        path = self._path(version, split)
        if not self.metadata().where((F.col("version") == version) & (F.col("split") == split)).isEmpty():
            raise FileExistsError(f"{split} of {version} exists already; a saved table is never replaced")
        fs, p = file_system(self.spark, path)
        fs.delete(p, True)
        return path

    def save(self, table: DataFrame, version: str, split: str, source: str) -> str:
        """Write once; a saved table is never replaced. A table counts as saved with its metadata row, which is written last."""
        path = self._claim(version, split)
        table.write.parquet(path)
        one = self.spark.read.schema(table.schema).parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*table.columns)).alias("content_hash")).first()
        self._record(version, split, source, one["n_rows"], table.columns, one["content_hash"])
        return path

    def register(self, parquet_path: str, version: str, split: str, source: str) -> str:
        """Adopt a written Parquet table: moved inside one file system, copied by Spark between two.

        Columns and number of rows come from the footers; no row is read where the table is moved, so it has no content hash.
        """
        table = self.spark.read.parquet(parquet_path)
        n_rows, path = table.count(), self._claim(version, split)  # a count without columns reads footers only
        fs, target = file_system(self.spark, path)
        other, origin = file_system(self.spark, parquet_path)
        if fs.getUri().equals(other.getUri()):
            fs.mkdirs(target.getParent())
            if not fs.rename(origin, target):
                raise OSError(f"could not move {parquet_path} to {path}")
        else:
            table.write.parquet(path)
        self._record(version, split, source, n_rows, table.columns, None)
        return path

    def metadata(self) -> DataFrame:
        if not names_in(self.spark, f"{self.root}/metadata"):
            return self.spark.createDataFrame([], META)
        return self.spark.read.schema(META).parquet(f"{self.root}/metadata")

    def versions(self) -> list[str]:
        """By number, so v0.10.0 follows v0.2.0."""
        part = lambda i: F.regexp_extract("version", VERSION.pattern, i).cast("int")
        return [r["version"] for r in self.metadata().select("version").distinct().orderBy(part(1), part(2), part(3)).collect()]

    def load(self, version: str, split: str) -> DataFrame:
        try:
            return self.spark.read.parquet(self._path(version, split))
        except AnalysisException as e:
            raise FileNotFoundError(f"no {split} of {version}; versions: {self.versions()}") from e
