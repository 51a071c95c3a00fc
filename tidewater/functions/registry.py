"""Named features: SQL templates over {source} or functions of the frame, computed in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    """compute: a SQL template that returns (row_id, value), or a function from the frame so far to a Column."""

    name: str
    compute: str | Callable[[DataFrame], Column]
    output_type: str
    description: str = ""
    dependencies: tuple[str, ...] = ()


class Registry:
    def __init__(self) -> None:
        self.features: dict[str, Feature] = {}

    def register(self, feature: Feature) -> Feature:
        if feature.name in self.features:
            raise ValueError(f"feature {feature.name!r} is registered already")
        self.features[feature.name] = feature
        return feature

    def feature(self, name: str, output_type: str, description: str = "", dependencies: tuple[str, ...] = ()):
        """Decorator: register a function of the frame."""
        def wrap(f: Callable[[DataFrame], Column]) -> Callable[[DataFrame], Column]:
            self.register(Feature(name, f, output_type, description, dependencies))
            return f

        return wrap


class FeatureSet:
    """Duplicates, unknown dependencies and cycles raise when the set is made."""

    def __init__(self, features: Sequence[Feature]):
        by_name = {f.name: f for f in features}
        if len(by_name) < len(features):
            raise ValueError("a feature name occurs twice")
        if missing := {d for f in features for d in f.dependencies} - by_name.keys():
            raise ValueError(f"unknown dependencies: {sorted(missing)}")
        try:
            order = list(TopologicalSorter({f.name: f.dependencies for f in features}).static_order())
        except CycleError as e:
            raise ValueError(f"features depend on each other: {e.args[1]}") from e
        self.ordered = [by_name[n] for n in order]

    def compute(self, spark: SparkSession, source: DataFrame) -> DataFrame:
        out = source
        for f in self.ordered:
            if isinstance(f.compute, str):
                out = attach(out, spark.sql(f.compute, source=source), f.name, f.output_type)
            else:
                out = out.withColumn(f.name, f.compute(out).cast(f.output_type))
        return out


def attach(df: DataFrame, values: DataFrame, name: str, output_type: str) -> DataFrame:
    """df with the (row_id, value) relation as a column; other columns, missing, doubled or foreign row ids raise."""
    if sorted(values.columns) != ["row_id", "value"]:
        raise ValueError(f"{name}: expected the columns row_id and value, got {values.columns}")
    own, other = df.select("row_id", F.lit(1).alias("a")), values.select("row_id", F.lit(1).alias("b"))
    bad = own.join(other, "row_id", "full").groupBy("row_id").agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> n OR b <> n OR n > 1")
    if not bad.isEmpty():
        raise ValueError(f"{name}: its rows are not the source's rows")
    return df.join(values.select("row_id", F.col("value").cast(output_type).alias(name)), "row_id")
