"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, shared_path  # noqa: F401

#: ASCII white space: [\x20\x09-\x0D]. bytes.split() without arguments splits at exactly these.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of keys is broadcast only up to this many rows (16 bytes each); beyond it, a shuffle join does the work.
MAX_BROADCAST_ROWS = 8_000_000
#: Rows that are Python objects at once.
SLICE_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once as Parquet in the shared folder and read it back, so a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: Catalyst would otherwise copy it into each use inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the held-out folds. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def free_name(df: DataFrame, base: str) -> str:
    """base, or base and as many '_' as it takes for no column of df to begin with it."""
    while any(c.lower().startswith(base.lower()) for c in df.columns):
        base += "_"
    return base


def bounded(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """df written once, and whether it has at most limit (else MAX_BROADCAST_ROWS) rows, so that it may be broadcast."""
    kept = materialize(df, "keys")
    return kept, kept.count() <= (MAX_BROADCAST_ROWS if limit is None else limit)


def restrict(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the ids; the ids are broadcast only if they are few enough, else both sides are shuffled."""
    kept, small = bounded(ids)
    return docs.join(F.broadcast(kept) if small else kept, ids.columns, how)


def map_rows(df: DataFrame, work: Callable[[Iterable[dict[str, list]]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over plain Python lists: work gets rows, at most SLICE_ROWS at once, as a dict of columns and yields dicts of columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(b.slice(i, SLICE_ROWS).to_pydict() for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
