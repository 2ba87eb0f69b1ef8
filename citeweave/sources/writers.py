"""Sinks (S5-S7): distributed writes, no ``toPandas``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import ARTICLE_SCHEMA
from .readers import read_csv_typed, read_json_lines


def write_csv(df: DataFrame, path: str, single_file: bool = False, compression: str | None = None) -> None:
    """CSV with a header, one folder per result.

    ``single_file`` coalesces to one task and is meant for bounded results
    (top-k tables, aggregates over a fixed domain) only.  ``compression`` is for
    whole collections; a file with quoted newlines is read by one task either way.
    """
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, compression=compression))


def export_collection(df: DataFrame, path: str, id_col: str = "ingest_id") -> None:
    """The whole collection as JSON lines, without the internal id."""
    df.drop(id_col).write.mode("overwrite").json(path)


def export_source(df: DataFrame, source: str, path: str, id_col: str = "ingest_id") -> None:
    """S7 as each collector does it: the rows of one source (P6 filter), without the id.
    The filter reaches the Parquet scan of a landed collection."""
    df.where(F.col("source") == source).drop(id_col).write.mode("overwrite").json(path)


def export_by_source(df: DataFrame, path: str, id_col: str = "ingest_id") -> DataFrame:
    """One JSON export per source in a single job (``by=<name>/`` folders).

    Rows are rebalanced on the source before the write: small sources are one
    file each, and a hot one is dealt out, by its measured size, over as many tasks
    as it has files of the advisory size.  The
    records hold the source themselves: NULL and ``''``, which share a folder,
    stay apart.  Returns the export read back with its schema, so the written
    files are what the caller sees.
    """
    out = df.withColumn("by", F.col("source"))
    (out.hint("rebalance", "by").drop(id_col).write.mode("overwrite").option("ignoreNullFields", False)
     .partitionBy("by").json(path))
    others = [f for f in ARTICLE_SCHEMA.fields if f.name != "source" and f.name in df.columns]
    extra = [f for f in df.schema.fields if f.name not in ARTICLE_SCHEMA.fieldNames() and f.name != id_col]
    schema = StructType(others + extra + [StructField("source", StringType(), True)])
    return read_json_lines(df.sparkSession, path, schema).select(*[F.col(f.name) for f in schema.fields])


def json_round_trip(df: DataFrame, path: str, id_col: str = "ingest_id") -> DataFrame:
    """The collection exported without its id and read back."""
    export_collection(df, path, id_col)
    return read_json_lines(df.sparkSession, path, df.drop(id_col).schema)


def csv_round_trip(df: DataFrame, path: str) -> DataFrame:
    """A result written as compressed CSV and read back typed."""
    write_csv(df, path, compression="gzip")
    return read_csv_typed(df.sparkSession, path, df.schema)
