"""Readers for article exports and result tables.

Schemas are always given: the analysis stage of the reference infers them
from a JSON array, which costs a pass and makes types depend on the data.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..schema import ARTICLE_SCHEMA


def read_json_array(spark: SparkSession, path: str, schema: StructType = ARTICLE_SCHEMA) -> DataFrame:
    """A JSON array file (``[{...}, ...]``); missing fields read as NULL.

    A whole-file JSON document cannot be split, so each file is one task;
    land it once as Parquet (``land``) before heavy work.  An empty array
    gives an empty frame; a malformed document fails the read.
    """
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_positions(spark: SparkSession, path: str, schema: StructType = ARTICLE_SCHEMA) -> DataFrame:
    """JSON-array files as (file, pos, columns): ``pos`` is a record's place in its array."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    array = F.from_json("value", ArrayType(schema), {"mode": "FAILFAST"})
    return texts.select("file", F.posexplode(array).alias("pos", "record")).select("file", "pos", "record.*")


def input_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a text input, sorted; a row per file, which the driver lists for any read."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"))
    return sorted({r["file"] for r in files.distinct().collect()})


def read_json_lines(spark: SparkSession, path: str, schema: StructType = ARTICLE_SCHEMA) -> DataFrame:
    """JSON lines (one object per line), splittable; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv_typed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S3: CSV with a header and typed columns; quoted fields may hold newlines.  An unquoted empty field is NULL,
    a quoted one is ``''``; a malformed row fails the read."""
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True).option("mode", "FAILFAST")
            .option("nullValue", "\0")                 # what an unquoted empty field stands for; '' stays ''
            .option("quote", '"').option("escape", '"')
            .csv(path))


def read_csv_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Like ``read_csv_typed``, but an empty typed frame when the path does not exist."""
    try:
        return read_csv_typed(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a frame as Parquet and read it back (cuts lineage, splittable, prunable)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
