"""Dynamic documents (S1, S2, S9): JSON arrays whose objects differ in their fields.

The collectors' store has no schema: an object may lack fields or bring its own.  A fixed schema would drop the
latter, and inference costs a pass over text and fails on mixed types.  Here every object is landed as one VARIANT
value, parsed once and written as Parquet (splittable, columnar); its fields are probed from the data by an aggregate
and read as typed columns, a value of another type as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..session import materialize

DOCUMENT = "document"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Objects of JSON-array files as (file, pos, document); each file is one array, on one line or many.

    A file cannot be split, so it is one task; a malformed one fails the read."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    objects = F.from_json("value", "array<variant>", {"mode": "FAILFAST"})
    return texts.select("file", F.posexplode(objects).alias("pos", DOCUMENT))


def land_documents(spark: SparkSession, path: str) -> DataFrame:
    """``read_documents``, landed as Parquet."""
    return materialize(read_documents(spark, path), "documents")


def fields(docs: DataFrame) -> dict[str, str]:
    """Every field that some document has, with the type that holds all its values; one aggregate, merged map-side."""
    found = docs.agg(F.schema_of_variant_agg(DOCUMENT).alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        return {}
    kind = DataType.fromDDL(found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))
    assert isinstance(kind, StructType)
    return {f.name: f.dataType.simpleString() for f in kind.fields}


def field(name: str, kind: str = "string") -> Column:
    """A field as a typed column; NULL where it is missing or holds something else."""
    for quote in "'", '"':                   # paths have no escapes
        if quote not in name and "?" not in name:
            return F.try_variant_get(DOCUMENT, f"$[{quote}{name}{quote}]", kind)
    return F.try_variant_get(F.try_element_at(F.try_variant_get(DOCUMENT, "$", "map<string,variant>"), F.lit(name)), "$", kind)


def columns(docs: DataFrame, wanted: dict[str, str] | None = None) -> DataFrame:
    """The documents as columns: the fields ``wanted`` (name to type; absent ones are NULL), by default all there are."""
    wanted = fields(docs) if wanted is None else wanted
    return docs.select(*[field(n, k).alias(n) for n, k in wanted.items()])


ARRAY_ROWS = 10_000          # objects of an array that is written


def write_arrays(df: DataFrame, path: str, order: str = "ingest_id") -> None:
    """Rows as files of one JSON array each, NULL fields left out; consecutive ids share a file."""
    own = df.select(F.floor(F.col(order) / ARRAY_ROWS).alias("chunk"), F.col(order).alias("_o"),
                    F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("object"))
    arrays = own.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("_o", "object"))).alias("objects"))     # at most ARRAY_ROWS, ids being unique
    text = F.concat(F.lit("["), F.array_join(F.transform("objects", lambda x: x["object"]), ", "), F.lit("]"))
    arrays.select("chunk", text.alias("value")).repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(path)
