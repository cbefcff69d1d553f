"""Helpers that the training-data operators share: document columns, Arrow batches, tables in the shared folder."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.settled import shared_dir

#: Python's list of Unicode White_Space is this one and U+001C..U+001F besides.
_SPACES = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one; other columns can't clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_key(df: DataFrame) -> DataFrame:
    """Adds ``key``, twelve bytes of the text's SHA-256: rows share it if their texts are equal."""
    return df.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 24)))


def row_key(df: DataFrame) -> DataFrame:
    """Adds ``key``: rows that agree in id and text share it, so it survives any re-run of the scan."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return df.withColumn("key", F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(own), own, F.col("text")), 256), 1, 32)))


def wrapped(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and ``rest``, a struct of all columns but the text: none can clash with an operator's own."""
    quoted = ("`" + c.replace("`", "``") + "`" for c in docs.columns if c != "text")
    return docs.select("doc_id", "text", F.struct(*map(F.col, quoted)).alias("rest"))


def unwrapped(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``wrapped`` put away, with the text of ``df``."""
    return df.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


@functools.cache
def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of columns of plain types and arrays of them, without a Spark session (for tasks)."""
    kind = lambda t: pa.list_(_ARROW[t[6:-1]]) if t.startswith("array<") else _ARROW[t]
    return pa.schema([(name, kind(t)) for name, t in (c.split() for c in ddl.split(","))])


def batch_of(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch from rows."""
    schema = arrow_schema(ddl)
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def batch_from(ddl: str, **columns) -> pa.RecordBatch:
    """A batch from columns."""
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f in schema for x in [columns[f.name]]], schema=schema)


def sliced(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows at most: what a task makes of a part is gone before the next one."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder for one table in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}-{name}"
    place, system = _at(spark, path)
    system.deleteOnExit(place)
    return path


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: a short lineage that survives the loss of executors.

    The table goes when the application ends, or with ``forget``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._place = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more (loops would fill the disk with them)."""
    for table in tables:
        place, system = _at(table.sparkSession, table._place)
        system.delete(place, True)
