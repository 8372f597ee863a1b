"""Reading and writing files: typed CSV, JSON lines or arrays, models, logs.

Paths go to Spark's readers and writers as they are, so any Hadoop file system
will do.  Writers overwrite unless their name says append.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERACTIONS = T.StructType([T.StructField(n, t) for n, t in (("user_id", T.LongType()), ("book_id", T.LongType()), ("is_read", T.ByteType()), ("rating", T.ByteType()), ("is_reviewed", T.ByteType()))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A headed CSV; typed with a schema, all strings without; limit 0 or None means all rows."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit else df


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by an explicit order; file order is not one."""
    return df.orderBy(*order).limit(n)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines or one JSON array, plain or gzip, told apart by the first character that is not blank."""
    head = next((x["value"].lstrip() for x in spark.read.text(path).where(F.trim("value") != "").limit(1).collect()), "")
    reader = spark.read.option("multiLine", head.startswith("["))
    return (reader.schema(schema) if schema else reader).json(path)


def write_parquet(df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """A headed CSV in the given order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row result as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_model(path: str, users: DataFrame, items: DataFrame, meta: dict) -> None:
    """Factor tables and metadata below one path."""
    users.write.mode("overwrite").parquet(f"{path}/users")
    items.write.mode("overwrite").parquet(f"{path}/items")
    users.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"), meta


def append_log(spark: SparkSession, path: str, rows: list[dict], schema: str) -> None:
    """Rows added to a run log; the table begins with the first of them."""
    spark.createDataFrame([tuple(r.get(f.name) for f in T.StructType.fromDDL(schema)) for r in rows], schema).coalesce(1).write.mode("append").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output is at path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sql_literal(value: Column) -> Column:
    """A string as an SQL literal with doubled quotes; null as NULL."""
    return F.when(value.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row; missing numbers are 0."""
    numeric = (T.NumericType,)
    values = [F.coalesce(F.col(f.name).cast("string"), F.lit("0")) if isinstance(f.dataType, numeric) else sql_literal(F.col(f.name)) for f in df.schema.fields]
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *values), F.lit(");")).alias("statement"))
