"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import checkpoint_dir

# white space of the word rules: space and \t \n \v \f \r
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    and survives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_dealt(df: DataFrame, what: str, by: str, n: int | None = None) -> DataFrame:
    """As :func:`keep`, dealt by a column into ``n`` buckets (as many as the shuffle has partitions):
    joins on it move the other side only."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(n, by).saveAsTable(name)
    kept = spark.table(name)
    kept.schema  # resolved: from here on the name in the catalog is not needed, and the files stay
    spark.sql(f"DROP TABLE {name}")
    return kept


def words(text: Column) -> Column:
    """Words of a text: the runs without white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")
