"""Series in long form (source, ts, value) from wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def find_dataset(spark: SparkSession, folder: str, name: str | None = None) -> str:
    """The CSV file called name, else the only one whose name contains it; ambiguity is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".csv"))
    found = [f for f in files if f == f"{name}.csv"] or [f for f in files if name is None or name in f]
    if len(found) != 1:
        raise ValueError(f"{len(found)} datasets match {name!r}: {found}")
    return f"{folder}/{found[0]}"


def read_csv(spark: SparkSession, path: str, time: str = "date") -> DataFrame:
    """A wide CSV table: a timestamp column and any number of double columns, named by the header."""
    header = spark.read.option("header", True).csv(path).columns
    if time not in header:
        raise ValueError(f"no column {time!r} in {path}")
    schema = T.StructType([T.StructField(c, T.TimestampNTZType() if c == time else T.DoubleType()) for c in header])
    return spark.read.schema(schema).option("header", True).csv(path)


def to_long(wide: DataFrame, time: str = "date", columns: list[str] | None = None) -> DataFrame:
    """Each chosen value column as a series of its own."""
    columns = columns or [c for c in wide.columns if c != time]
    if missing := set(columns) - set(wide.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return wide.select(F.col(time).alias("ts"), *columns).unpivot("ts", columns, "source", "value").select("source", "ts", "value")


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as series: one for each event type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("source"), "ts", F.col("event_id").alias("tie"), "value")
