"""A collection of points: a Parquet table partitioned by source and slab, keyed by source and window_idx.

A slab is a stretch of consecutive places of a source. The first rows of a collection, and
rows with new keys, are appended where they are made, without a shuffle. An upsert adds its
rows beside those that they replace, as the changes of one number, so its cost goes with the
rows that it brings; a reader takes the row of the largest number of each key. After CHANGES
upserts the slabs that hold changes are rewritten, and no others. Within a file rows
are sorted by month, hour and place, so that filters by time skip row groups by their
statistics. A reader of a slab that is being rewritten may have to be started again. Of two
writers that number samples at a time, both may take one number; the later upsert wins. Two
writers must not upsert at a time.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import POINT
from .staging import delete, discard, stage

#: Consecutive windows of a source that make a slab, and bytes of a row group within it.
SLAB, GROUP_BYTES = 50_000, 4 << 20
#: Upserts whose rows stand beside those that they replace, before slabs are rewritten.
CHANGES = 8
_WIDTH = "vectors must have {} dimensions"


class Collection:
    def __init__(self, spark: SparkSession, path: str, width: int, schema: T.StructType = POINT, key: tuple[str, ...] = ("source", "window_idx"), slab: int = SLAB) -> None:
        self.spark, self.path, self.width, self.schema, self.key, self.slab = spark, path, width, schema, key, slab
        self.stored = T.StructType([*schema.fields, T.StructField("change", T.IntegerType()), T.StructField("slab", T.LongType())])

    def _at(self, *below: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self) -> bool:
        fs, at = self._at()
        return fs.exists(at)

    def create(self) -> None:
        """An empty table, or a check that the one there has this vector width."""
        if not self.exists():
            self.spark.createDataFrame([], self.stored).write.partitionBy("source", "slab").parquet(self.path)
        elif (found := stats(self._read()).first()["vector_width"]) not in (None, self.width):
            raise ValueError(f"the collection's vectors have {found} dimensions, not {self.width}")

    def drop(self) -> None:
        delete(self.spark, self.path)

    def read(self, **more: Column) -> DataFrame:
        """The rows; more: columns of each row's own, told before changes are settled, so that wide ones that they are made of needn't be moved."""
        return self._settled(more).select(*self.schema.names, *more)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.path)

    def _changes(self) -> list[int]:
        """Numbers of the upserts whose rows may stand beside those that they replace, told by empty files that no reader of the table sees."""
        fs, at = self._at("_changes")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at)) if fs.exists(at) else []

    def _settled(self, more: dict[str, Column]) -> DataFrame:
        rows = self._read().withColumns(more) if more else self._read()
        if not (numbers := self._changes()):
            return rows
        newer = rows.where("change > 0")
        if len(numbers) > 1:
            last = Window.partitionBy(*self.key).orderBy(F.col("change").desc())
            newer = newer.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
        return upserted(rows.where("change is null or change = 0"), newer, list(self.key))

    def _write(self, rows: DataFrame, change: int = 0, overwrite: bool = False) -> None:
        """Rows with their slabs, where they are."""
        times = [c for c in ("month", "hour") if c in self.schema.names]
        parts = rows.withColumn("change", F.lit(change)).sortWithinPartitions("source", "slab", *times, *[k for k in self.key if k != "source"])
        parts.write.partitionBy("source", "slab").mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", GROUP_BYTES).parquet(self.path)

    def fold(self) -> None:
        """Rewrite the slabs that hold changes."""
        touched = self._read().where("change > 0").select(F.col("source").alias("_s"), F.col("slab").alias("_b")).distinct()
        merged = stage(self._settled({}).join(touched, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slab") == F.col("_b")), "left_semi"))
        self._write(merged.repartition("source", "slab"), overwrite=True)
        delete(self.spark, f"{self.path}/_changes")
        discard(merged)

    def upsert(self, rows: DataFrame, new: bool = False, single: bool = False) -> int:
        """Rows replace those with their keys; of several with one key the last label wins. Returns their number.

        new: no key is there yet, so that the rows are appended and nothing is read. single: no
        two rows have one key; into an empty table they then go without a shuffle.
        """
        aligned = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        slab = F.floor(F.col("window_idx") / self.slab)
        wide = F.coalesce(F.size("vector") == self.width, F.lit(False))
        empty = not self.exists() or self._read().isEmpty()
        if single and empty:
            try:
                self._write(aligned.withColumn("vector", F.when(wide, F.col("vector")).otherwise(F.raise_error(F.lit(_WIDTH.format(self.width))))).withColumn("slab", slab))
            except PySparkException as e:
                if _WIDTH.format(self.width) not in str(e):
                    raise
                raise ValueError(_WIDTH.format(self.width)) from e
            return self._read().count()
        fresh = stage(aligned if single else latest(aligned, self.key))
        if not fresh.where(~wide).isEmpty():
            discard(fresh)
            raise ValueError(_WIDTH.format(self.width))
        change = 0
        if not new and not empty:
            if len(self._changes()) >= CHANGES:
                self.fold()
            change = max(self._changes(), default=0) + 1
            fs, at = self._at("_changes", str(change))
            fs.create(at).close()
        self._write(fresh.withColumn("slab", slab), change)
        n = fresh.count()
        discard(fresh)
        return n

    def next_idx(self, source: str | None = None) -> int:
        """The first window_idx after all of a source."""
        last = self._read().where(F.col("source").eqNullSafe(F.lit(source))).agg(F.max("window_idx")).first()[0] if self.exists() else None
        return 0 if last is None else last + 1

    def count(self) -> int:
        return self.read().count()

    def info(self) -> DataFrame:
        return stats(self.read(held=F.when(F.col("vector").isNotNull(), F.size("vector"))), "held", F.col("held"))

    def by_source(self) -> DataFrame:
        return self.read().groupBy("source").agg(F.count("*").alias("points"))


def latest(rows: DataFrame, key: tuple[str, ...], order: str = "label_ts") -> DataFrame:
    """One row of each key: the one of the last time, and of equal or missing times the one that is largest by its other columns."""
    ties = [F.col(c).desc_nulls_last() for c in rows.columns if c not in (*key, order)]
    w = Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last(), *ties)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stats(points: DataFrame, vector: str = "vector", width: Column | None = None) -> DataFrame:
    """One row: points, vectors, vector_width and status."""
    return points.agg(F.count("*").alias("points"), F.count(vector).alias("vectors"), F.max(F.size(vector) if width is None else width).alias("vector_width"), F.lit("ok").alias("status"))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new rows and the old ones whose key they lack; null keys are equal."""
    keys = new.select(*[F.col(k).alias(f"_new_{k}") for k in key])
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_new_{k}"))
    return old.join(keys, same, "left_anti").unionByName(new)
