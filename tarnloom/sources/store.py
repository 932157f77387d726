"""The chunk store: a table of parts for each collection, the newest version of a chunk counts.

An upsert writes a part with the new chunks, a deletion one with marks; readers resolve them by version, and after
MOST_PARTS parts a write joins them into one. sources.work.Parts says why a crash loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tarnloom import schema
from tarnloom.operators import upkeep
from tarnloom.sources import work

STORED = T.StructType([*schema.CHUNK.fields, T.StructField("point_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("version", T.LongType())])
_WRITTEN = T.StructType([*STORED.fields, T.StructField("gone", T.BooleanType())])
MOST_PARTS = 16


def newest(rows: DataFrame, later: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows (with version and gone) that no later part replaces; later: the rows of all parts but the first."""
    last = later.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("version").alias("_last"))
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"_{k}")) if same is None else same & (F.col(k) == F.col(f"_{k}"))
    return rows.join(last, same, "left").where("(_last is null or version = _last) and not gone").drop("_last", *[f"_{k}" for k in keys])


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None):
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension

    def _parts(self, collection: str) -> work.Parts:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return work.Parts(self.spark, f"{self.path}/collection={escape(collection)}")

    def _names(self) -> list[str]:
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return sorted(unescape(n.removeprefix("collection=")) for n in work.names_in(self.spark, self.path) if n.startswith("collection="))

    def read(self, collection: str | None = None) -> DataFrame:
        """All chunks, or those of one collection, which reads its parts alone."""
        out = self.spark.createDataFrame([], T.StructType([*STORED.fields, T.StructField("collection", T.StringType())]))
        first = True
        for name in [collection] if collection else self._names():
            _, parts = self._parts(name).live()
            if parts:
                rows = self._resolved(parts).withColumn("collection", F.lit(name))
                out, first = (rows if first else out.unionByName(rows)), False
        return out

    def _resolved(self, parts: list[str]) -> DataFrame:
        rows = lambda some: self.spark.read.schema(_WRITTEN).parquet(*some)
        found = newest(rows(parts), rows(parts[1:]), ("point_id",)) if len(parts) > 1 else rows(parts).where("not gone")
        return found.drop("gone")

    def _append(self, collection: str, rows: DataFrame, check: bool = False) -> int:
        """Writes rows (with gone) as the next part; how many stay. Nothing changes if the check fails."""
        table = self._parts(collection)
        number, parts = table.live()
        path = table.fresh()
        rows.withColumn("version", F.lit(number + 1).cast("long")).select([f.name for f in _WRITTEN]).write.parquet(path)
        written = self.spark.read.schema(_WRITTEN).parquet(path)
        if check and self.dimension and not written.where((F.size("embedding") != self.dimension) & ~F.col("gone")).isEmpty():
            target, fs = work.folder(self.spark, path)
            fs.delete(target, True)
            raise ValueError(f"vectors of this store have {self.dimension} components")
        n, parts = written.where("not gone").count(), [*parts, path]
        if len(parts) > MOST_PARTS:
            joined = table.fresh()
            self._resolved(parts).withColumn("gone", F.lit(False)).write.parquet(joined)
            parts = [joined]
        table.commit(number, parts)
        return n

    def stale(self, paths: DataFrame, fresh: DataFrame, collection: str) -> DataFrame:
        """Stored chunks of paths (file_path) whose point_id is not among the fresh ones."""
        rows = self.read(collection).join(paths.select("file_path").distinct(), "file_path", "left_semi")
        return rows.join(fresh.select("point_id"), "point_id", "left_anti")

    def upsert(self, chunks: DataFrame, collection: str, replace_files: bool = False) -> int:
        """Chunks (with embedding) by point id: a later call's replace an earlier one's; of several with one id in a call
        that with the largest hash of its columns counts. With replace_files a file's other chunks go."""
        rows = upkeep.with_ids(chunks)
        names = [f.name for f in STORED if f.name != "version"]
        order = Window.partitionBy("point_id").orderBy(F.desc(F.xxhash64(*names)))
        rows = rows.select(names).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").withColumn("gone", F.lit(False))
        if replace_files:
            stale = self.stale(rows, rows, collection).select(names).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("gone", F.lit(True))
            rows = rows.unionByName(stale)
        return self._append(collection, rows, check=True)

    def delete(self, paths: list[str], collection: str) -> int:
        gone = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
        rows = self.read(collection).join(gone.distinct(), "file_path", "left_semi")
        n = upkeep.count_deleted(self.read(collection), gone).first()[0]
        if n:
            self._append(collection, rows.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("gone", F.lit(True)))
        return n

    def clear(self, collection: str | None = None) -> None:
        target, fs = work.folder(self.spark, self._parts(collection).path if collection else self.path)
        fs.delete(target, True)

    def has_data(self, collection: str) -> bool:
        return not self.read(collection).isEmpty()

    def collections(self) -> list[str]:
        return [n for n in self._names() if self.has_data(n)]
