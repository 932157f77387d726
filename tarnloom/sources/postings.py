"""The stored full-text index: postings in buckets of terms, and a row with its length for each document.

Documents come, are replaced and go by key (collection, doc_id), a part at a time like the chunk store's; statistics are those
of all live documents of all collections. A search reads the buckets of its terms only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnloom.operators import fulltext
from tarnloom.sources import store, work

KEYS = ("collection", "doc_id")
_LENGTHS = "doc_id string, collection string, dl long, version long, gone boolean"
_POSTINGS = "term string, doc_id string, collection string, dl long, col string, positions array<int>, version long, bucket int"


class PostingStore:
    def __init__(self, spark: SparkSession, path: str, stem: bool = True):
        self.spark, self.stem = spark, stem
        self.parts = work.Parts(spark, path.rstrip("/"))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows by the bucket of their term; a bucket goes to several tasks, by document, so that no term is a hot key."""
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        rows = rows.withColumn("bucket", fulltext.bucket(F.col("term"))).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(-(-parts // fulltext.BUCKETS))))
        return rows.repartition(parts, "bucket", "_part")

    def _write(self, path: str, lengths: DataFrame, postings: DataFrame) -> None:
        lengths.write.parquet(f"{path}/lengths")
        postings.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")

    def replace(self, docs: DataFrame) -> None:
        """Documents (as fulltext.documents makes them) in the place of those with the same keys; of several with one
        key in a call one counts, that with the largest hash of its columns."""
        number, parts = self.parts.live()
        path = self.parts.fresh()
        columns = ["doc_id", "collection", *[c for c in fulltext.COLUMNS if c in docs.columns and c != "doc_id"]]
        docs = docs.select(columns).groupBy(*KEYS).agg(F.max_by(F.struct(*columns), F.xxhash64(*columns)).alias("_d")).select("_d.*")
        index = fulltext.build(docs, self.stem)
        version = F.lit(number + 1).cast("long")
        lengths = index.lengths.select("doc_id", "collection", "dl", version.alias("version"), F.lit(False).alias("gone"))
        dealt = self._dealt(index.tokens)  # by what the groups hold too, so that they need no shuffle of their own
        postings = dealt.groupBy("bucket", "_part", "term", "doc_id", "collection", "dl", "col").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        self._write(path, lengths, postings.drop("_part").withColumn("version", version))
        self._commit(number, [*parts, path])

    def delete(self, keys: DataFrame) -> int:
        """Documents by (collection, doc_id); how many there were."""
        number, parts = self.parts.live()
        if not parts:
            return 0
        path = self.parts.fresh()
        gone = self.lengths().join(keys.select(*KEYS).distinct(), list(KEYS), "left_semi")
        gone.select("doc_id", "collection", "dl", F.lit(number + 1).cast("long").alias("version"), F.lit(True).alias("gone")).write.parquet(f"{path}/lengths")
        n = self._lengths([path]).count()
        if n:
            self._commit(number, [*parts, path])
        return n

    def _commit(self, number: int, parts: list[str]) -> None:
        if len(parts) > store.MOST_PARTS:
            joined = self.parts.fresh()
            self._write(joined, self._live_lengths(parts).withColumn("gone", F.lit(False)), self._dealt(self._live_postings(parts)).drop("_part"))
            parts = [joined]
        self.parts.commit(number, parts)

    def clear(self, collection: str | None = None) -> None:
        if collection:
            self.delete(self.lengths().where(F.col("collection") == collection))
        else:
            target, fs = work.folder(self.spark, self.parts.path)
            fs.delete(target, True)

    # ------------------------------------------------------------ reading

    def _lengths(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(_LENGTHS).parquet(*[f"{p}/lengths" for p in parts])

    def _live_lengths(self, parts: list[str]) -> DataFrame:
        rows = self._lengths(parts)
        return (store.newest(rows, self._lengths(parts[1:]), KEYS) if len(parts) > 1 else rows.where("not gone")).drop("gone")

    def _live_postings(self, parts: list[str]) -> DataFrame:
        """Postings of the newest version of each document. A part of deletions has none."""
        out = None
        for p in parts:
            if "postings" in work.names_in(self.spark, p):
                rows = self.spark.read.schema(_POSTINGS).option("basePath", f"{p}/postings").parquet(f"{p}/postings")
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], _POSTINGS)
        if len(parts) == 1:
            return out
        return store.newest(out.withColumn("gone", F.lit(False)), self._lengths(parts[1:]), KEYS).drop("gone")

    def lengths(self) -> DataFrame:
        _, parts = self.parts.live()
        return self._live_lengths(parts) if parts else self.spark.createDataFrame([], _LENGTHS).drop("gone")

    def is_empty(self) -> bool:
        return not self.parts.live()[1]

    def index(self) -> fulltext.Index:
        """What searches read."""
        _, parts = self.parts.live()
        return fulltext.Index(None, self.lengths().drop("version"), self.stem, self._live_postings(parts).drop("version"))
