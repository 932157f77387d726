"""The engine: files are indexed into collections, and questions answered from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnloom import schema
from tarnloom.operators import chunking, embedding, fulltext, rendering, upkeep
from tarnloom.plans import retrieval
from tarnloom.sources import files as sources, postings, store, work


class Engine:
    """A store of chunks at path, an embedder, and retrieval options. Files are kept beside the chunks if
    keep_files, for completing cut-off chunks."""

    def __init__(self, spark: SparkSession, path: str, embedder: embedding.Embedder | None = None, model: str = "nomic-embed-text", cap: int = rendering.CAP, stem: bool = True):
        self.spark, self.path = spark, path.rstrip("/")
        self.embedder = embedder or embedding.HashEmbedder()
        self.model, self.cap, self.stem = model, cap, stem
        self.store = store.ChunkStore(spark, f"{self.path}/chunks", self.embedder.dimension)
        self.postings = postings.PostingStore(spark, f"{self.path}/postings", stem)

    # ------------------------------------------------------------ indexing

    def index(self, files: DataFrame | None = None, collection: str = schema.DEFAULT_COLLECTION, deleted: list[str] | None = None, replace_files: bool = False) -> dict:
        """Deletes, then chunks, embeds and stores files (path, content, content_hash); texts that no model takes are
        counted as failed and not stored. The full-text index follows, chunk by chunk."""
        if files is None and not deleted:
            raise ValueError("neither files nor deletions")
        out = {"deleted": 0, "indexed": 0, "failed": 0}
        if deleted:
            gone = self.spark.createDataFrame([(p,) for p in deleted], "file_path string")
            self.postings.delete(fulltext.documents(self.store.read(collection).join(gone.distinct(), "file_path", "left_semi")))
            out["deleted"] = self.store.delete(deleted, collection)
        if files is not None:
            rows = files.where((F.col("path") != "") & ~sources.is_blank(F.col("content")))
            chunks = embedding.embed(chunking.chunk_files(rows), self.embedder, model=self.model)
            kept = work.work_path(self.spark, "engine-chunks")
            chunks.write.parquet(kept)  # embedded once, read for both outcomes
            chunks = self.spark.read.schema(chunks.schema).parquet(kept)
            good = chunks.where("embedding is not null")
            out["failed"] = chunks.where("embedding is null").count()
            lacking = self.postings.is_empty()  # then full_text builds it from the store
            if replace_files and not lacking:
                named = upkeep.with_ids(good)
                self.postings.delete(fulltext.documents(self.store.stale(named, named, collection)))
            out["indexed"] = self.store.upsert(good, collection, replace_files)
            if not lacking:
                self.postings.replace(fulltext.documents(good.withColumn("collection", F.lit(collection))))
            target, fs = work.folder(self.spark, kept)
            fs.delete(target, True)
        return out

    def index_directory(self, root: str, collection: str = schema.DEFAULT_COLLECTION) -> dict:
        return self.index(sources.read_directory(self.spark, root), collection)

    def index_requests(self, requests: DataFrame, column: str = "body") -> dict[str, dict]:
        """JSON requests, a collection at a time."""
        parsed = sources.parse_requests(requests, column).cache()
        out = {}
        for (name,) in sorted(parsed.select("collection").distinct().collect()):
            own = parsed.where(F.col("collection") == name)
            gone = [r[0] for r in own.select(F.explode("deleted_files")).distinct().collect()]
            rows = sources.requested_files(own).drop("collection")
            out[name] = self.index(None if rows.isEmpty() else rows, name, gone) if gone or not rows.isEmpty() else {"deleted": 0, "indexed": 0, "failed": 0}
        parsed.unpersist()
        return out

    # ------------------------------------------------------------ questions

    def _documents(self, collection: str) -> DataFrame:
        return fulltext.documents(self.store.read(collection))

    def full_text(self) -> fulltext.Index:
        """The index of all collections, built from the store where there is none."""
        if self.postings.is_empty():
            self.rebuild()
        return self.postings.index()

    def rebuild(self) -> None:
        """The full-text index anew from the store."""
        self.postings.clear()
        self.postings.replace(fulltext.documents(self.store.read()))

    def retrieve(self, query: str, limit: int = 20, collection: str = schema.DEFAULT_COLLECTION, files: DataFrame | None = None, **options) -> DataFrame:
        vector = embedding.embed_query(self.embedder, query, self.model)
        asked = self.spark.createDataFrame([(0, query, vector)], "query_id int, query string, vector array<double>")
        return retrieval.retrieve(self._documents(collection), asked, self.full_text(), files, limit, collection=collection, **options)

    def query(self, query: str, limit: int = 20, collection: str = schema.DEFAULT_COLLECTION, **options) -> dict:
        """The formatted results and how many there are, those beyond the byte limit included."""
        if not query:
            raise ValueError("no query")
        if not self.store.has_data(collection):
            raise LookupError(f"collection {collection} doesn't exist")
        found = self.retrieve(query, limit, collection, **options).cache()
        text = rendering.render(found, self.cap).collect()
        out = {"results": text[0]["output"] if text else rendering.HEADER, "count": found.count()}
        found.unpersist()
        return out

    # ------------------------------------------------------------ upkeep

    def status(self) -> dict:
        return {"status": "ok", "collections": self.store.collections(), "engine": "tarnloom"}

    def list_collections(self) -> list[str]:
        return self.store.collections()

    def file_hashes(self, collection: str = schema.DEFAULT_COLLECTION) -> DataFrame:
        return upkeep.file_hashes(self.store.read(collection))

    def changes(self, files: DataFrame, collection: str = schema.DEFAULT_COLLECTION) -> DataFrame:
        """(file_path, status) of files (path, content_hash) against what is stored."""
        return upkeep.hash_diff(self.file_hashes(collection), files.select(F.col("path").alias("file_path"), "content_hash"))

    def statistics(self, collection: str | None = None) -> dict:
        return upkeep.statistics(self.store.read(collection)).first().asDict()

    def clean(self, collection: str | None = None) -> None:
        self.postings.clear(collection)
        self.store.clear(collection)


