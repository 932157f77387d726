import json
import os

import numpy as np
import pytest

from tarnloom.operators import embedding
from tarnloom.plans.engine import Engine
from tarnloom.sources import files as sources
from tarnloom.streaming.ingest import index_stream

FILE = "path string, content string, content_hash string"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", embedding.HashEmbedder(32))


def frame(spark, rows):
    return spark.createDataFrame(rows, FILE)


def test_index_ask_change_and_delete(spark, engine):
    first = [("a/auth.py", "def login(user):\n    return user", "h1"), ("b.go", "func Connect() error { return nil }", "h2"), ("c.txt", "notes about password storage", "h3"), ("", "x", "h"), ("d.txt", "  \n", "h4")]
    assert engine.index(frame(spark, first), "one") == {"deleted": 0, "indexed": 3, "failed": 0}
    assert engine.list_collections() == ["one"] and engine.statistics("one") == {"total_chunks": 3, "unique_files": 3}
    assert {r.file_path: r.content_hash for r in engine.file_hashes("one").collect()} == {"a/auth.py": "h1", "b.go": "h2", "c.txt": "h3"}
    out = engine.query("connect", collection="one")
    assert "Path: b.go" in out["results"] and out["count"] == 3

    second = [("a/auth.py", "def login(user):\n    return None", "h9"), ("n.py", "pass", "h5")]
    changes = {r.file_path: r.status for r in engine.changes(frame(spark, [*second, first[2]]), "one").collect()}
    assert changes == {"a/auth.py": "changed", "n.py": "new", "b.go": "deleted", "c.txt": "same"}
    assert engine.index(frame(spark, second), "one", ["b.go"]) == {"deleted": 1, "indexed": 2, "failed": 0}
    assert {r.file_path: r.content_hash for r in engine.file_hashes("one").collect()} == {"a/auth.py": "h9", "n.py": "h5", "c.txt": "h3"}
    assert "Connect" not in engine.query("connect", collection="one")["results"]

    engine.index(frame(spark, first[:1]), "two")
    assert engine.status()["collections"] == ["one", "two"]
    assert engine.index(None, "one", ["c.txt", "nothing"]) == {"deleted": 1, "indexed": 0, "failed": 0}
    engine.clean("one")
    assert engine.list_collections() == ["two"] and engine.statistics("one") == {"total_chunks": 0, "unique_files": 0}
    with pytest.raises(LookupError):
        engine.query("x", collection="one")
    with pytest.raises(ValueError):
        engine.query("", collection="two")
    with pytest.raises(ValueError):
        engine.index(None, "two")
    engine.clean()
    assert engine.list_collections() == []


def test_changed_files_keep_or_lose_their_old_chunks(spark, engine):
    long, short = "\n".join(f"x{k}" for k in range(200)), "y"
    for replace, want in ((False, 3), (True, 1)):
        engine.clean("c")
        engine.index(frame(spark, [("f.txt", long, "1")]), "c")
        engine.index(frame(spark, [("f.txt", short, "2")]), "c", replace_files=replace)
        assert engine.statistics("c")["total_chunks"] == want


def test_json_requests(spark, engine):
    bodies = [{"files": [{"path": "a.py", "content": "x = 1", "content_hash": "h"}, {"path": "", "content": "y"}, {"content": "z"}]}, {"collection": "k", "files": [{"path": "b", "content": "words"}], "deleted_files": ["gone"]}, {}]
    out = engine.index_requests(spark.createDataFrame([(json.dumps(b),) for b in bodies] + [("not json",), (None,)], "body string"))
    assert out["k"]["indexed"] == 1 and out["default"]["indexed"] == 1 and engine.list_collections() == ["default", "k"]


def test_directory(spark, engine, tmp_path):
    root = tmp_path / "in +dir"
    for name, raw in {"a.py": b"x = 1\n", "sub/b b.txt": b"caf\xc3\xa9 \xff!", "node_modules/c.js": b"no", "d.PNG": b"no", "gradlew": b"no", "blank.txt": b" \n", ".png": b"dot", "pkg/__init__.py": b"y = 2"}.items():
        path = root / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(raw)
    got = {r.path: r.content for r in sources.read_directory(spark, str(root)).collect()}
    assert got == {"a.py": "x = 1\n", "sub/b b.txt": "café !", ".png": "dot", "pkg/__init__.py": "y = 2"}
    assert engine.index_directory(f"file://{tmp_path}/in%20%2Bdir", "d")["indexed"] == 4


def test_stream(spark, engine, tmp_path):
    source = f"{tmp_path}/stream"
    for k in range(3):
        frame(spark, [(f"f{k}.py", f"value = {k}", str(k))]).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(FILE).option("maxFilesPerTrigger", 1).parquet(source)
    index_stream(stream(), engine, f"{tmp_path}/check", "s").awaitTermination()
    assert engine.statistics("s") == {"total_chunks": 3, "unique_files": 3}
    frame(spark, [("f0.py", "value = 10", "9")]).write.mode("append").parquet(source)
    index_stream(stream(), engine, f"{tmp_path}/check", "s").awaitTermination()
    assert {r.file_path: r.content_hash for r in engine.file_hashes("s").collect()} == {"f0.py": "9", "f1.py": "1", "f2.py": "2"}


class Fussy:
    dimension = 2

    def __init__(self):
        self.calls = []

    def embed(self, texts):
        self.calls.append(texts)
        if any("bad" in t for t in texts):
            raise RuntimeError("bad text")
        return np.array([[1.0, len(t)] for t in texts])


def test_embedding_runs_and_errors(spark):
    model = Fussy()
    got = embedding.embed_all(model, ["a" * 10_000, "b" * 10_000, "c" * 10_000])
    assert [len(c) for c in model.calls] == [2, 1] and [v[1] for v, _ in got] == [10_000] * 3
    got = embedding.embed_all(Fussy(), ["fine", "bad one", "good"])
    assert [e for _, e in got] == [None, "bad text", None] and got[1][0] is None
    rows = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None)], "id int, content string")
    out = {r.id: r for r in embedding.embed(rows, Fussy(), task="clustering").collect()}
    assert out[1].embedding == [1.0, len("clustering: fine")] and out[2].embed_error == "bad text" and out[3].embedding is None and out[3].embed_error is None
    assert embedding.embed_query(Fussy(), "bad") is None and embedding.embed_query(Fussy(), "ok", "other") == [1.0, 2.0]


def test_texts_that_no_model_takes_are_counted(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/s", Fussy())
    assert engine.index(frame(spark, [("a", "fine", "1"), ("b", "bad", "2")])) == {"deleted": 0, "indexed": 1, "failed": 1}


def test_wrong_dimension(spark, engine):
    rows = spark.createDataFrame([("p", [1.0, 2.0])], "file_path string, embedding array<float>")
    from tarnloom import schema

    full = spark.createDataFrame([], schema.CHUNK).unionByName(rows.drop("embedding"), allowMissingColumns=True).join(rows, "file_path")
    with pytest.raises(ValueError):
        engine.store.upsert(full, "c")
