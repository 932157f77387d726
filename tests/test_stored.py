"""Tables that change a part at a time: crashes between the steps, replaced and deleted rows, two collections."""

import pytest
from pyspark.sql import functions as F

from tarnloom.operators import embedding, fulltext
from tarnloom.plans.engine import Engine
from tarnloom.sources import postings, store, work

FILE = "path string, content string, content_hash string"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/e", embedding.HashEmbedder(16))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_crash_before_the_list_changes_nothing(spark, engine, monkeypatch):
    index = lambda rows: engine.index(spark.createDataFrame(rows, FILE), "c", replace_files=True)
    index([("a.txt", "first words", "1")])
    before = rows_of(engine.store.read("c").select("file_path", "content"))

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(work.Parts, "commit", crash)
        with pytest.raises(KeyboardInterrupt):
            index([("a.txt", "second words", "2"), ("b.txt", "more", "3")])
    assert rows_of(engine.store.read("c").select("file_path", "content")) == before
    index([("a.txt", "third words", "4")])
    assert rows_of(engine.store.read("c").select("file_path", "content")) == [("a.txt", "third words")]


def test_a_second_writer_fails(spark, tmp_path):
    parts = work.Parts(spark, f"file://{tmp_path}/p")
    parts.commit(0, [parts.fresh()])
    with pytest.raises(OSError):
        parts.commit(0, [])
    assert parts.live()[0] == 1 and len(parts.live()[1]) == 1


def test_many_small_changes_are_joined(spark, engine, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 3)
    for k in range(6):
        engine.index(spark.createDataFrame([(f"f{k % 4}.txt", f"common word{k}", str(k))], FILE), "c", replace_files=True)
        engine.full_text()
    assert {r.content for r in engine.store.read("c").collect()} == {"common word4", "common word5", "common word2", "common word3"}
    assert len(engine.store._parts("c").live()[1]) <= 3 and engine.full_text().lengths.count() == 4
    assert engine.index(None, "c", ["f0.txt"])["deleted"] == 1
    assert "word4" not in engine.query("common", collection="c")["results"]


def test_stored_postings_are_those_of_a_new_index(spark, tmp_path):
    rows = lambda ks, more="": [(f"d{k}", "c", f"p{k}.py", f"some_words get{k}User {more}", None, "function", None, "python") for k in ks]
    frame = lambda r: spark.createDataFrame(r, "doc_id string, collection string, file_path string, content string, symbol_name string, symbol_type string, parent_context string, language string")
    stored = postings.PostingStore(spark, f"file://{tmp_path}/x", stem=True)
    stored.replace(frame(rows(range(12))))
    stored.replace(frame(rows(range(3, 6), "changed text")))
    assert stored.delete(frame(rows([0, 1, 99]))) == 2
    now = frame(rows([2, *range(6, 12)]) + rows(range(3, 6), "changed text"))
    want = fulltext.build(now, True)
    columns = ["term", "doc_id", "collection", "dl", "col", "positions"]
    assert rows_of(stored.index().postings.select(columns)) == rows_of(want.postings.select(columns))
    asked = spark.createDataFrame([(0, "some_words"), (1, "changed"), (2, "get3User"), (3, "nothing")], "query_id int, query string")
    scores = lambda index: rows_of(fulltext.scores(index, asked).withColumn("score", F.round("score", 9)))
    assert scores(stored.index()) == scores(want) != []


def test_one_file_in_two_collections_is_two_results(spark, engine):
    for name in ("one", "two"):
        engine.index(spark.createDataFrame([("a.txt", "the needle here", "1"), (f"{name}.txt", "hay", "2")], FILE), name)
    docs = fulltext.documents(engine.store.read())
    asked = spark.createDataFrame([(0, "needle", embedding.embed_query(engine.embedder, "needle"))], "query_id int, query string, vector array<double>")
    from tarnloom.plans import retrieval

    got = retrieval.retrieve(docs, asked, engine.full_text(), limit=10, expand=False).collect()
    assert sorted((r.file_path, r.collection) for r in got) == [("a.txt", "one"), ("a.txt", "two"), ("one.txt", "one"), ("two.txt", "two")]
    assert [r.file_path for r in engine.retrieve("needle", collection="two").orderBy("rank").collect()] == ["a.txt", "two.txt"]
    n = fulltext.statistics(engine.full_text()).first().n_docs
    assert n == 4  # of all collections
