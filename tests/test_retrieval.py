import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnloom import queries as queries_
from tarnloom.operators import context, embedding, fulltext, ranking, rendering, vectors
from tarnloom.plans import retrieval


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]
    x[9] = 0
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    asked = [(q, rng.normal(size=8)) for q in range(7)] + [(7, x[3])]
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in asked], "query_id int, vector array<double>")
    got = {}
    for r in vectors.nearest_of_each(points, queries, 5, held=3 * 64).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q, v in asked:
        s = np.round((x @ v) / np.where((n := np.linalg.norm(x, axis=1)) > 0, n, 1) / np.linalg.norm(v), 12)
        assert [got[q][k] for k in range(1, 6)] == sorted(range(300), key=lambda k: (-s[k], k))[:5]
    one = vectors.nearest(points.where("vec_id < 300"), asked[0][1].tolist(), 5).orderBy("rank").collect()
    assert [r.vec_id for r in one] == [got[0][k] for k in range(1, 6)]
    assert vectors.nearest(points, asked[0][1].tolist(), 0).count() == 0


def test_fusion_golden(spark):
    frame = lambda rows: spark.createDataFrame(rows, "query_id int, doc_key string, rank int")
    got = ranking.fuse(frame([(0, "a", 1), (0, "b", 2)]), frame([(0, "b", 1), (0, "c", 2)])).orderBy("rank").collect()
    assert [(r.doc_key, round(r.score, 7)) for r in got] == [("b", 0.0162084), ("a", 0.0114754), ("c", 0.0048387)]


def spec_fuse(a, b):
    score, order = {}, []
    for hits, w in ((a, 0.7), (b, 0.3)):
        for k, key in enumerate(hits, 1):
            if key not in score:
                score[key] = 0.0
                order.append(key)
            score[key] += w / (60 + k)
    return sorted(order, key=lambda x: -round(score[x], 12))


def spec_diverse(keys, limit, per_file):
    seen, files, out = set(), {}, []
    for key in keys:
        path = key.split(":")[0]
        if len(out) < limit and key not in seen and files.get(path, 0) < per_file:
            out.append(key)
            files[path] = files.get(path, 0) + 1
        seen.add(key)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fusion_and_diversity_against_plain_python(spark, seed):
    rng = random.Random(seed)
    rows_a, rows_b, want = [], [], {}
    limit, per = rng.choice([0, 1, 5, 50]), rng.choice([1, 3])
    for q in range(6):
        a, b = ([f"f{rng.randrange(5)}:{rng.randrange(4)}" for _ in range(rng.randrange(15))] for _ in range(2))
        rows_a += [(q, x, k) for k, x in enumerate(a, 1)]
        rows_b += [(q, x, k) for k, x in enumerate(b, 1)]
        want[q] = spec_diverse(spec_fuse(a, b), limit, per)
    frame = lambda rows: spark.createDataFrame(rows, "query_id int, doc_key string, rank int")
    fused = ranking.fuse(frame(rows_a), frame(rows_b)).withColumn("file_path", F.split_part("doc_key", F.lit(":"), F.lit(1)))
    got = {q: [] for q in range(6)}
    for r in ranking.diversify(fused, limit, per).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_key)
        assert r["rank"] == len(got[r.query_id])
    assert got == want


def docs_of(spark, n=40):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "login", "authenticate"]
    rows = [(f"f{k % 7}.py", k, k + 2, " ".join(rng.choice(words, 6)), "python" if k % 2 else "go", "function", rng.normal(size=6).tolist()) for k in range(n)]
    return fulltext.documents(spark.createDataFrame(rows, "file_path string, start_line int, end_line int, content string, language string, symbol_type string, embedding array<double>"))


def test_hybrid_is_its_parts(spark):
    docs = docs_of(spark)
    queries = spark.createDataFrame([(0, "login", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (1, "alpha beta", [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (2, "zzz", [0.0, 0.0, 1.0, 0.0, 0.0, 0.0])], "query_id int, query string, vector array<double>")
    index = fulltext.build(docs)
    got = {}
    for r in retrieval.retrieve(docs, queries, index, limit=5, expand=False).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_key)
    near = vectors.nearest_of_each(docs, queries, 15, key="doc_id").join(docs, "doc_id").orderBy("rank").collect()
    found = fulltext.search(index, docs, queries, 15).orderBy("rank").collect()
    for q in range(3):
        a, b = ([r.doc_key for r in hits if r.query_id == q] for hits in (near, found))
        assert got[q] == spec_diverse(spec_fuse(a, b), 5, 3)


def test_filters_and_modes(spark):
    docs = docs_of(spark)
    queries = spark.createDataFrame([(0, "alpha", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "query_id int, query string, vector array<double>")
    index = fulltext.build(docs)
    run = lambda **o: retrieval.retrieve(docs, queries, index, limit=5, **o).collect()
    assert {r.language for r in run(language="go")} == {"go"}
    assert {r.file_path for r in run(path_pattern="f1%")} <= {"f1.py"}
    assert run(language="cobol") == [] and len(run(language="go", prefilter=True)) == 5
    assert len(run(hybrid=False)) == 5 and all(len([r for r in run(per_file=1) if r.file_path == f"f{k}.py"]) <= 1 for k in range(7))


def test_natural_end():
    assert context.natural_end(["f(a,", "b", "c)", "d"], 0) == 2
    assert context.natural_end(["def f(x", "  a", "  b", "  c", "g"], 0) == 3
    assert context.natural_end(["def f(x", " # c"], 0) is None and context.natural_end([], 0) is None and context.natural_end(["a"], 3) is None
    assert context.natural_end(["x", "y"], 0) == 1


def test_expansion_reads_on_in_the_file(spark):
    files = spark.createDataFrame([("a.py", "def f(\n  a,\n  b):\n  return 1\n" + "x\n" * 90), ("b.py", None)], "path string, content string")
    rows = [("a.py", 1, 1, "def f(", "function"), ("a.py", 1, 4, "whole", "function"), ("b.py", 1, 1, "def g(", "function"), ("c.py", 1, 1, "def h(", "method"), ("a.py", 1, 1, "def f(", None)]
    got = context.expand(spark.createDataFrame(rows, "file_path string, start_line int, end_line int, content string, symbol_type string"), files).collect()
    by = {(r.file_path, r.end_line, r.symbol_type): r for r in got}
    assert len(got) == 5 and sum(r.expanded for r in got) == 1
    assert by["a.py", 3, "function"].content == "def f(\n  a,\n  b):\n" and by["a.py", 3, "function"].expanded


def test_rendering(spark):
    frame = lambda rows: spark.createDataFrame([(0, k, *r) for k, r in enumerate(rows, 1)], "query_id int, rank int, file_path string, start_line int, content string")
    (r,) = rendering.render(frame([("test.py", 10, "line1\nline2\nline3")])).collect()
    assert r.output == rendering.HEADER + "\nPath: test.py\n...\n    10\tline1\n    11\tline2\n    12\tline3\n..."
    (r,) = rendering.render(frame([(f"f{k}.py", 1, "x" * 100) for k in range(10)]), 200).collect()
    assert r.output.count("Path:") == 1 and len(r.output.encode()) <= 200
    (r,) = rendering.render(frame([("a", 1, "x" * 500)]), 100).collect()
    assert r.output == rendering.HEADER


@pytest.mark.parametrize("cap", [60, 200, 1000, 5000])
def test_byte_cap_against_a_loop(spark, cap):
    rng = random.Random(cap)
    rows = [(f"f{k}", rng.randrange(1, 3), rng.choice(["é", "x", "日"]) * rng.randrange(80)) for k in range(40)]
    output = rendering.HEADER
    for path, start, content in rows:
        s = "\n".join([f"Path: {path}", *(["..."] if start > 1 else []), *(f"{start + i:6}\t{x}" for i, x in enumerate(content.splitlines())), "..."])
        if len(output.encode()) + len(s.encode()) > cap:
            break
        output += "\n" + s
    frame = spark.createDataFrame([(0, k, *r) for k, r in enumerate(rows, 1)], "query_id int, rank int, file_path string, start_line int, content string")
    assert rendering.render(frame, cap).first().output == output


def test_hybrid_query_finds_documents_without_a_vector(spark, tmp_path):
    rows = [(k, f"some words number{k} here", "en", "web", 20) for k in range(12)]
    rows[0] = (0, "a b needle haystack", "en", "web", 20)
    rows[9] = (9, "the needle, a haystack: no vector", "en", "web", 20)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, [1.0, float(k)]) for k in range(6)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries_.QUERIES["hybrid_retrieve"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in found} == {0}
    assert "web/9.txt" in {r.file_path for r in found}


def test_natural_end_against_a_walk():
    """The rules a line at a time."""

    def walk(lines, last):
        for k in range(last + 1, len(lines)):
            if all("".join(lines[: k + 1]).count(a) <= "".join(lines[: k + 1]).count(b) for a, b in context.PAIRS):
                return k
            indent = lambda x: len(x) - len(x.lstrip())
            if k > last + 2 and lines[k].strip() and not lines[k].lstrip().startswith("#") and indent(lines[k]) <= (indent(lines[0]) if lines[0].strip() else 0):
                return k - 1
        return None

    rng = np.random.default_rng(8)
    for _ in range(500):
        lines = [" " * rng.integers(0, 4) + "".join(rng.choice(list("ab(){}[]# "), rng.integers(0, 5))) for _ in range(rng.integers(1, 14))]
        last = int(rng.integers(0, len(lines)))
        assert context.natural_end(lines, last) == walk(lines, last)


def test_documents_that_fail_raise():
    class Failing:
        dimension = 2

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return np.ones((len(texts), 2))

    with pytest.raises(embedding.EmbeddingError, match="1 of 2"):
        embedding.embed_documents(Failing(), ["good", "bad"])
    assert embedding.embed_documents(Failing(), ["good", "bad"], raise_on_error=False) == [[1, 1], None]
    assert embedding.embed_query(Failing(), "bad") is None
    with pytest.raises(embedding.EmbeddingError):
        embedding.embed_query(Failing(), "bad", raise_on_error=True)
