import random
import sqlite3

import pytest

from tarnloom.functions import stemming
from tarnloom.operators import expansion, fulltext

CORPUS = [
    ("auth.py", "def authenticate_user(username, password): pass", "authenticate_user", "function", "python"),
    ("utils.py", "def format_date(date): return str(date)", "format_date", "function", "python"),
    ("web/userView.js", "class UserView { getUserById(id) { return users[id]; } }", "UserView", "class", "javascript"),
    ("db/conn.go", "func Connect(dsn string) error { return nil }", "Connect", "function", "go"),
]
GOLDEN = {"authenticate user": {0: 1.444454}, "date": {1: 1.550649}, "format_date": {1: 4.411453}, "Connect": {3: 1.238633}, "user": {0: 2e-6, 2: 2e-6}, "python": {0: 1e-6, 1: 1e-6}, "sign_in": {}, "": {}, "__": {}}


def documents(spark, rows):
    made = [(f"doc{k + 1}", "c", p, c, n, t, None, lang) for k, (p, c, n, t, lang) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id string, collection string, file_path string, content string, symbol_name string, symbol_type string, parent_context string, language string")


def code_tokens(text):
    import re

    out = []
    for w in re.findall(r"[a-zA-Z0-9_]{2,}", text):
        out.append(w.lower())
        for parts in (re.split(r"(?<!^)(?=[A-Z])", w), re.split("_+", w)):
            out += [p.lower() for p in parts if len(p) >= 2] if len(parts) > 1 else []
    return " ".join(out)


def sqlite_scores(rows, queries, stem):
    db = sqlite3.connect(":memory:")
    names = "doc_id, file_path, content, symbol_name, symbol_type, parent_context, language"
    db.execute(f"CREATE VIRTUAL TABLE t USING fts5({names}, tokenize='{'porter ' if stem else ''}unicode61')")
    for k, (p, c, n, t, lang) in enumerate(rows):
        db.execute("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?)", (f"doc{k + 1}", p, code_tokens(c), code_tokens(n or ""), t or "", "", lang))
    out = {}
    for q in queries:
        cut = code_tokens(q)
        out[q] = {r[0]: -r[1] for r in db.execute("SELECT doc_id, bm25(t) FROM t WHERE t MATCH ?", (cut,))} if cut else {}
    return out


def our_scores(spark, rows, queries, stem):
    index = fulltext.build(documents(spark, rows), stem)
    asked = spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")
    out = {q: {} for q in queries}
    for r in fulltext.scores(index, asked).collect():
        out[r.query_id][r.doc_id] = r.score
    return out


def test_golden_scores(spark):
    got = our_scores(spark, CORPUS, list(GOLDEN), True)
    for q, want in GOLDEN.items():
        assert got[q] == {f"doc{k + 1}": pytest.approx(v, rel=1e-4, abs=1e-6) for k, v in want.items()}, q


@pytest.mark.parametrize("stem", [True, False])
def test_random_corpora_against_sqlite(spark, stem):
    rng = random.Random(3 + stem)
    words = "running flies authentication getUserName user_name the café Über is parse_HTTPRequest generalizations x1 relational conditional hopping".split()
    for _ in range(3):
        rows = [(f"src/f{k}.py", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))), rng.choice([*words, None]), rng.choice(["function", "class", None]), rng.choice(["python", "go"])) for k in range(30)]
        queries = list({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(40)})
        want, got = sqlite_scores(rows, queries, stem), our_scores(spark, rows, queries, stem)
        for q in queries:
            assert got[q] == {d: pytest.approx(s, rel=1e-9) for d, s in want[q].items()}, q


def test_stems_against_sqlite():
    rng = random.Random(5)
    roots = "run fly author relat condit hop general nation oper sens bow adjust activ cit gener happi rat plan agre tri hiss fall fil siz".split()
    ends = "s es ed ing eed ies y ly ational tional izer ization ation ator alism iveness fulness ousness aliti iviti biliti icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize e ll".split()
    words = sorted({rng.choice(roots) + "".join(rng.choice(ends) for _ in range(rng.randrange(3))) for _ in range(3000)})
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    for k, w in enumerate(words):
        db.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (k, w))
    want = {words[doc]: term for term, doc in db.execute("SELECT term, doc FROM v")}
    assert {w: stemming.stem(w) for w in words} == want


def test_filters_limits_and_modes(spark):
    docs = documents(spark, CORPUS)
    index = fulltext.build(docs)
    asked = spark.createDataFrame([(0, "def return")], "query_id int, query string")
    paths = lambda **o: sorted(r.file_path for r in fulltext.search(index, docs, asked, 10, **o).collect())
    assert paths() == ["utils.py"]
    assert paths(match="any") == ["auth.py", "db/conn.go", "utils.py", "web/userView.js"]
    assert paths(match="any", language="go") == ["db/conn.go"] and paths(match="any", symbol_type="class") == ["web/userView.js"]
    assert paths(match="any", path_like="%.PY") == ["auth.py", "utils.py"] and paths(match="any", collection="other") == []
    assert [r["rank"] for r in fulltext.search(index, docs, asked, 2, match="any").collect()] == [1, 2]
    with pytest.raises(ValueError):
        fulltext.search(index, docs, asked, 2, match="some")


def test_expansion(spark):
    rows = {"auth function": ["authentication", "authorization", "fn", "func", "login", "method"], "login user": ["auth", "authenticate", "authentication", "sign_in", "signin"], "xyzunknown abcterm": [], "": []}
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(q,) for q in rows], "q string").select("q", expansion.expansions(F.col("q")).alias("e"), expansion.expand(F.col("q")).alias("x")).collect()
    for r in got:
        assert r.e == rows[r.q] and r.x == " ".join([r.q, *rows[r.q]] if rows[r.q] else [r.q])
    assert all(len(r.e) <= 6 * len(r.q.split()) for r in got)


def test_related_terms(spark):
    got = {r.term: r.related for r in expansion.related_terms(spark.createDataFrame([("AUTH",), ("fn",), ("zz",)], "term string")).collect()}
    assert got["AUTH"] == sorted(expansion.RELATED["auth"]) and got["fn"] == ["func", "function", "method"] and got["zz"] == []


def test_scan_is_the_index_and_shuffles_no_tokens(spark):
    docs = documents(spark, CORPUS * 3)
    queries = [*GOLDEN, "user_by id", "password user", "python function"]
    asked = spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")
    seen = lambda found: [(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in found.orderBy("query_id", "rank").collect()]
    for stem in (True, False):
        index = fulltext.build(docs, stem)
        for filters in ({}, {"match": "any"}, {"match": "any", "language": "python"}, {"path_like": "%.PY"}, {"collection": "d"}):
            assert seen(fulltext.search(fulltext.Scan(docs.repartition(3), stem), docs, asked, 4, **filters)) == seen(fulltext.search(index, docs, asked, 4, **filters))


def test_hybrid_queries_write_less_than_their_tables(spark):
    """Without a stored index and without shuffled tokens."""
    import os

    from tarnloom import queries as registered

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    registered.QUERIES["hybrid_plain"](spark, "/root/testdata/sf0.001").collect()
    assert not [x for x in set(os.listdir(root)) - before if x.startswith("postings")]
