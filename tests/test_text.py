import base64
import fnmatch
import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tarnloom.functions import text


def values(spark, rows, column, **columns):
    """One expression over rows of (k, x, ...)."""
    names = ", ".join(["k int", *(f"{n} {t}" for n, t in columns.items())])
    out = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], names).select("k", column.alias("v"))
    return [r.v for r in sorted(out.collect(), key=lambda r: r.k)]


GOLDEN = {
    "def authenticate_user(username, password): pass": "def authenticate_user authenticate user username password pass",
    "getUserById findAllUsers": "getuserbyid get user by id findallusers find all users",
    "HTTPServer __init__ x a1": "httpserver server __init__ init a1",
    "getUser_byId": "getuser_byid get user_by id getuser byid",
    "café naïve_día": "caf na ve_d ve",
    "": "",
    None: "",
}


def test_code_tokens(spark):
    assert values(spark, list(GOLDEN), text.code_text(F.col("x")), x="string") == list(GOLDEN.values())


def test_lines_are_those_of_splitlines(spark):
    rng = random.Random(1)
    rows = ["", "\n", "a", "a\n", "a\n\n", "\r\n", "a\r\rb"] + ["".join(rng.choice("ab \n\r\x0b\x0c\x1c\x1d\x1e\x85  ") for _ in range(12)) for _ in range(200)]
    assert values(spark, rows, text.lines(F.col("x")), x="string") == [r.splitlines() for r in rows]


def test_strip_and_indent(spark):
    rows = ["", "  a ", "\t a ", " b\x1f", "x\n"]
    assert values(spark, rows, text.strip(F.col("x")), x="string") == [r.strip() for r in rows]
    assert values(spark, rows, text.indent(F.col("x")), x="string") == [len(r) - len(r.lstrip()) for r in rows]


def test_point_ids_are_name_based_uuids(spark):
    rows = [("a/b.py", 1, 20), ("é", 0, 0), (None, None, None), ("x", None, 7)]
    keys = [f"{p or ''}:{a or 0}:{b or 0}" for p, a, b in rows]
    got = values(spark, rows, F.struct(text.doc_key().alias("key"), text.doc_id(text.doc_key()).alias("id"), text.point_id(text.doc_key()).alias("point")), file_path="string", start_line="int", end_line="int")
    space = uuid.UUID(text.POINT_NAMESPACE)
    assert [(r.key, r.id, r.point) for r in got] == [(k, hashlib.md5(k.encode()).hexdigest(), str(uuid.uuid5(space, k))) for k in keys]


@pytest.mark.parametrize("pattern", ["*.py", "src/%", "a?c", "[ab]*", "[!a]*", "a.c", "*_x", "[", "a[b", "[a-c]\\d", "", "**", "[^a]b", "[]a]x"])
def test_globs_are_those_of_fnmatch(spark, pattern):
    rows = ["a.py", "src/x", "abc", "a.c", "axc", "b", "", "a_x", "a-x", "[", "a[b", "b\\d", "^b", "xb", "]x", "A.PY", "a\nb"]
    assert values(spark, rows, text.glob_filter(F.col("x"), pattern), x="string") == [fnmatch.fnmatchcase(r, pattern.replace("%", "*")) for r in rows]


def test_like_ignores_case_and_has_no_escape(spark):
    rows = ["A\\b", "a\\B/c", "ab"]
    assert values(spark, rows, text.like_filter(F.col("x"), "a\\%"), x="string") == [True, True, False]


def test_languages(spark):
    rows = ["a/b.PY", "go", "x.tar.gz", "Makefile", "a.b/c", "m.hpp", ""]
    assert values(spark, rows, text.language(F.col("x")), x="string") == ["python", "go", "text", "text", "text", "cpp", "text"]


def test_truncation(spark):
    rows = [("def foo():\n    x = 1\n    {", "function"), ("def foo():\n    return 1", "function"), ("anything {", "comment"), ("return x:", "method"), ("if x:", "method"), ("", "class"), ("a(", None), ("f([)]", "class"), ("x\\", "class"), ("y ... \n", "function")]
    assert values(spark, rows, text.is_truncated(F.col("c"), F.col("s")), c="string", s="string") == [True, False, False, False, True, False, False, False, True, True]


def test_query_words(spark):
    assert values(spark, ["Café auth Login2 2abc _x a-b"], text.query_words(F.col("x")), x="string") == [["auth", "login2", "_x", "a", "b"]]


def test_encryption(spark):
    rows = ["", "x", "é" * 1000]
    token = text.encrypt(F.encode("x", "UTF-8"), "s3")
    got = values(spark, rows, F.struct(token.alias("t"), F.decode(text.decrypt(token, "s3"), "UTF-8").alias("p"), text.decrypt(token, "other").alias("o")), x="string")
    assert [g.p for g in got] == rows and all(g.o is None for g in got)
    assert [len(base64.b64decode(g.t)) for g in got] == [28 + len(r.encode()) for r in rows]


def test_embedding_input(spark):
    rows = ["a" * 25_000]
    (got,) = values(spark, rows, text.task_text(F.col("x"), "search_query"), x="string")
    assert got == "search_query: " + "a" * 20_000
