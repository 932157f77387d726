import random

import pytest

from tarnloom.operators import chunking as C


def plain(content, max_lines=150, max_chars=6000):
    """The rules, read line by line."""
    lines = content.splitlines()
    if len(lines) <= max_lines and len(content) <= max_chars:
        return [(1, len(lines))]
    out, i, n = [], 0, len(lines)
    blank = lambda k: not lines[k].strip()
    depth = lambda k: len(lines[k]) - len(lines[k].lstrip())
    while i < n:
        j = min(i + max_lines, n)
        while j > i + 1 and sum(len(x) + 1 for x in lines[i:j]) > max_chars:
            j -= 1
        end = j
        if j >= n:
            end = n
        else:
            odd = any("".join(f"{x}\n" for x in lines[i:j]).count(q) % 2 for q in ('"""', "'''"))
            close = next((k for k in range(j, min(j + 30, n)) if '"""' in lines[k] or "'''" in lines[k]), None)
            if odd and close and close < i + max_lines + 20:
                end = close + 1
            else:
                first = next((k for k in range(i, min(i + 5, n)) if not blank(k)), None)
                for cut in range(j, j - min(10, j - i), -1):
                    if cut <= i:
                        break
                    if blank(cut - 1) or first is None or blank(cut) or depth(cut) <= depth(first):
                        end = cut
                        break
        out.append((i + 1, end))
        if end >= n:
            break
        i = max(end - 5, i + 1)
    return out


def ranges(pieces):
    return [(p.start, p.end) for p in pieces]


def test_goldens():
    assert ranges(C.chunk_lines("\n".join(f"line_{i} = {i}" for i in range(200)))) == [(1, 150), (146, 200)]
    assert ranges(C.chunk_lines("\n".join(["x" * 19] * 10), max_chars=100)) == [(1, 5), (2, 6), (3, 7), (4, 8), (5, 9), (6, 10)]
    assert [(p.start, p.end, p.content) for p in C.chunk_lines("")] == [(1, 0, "")]
    assert ranges(C.chunk_lines("\n".join(f"line{i}" for i in range(1, 6)))) == [(1, 5)]
    assert ranges(C.chunk_lines("y" * 9000 + "\nz")) == [(1, 1), (2, 2)]


def test_random_texts_against_the_rules():
    rng = random.Random(9)
    for _ in range(300):
        lines = [rng.choice(["", "    ", '"""', "'''x'''", " " * rng.randrange(9) + "w" * rng.randrange(60), "# c", '""" a """ b'])for _ in range(rng.randrange(90))]
        text = "\n".join(lines)
        size, chars = rng.randrange(1, 30), rng.randrange(20, 600)
        assert ranges(C.chunk_lines(text, size, chars)) == plain(text, size, chars)


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    files = docs.selectExpr("concat(doc_id, '.txt') AS path", "text AS content", "'h' AS content_hash", "lang AS collection")
    by = {}
    for r in C.chunk_files(files).collect():
        by.setdefault(r.file_path, []).append(r)
    for r in docs.collect():
        own = sorted(by[f"{r.doc_id}.txt"], key=lambda c: c.start_line)
        lines = r.text.splitlines()
        assert [(c.start_line, c.end_line) for c in own] == plain(r.text)
        assert own[0].start_line == 1 and own[-1].end_line == len(lines) and all(b.start_line <= a.end_line + 1 for a, b in zip(own, own[1:], strict=False))
        assert all(c.content_hash == "h" and c.collection == r.lang and c.language == "text" for c in own)


SOURCE = '''import os
from typing import Any

X = 1
Y = 2


class Outer(Base):
    """What it is."""

    def small(self):
        return 1


@deco
def free(a,
         b):
    """Doc
    string."""
    return a


def tiny(): pass


async def later():
    x = 1
    return x
''' + "\n".join(f"# {k}" for k in range(12)) + "\n"


def test_python_source():
    got = C.chunk_source(SOURCE, "python")
    named = {p.name: p for p in got if p.name}
    assert set(named) == {"Outer", "free", "later"}
    assert (named["Outer"].kind, named["free"].kind, named["later"].kind) == ("class", "decorated", "function")
    assert named["Outer"].docstring == '"""What it is."""' and named["free"].docstring.startswith('"""Doc') and named["later"].docstring is None
    assert named["free"].content.startswith("@deco") and named["free"].imports == "import os\nfrom typing import Any"
    assert any(p.name is None and "X = 1" in p.content for p in got) and got == sorted(got, key=lambda p: p.start)


def test_large_definitions_are_cut_and_keep_their_class():
    body = "\n".join(f"    def m{k}(self):\n        a = {k}\n        return a\n" for k in range(60))
    got = C.chunk_source("class Big:\n" + body, "python")
    assert len(got) > 1 and all(p.parents == ["Big"] and p.end - p.start < C.MAX_LINES for p in got)


@pytest.mark.parametrize("content", ["def broken(:\n" * 40, "x = '\x00'\n" * 40, "x\n" * 40 + "y = ("])
def test_source_that_does_not_parse_is_cut_by_lines(content):
    assert ranges(C.chunk_file("a.py", content, "python")) == plain(content)


def test_small_files_are_one_chunk():
    assert ranges(C.chunk_source("x" * 9000, "python")) == [(1, 1)] and ranges(C.chunk_source("", "python")) == [(1, 0)]


def test_null_content(spark):
    (r,) = C.chunk_files(spark.createDataFrame([("a.go", None)], "path string, content string")).collect()
    assert (r.start_line, r.end_line, r.content, r.language, r.content_hash) == (1, 0, "", "go", None)


def test_a_large_decorated_definition_is_one_named_chunk():
    source = "import x\n\n@first\n@second(1)\ndef big(a):\n" + "".join(f"    y{k} = {k}\n" for k in range(200)) + "\nz = 1\n"
    got = C.chunk_source(source, "python")
    assert [(p.start, p.end, p.name, p.kind) for p in got if p.name] == [(5, 205, "big", "function")]
    assert not any(p.name is None and p.end - p.start > 10 for p in got)


JAVASCRIPT = '''import { a } from "a";
const fs = require("fs");

/* class Not { } */
export class UserView extends View {
  constructor(x) {
    this.x = "}" + x;
  }
  async getUser(id) {
    if (id) {
      return users[id];
    }
  }
}

function plain(a, b) {
  // }
  return `${a} }`;
}

export const arrow = async (x) => {
  const y = { z: 1 };
  return y;
};

app.get("/", (req, res) => {
  res.send("}");
  res.end();
});
'''
GO = '''package main

import "fmt"

type Conn struct {
	dsn string
	n   int
}

type Reader interface {
	Read() error
	Close() error
}

func (c *Conn) Open(dsn string) error {
	c.dsn = dsn
	return nil
}

func main() {
	for i := 0; i < 3; i++ {
		fmt.Println("{", '{')
	}
}
'''
RUST = "use std::fmt;\n\npub struct P<'a> {\n    x: &'a str,\n}\n\nimpl<'a> fmt::Display for P<'a> {\n    fn fmt(&self) -> R {\n        ok()\n    }\n}\n\n#[test]\npub fn run(x: u8) -> u8 {\n    match x {\n        _ => x,\n    }\n}\n"
JAVA = "import java.util.List;\n\n@Service\npublic class Users {\n    private int n;\n\n    public List<User> all(String q) throws E {\n        return repo.all(q);\n    }\n}\n\npublic interface Repo {\n    User one();\n    User two();\n}\n"
C_ = "#include <stdio.h>\n\nstatic int add(int a, int b)\n{\n    return a + b;\n}\n\nstruct point {\n    int x;\n    int y;\n};\n"


@pytest.mark.parametrize(
    "language, source, want, imports",
    [
        ("javascript", JAVASCRIPT, [(5, 14, "UserView", "class"), (16, 19, "plain", "function"), (21, 24, "arrow", "function")], 'import { a } from "a";\nconst fs = require("fs");'),
        ("go", GO, [(5, 8, "Conn", "struct"), (10, 13, "Reader", "interface"), (15, 18, "Open", "method"), (20, 24, "main", "function")], 'import "fmt"'),
        ("rust", RUST, [(3, 5, "P", "struct"), (7, 11, "P", "impl"), (13, 18, "run", "function")], "use std::fmt;"),
        ("java", JAVA, [(3, 10, "Users", "class"), (12, 15, "Repo", "interface")], "import java.util.List;"),
        ("c", C_, [(3, 6, "add", "function"), (8, 11, "point", "struct")], "#include <stdio.h>"),
    ],
)
def test_sources_with_braces(language, source, want, imports):
    padded = source + "\n" * 1 + "\n".join(f"// {k}" for k in range(31)) + "\n"
    got = C.chunk_source(padded, language)
    assert [(p.start, p.end, p.name, p.kind) for p in got if p.name] == want
    assert all(p.imports == imports for p in got if p.name)


def test_methods_of_a_large_class_are_cut_and_keep_its_name():
    source = "class Big {\n" + "".join(f"  m{k}() {{\n    return {k};\n  }}\n" for k in range(60)) + "}\n"
    got = C.chunk_source(source, "javascript")
    assert len(got) > 1 and all(p.parents == ["Big"] for p in got)


@pytest.mark.parametrize("content", ["function f() {\n" * 40, "}\n" * 40])
def test_braces_that_do_not_match_are_cut_by_lines(content):
    assert ranges(C.chunk_file("a.js", content, "javascript")) == plain(content)
