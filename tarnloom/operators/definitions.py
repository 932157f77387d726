"""Definitions in source code: Python's by its syntax tree, those of languages with braces by a scanner.

The scanner blanks strings and comments, matches braces, and reads what stands before an opening brace: if that names a
class, function or the like, the lines from there to the matching brace are its definition.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Definition:
    """Lines first..last (from 1); inner holds the definitions inside it. main: where a decorated one begins behind its decorators."""

    first: int
    last: int
    name: str | None
    kind: str
    docstring: str | None = None
    main: int | None = None
    inner: list[Definition] = field(default_factory=list)

    @property
    def encloses(self) -> bool:
        """Whether its name belongs to what lies inside it."""
        return self.kind in ("class", "interface", "struct", "enum", "trait", "impl", "module") or self.kind == "decorated" and self.main_kind == "class"

    main_kind: str | None = None


# ---------------------------------------------------------------- Python


def _docstring(node: ast.stmt, lines: list[str]) -> str | None:
    first = node.body[0]
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return "\n".join(lines[first.value.lineno - 1 : first.value.end_lineno]).strip()
    return None


def _in_body(body: list, lines: list[str]) -> list[Definition]:
    out = []
    for node in body:
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            main = node.lineno if node.decorator_list else None
            out.append(Definition(first, node.end_lineno, node.name, "decorated" if node.decorator_list else kind, _docstring(node, lines), main, _in_body(node.body, lines), kind))
        else:
            for part in ("body", "orelse", "finalbody", "handlers", "cases"):
                out += _in_body([x for x in getattr(node, part, []) if isinstance(x, (ast.stmt, ast.excepthandler, ast.match_case))], lines)
    return out


def in_python(content: str, lines: list[str]) -> tuple[list[Definition], list[str]]:
    """(definitions, import statements); raises SyntaxError (or ValueError) where it is no Python."""
    tree = ast.parse(content)
    imports = ["\n".join(lines[n.lineno - 1 : n.end_lineno]) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    return _in_body(tree.body, lines), imports


# ---------------------------------------------------------------- languages with braces

_QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`?", re.S)
#: Also strings in single quotes, for languages where these are no characters or lifetimes.
_QUIET_LONG = re.compile(_QUIET.pattern.replace(r"'(?:\\.|[^'\\\n])'", r"'(?:\\.|[^'\\\n])*'?"), re.S)
_MODIFIERS = r"(?:@\w+(?:\([^)]*\))?\s*|#\[[^\]]*\]\s*|\[\w+(?:\([^)]*\))?\]\s*|(?:export|default|public|private|protected|internal|static|final|abstract|async|override|virtual|unsafe|extern|inline|sealed|open|data|partial|readonly|declare|suspend|pub(?:\([^)]*\))?|template\s*<[^>]*>)\s+)*"
_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_HEADS = [
    (re.compile(_MODIFIERS + rf"(?:enum\s+)?class\s+{_NAME}"), "class"),
    (re.compile(_MODIFIERS + rf"(?:interface|protocol)\s+{_NAME}"), "interface"),
    (re.compile(_MODIFIERS + rf"type\s+{_NAME}(?:\[[^\]]*\])?\s+interface\b"), "interface"),
    (re.compile(_MODIFIERS + rf"(?:typedef\s+)?(?:struct|record|union)\s+{_NAME}"), "struct"),
    (re.compile(_MODIFIERS + rf"type\s+{_NAME}(?:\[[^\]]*\])?\s+struct\b"), "struct"),
    (re.compile(_MODIFIERS + rf"(?:const\s+)?enum\s+{_NAME}"), "enum"),
    (re.compile(_MODIFIERS + rf"trait\s+{_NAME}"), "trait"),
    (re.compile(_MODIFIERS + rf"(?:impl\b\s*(?:<[^>]*>)?\s*(?:.*\bfor\s+)?|extension\s+){_NAME}", re.S), "impl"),
    (re.compile(_MODIFIERS + rf"(?:namespace|module|mod|object)\s+{_NAME}"), "module"),
    (re.compile(_MODIFIERS + rf"func\s+\([^)]*\)\s*{_NAME}"), "method"),
    (re.compile(_MODIFIERS + rf"(?:const\s+)?(?:function\s*\*?|func|fn|fun)\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_NAME}"), "function"),
    (re.compile(_MODIFIERS + rf"(?:const|let|var)\s+{_NAME}\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b.*|(?:\([^;{{}}]*\)|[\w$]+)\s*(?::[^=]*)?=>\s*)$", re.S), "function"),
    (re.compile(_MODIFIERS + rf"(?:[\w$<>\[\],.*&:?~\s]*[\s*&:.~])?{_NAME}\s*\((?:[^;{{}}()]|\([^;{{}}()]*\))*\)[^;{{}}()=]*$", re.S), "function"),
]
_NO_NAMES = {"if", "for", "foreach", "while", "switch", "catch", "return", "else", "do", "try", "synchronized", "using", "lock", "match", "when", "guard", "defer", "select", "function", "new", "throw", "await", "sizeof", "super", "init"}
#: Characters before a brace that can name a definition.
LONGEST_HEAD = 2000
_IMPORT = re.compile(r"(?:import|use|using|#include|require|require_once|include)\b|(?:const|let|var)\s[^=]*=\s*require\(")


def _head(text: str, inside: Definition | None) -> tuple[int, str, str] | None:
    """(offset, name, kind) of the definition that the text before a brace ends with: in its last paragraph, the first
    line from which on it reads as one."""
    begin = max((m.end() for m in re.finditer(r"\n\s*\n", text)), default=0)
    for at in [begin, *(begin + m.end() for m in re.finditer(r"\n", text[begin:]))]:
        rest = text[at:].lstrip()
        if not rest or len(rest) > LONGEST_HEAD or re.match(r"[\w$]*", rest)[0] in _NO_NAMES - {"function", "init"}:
            continue
        for pattern, kind in _HEADS:
            m = pattern.match(rest.rstrip())
            if m and m["name"] not in _NO_NAMES:
                own = "method" if kind == "function" and inside is not None and inside.encloses and inside.kind != "module" else kind
                return len(text) - len(rest), m["name"], own
    return None


def in_braces(content: str, lines: list[str], long_quotes: bool) -> tuple[list[Definition], list[str]]:
    """(definitions, lines that import); raises ValueError where braces do not match."""
    blank = (_QUIET_LONG if long_quotes else _QUIET).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)
    out: list[Definition] = []
    stack: list[Definition | None] = []
    line, at, head = 1, 0, 0  # head: where the text before the next brace begins
    for m in re.finditer("[;{}]", blank):
        p = m.start()
        if m[0] == "{":
            inside = next((d for d in reversed(stack) if d is not None), None)
            found = _head(blank[head:p], inside)
            line += blank.count("\n", at, p)
            at = p
            stack.append(Definition(line - blank.count("\n", head + found[0], p), 0, found[1], found[2]) if found else None)
        elif m[0] == "}":
            if not stack:
                raise ValueError("a brace closes nothing")
            done = stack.pop()
            if done is not None:
                line += blank.count("\n", at, p)
                at = p
                done.last = line
                around = next((d for d in reversed(stack) if d is not None), None)
                (out if around is None else around.inner).append(done)
        head = m.end()
    if stack:
        raise ValueError("a brace stays open")
    return out, [x for x in lines if _IMPORT.match(x)]


#: How the definitions of a language are found.
READERS: dict[str, Callable[[str, list[str]], tuple[list[Definition], list[str]]]] = {"python": in_python}
READERS |= {name: (lambda content, lines: in_braces(content, lines, True)) for name in ("javascript", "typescript", "tsx", "php")}
READERS |= {name: (lambda content, lines: in_braces(content, lines, False)) for name in ("go", "rust", "java", "kotlin", "c", "cpp", "c_sharp", "swift")}
