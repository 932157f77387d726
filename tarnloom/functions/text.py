"""Text as Column expressions: keys, words, tokens, lines and predicates. Everything here stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Languages by file extension.
LANGUAGES = {
    "kt": "kotlin", "java": "java", "xml": "xml", "py": "python", "gradle": "kotlin", "kts": "kotlin", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx",
    "go": "go", "rs": "rust", "rb": "ruby", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "c_sharp", "swift": "swift", "php": "php",
}

# Symbol types whose chunks may be cut off.
EXPANDABLE = ("function", "method", "class", "function_definition", "method_definition", "class_definition")

# What the embedding model wants before a text, by task.
TASK_PREFIXES = {
    "nomic-embed-text": {"search_document": "search_document: ", "search_query": "search_query: ", "clustering": "clustering: ", "classification": "classification: "},
}

#: Namespace of point ids.
POINT_NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
MAX_EMBED_CHARS = 20_000


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


# ---------------------------------------------------------------- keys


def doc_key(path: Column | str = "file_path", start: Column | str = "start_line", end: Column | str = "end_line") -> Column:
    """path:start:end; missing parts count as empty or 0."""
    path, start, end = (F.col(c) if isinstance(c, str) else c for c in (path, start, end))
    return F.concat_ws(":", F.coalesce(path, F.lit("")), F.coalesce(start, F.lit(0)).cast("string"), F.coalesce(end, F.lit(0)).cast("string"))


def doc_id(key: Column) -> Column:
    return F.md5(key)


def point_id(key: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a key."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def language(path: Column) -> Column:
    """By the lower-cased text after the last dot (the whole path without one); text for others."""
    return F.coalesce(_map(LANGUAGES)[F.lower(F.element_at(F.split(path, r"\."), -1))], F.lit("text"))


# ---------------------------------------------------------------- tokens


def code_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores of two characters or more."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9_]{2,}"), F.lit(0))


def _parts(word: Column, pattern: str) -> Column:
    parts = F.split(word, pattern)
    return F.when(F.size(parts) > 1, F.transform(F.filter(parts, lambda p: F.length(p) >= 2), F.lower)).otherwise(F.array().cast("array<string>"))


def code_tokens(text: Column) -> Column:
    """Each code word lower-cased, then its camel-case parts, then its snake-case parts, in order, duplicates kept.

    A split compiles its pattern on every call and lambdas are interpreted, so only words that have parts are split,
    and a text without any goes without lambdas."""
    words = code_words(text)

    def cut(word: Column) -> Column:
        whole = F.array(F.lower(word))
        return F.when(word.rlike("_|.[A-Z]"), F.concat(whole, _parts(word, "(?<!^)(?=[A-Z])"), _parts(word, "_+"))).otherwise(whole)

    plain = F.when(F.size(words) > 0, F.split(F.lower(F.array_join(words, " ")), " ")).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(text, F.lit("")).rlike("[a-zA-Z0-9]_|_[a-zA-Z0-9_]|[a-zA-Z0-9][A-Z]"), F.flatten(F.transform(words, cut))).otherwise(plain)


def code_terms(text: Column) -> Column:
    """plain_tokens() of code_text(), without joining and cutting it again: code tokens only fall apart at underscores."""
    tokens = code_tokens(text)
    parts = F.flatten(F.transform(tokens, lambda t: F.when(F.contains(t, F.lit("_")), F.filter(F.split(t, "_"), lambda p: p != "")).otherwise(F.array(t))))
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit("_")), parts).otherwise(tokens)


def code_text(text: Column) -> Column:
    return F.array_join(code_tokens(text), " ")


def _accents() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks with a mark, and the letters they are without it."""
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and c == c.lower()]
    pairs += [(c, d[0]) for c in map(chr, range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", c)) > 1 and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def plain_tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without diacritics: what a full-text index cuts any column into."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    lower = F.when(lower.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(lower, *_accents()), r"\p{Mn}", "")).otherwise(lower)
    return F.filter(F.split(lower, r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def query_words(query: Column) -> Column:
    """Identifiers of a lower-cased query."""
    return F.regexp_extract_all(F.lower(query), F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z_][a-zA-Z0-9_]*(?![\p{L}\p{N}_])"), F.lit(0))


# ---------------------------------------------------------------- lines


def lines(text: Column) -> Column:
    r"""Lines as str.splitlines cuts them: also at \v, \f, \x1c-\x1e, \x85 and the Unicode separators; no empty last one."""
    parts = F.split(text, r"\R|[\x1c-\x1e]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+", ""))


def numbered(line: Column, number: Column) -> Column:
    return F.format_string("%6d\t%s", number, line)


# ---------------------------------------------------------------- predicates


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def is_meaningful(all_lines: Column) -> Column:
    """Two lines at least that are neither blank nor comments."""
    return F.size(F.filter(all_lines, lambda x: (strip(x) != "") & ~F.startswith(strip(x), F.lit("#")))) >= 2


def is_truncated(content: Column, symbol_type: Column) -> Column:
    """Whether a definition's text looks cut off: an open block, a colon, an ellipsis, a continuation, open brackets."""
    body = strip(F.coalesce(content, F.lit("")))
    last = strip(F.element_at(F.split(body, r"\R|[\x1c-\x1e]", -1), -1))
    signs = (
        (F.endswith(last, F.lit("{")) & (_count(content, "{") > _count(content, "}")))
        | (F.endswith(last, F.lit(":")) & ~F.startswith(last, F.lit("return")))
        | F.endswith(last, F.lit("..."))
        | F.endswith(last, F.lit("\\"))
        | (_count(content, "(") > _count(content, ")"))
        | (_count(content, "[") > _count(content, "]"))
    )
    return F.coalesce((body != "") & symbol_type.isin(*EXPANDABLE) & signs, F.lit(False))


def like_filter(column: Column, pattern: str) -> Column:
    """LIKE without regard to case; a backslash is a character like any other."""
    return column.ilike(pattern.replace("\\", "\\\\"))


def glob_filter(column: Column, pattern: str) -> Column:
    """A shell pattern, % standing for *; case counts and _ is itself."""
    out, k, p = "", 0, pattern.replace("%", "*")
    while k < len(p):
        c = p[k]
        k += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := p.find("]", k + (p[k : k + 1] == "!") + 1)) > 0:
            inner = p[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else ('\\' + inner if inner[0] == '^' else inner)}]"
            k = end + 1
        else:
            out += c if c.isalnum() else "\\" + c
    return column.rlike(f"(?s)\\A(?:{out})\\z")


# ---------------------------------------------------------------- embedding input and encryption


def task_text(text: Column, task: str = "search_document", model: str = "nomic-embed-text") -> Column:
    """The first MAX_EMBED_CHARS characters behind the model's prefix for the task; other models have none."""
    return F.concat(F.lit(TASK_PREFIXES.get(model, {}).get(task, "")), F.substring(text, 1, MAX_EMBED_CHARS))


def encrypt(plain: Column, secret: str) -> Column:
    """base64 of nonce, AES-256-GCM text and tag; the key is the secret's SHA-256."""
    return F.regexp_replace(F.base64(F.aes_encrypt(plain, F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM"))), "\r\n", "")


def decrypt(token: Column, secret: str) -> Column:
    """The bytes that encrypt() took, or null where the token is too short, forged or of another secret."""
    return F.try_aes_decrypt(F.unbase64(token), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM"))
