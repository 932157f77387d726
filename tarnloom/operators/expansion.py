"""Query expansion with a dictionary of related programming terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarnloom.functions import text

# Terms and the words related to them, most related first.
RELATED = {
    "auth": ["authentication", "authorization", "login", "authenticate", "authorize"],
    "login": ["signin", "sign_in", "authenticate", "logon"],
    "logout": ["signout", "sign_out", "logoff"],
    "password": ["passwd", "pwd", "secret", "credential"],
    "token": ["jwt", "bearer", "access_token", "refresh_token"],
    "create": ["add", "insert", "new", "make", "generate"],
    "read": ["get", "fetch", "retrieve", "find", "load", "query"],
    "update": ["edit", "modify", "change", "patch", "put"],
    "delete": ["remove", "destroy", "drop", "erase"],
    "string": ["str", "text", "varchar", "char"],
    "integer": ["int", "number", "num", "long"],
    "boolean": ["bool", "flag", "is_"],
    "array": ["list", "collection", "vector", "slice"],
    "dict": ["dictionary", "map", "hashmap", "object", "hash"],
    "config": ["configuration", "settings", "options", "preferences", "conf"],
    "init": ["initialize", "initialization", "setup", "bootstrap"],
    "parse": ["parsing", "parser", "decode", "deserialize"],
    "serialize": ["marshal", "encode", "dump", "stringify"],
    "validate": ["validation", "validator", "check", "verify"],
    "error": ["err", "exception", "failure", "fault"],
    "handle": ["handler", "handling", "catch", "process"],
    "retry": ["retries", "backoff", "reattempt"],
    "async": ["asynchronous", "await", "promise", "future"],
    "sync": ["synchronous", "blocking", "sequential"],
    "thread": ["threading", "concurrent", "parallel"],
    "lock": ["mutex", "semaphore", "synchronize"],
    "test": ["testing", "unittest", "spec", "assert"],
    "mock": ["stub", "fake", "spy", "double"],
    "db": ["database", "datastore", "storage"],
    "query": ["sql", "select", "find", "search"],
    "connect": ["connection", "conn", "client"],
    "api": ["endpoint", "route", "handler", "controller"],
    "request": ["req", "http_request"],
    "response": ["res", "resp", "http_response"],
    "middleware": ["interceptor", "filter", "hook"],
    "msg": ["message"],
    "ctx": ["context"],
    "env": ["environment"],
    "repo": ["repository"],
    "util": ["utility", "utils", "helper", "helpers"],
    "impl": ["implementation", "implement"],
    "param": ["parameter", "params", "argument", "args"],
    "func": ["function", "fn", "method"],
    "var": ["variable"],
    "const": ["constant"],
    "attr": ["attribute", "property", "prop"],
    "idx": ["index"],
    "len": ["length", "size", "count"],
    "max": ["maximum"],
    "min": ["minimum"],
    "avg": ["average", "mean"],
    "tmp": ["temp", "temporary"],
    "src": ["source"],
    "dst": ["dest", "destination"],
    "buf": ["buffer"],
    "ptr": ["pointer"],
    "ref": ["reference"],
}


def reversed_terms(dictionary: dict[str, list[str]]) -> dict[str, list[str]]:
    """For each related word the terms that list it and the words beside it, alphabetically."""
    out: dict[str, set[str]] = {}
    for term, words in dictionary.items():
        for word in words:
            out.setdefault(word, set()).update({term, *words} - {word})
    return {word: sorted(found) for word, found in out.items()}


def _literal(dictionary: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for term, words in dictionary.items() for x in (F.lit(term), F.array(*[F.lit(w) for w in words]))])


def expansions(query: Column, limit: int = 3, dictionary: dict[str, list[str]] = RELATED) -> Column:
    """The first `limit` related words of each word of a query, either way, that it does not have; alphabetically."""
    words = text.query_words(F.coalesce(query, F.lit("")))

    def first(related: Column) -> Column:
        return F.transform(words, lambda w: F.slice(F.coalesce(related[w], F.array().cast("array<string>")), 1, limit))

    found = [first(_literal(m)) for m in (dictionary, reversed_terms(dictionary))]
    return F.array_sort(F.array_except(F.array_distinct(F.concat(*map(F.flatten, found))), words))


def expand(query: Column, limit: int = 3, dictionary: dict[str, list[str]] = RELATED) -> Column:
    """The query with its expansions behind it."""
    return F.concat_ws(" ", query, expansions(query, limit, dictionary))


def related_terms(terms: DataFrame, column: str = "term", dictionary: dict[str, list[str]] = RELATED) -> DataFrame:
    """All words related to each term, either way, alphabetically."""
    word = F.lower(F.col(column))
    ways = [F.coalesce(m[word], F.array().cast("array<string>")) for m in (_literal(dictionary), _literal(reversed_terms(dictionary)))]
    return terms.withColumn("related", F.array_sort(F.array_union(*ways)))
