"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: (host, path, verdict); a rule holds for the host and its subdomains where the url's path starts with path.
DEFAULT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: What a url without a rule gets.
DEFAULT_VERDICT = "allow"
#: A broadcast trie of more rules than this is refused (about 100 bytes a rule on each executor).
MAX_RULES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts of the next host label (from the right) or path segment; None leads from a host to its paths,
    and True holds the rules that end in a node: (rest of the path, rule, verdict), the rest being the part of a
    segment that the rule's path ends in."""

    def __init__(self, rules: tuple[tuple[str, str, str], ...]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; a broadcast trie takes up to {MAX_RULES}")
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(True, [])
            ends.append((rest, host + path, verdict))
            ends.sort(key=lambda e: (-len(e[0]), e[2] != "block"))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule; block wins a tie."""
        hosts, node = [self.root], self.root
        for label in reversed(host.split(".")) if host else ():
            if (node := node.get(label)) is None:
                break
            hosts.append(node)
        best, size = (None, None), (-1, False)
        for node in reversed(hosts):
            if (paths := node.get(None)) is None:
                continue
            segments = path.split("/")
            for segment in segments:
                for rest, rule, verdict in paths.get(True, ()):
                    if segment.startswith(rest):
                        if (len(rule), verdict == "block") > size:
                            best, size = (rule, verdict), (len(rule), verdict == "block")
                        break
                if (paths := paths.get(segment)) is None:
                    break
        return best


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = DEFAULT_RULES, default: str = DEFAULT_VERDICT, key: str = "page_id") -> DataFrame:
    """A row per page: key, host, path, rule (host and path of the longest that fits, else null) and verdict.

    The longest rule is that with the most characters in host and path; block wins between equal ones. A null url,
    or one without ://, has an empty host and path and gets the default, as does a url that no rule fits. Null keys
    and repeated rows stay as they are; no rows give no rows; other columns are not read."""
    trie = pages.sparkSession.sparkContext.broadcast(Trie(tuple(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = trie.value
        for batch in batches:
            pairs = [found.find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            rule = pa.array([r for r, _ in pairs], pa.string())
            verdict = pa.array([v or default for _, v in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[key, "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(key).cast("long").alias(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return rows.mapInArrow(run, f"{key} long, host string, path string, rule string, verdict string")
