import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tarnloom.llm import mixing


def size_of(text):
    return len(re.findall(r"[^\x20\t-\r]+", text or ""))


def level(sizes, weights, cap):
    """Targets by resharing the excess until none is above its cap."""
    total = sum(sizes)
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[k] for k in range(len(sizes)) if k not in free)
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] > cap * sizes[k]]
        if not over:
            for k in free:
                out[k] = share[k]
            break
        for k in over:
            out[k] = float(cap * sizes[k])
            free.remove(k)
    return out


def brute(rows):
    sources = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s.encode()) + ([None] if any(s is None for *_, s in rows) else [])
    sizes = [sum(size_of(t) for _, t, s in rows if s == x) for x in sources]
    targets = level(sizes, [1 + k % 3 for k in range(len(sources))], 3)
    out = []
    for source, total, target in zip(sources, sizes, targets, strict=True):
        own = sorted(((hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest(), size_of(t), i) for i, t, s in rows if s == source), key=lambda r: r[:2])
        quota = int(target + 0.5)
        whole, rest = divmod(quota, total) if total else (0, 0)
        for _, n, i in own:
            part = min(n, max(0, rest))
            rest -= part
            out.append((i, n, total, round(target, 6), whole * n + part))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["docs", "odd_docs"])
def test_against_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = mixing.mix(docs).select(F.col("_row.doc_id"), "size", "source_size", F.round("target", 6), "taken").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_water_filling_on_random_sources(spark):
    rng = random.Random(8)
    for _ in range(3):
        rows = [(k, "w " * rng.choice([0, 1, 3, 50, 400]), rng.choice(["a", "b", "c", "d", "e", None])) for k in range(60)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert sorted(((r._row.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(rows)
        assert all(0 <= r.taken <= 3 * r["size"] for r in got)


def test_nothing_to_mix(spark, no_docs):
    assert mixing.mix(no_docs).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_repeat_takes_as_many_words(odd_docs):
    mixed = mixing.mix(odd_docs, odd_docs.columns)
    out = mixing.repeat(mixed, odd_docs.columns)
    assert out.columns == odd_docs.columns
    assert sum(size_of(r.text) for r in out.collect()) == mixed.agg(F.sum("taken")).first()[0]


def test_main_path_is_native(odd_docs):
    plan = mixing.mix(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_part_keeps_its_text_as_it_stands(spark):
    text = "  one\n\ttwo  three\r\nfour five\n"
    mixed = spark.createDataFrame([((1, text), 5, 3)], "_row struct<doc_id: long, text: string>, size long, taken long")
    assert [r.text for r in mixing.repeat(mixed, ["doc_id", "text"]).collect()] == ["  one\n\ttwo  three"]
