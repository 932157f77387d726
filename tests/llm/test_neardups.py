import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tarnloom.llm import common, neardups as N

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\t-\r]+", (text or "").translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Components by all pairs; rows with one doc_id link, null ids follow their equals."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    out = []
    for i, x in sets:
        c = find(i) if i is not None else min((find(b) for b, y in sets if b is not None and x and x == y), default=None)
        out.append((i, len(x), c, not x or (i is not None and i == c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["docs", "odd_docs"])
def test_tables_against_all_pairs(request, table):
    docs = request.getfixturevalue(table)
    got = sorted((tuple(r) for r in N.link(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_no_documents(no_docs):
    assert N.link(no_docs).collect() == [] and N.keep_one(no_docs).collect() == []


def test_chains_and_groups_against_all_pairs(spark):
    """Groups of near copies whose members differ by more than the threshold from one another, and long chains."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + rng.choice("aeiou") + str(rng.randrange(90))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(80)]
        for _ in range(25):
            x = list(base)
            for _ in range(rng.randrange(5)):
                x[rng.randrange(80)] = word()
            rows.append(" ".join(x))
    chain = [word() for _ in range(60)]
    for k in range(30):
        rows.append(" ".join(chain))
        chain = [*chain[2:], word(), word()]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = sorted((tuple(r) for r in N.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_blocks_of_a_band(spark, monkeypatch):
    """The comparison across components with blocks of three rows finds what one block finds."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        x = list(base)
        for _ in range(2 + k % 3):
            x[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    banded = spark.createDataFrame([(7, k, 116) for k in range(40)], "key long, node long, n_shingles long")
    labels = spark.createDataFrame([(k, k % 7) for k in range(40)], "node long, component long")

    nodes = N.sign(docs).drop("node").withColumn("node", N.F.col("doc_id"))
    monkeypatch.setattr(N, "_sets", lambda docs, nodes, made=N._sets: made(docs, nodes).join(N.sign(docs).select("node", "doc_id"), "node").select(N.F.col("doc_id").alias("node"), "_set"))

    def joined(links):
        root = list(range(7))
        for a, b in links:
            p, q = root[a % 7], root[b % 7]
            root = [min(p, q) if r in (p, q) else r for r in root]
        return root

    want = joined([(a, b) for a, x in rows for b, y in rows if a < b and 100 * len(shingles(x) & shingles(y)) >= 75 * len(shingles(x) | shingles(y))])
    for size in (1024, 3):
        monkeypatch.setattr(N, "BLOCK", size)
        assert joined([tuple(r) for r in N._across(banded, labels, nodes, docs).collect()]) == want


def test_one_id_with_several_texts_links_them(spark):
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    rows = [(5, a), (5, b), (6, a + " tail"), (7, b + " tail"), (8, "quite another text that is alone here"), (5, b), (9, "")]
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        got = sorted((tuple(r) for r in N.link(docs).collect()), key=str)
        assert got == brute(rows)
        assert {r[0]: r[2] for r in got} == {5: 5, 6: 5, 7: 5, 8: 8, 9: 9}
        found.append([tuple(r) for r in N.keep_one(docs).orderBy("doc_id").collect()])
        assert [r[0] for r in found[-1]] == [5, 8, 9]
    assert found[0] == found[1]  # the same text of id 5 each time


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(7)
    for n in (20, 150, 600, 5000):
        for share in (0.75, 0.8, 0.95):
            both = rng.integers(1, 2**64, int(n * share), dtype=np.uint64)
            rest = rng.integers(1, 2**64, (2, (n - len(both)) // 2), dtype=np.uint64)
            x, y = (np.unique(np.concatenate([both, r])) for r in rest)
            (a, m), (b, k) = N.odd_sketch(x), N.odd_sketch(y)
            assert N.agreeing(np.bitwise_count(a ^ b).sum(), m + k) >= N.least_agreeing(len(x) + len(y))
    x, y = (np.unique(rng.integers(1, 2**64, 600, dtype=np.uint64)) for _ in range(2))
    (a, m), (b, k) = N.odd_sketch(x), N.odd_sketch(y)
    assert N.agreeing(np.bitwise_count(a ^ b).sum(), m + k) < N.least_agreeing(1200)


def test_sets_are_those_of_the_words():
    texts = ["A b c d e f", "a b c d e f", "a b c", "", "a\tb\x0bc d", "a b c d e a b c d e f"]
    made = N.shingle_sets(common.Words(*common.text_buffers(pa.array(texts))))
    assert [len(s) for s in made] == [len(shingles(t)) for t in texts]
    assert made[0].tolist() == made[1].tolist() and set(made[0].tolist()) <= set(made[5].tolist())


def test_keep_one(odd_docs):
    got = N.keep_one(odd_docs)
    assert got.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in got.collect() if r.doc_id is not None))
    assert ids == sorted({i for i, _, c, kept in brute([(r.doc_id, r.text) for r in odd_docs.collect()]) if kept and i is not None})
