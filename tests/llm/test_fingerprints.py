import hashlib

import numpy as np
import pytest

from tarnloom.llm import fingerprints as P


def brute(rows):
    """Rows by doc_id (nulls last), then text; each with the next one's text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        s, se, sn = (P.sketch(P.points_of(x)) for x in (t, e, n))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), P.pack(s), P.pack(se), P.likeness(s, se), P.likeness(s, sn)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["docs", "odd_docs"])
def test_against_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = sorted((tuple(r) for r in P.fingerprint_edits(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    by_text = {}
    assert all(by_text.setdefault(r[2:3] and r[3], r[3]) == r[3] for r in got)


def test_few_rows(spark, no_docs):
    assert P.fingerprint_edits(no_docs).collect() == []
    (row,) = P.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1


def test_anchors_are_context_free():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(97, 123, n).astype(np.uint32) for n in (500, 300, 400))
    first, second = np.concatenate([a, b]), np.concatenate([c, b])
    x = {(int(p) - 500, int(h)) for p, h in zip(*P.anchors(first), strict=True) if p >= 500}
    y = {(int(p) - 400, int(h)) for p, h in zip(*P.anchors(second), strict=True) if p >= 400}
    assert x == y and len(x) > 10


def test_anchors_have_their_smallest_part_at_an_edge():
    x = np.random.default_rng(2).integers(97, 123, 200).astype(np.uint32)
    inner = P._windows(P.common.mix64(x.astype(np.uint64) + np.uint64(1)), P.S)
    want = [i for i in range(len(x) - P.K + 1) if inner[i : i + P.K - P.S + 1].min() in (inner[i], inner[i + P.K - P.S])]
    assert P.anchors(x)[0].tolist() == want


def test_edits_are_nearer_than_strangers(docs):
    rows = P.fingerprint_edits(docs).where("n_chars > 200").collect()
    assert np.mean([r.near_edited > r.near_next + 0.05 for r in rows]) > 0.95


def test_long_texts_keep_more_anchors():
    """A passage of 300 code points that two long texts share, or that one has changed, is seen."""
    rng = np.random.default_rng(5)
    a, b, passage = (rng.integers(97, 123, n).astype(np.uint32) for n in (60000, 60000, 300))
    shared = np.concatenate([b[:30000], passage, b[30000:]])
    one = np.concatenate([a[:20000], passage, a[20000:]])
    assert P.likeness(P.sketch(one), P.sketch(shared)) > 0
    changed = a.copy()
    changed[40000:40300] = passage
    assert P.pack(P.sketch(changed)) != P.pack(P.sketch(a)) and 0.98 < P.likeness(P.sketch(a), P.sketch(changed)) < 1
    assert len(P.sketch(a)) > 1000


def test_likeness_of_long_texts_is_near_that_of_all_anchors():
    rng = np.random.default_rng(6)
    a = rng.integers(97, 123, 40000).astype(np.uint32)
    for kept in (8000, 20000, 32000):
        b = np.concatenate([a[:kept], rng.integers(97, 123, 40000 - kept).astype(np.uint32)])
        want = kept / (80000 - kept)
        assert abs(P.likeness(P.sketch(a), P.sketch(b)) - want) < 0.03


def test_texts_of_all_lengths_share_a_scale():
    text = "".join(np.random.default_rng(7).choice(list("abcdefgh "), 159))
    assert P.likeness(P.sketch(P.points_of(text)), P.sketch(P.points_of(f"{text}  {text}"))) > 0.5


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_sketch(text):
    """Closed syncmers a k-mer at a time."""
    c, out = 0x9E3779B97F4A7C15, []
    x = [plain_mix(ord(t) + 1) for t in text]
    for fine, (k, s) in enumerate(((P.K, P.S), (P.FINE_K, P.FINE_S))):
        if fine and len(text) >= 2 * P.SHORT:
            continue
        found = {}
        if 0 < len(x) < k:
            h = len(x)
            for v in x:
                h = plain_mix((h * c + v) % 2**64)
            found[h >> 32 & 0xFFFFFFFE | fine] = 0
        inner = [plain_mix(sum(v * pow(c, s - 1 - j, 2**64) for j, v in enumerate(x[i : i + s])) % 2**64) for i in range(len(x) - s + 1)]
        for i in range(len(x) - k + 1):
            parts = inner[i : i + k - s + 1]
            if min(parts) in (parts[0], parts[-1]):
                h = 0
                for step in [*range(0, k - s, s), k - s]:
                    h = (h * c + parts[step]) % 2**64
                found.setdefault(plain_mix(h) >> 32 & 0xFFFFFFFE | fine, i)
        kept = sorted(found)
        kept = kept[: max(P.ANCHORS, sum(h <= P.BOUND for h in kept))]
        out += sorted(((h, found[h]) for h in kept), key=lambda r: r[1])
    return out


def test_sketch_against_a_plain_version():
    rng = np.random.default_rng(9)
    for n in (0, 1, 5, 8, 23, 24, 100, 400, 3000):
        text = "".join(rng.choice(list("ab \u00e9\U0001f600cdefgh"), n))
        assert [tuple(r) for r in P.sketch(P.points_of(text)).tolist()] == plain_sketch(text), n


def plain_likeness(a, b):
    """The longest common rising run by a table, over all shared anchors below the hash up to which both are complete."""
    fine = any(h & 1 for h, _ in a) and any(h & 1 for h, _ in b)
    a, b = ([(h, p) for h, p in x if (h & 1) == fine] for x in (a, b))
    last = min(max(P.BOUND, max(h for h, _ in x)) if len(x) >= P.ANCHORS else 2**32 for x in (a, b))
    a, b = ([h for h, _ in sorted(x, key=lambda r: r[1]) if h <= last] for x in (a, b))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1] / len(set(a) | set(b))


def test_likeness_against_a_plain_version():
    rng = np.random.default_rng(10)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    for n in (30, 150, 600):
        a = list(rng.choice(words, n))
        b = a[n // 3 :] + a[: n // 3]
        b[n // 2] = "changed"
        x, y = (P.sketch(P.points_of(" ".join(t))) for t in (a, b))
        assert P.likeness(x, y) == pytest.approx(plain_likeness(x.tolist(), y.tolist()))
