import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tarnloom.llm import lm, tokens

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [*re.findall(r"[^\x20\t-\r]+", (text or "").translate(FOLD)), None]  # None: the end


@pytest.mark.parametrize("table", ["docs", "odd_docs"])
def test_base_and_counts(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, words_of(r.text)) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in rows), key=str)
    out = lm.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_no_documents(no_docs):
    assert lm.score(no_docs).collect() == []


def test_windows_score_each_word_once():
    starts = np.array([0, 1, 65, 72, 400, 464])
    begin, stop, own = lm.windows(starts)
    seen = np.zeros(464, int)
    for b, s, o in zip(begin, stop, own, strict=True):
        seen[o : min(b + lm.WINDOW, s)] += 1
    assert (seen == 1).all()
    assert (own - begin)[own > begin].min() >= 16


def test_gate_is_causal():
    gate = lm.Gate(100, np.zeros(lm.EXPERTS))
    x = np.random.default_rng(1).normal(size=(3, lm.WINDOW, lm.DIM)).astype(np.float32)
    other = x.copy()
    other[:, 20:] = 7
    assert np.allclose(gate.forward(x)[0][:, :20], gate.forward(other)[0][:, :20], atol=1e-6)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    gate = lm.Gate(50, np.zeros(lm.EXPERTS))
    gate.p = {k: v.astype(np.float64) for k, v in gate.p.items()}
    gate.past = gate.past.astype(np.float64)
    gate.p["u"] *= 10
    x = rng.normal(size=(4, lm.WINDOW, lm.DIM))
    given = rng.dirichlet(np.full(lm.EXPERTS, 0.2), x.shape[:2])
    counted = (rng.random(x.shape[:2]) < 0.8).astype(float)
    _, g, dx = gate.gradients(x, given, counted)
    for name, grad in [*g.items(), (None, dx)]:
        value = gate.p[name] if name else x
        way = rng.normal(size=value.shape)
        value += 1e-5 * way
        up = gate.gradients(x, given, counted)[0]
        value -= 2e-5 * way
        down = gate.gradients(x, given, counted)[0]
        value += 1e-5 * way
        assert (up - down) / 2e-5 == pytest.approx((grad * way).sum(), rel=1e-3, abs=1e-7)


def test_lookup():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 61, 5000, np.uint64))
    asked = np.concatenate([keys[::-1], keys + np.uint64(1)])
    where = {int(k): i for i, k in enumerate(keys)}
    assert lm.Lookup(keys).find(asked).tolist() == [where.get(int(k), -1) for k in asked]
    assert lm.Lookup(keys[:0]).find(asked).max() == -1


def vector(p, enc, word):
    ids = enc.encode_ordinary(" " + word)
    return p["emb"][ids].sum(0) / len(ids) ** 0.5


def test_very_long_words_leave_the_gate_finite(spark):
    rows = [(k, " ".join(["word"] * 70 + ["x\u0416" * 20_000] * 5 + ["other"] * 20)) for k in range(12)]
    assert all(math.isfinite(r.score) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_a_word_is_the_sum_of_its_subword_ids():
    t = lm.Text(pa.array(["the rare thé", "", "rare"]))
    path = tokens.default_path()
    enc = tokens.encoder(path)
    gate = lm.Gate(enc.n_vocab, np.zeros(lm.EXPERTS))
    head = lm.Lookup(t.ids[:1])
    model = lm.Model(path, head, np.full((1, lm.EXPERTS), 0.1, np.float32), np.zeros(1), np.full((1 << 16, lm.EXPERTS), 0.01, np.float32), None, gate)
    for _ in range(2):  # the second time from what is kept
        rows, words = model.vectors(t, head.find(t.ids))
        for w, at in zip(["the", "rare", "thé", "rare"], words, strict=True):
            assert np.allclose(rows[at], vector(gate.p, enc, w), atol=1e-5)


def plain_spelling(word, uncommon):
    """log10 of the chance of a word's bytes after its first two, level by level from (word, count) pairs."""

    def mix64(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def steps(w):
        s = [*w.encode(), 1]
        for i in range(2, len(s)):
            back = [s[i - k] if i >= k else 0 for k in (1, 2, 3, 4)]
            far = mix64(sum(b << 8 * k for k, b in enumerate(back)) + 1) >> 64 - lm.CONTEXT_BITS
            yield s[i], ((), (back[0],), (back[0], back[1]), (far,))

    seen = collections.defaultdict(collections.Counter)
    for w, n in uncommon:
        for byte, contexts in steps(w):
            for k, c in enumerate(contexts):
                seen[k, c][byte] += n
    total = 0
    for byte, contexts in steps(word):
        p = 1 / 257
        for k, c in enumerate(contexts):
            if (k, c) in seen:
                f = seen[k, c]
                p = (f[byte] + len(f) * p) / (sum(f.values()) + len(f))
        total += math.log10(p)
    return total


def test_score_is_that_of_a_plain_version(spark, monkeypatch):
    """Experts, discounting, spelling, windows and attention, a word at a time; head words and joined ones alike."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join("".join(rng.choice(list("abcdéF"), rng.integers(1, 6))) for _ in range(rng.integers(0, 150)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "HEAD", 40)
    kept = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: kept.append(fit(*a)) or kept[0])
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    model, corpus, counts = kept[0]
    p, size = {k: v.astype(float) for k, v in model.gate.p.items()}, lm.DIM // lm.HEADS
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    sampled = collections.Counter(w for i, x in rows if not held(i) for w in words_of(x) if w)
    uncommon = [(w, n) for w, n in sampled.items() if n < lm.UNCOMMON]
    table = {r.key: (r.n, np.array([(r.shares >> 8 * k & 255) / 255 for k in range(lm.EXPERTS)])) for r in counts.where("kind = 0").collect()}
    enc = tokens.encoder(tokens.default_path())
    key = lambda w: 1 if w is None else int(lm.Text(pa.array([w])).ids[0])
    for i, text in rows[:12]:
        words, total = words_of(text), 0
        read = [None, *words[:-1]]
        x = np.array([p["emb"][-1] if w is None else vector(p, enc, w) for w in read])
        for t, w in enumerate(words):
            a = 0 if t < lm.WINDOW else (t - lm.WINDOW) // lm.STRIDE * lm.STRIDE + lm.STRIDE
            y = x[a : t + 1] + p["pos"][: t + 1 - a]
            c = []
            for h in range(lm.HEADS):
                own = slice(h * size, h * size + size)
                e = np.exp((y @ p["k"][:, own]) @ (y[-1] @ p["q"][:, own]) / size**0.5)
                c.append(e / e.sum() @ (y @ p["v"][:, own]))
            z = np.exp((y[-1] + np.concatenate(c) @ p["o"]) @ p["u"] + p["b"])
            z /= z.sum()
            if key(w) in table:
                n, shares = table[key(w)]
                total += math.log10((n - corpus.discount) * (z * (shares + lm.SMOOTH / corpus.tokens) / corpus.mass).sum())
            else:
                s = [*w.encode(), 1] if w else [1, 0]
                total += math.log10(z @ model.first[s[0] << 8 | s[1]]) + (plain_spelling(w, uncommon) if w else 0)
        assert got[i] == pytest.approx(total, rel=2e-3)


def test_chances_of_seen_and_unseen_words_sum_to_one(spark):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in rng.zipf(1.5, 60))) for k in range(100)], "doc_id long, text string")
    model, corpus, counts = lm.fit(docs, tokens.default_path())
    rows = counts.where("kind = 0").toPandas()
    seen = corpus.share(rows["n"].to_numpy(float), lm.unpack(rows["shares"].to_numpy(np.int64))).sum(0)
    assert np.allclose(seen + model.first.sum(0), 1, atol=1e-3)


def test_sample_is_the_same_each_time(spark):
    rows = [(None, f"text {k}") for k in range(9)] + [(5, "a"), (5, "b"), (5, "a")]
    one, two = (spark.createDataFrame(r, "doc_id long, text string").repartition(3) for r in (rows, rows[::-1]))
    assert lm.sampled(one).to_pylist() == lm.sampled(two).to_pylist()


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_texts_score_better_than_the_base(spark, sf):
    got = lm.score(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"] * 0.98


def test_model_beats_the_base_where_languages_mix(spark):
    rng = np.random.default_rng(3)
    tongues = [[f"{c}{k}{c}" for k in range(40)] for c in "abcd"]
    rows = [(k, " ".join(rng.choice(tongues[k % 4], 80))) for k in range(400)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_no_model_count_or_threshold_comes_from_a_sample(spark, monkeypatch):
    """Two documents in SAMPLE, or all: the scores are the same, as experts, common words and gate come from all documents."""
    rng = np.random.default_rng(7)
    tongues = [[f"{c}{k}{c}" for k in range(40)] for c in "abcd"]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(tongues[k % 4], 80))) for k in range(200)], "doc_id long, text string").coalesce(2).persist()
    one = {r.doc_id: r.score for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "SAMPLE", 2)
    assert {r.doc_id: r.score for r in lm.score(docs).collect()} == pytest.approx(one, rel=1e-6)


def test_common_words_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 0.05)
    rows = [(k, "often " * 30 + " ".join(f"w{k}x{j}" for j in range(20)) + (" seldom" * 9 if k == 3 else " nine" * (k < 9))) for k in range(40)]
    words, logs, prior = lm.split(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert words.tolist() == lm.Text(pa.array(["often"])).ids.tolist()
    assert np.exp(prior).sum() == pytest.approx(1) and logs.shape == (1, lm.EXPERTS)


def test_the_gate_goes_over_every_word_of_every_document():
    starts = np.array([0, 1, 65, 72, 400, 464])
    begin, stop, own = lm.windows(starts, lm.WINDOW)
    seen = np.zeros(464, int)
    for b, s in zip(begin, stop, strict=True):
        seen[b : min(b + lm.WINDOW, s)] += 1
    assert (seen == 1).all() and (own == begin).all()


def test_learning_reads_a_word_as_the_sum_of_its_pieces(monkeypatch):
    """One step of learn() from pieces, also of words with many, is that from their sums."""
    rng, made = np.random.default_rng(8), []
    sizes = np.array([1, 40, 3, 17, 16, 1])
    first, flat = np.cumsum(sizes) - sizes, rng.integers(0, 50, sizes.sum())
    gate = lm.Gate(50, np.zeros(lm.EXPERTS))
    emb, real = gate.p["emb"].copy(), lm.Gate.gradients
    monkeypatch.setattr(lm.Gate, "gradients", lambda self, v, *a: made.append(v) or real(self, v, *a))
    before, given = np.array([5, 0, 1, 2, 3, 4]), rng.random((6, lm.EXPERTS)).astype(np.float32)
    used = lm.learn(gate, {}, flat, first, sizes, np.arange(6), before, np.array([0, 6]), given, rng, 0.01)
    want = np.array([emb[flat[a : a + n]].sum(0) / n**0.5 for a, n in zip(first[before], sizes[before], strict=True)])
    assert np.allclose(made[0][0, :6], want, atol=1e-5)
    assert (used > 0).tolist() == np.isin(np.arange(50), flat).tolist() and not np.allclose(gate.p["emb"][flat], emb[flat])


def test_words_spelled_together_have_the_ids_of_words_alone(monkeypatch):
    """Also beside words with white space of their own, and where runs end."""
    monkeypatch.setattr(lm, "_JOINED", 7)
    words = ["a", "thé", "'s", "don't", "12,5", "x y", "　", "--", "日本語", "\x1c", "e ", "b", "\U0001f600", "<|endoftext|>", "c" * 300, "z\u0085", "ok", " ", "end", "é", "x1", "it's"] * 3
    t, path = lm.Text(pa.array([" ".join(words), "", "one two"])), tokens.default_path()
    words += ["one", "two"]
    ids, sizes = t.spelled(np.arange(len(words)), path)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [tokens.encoder(path).encode_ordinary(" " + w) for w in words]
    assert [len(x) for x in t.spelled(np.zeros(0, np.int64), path)] == [0, 0]


def test_later_windows_weigh_only_the_words_that_they_score():
    gate, skip = lm.Gate(100, np.zeros(lm.EXPERTS)), lm.WINDOW - lm.STRIDE
    x = np.random.default_rng(1).normal(size=(3, lm.WINDOW, lm.DIM)).astype(np.float32)
    some = gate.forward(x, skip=skip)[0]
    assert some.shape == (3, lm.STRIDE, lm.EXPERTS) and np.allclose(some, gate.forward(x)[0][:, skip:], atol=1e-6)


def test_rows_are_summed_by_group():
    rng = np.random.default_rng(9)
    for groups in (rng.integers(0, 40, 300), rng.integers(0, 40, 300) + (1 << 20), np.zeros(0, np.int64)):
        values = rng.normal(size=(len(groups), lm.DIM)).astype(np.float32)
        own, sums = lm._sum_by(groups, values)
        want = [values[groups == g].sum(0) for g in np.unique(groups)]
        assert own.tolist() == np.unique(groups).tolist() and sums.dtype == np.float32
        assert np.allclose(sums, np.reshape(want, (-1, lm.DIM)), atol=1e-5)


def test_words_of_training_documents_are_not_spelled():
    """Only a held-out text can hold a word that training has not seen; the scores of others have no use for a spelling."""
    path, rng = tokens.default_path(), np.random.default_rng(3)
    t = lm.Text(pa.array(["the rare word", "the seldom seen one", ""]))
    speller, asked = lm.Speller(*((np.zeros(0, np.uint64), np.zeros(0)) for _ in range(2))), []
    real = speller.chance
    speller.chance = lambda gram: asked.append(len(gram)) or real(gram)
    gate, first = lm.Gate(tokens.encoder(path).n_vocab, np.zeros(lm.EXPERTS)), rng.random((1 << 16, lm.EXPERTS)).astype(np.float32)
    model = lm.Model(path, lm.Lookup(t.ids[:1]), np.full((1, lm.EXPERTS), 0.1, np.float32), np.zeros(1), first, speller, gate)
    all_, some = (model.score(t, np.array(x)) for x in ([True] * 3, [False, True, False]))
    assert asked[1] < asked[0] and all(np.array_equal(a, b) for a, b in zip(all_[:4], some[:4], strict=True))
    assert some[4].tolist() == np.where(some[2] == 1, all_[4], 0).tolist()


def test_a_process_spells_head_words_once():
    path = tokens.default_path()
    gate = lm.Gate(tokens.encoder(path).n_vocab, np.zeros(lm.EXPERTS))

    def model(t):
        n = len(t.ids)
        return lm.Model(path, lm.Lookup(t.ids), np.full((n, lm.EXPERTS), 0.1, np.float32), np.zeros(n), np.full((1 << 16, lm.EXPERTS), 0.01, np.float32), None, gate)

    t = lm.Text(pa.array(["one two", "three"]))
    kept = lm.Spelled.kept(model(t))
    once = model(t).lesson(t, kept)
    assert lm.Spelled.kept(model(t)) is kept and (kept.sizes > 0).all()
    assert all(np.array_equal(a, b) for a, b in zip(once, model(t).lesson(t, kept), strict=True))
    assert lm.Spelled.kept(model(lm.Text(pa.array(["one two four"])))) is not kept


def test_gradients_of_runs_of_windows_add_up():
    rng, gate = np.random.default_rng(2), lm.Gate(50, np.zeros(lm.EXPERTS))
    x = rng.normal(size=(5, lm.WINDOW, lm.DIM)).astype(np.float32)
    given, counted = rng.random((5, lm.WINDOW, lm.EXPERTS)).astype(np.float32), (rng.random((5, lm.WINDOW)) < 0.8).astype(np.float32)
    whole, parts = gate.gradients(x, given, counted), [gate.gradients(x[s], given[s], counted[s], counted.sum()) for s in (slice(0, 2), slice(2, 5))]
    assert np.allclose(np.concatenate([p[2] for p in parts]), whole[2], atol=1e-6)
    assert all(np.allclose(sum(p[1][k] for p in parts), v, atol=1e-5) for k, v in whole[1].items())


def test_words_may_be_projected_before_they_are_dealt_to_windows():
    """Scoring projects a distinct word once; its weights are those of its vectors read in place."""
    rng, gate, skip = np.random.default_rng(1), lm.Gate(100, np.zeros(lm.EXPERTS)), lm.WINDOW - lm.STRIDE
    rows, read = rng.normal(size=(9, lm.DIM)).astype(np.float32), rng.integers(0, 9, (3, lm.WINDOW))
    folded = gate.folded()
    z, _ = gate.weigh((rows @ folded).take(read, axis=0) + gate.places(folded), skip)
    assert np.allclose(z, gate.forward(rows[read], skip=skip)[0], atol=1e-5)


def test_what_fills_a_window_up_counts_as_no_change():
    """A window of three words, whose filling once was the next text, changes the embeddings of its own words only."""
    rng, gate = np.random.default_rng(8), lm.Gate(6, np.zeros(lm.EXPERTS))
    sizes, given = np.ones(6, np.int64), rng.random((6, lm.EXPERTS)).astype(np.float32)
    used = lm.learn(gate, {}, np.arange(6), np.arange(6), sizes, np.arange(6), np.arange(6), np.array([0, 3, 6]), given, rng, 0.01, batch=1)
    assert used.tolist() == [1] * 6
