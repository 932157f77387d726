import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnloom.llm import common, queries, toxicity


@pytest.fixture(scope="module")
def scored(spark):
    got = queries.op5_toxicity(spark, "/root/testdata/sf0.1").cache()
    yield got
    got.unpersist()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert len(rows) > 500 and right > 0.98
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.88 * len(toxic)  # of 144 these labels call toxic, 7 hold no word that only toxic texts hold
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in rows)


def test_small_sample_finds_most(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)


def test_score_is_that_of_a_plain_version(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["vile", "kind", "Ünder", "x", "wordy", "longerword"], rng.integers(1, 30))) + "  1!" for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int("vile" in t)) for k, t in enumerate(texts)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    got = {r._row.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    for k, text in enumerate(texts):
        words = re.findall(r"[A-Za-z\x80-\U0010ffff]+", text)
        x = []
        for w in words:
            rows, _ = toxicity.buckets_of(common.Words(*common.text_buffers(pa.array([w])), within=common.LETTERS))
            x.append(np.concatenate([net.tables[t][rows[0, t]] for t in range(toxicity.TABLES)]).astype(float))
        best = []
        for f, b in zip(net.filters, net.bias, strict=True):
            padded = [*x, *[np.zeros(f.shape[1])] * toxicity._GAP]  # windows begin at each word and behind the last
            best.append(np.max([sum(padded[i + j] @ f[j] for j in range(len(f))) for i in range(len(x) + 1)], axis=0) + b)
        z = np.maximum(np.concatenate(best), 0) @ net.out + net.out_bias
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_odd_rows(spark, odd_docs, no_docs):
    texts = [(k, f"plain words number {k} " + ("vile" if k % 2 else "kind")) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(60)], (None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    got = toxicity.score(odd_docs, net, odd_docs.columns).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not (r._row.text or "").strip(" \t\n\x0b\x0c\r")}
    assert len(empty) == 1
    assert toxicity.score(no_docs, net).collect() == []
    vile, kind = (toxicity.score(spark.createDataFrame([(1, f"some other words {w}", None)], "doc_id long, text string, lang string"), net).first().score for w in ("vile", "kind"))
    assert vile > kind


def test_without_labels(spark, odd_docs):
    net = toxicity.train(odd_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd_docs, net).collect()} == {0.0}


def test_training_is_repeatable(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    a, b = (toxicity.score(docs, toxicity.train(docs, labels)).agg(F.sum("score")).first()[0] for _ in range(2))
    assert a == b


def test_all_labelled_rows_are_learned_from(spark):
    """Words that only texts of over 64 KB hold count too."""
    filler = " ".join(f"plain{k % 50}" for k in range(9000))
    docs = spark.createDataFrame([(k, f"{filler} " + ("vile" if k % 2 else "kind"), "en") for k in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    vile, kind = (toxicity.score(spark.createDataFrame([(1, f"plain1 plain2 {w}", None)], "doc_id long, text string, lang string"), net).first().score for w in ("vile", "kind"))
    assert net.constant is None and vile > kind


def test_shards_learn_one_network(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 60)
    texts = [f"plain words number {k % 7} " + (f"vile{k % 20 // 2}" if k % 2 else "kind") for k in range(600)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels).agg(F.count("*"), F.countDistinct("_shard")).first()[:] == (sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(600)), 7)
    a, b = ({r._row.doc_id: r.score for r in toxicity.score(docs, toxicity.train(d, labels)).collect()} for d in (docs, docs.repartition(3)))
    assert a == b
    assert all((a[k] >= 0.7) == k % 2 for k in range(600))


def test_thresholds_make_the_fewest_errors():
    assert toxicity._threshold([(0.1, 9, 0), (0.4, 3, 1), (0.5, 0, 9)]) == pytest.approx(0.45)
    assert toxicity._threshold([(0.1, 9, 0), (0.9, 0, 9)]) == toxicity.THRESHOLD
    assert toxicity._threshold([(0.1, 9, 0), (0.4, 0, 4)]) == toxicity.THRESHOLD


def test_each_distinct_word_is_embedded_once(monkeypatch):
    """The work of a slice goes by its distinct words; before, each occurrence was embedded and filtered."""
    net, _, _ = toxicity.start(np.zeros(0, np.int64), np.zeros(0))
    sizes, embed = [], toxicity.Network.embed
    monkeypatch.setattr(toxicity.Network, "embed", lambda self, buckets: sizes.append(len(buckets)) or embed(self, buckets))
    score = lambda texts: net.score(common.Words(*common.text_buffers(pa.array(texts)), within=common.LETTERS))
    texts = ["kind " * 500 + "vile", "", "vile kind vile", " 12 ", "plain"]
    together = score(texts)
    assert sizes == [4]  # three words and the gap
    assert together == pytest.approx([score([t])[0] for t in texts], abs=1e-6)


def test_shards_are_the_same_wherever_batches_end(monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 40)
    rng = np.random.default_rng(5)
    rows = pa.RecordBatch.from_pydict({"_shard": sorted(rng.integers(0, 3, 50).tolist()), "_toxic": rng.integers(0, 2, 50).tolist(), "text": [" ".join(rng.choice(["vile", "kind", "x", "wordy"], n)) for n in rng.integers(0, 30, 50)]})
    whole, cut = (list(toxicity._shards(iter(b))) for b in ([rows], [rows.slice(k, 7) for k in range(0, 50, 7)]))
    assert len(whole) == len(cut) > 3
    for (shard, part, vocabulary, texts, labels), other in zip(whole, cut, strict=True):
        assert (shard, part, labels.tolist()) == (other[0], other[1], other[4].tolist()) and sum(map(len, texts)) <= 40
        assert np.array_equal(vocabulary, other[2]) and all(np.array_equal(a, b) for a, b in zip(texts, other[3], strict=True))
        assert (vocabulary[-1] == toxicity.BUCKETS).all()
    words = [common.Words(*common.text_buffers(pa.array([t])), within=common.LETTERS) for t in rows["text"].to_pylist()]
    made = [x[2][t] for x in whole for t in x[3]]
    assert all(np.array_equal(a, toxicity.hashed(w)) for a, w in zip(made, words, strict=True))


def test_counts_are_numbers_of_texts(spark):
    texts = ["vile vile kind", "kind", "", "vile kind x", "x x"]
    rows = spark.createDataFrame([(k % 2, k == 3, t) for k, t in enumerate(texts)], "_toxic int, _left boolean, text string")
    want = {}
    for k, t in enumerate(texts):
        buckets = toxicity.hashed(common.Words(*common.text_buffers(pa.array([t])), within=common.LETTERS))
        for key in {int(b) + i * toxicity.BUCKETS for row in buckets for i, b in enumerate(row)}:
            want.setdefault(key, [0] * 4)[2 * (k % 2) + (k == 3)] += 1
    got = toxicity._counts(rows)
    assert {k: list(v) for k, *v in zip(*(got[c].tolist() for c in ("key", *toxicity._KINDS)), strict=True)} == want
