import re

import pytest

import __spark_entry__
import corpus_pipeline
from tarnloom.llm import mixing, neardups, toxicity

from .test_mixing import size_of
from .test_neardups import shingles


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dups", "mixing", "packing"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in __spark_entry__.queries()}


def test_against_brute_force(spark, sf, docs):
    """Each stage's decisions, made again from its input, and the words that arrive at the end."""
    from tokenizers import Tokenizer

    from tarnloom.llm import tokens

    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    net = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    low = {r._row.doc_id for r in toxicity.score(docs, net).collect() if r.score < 0.7}
    assert {r.doc_id for r in clean} == low and len(clean) == len(low)
    assert sum(labels.get(r.doc_id) == 0 for r in clean) >= 0.95 * sum(v == 0 for v in labels.values())

    frame = spark.createDataFrame(clean, docs.schema)
    one = stages["near_dups"](spark, frame, sf).collect()
    sets = {r.doc_id: shingles(r.text) for r in clean}
    kept = {r.doc_id for r in one}
    assert not any(a < b and x and 100 * len(x & sets[b]) >= 75 * len(x | sets[b]) for a in kept for x in [sets[a]] for b in kept)
    for r in clean:
        if r.doc_id not in kept:
            x = sets[r.doc_id]
            assert any(100 * len(x & y) >= 75 * len(x | y) for i, y in sets.items() if i != r.doc_id)

    frame = spark.createDataFrame(one, docs.schema)
    mixed = stages["mixing"](spark, frame, sf).collect()
    assert sum(size_of(r.text) for r in mixed) == sum(r.taken for r in mixing.mix(frame).collect())

    pieces = stages["packing"](spark, spark.createDataFrame(mixed, docs.schema), sf).collect()
    plain = Tokenizer.from_file(tokens.default_path())
    assert sum(p.length for p in pieces) == sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((p.doc_id, p.doc_tokens) for p in whole if p.start == 0) == sorted((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0)


def test_odd_documents(spark, odd_docs, sf, tmp_path):
    labels = spark.createDataFrame([(1, 0), (11, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == odd_docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() > 0


@pytest.mark.parametrize("module", ["mixing", "neardups", "packing", "toxicity"])
def test_no_import_guards(module):
    import importlib
    import inspect

    assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", inspect.getsource(importlib.import_module(f"tarnloom.llm.{module}")))


def test_toxicity_stage_uses_the_thresholds_by_language(spark, sf, docs, monkeypatch):
    net = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    langs = sorted({r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"]})
    net.thresholds = {langs[0]: 0.0, langs[1]: 1.1}
    monkeypatch.setattr(toxicity, "train", lambda *_: net)
    kept = corpus_pipeline.toxicity_stage(spark, docs, sf).collect()
    assert not any(r.lang == langs[0] for r in kept)
    assert sum(r.lang == langs[1] for r in kept) == docs.where(docs.lang == langs[1]).count()


def test_empty_tables(spark, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, no_docs, str(tmp_path))
        assert out.columns == no_docs.columns and out.collect() == [], name
