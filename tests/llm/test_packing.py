import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnloom.llm import packing, tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_gives_the_tokenizers_ids(plain, docs):
    texts = [r.text for r in docs.collect()] + ["", " ", "<|endoftext|>", "a<|endoftext|>b", "\U0001f600\u200d é\r\n\t x", "1234567 don't WON'T"]
    for text in texts:
        assert tokens.ids_of(tokens.default_path(), text).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("table", ["docs", "odd_docs"])
def test_every_id_lies_in_one_piece(request, plain, table):
    docs = request.getfixturevalue(table)
    pieces = packing.pack(docs).collect()
    want = sorted(((r.doc_id, ids(plain, r.text)) for r in docs.collect()), key=str)
    by_place = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for p in by_place:
        assert (p.sequence_id, p.offset) == divmod(at, 1024)  # gapless: only the last sequence is not full
        at += p.length
        assert p.ids_crc32 == zlib.crc32(bytes(p.piece_ids)) and len(p.piece_ids) == 4 * p.length
    assert at == sum(len(x) for _, x in want)
    got, held = [], []
    for p in by_place:
        assert p.start == len(held)
        held += np.frombuffer(p.piece_ids, "<u4").tolist()
        if len(held) == p.doc_tokens:
            got.append((p.doc_id, held))
            held = []
    assert not held and sorted(got, key=str) == want


def test_empty_table(no_docs):
    assert packing.pack(no_docs).collect() == []


def test_other_lengths(docs):
    assert packing.pack(docs, length=64).agg(F.max(F.col("offset") + F.col("length"))).first()[0] == 64
