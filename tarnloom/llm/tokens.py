"""Subword ids of a published byte-level BPE vocabulary."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others count up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """An encoder with the ids that tokenizers gives for the file at path without added special tokens.

    A special token's own string in a text is that token, as there. tiktoken runs the same merges several times
    faster; tests hold both against each other."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def leads(path: str) -> np.ndarray:
    """By id, whether its bytes begin with a space."""
    enc, out = encoder(path), np.zeros(encoder(path).n_vocab, bool)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = token[:1] == b" "
    return out


def ids_of(path: str, text: str) -> np.ndarray:
    """uint32 ids of one text."""
    return np.asarray(encoder(path).encode_to_numpy(text, allowed_special="all"), np.uint32)
