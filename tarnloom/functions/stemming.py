"""Porter's 1980 algorithm for English suffixes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

# The algorithm's suffix tables, longest match first within a step.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowel(word: str, k: int) -> bool:
    return word[k] in "aeiou" or word[k] == "y" and k > 0 and not _vowel(word, k - 1)


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = [_vowel(stem, k) for k in range(len(stem))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, k) for k in range(len(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1)


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    n = len(word)
    return n >= 3 and not _vowel(word, n - 3) and _vowel(word, n - 2) and not _vowel(word, n - 1) and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    """Words of under three or over sixty-four bytes stay."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP_2, 0), STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    if _measure(word) > 1 and _doubled(word) and word.endswith("l"):
        word = word[:-1]
    return word


_known: dict[str, str] = {}
#: Words whose stems a process keeps.
KEPT = 1 << 18


def stem_all(words: list[str]) -> list[str]:
    out = []
    for word in words:
        if (found := _known.get(word)) is None:
            if len(_known) >= KEPT:
                _known.clear()
            found = _known[word] = stem(word)
        out.append(found)
    return out


def stems(words: Column) -> Column:
    """The stems of an array of words. A word is stemmed once a process, and no row moves for it."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else stem_all(x) for x in lists.to_pylist()], pa.list_(pa.string()))

    return run(words)
