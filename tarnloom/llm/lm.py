"""LM scoring: a causal self-attention model over subword ids, in numpy.

A word enters the model as the sum of the embeddings of its byte-BPE ids, over the root of their number. At each word, attention over the words before it
(windows of WINDOW words that overlap by WINDOW - STRIDE; each word is scored once, in the window where it has the most
context) weighs EXPERTS distributions over all words of the training corpus and the end. An expert's distribution comes
from counts over all training documents, each counted for the expert that fits it best; absolute discounting takes from
every word what goes to words that training has not seen. These are spelled: the first two bytes by the experts, each
further byte by the bytes before it, with interpolated counts over the corpus's uncommon words.

The HEAD most frequent words are broadcast, all others come by a join of the documents' other words with the table of
counts; both have the same formula, so HEAD moves work and no score.

Everything is learned from all training documents, in tasks. Experts start from CELLS sums of word counts, to which each
document adds its own by the signs of hashed projections; EM splits the cells, and a round over all documents sets the
experts by which they are counted. The gate (embeddings, attention, output) goes over every window of every training
document: tasks learn side by side from one gate, what they make of it is averaged, an embedding over the tasks that
change it, and goes out again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import common, tokens

#: Words that are broadcast, at most; the others are joined.
HEAD = 1 << 17
EXPERTS, DIM, HEADS = 8, 32, 2
WINDOW, STRIDE = 64, 48
#: Documents that sampled() gives, whole; nothing is learned from them.
SAMPLE = 2500
#: Common words choose a document's expert: those with so many occurrences that also make up this share of all words. The
#: others tell how unseen words are spelled.
UNCOMMON, COMMON = 10, 1e-5
#: Rounds over all documents that set the experts after their start; words that a task assigns at once, and how far the
#: experts then move.
ROUNDS, STEP, RATE = 1, 40_000, 0.1
#: Bits of a document's cell.
CELL_BITS = 6
CELLS = 1 << CELL_BITS
#: Windows that the gate learns from, repeats included: corpora of fewer are gone over again, PASSES times at most. In one
#: pass, documents come in parts that end at these shares of the last number. Learning rates of the passes or parts.
LEAST_WINDOWS, PASSES, PARTS = 140_000, 3, (1, 3, 6, 10)
RATES = (0.01, 0.01, 0.005, 0.003)
#: Pieces whose embeddings travel in one row.
_CHUNK = 32
#: Counts of the whole corpus's distribution that each expert's starts from.
SMOOTH, SMOOTH_FIRST = 1000.0, 300.0
#: Bits of the hash of the four bytes before a byte; with two bytes they are taken as they are.
CONTEXT_BITS = 18
#: Words, with repeats between slices, that a task holds before it merges them.
MERGE_WORDS = 2_000_000
_SLICE = 2 << 20
#: Of a number of eight bytes, the last 1, 2, ... 5.
_LAST = np.array([(1 << 8 * k) - 1 for k in range(1, 6)], np.uint64)
_END, _STOP = np.uint64(1), 1
_WORD, _FAR, _NEAR, _FIRST = range(4)  # kinds of what is counted
_DEAD = 1e-30
#: Pieces that are added for all words at once.
_EACH = 16
#: Words that are encoded at once.
_JOINED = 512
#: Windows that are computed at once, so that what they make stays in the processor's cache.
_SIDE = 32
#: Columns of what each head's values add, of a projected word: behind queries and keys, before the residual.
_VALUES = [slice(2 * DIM + h * EXPERTS, 2 * DIM + (h + 1) * EXPERTS) for h in range(HEADS)]


def training(docs: DataFrame) -> DataFrame:
    return docs.where(common.crc_mod("doc_id", 10) != 0)


class Lookup:
    """The place of each of many 64-bit hashes, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - 3 - bits), (1 << bits) - 1
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            free = np.flatnonzero(self.places[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            self.places[slots], self.keys[slots] = left[free[first]], keys[left[free[first]]]
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, -1 for keys that are not there."""
        at = self._start(keys)
        out = self.places[at]
        astray = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(astray):
            at[astray] = (at[astray] + 1) & self.mask
            out[astray] = self.places[at[astray]]
            astray = astray[(out[astray] >= 0) & (self.keys[at[astray]] != keys[astray])]
        return out


class Text:
    """Texts as words, by 61-bit hashes, and their folded bytes."""

    def __init__(self, texts: pa.Array):
        data, offsets = common.text_buffers(texts)
        self.words = common.Words(data, offsets)
        self.data = data | (data - np.uint8(65) < 26).view(np.uint8) << 5  # A-Z folded
        self.ids = self.words.hash >> np.uint64(3)
        self.counts = self.words.counts()

    def spelled(self, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
        """The subword ids of words, one after the other, and how many each has. Words are encoded _JOINED at once, as no id
        crosses a space; those with white space of their own one by one."""
        enc, leads = tokens.encoder(path), tokens.leads(path)
        start, size = self.words.start[at], (self.words.end - self.words.start)[at]
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(at), _JOINED):
            n = size[k : k + _JOINED] + 1  # with the space before
            edges = np.cumsum(n)
            joined = self.data.take(np.repeat(start[k : k + _JOINED] - 1 - (edges - n), n) + np.arange(edges[-1]), mode="clip")
            joined[edges - n] = 32
            text = joined.tobytes().decode("utf-8", "replace")
            found = enc.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
            begin = np.flatnonzero(leads[found])
            if len(begin) != len(n) or len(text.split()) != len(n):
                each = [enc.encode_ordinary(joined[j - m : j].tobytes().decode("utf-8", "replace")) for j, m in zip(edges.tolist(), n.tolist(), strict=True)]
                found, begin = np.array([i for x in each for i in x], np.int64), np.cumsum([0, *(len(x) for x in each[:-1])])
            ids.append(found)
            sizes.append(np.diff(begin, append=len(found)))
        return np.concatenate(ids), np.concatenate(sizes)

    def first_bytes(self, at: np.ndarray) -> np.ndarray:
        """The first two bytes of words; a stop stands behind a word's last."""
        start = self.words.start[at]
        second = np.where(self.words.end[at] > start + 1, self.data.take(start + 1, mode="clip"), _STOP) if len(at) else np.zeros(0, np.uint8)
        return self.data[start].astype(np.int64) << 8 | second

    def bytes_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words: the first two bytes; then for each further byte, the stop included, the word, by its place in `at`, and
        a number of 40 bits: the four bytes before it, and it."""
        start, size = self.words.start[at], (self.words.end - self.words.start)[at]
        n = np.maximum(size - 1, 0)
        word = np.repeat(np.arange(len(at)), n)
        i = 2 + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        padded = np.concatenate([np.zeros(7, np.uint8), self.data, np.zeros(1, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(self.data) + 1,), (1,), writeable=False)  # by the place of the last
        gram = eight[start[word] + i].astype(np.uint64) & _LAST[np.minimum(i, 4)]
        stop = i == size[word]
        gram[stop] = gram[stop] & ~np.uint64(255) | np.uint64(_STOP)
        return self.first_bytes(at), word, gram


def _far(gram: np.ndarray) -> np.ndarray:
    return common.mix64((gram >> np.uint64(8)) + np.uint64(1)) >> np.uint64(64 - CONTEXT_BITS) << np.uint64(8) | gram & np.uint64(255)


def _near(gram: np.ndarray) -> np.ndarray:
    return gram & np.uint64(0xFFFFFF)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, inverse = np.unique(keys, return_inverse=True)
    return own, np.bincount(inverse, n, len(own))


class Speller:
    """What byte comes after up to four: counts interpolated from no byte to one, two and (hashed) four before it, each
    giving way to the shorter context by as many chances as it has kinds of followers."""

    def __init__(self, far: tuple[np.ndarray, np.ndarray], near: tuple[np.ndarray, np.ndarray]):
        one, none = _summed(near[0] & np.uint64(0xFFFF), near[1]), _summed(near[0] & np.uint64(0xFF), near[1])
        self.levels = []
        for keys, n in (none, one, near, far):
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            contexts, first, kinds = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
            after = np.add.reduceat(n, first) if len(n) else n
            self.levels.append((keys, n, contexts, after, kinds.astype(float)))

    def chance(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the last byte's chance, by 40-bit numbers."""
        own, inverse = np.unique(gram, return_inverse=True)
        p = np.full(len(own), 1 / 257)
        for (keys, n, contexts, after, kinds), key in zip(self.levels, (own & np.uint64(0xFF), own & np.uint64(0xFFFF), _near(own), _far(own)), strict=True):
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(contexts, key >> np.uint64(8)), len(contexts) - 1)
            seen = contexts[at] == key >> np.uint64(8)
            at, key = at[seen], key[seen]
            own_at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            p[seen] = (np.where(keys[own_at] == key, n[own_at], 0.0) + kinds[at] * p[seen]) / (after[at] + kinds[at])
        return np.log10(p)[inverse]


def best_experts(values: np.ndarray, counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The likeliest expert of each text, from its words' log probabilities (words, EXPERTS)."""
    full = np.flatnonzero(counts)
    total = np.tile(prior, (len(counts), 1))
    if len(full):
        total[full] += np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return total.argmax(1)


def count(docs: DataFrame, known: Lookup, logs: np.ndarray, prior: np.ndarray) -> DataFrame:
    """(kind, key, n, shares) over docs: words with the share of each expert in 255ths, a byte each, and of uncommon
    words first two bytes, and bytes after two and after four others. known: the common words, with their log
    probabilities by expert."""
    shared = docs.sparkSession.sparkContext.broadcast((known, np.vstack([logs, np.zeros((1, EXPERTS), logs.dtype)]), prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, prior = shared.value
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], [], []]

        def put(kind: int, keys: np.ndarray) -> None:
            found[kind].append(np.unique(keys, return_counts=True))

        def merged() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(found):
                if parts:
                    keys, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(common.signed(keys)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])
                    parts.clear()

        for batch in batches:
            for piece in common.slices(batch, "text", _SLICE):
                t = Text(piece.column("text"))
                place = known.find(t.ids)
                expert = best_experts(logs[place], t.counts, prior).astype(np.uint64)
                own = expert[t.words.doc]
                put(_WORD, t.ids << np.uint64(3) | own)
                put(_WORD, _END << np.uint64(3) | expert)
                odd = np.flatnonzero(place < 0)
                first, _, gram = t.bytes_of(odd)
                put(_FIRST, first.astype(np.uint64) << np.uint64(3) | own[odd])
                gram, n = np.unique(gram, return_counts=True)
                for kind, key in ((_FAR, _far(gram)), (_NEAR, _near(gram))):
                    found[kind].append(_summed(key << np.uint64(3), n))
                if sum(len(k) for k, _ in found[_WORD]) > MERGE_WORDS:
                    yield from merged()
        yield from merged()

    rows = docs.select(common.null_as_empty("text").alias("text")).mapInArrow(run, "kind int, key long, n long")
    by = [F.sum(F.when(F.col("key").bitwiseAND(7) == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(EXPERTS)]
    rows = rows.groupBy("kind", F.shiftrightunsigned("key", 3).alias("word")).agg(F.sum("n").alias("n"), *by)
    shares = [F.shiftleft(F.round(F.col(f"n{k}") * 255 / F.col("n")).cast("long"), 8 * k) for k in range(EXPERTS)]
    packed = shares[0]
    for x in shares[1:]:
        packed = packed.bitwiseOR(x)
    return rows.select("kind", F.col("word").alias("key"), "n", packed.alias("shares"))


def _byte(column: Column, k: int) -> Column:
    return F.shiftrightunsigned(column, 8 * k).bitwiseAND(255)


def unpack(shares: np.ndarray) -> np.ndarray:
    """(rows, EXPERTS) shares of the packed ones."""
    return np.ascontiguousarray(shares, "<i8").view(np.uint8).reshape(-1, EXPERTS) / 255


def _over_experts(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays; a product is faster than sum() for so few."""
    return (x.reshape(-1, EXPERTS) @ np.ones((EXPERTS, 1), x.dtype)).reshape(*x.shape[:-1], 1)


class Gate:
    """Causal attention of several heads with a residual; its output weighs the experts."""

    def __init__(self, pieces: int, prior: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        w = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
        self.p = {
            "emb": rng.normal(0, 0.2, (pieces, DIM)).astype(np.float32), "pos": rng.normal(0, 0.1, (WINDOW, DIM)).astype(np.float32),
            "q": w(DIM, DIM), "k": w(DIM, DIM), "v": w(DIM, DIM), "o": w(DIM, DIM), "u": w(DIM, EXPERTS) * np.float32(0.1), "b": prior.astype(np.float32),
        }
        self.past = np.tri(WINDOW, dtype=np.float32)

    def folded(self) -> np.ndarray:
        """Queries, keys, what each head's values add to the output, and the residual's, by one product."""
        p, size = self.p, DIM // HEADS
        heads = [p["v"][:, h : h + size] @ (p["o"][h : h + size] @ p["u"]) for h in range(0, DIM, size)]
        return np.concatenate([p["q"] * size**-0.5, p["k"], *heads, p["u"]], axis=1).astype(p["q"].dtype, copy=False)

    def places(self, folded: np.ndarray) -> np.ndarray:
        """What its place in the window adds to a projected word."""
        out = self.p["pos"] @ folded
        out[:, -EXPERTS:] += self.p["b"]
        return out

    def forward(self, x: np.ndarray, folded: np.ndarray | None = None, skip: int = 0):
        """x: (windows, WINDOW, DIM) vectors of what was read; (windows, WINDOW - skip, EXPERTS) weights of all words but the
        first `skip`, which are only looked back at, and what backward needs."""
        w = self.folded() if folded is None else folded
        x = x + self.p["pos"]
        m = (x.reshape(-1, DIM) @ w).reshape(*x.shape[:2], -1)
        m[:, :, -EXPERTS:] += self.p["b"]
        z, heads = self.weigh(m, skip)
        return z, (x, w, heads)

    def weigh(self, m: np.ndarray, skip: int = 0):
        """forward() from projected words."""
        size, (n, length) = DIM // HEADS, m.shape[:2]
        z, ones, heads = m[:, skip:, -EXPERTS:].copy(), np.ones((length, 1), m.dtype), []
        for h in range(HEADS):
            q, k, v = m[:, skip:, h * size : (h + 1) * size], m[:, :, DIM + h * size : DIM + (h + 1) * size], m[:, :, _VALUES[h]]
            e = q @ k.transpose(0, 2, 1)
            np.exp(np.clip(e, -40, 40, out=e), out=e)  # a word sees itself, so no sum is empty
            e *= self.past[skip:length, :length]
            total = (e.reshape(-1, length) @ ones).reshape(n, -1, 1)
            c = e @ v
            c /= total
            z += c
            heads.append((q, k, v, e, total, c))
        np.exp(np.clip(z, -30, 30, out=z), out=z)
        z /= _over_experts(z)
        return z, heads

    def gradients(self, vectors: np.ndarray, given: np.ndarray, counted: np.ndarray, n: float | None = None, folded: np.ndarray | None = None) -> tuple[float, dict, np.ndarray]:
        """Mean log likelihood, its gradients by the parameters and by the vectors read; given: what each expert gives
        the word that comes, counted: whether it counts. n: what the sums are divided by, if these are not all words."""
        p, size = self.p, DIM // HEADS
        z, (x, w, heads) = self.forward(vectors, folded)
        mix = z * given
        total = np.maximum(_over_experts(mix), _DEAD)
        n = max(counted.sum(), 1) if n is None else n
        dz = (mix / total - z) * (counted / n)[:, :, None]
        dm = np.empty((*x.shape[:2], w.shape[1]), x.dtype)
        dm[:, :, -EXPERTS:] = dz
        for h, (q, k, v, e, sums, c) in enumerate(heads):
            by = dz / sums
            ds = by @ v.transpose(0, 2, 1)
            ds -= _over_experts(by * c)
            ds *= e
            np.matmul(ds, k, out=dm[:, :, h * size : (h + 1) * size])
            np.matmul(ds.transpose(0, 2, 1), q, out=dm[:, :, DIM + h * size : DIM + (h + 1) * size])
            np.matmul(e.transpose(0, 2, 1), by, out=dm[:, :, _VALUES[h]])
        flat = dm.reshape(-1, w.shape[1])
        dw, dx = x.reshape(-1, DIM).T @ flat, (flat @ w.T).reshape(x.shape)
        g = {"q": dw[:, :DIM] * size**-0.5, "k": dw[:, DIM : 2 * DIM], "u": dw[:, -EXPERTS:].copy(), "b": dz.sum((0, 1)), "pos": dx.sum(0), "v": np.empty_like(p["v"]), "o": np.empty_like(p["o"])}
        for h, at in enumerate(_VALUES):
            own, by = slice(h * size, (h + 1) * size), dw[:, at]
            g["v"][:, own] = by @ (p["o"][own] @ p["u"]).T
            g["o"][own] = p["v"][:, own].T @ by @ p["u"].T
            g["u"] += (p["v"][:, own] @ p["o"][own]).T @ by
        return float((np.log(total[:, :, 0]) * counted).sum() / n), g, dx

    def update(self, g: dict, pieces: np.ndarray, grad: np.ndarray, state: dict, rate: float) -> None:
        """A step up: Adam, and AdaGrad for the embeddings of the given pieces."""
        state["t"] = t = state.get("t", 0) + 1
        for name, value in g.items():
            m, s = state.setdefault(name, [np.zeros_like(self.p[name]), np.zeros_like(self.p[name])])
            m += 0.1 * (value - m)
            s += 0.01 * (value * value - s)
            self.p[name] += rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        squares = state.setdefault("emb", np.full((len(self.p["emb"]), 1), 1e-8, np.float32))
        squares[pieces] += (grad * grad).mean(1, keepdims=True)
        self.p["emb"][pieces] += rate * 5 * grad / np.sqrt(squares[pieces])


def windows(starts: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts that lie between starts: (first word of the window, its text's end, first word that it scores)."""
    sizes = np.diff(starts)
    n = 1 + np.maximum(0, -(-(sizes - WINDOW) // stride))
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = starts[:-1][text] + k * stride
    return begin, starts[1:][text], np.where(k == 0, begin, begin + WINDOW - stride)


def sequences(words: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with the end behind each text, where texts start and the last ends, what has been read before each: the
    end before a text's first word)."""
    n = len(counts)
    out = np.full(len(words) + n, end, np.int64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), counts)] = words
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[starts[:-1]] = end
    return out, starts, before


def _sum_by(groups: np.ndarray, values: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct groups, sums of their rows of float32, which are added in pairs, as complex numbers, at half the cost);
    groups are numbers below 2**16 (which sort faster) or any others; rows: those of values, if not one for each group."""
    order = np.argsort(groups.astype(np.uint16) if len(groups) and groups.max() < 1 << 16 else groups, kind="stable")
    groups = groups[order]
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])[: len(groups)])
    return groups[first], np.add.reduceat(values.take(order if rows is None else rows[order], axis=0).view(np.complex64), first, axis=0).view(np.float32)


def _of_pieces(emb: np.ndarray, flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the embeddings of each word's ids, flat[first : first + n]; the longest words come first."""
    out = emb.take(flat[first], axis=0)
    if len(n):
        for k in range(1, min(int(n[0]), _EACH)):
            m = int(np.searchsorted(-n, -k))
            out[:m] += emb.take(flat[first[:m] + k], axis=0)
        for j in range(int(np.searchsorted(-n, -_EACH))):  # the rest of long words
            out[j] += emb[flat[first[j] + _EACH : first[j] + n[j]]].sum(0)
    return out


def learn(gate: Gate, state: dict, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, words: np.ndarray, before: np.ndarray, starts: np.ndarray, given: np.ndarray, rng: np.random.Generator, rate: float, batch: int = 128) -> np.ndarray:
    """Goes over all words of the texts between starts, in windows side by side; before: what is read, by the words whose subword ids
    are flat[first : first + sizes]; words: the rows of given, what each expert gives the word that comes. Gives how
    often each piece's embedding has changed."""
    used = np.zeros(len(gate.p["emb"]), np.int64)
    begin, stop, _ = windows(starts, WINDOW)
    row = np.zeros(len(sizes), np.int64)  # of a word among the batch's
    for part in np.array_split(rng.permutation(len(begin)), max(1, len(begin) // batch)):
        at = begin[part][:, None] + np.arange(WINDOW)
        inside = at < stop[part][:, None]
        at = np.where(inside, at, begin[part][:, None])  # what fills a window up is a word of its own, and changes nothing
        read = before[at]
        row[read] = 1
        own = np.flatnonzero(row)
        own = own[np.argsort(-sizes[own], kind="stable")]  # so that words with a k-th piece come first
        row[own] = np.arange(len(own))
        inverse = row[read]
        row[own] = 0
        n = sizes[own]
        piece_of = np.repeat(np.arange(len(own)), n)
        ids = flat[(first[own] - (np.cumsum(n) - n))[piece_of] + np.arange(len(piece_of))]
        scale = n.astype(np.float32)[:, None] ** -0.5
        vectors = _of_pieces(gate.p["emb"], flat, first[own], n)
        vectors *= scale
        g, dx, come, counted, total = {}, np.empty((*at.shape, DIM), np.float32), words[at], inside.astype(np.float32), max(float(inside.sum()), 1.0)
        folded = gate.folded()
        for a in range(0, len(at), _SIDE):
            some = slice(a, a + _SIDE)
            _, more, dx[some] = gate.gradients(vectors.take(inverse[some], axis=0), given.take(come[some], axis=0), counted[some], total, folded)
            g = {k: g[k] + x if g else x for k, x in more.items()}
        real = np.flatnonzero(inside)
        _, by_word = _sum_by(inverse.ravel()[real], dx.reshape(-1, DIM), real)
        pieces, grad = _sum_by(ids, by_word * scale, piece_of)
        gate.update(g, pieces, grad, state, rate)
        used[pieces] += 1
    return used


_SPELLED: dict[tuple, Spelled] = {}


class Spelled:
    """Subword ids of words; those of head words are kept."""

    def __init__(self, head: int, pieces: int, path: str):
        self.path, self.end = path, pieces - 1
        self.flat, self.first, self.sizes = np.zeros(0, np.int64), np.zeros(head, np.int64), np.zeros(head, np.int64)

    @classmethod
    def kept(cls, model: Model) -> Spelled:
        """What this process has spelled of the model's head, in all its tasks and turns."""
        key = (model.tokenizer_path, hashlib.sha1(model.head.keys).digest(), hashlib.sha1(model.head.places).digest())
        if key not in _SPELLED:
            _SPELLED.clear()
            _SPELLED[key] = cls(len(model.table), len(model.gate.p["emb"]), model.tokenizer_path)
        return _SPELLED[key]

    def of(self, t: Text, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, numbers) of words, by where they are and their places in the head, and of the end behind them."""
        new = np.flatnonzero(place >= 0)
        new = new[self.sizes[place[new]] == 0]
        odd = np.flatnonzero(place < 0)
        ids, n = t.spelled(at[np.concatenate([new, odd])], self.path)
        begin, a = np.cumsum(n) - n, len(new)
        kept = int(n[:a].sum())
        self.first[place[new]], self.sizes[place[new]] = len(self.flat) + begin[:a], n[:a]
        self.flat = np.concatenate([self.flat, ids[:kept]])
        first, sizes = np.empty(len(at) + 1, np.int64), np.empty(len(at) + 1, np.int64)
        first[:-1], sizes[:-1] = self.first[place], self.sizes[place]
        first[odd], sizes[odd] = len(self.flat) + begin[a:] - kept, n[a:]
        first[-1], sizes[-1] = len(self.flat) + len(ids) - kept, 1
        return np.concatenate([self.flat, ids[kept:], [self.end]]), first, sizes


@dataclass
class Model:
    tokenizer_path: str
    head: Lookup
    table: np.ndarray  # (head words, EXPERTS)
    bases: np.ndarray  # by head word: log10 of its count and 0.1
    first: np.ndarray  # (2**16, EXPERTS): that a word is unseen and begins with two bytes
    speller: Speller | None  # not needed to learn
    gate: Gate

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_vectors"}

    def distinct(self, t: Text, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct words of texts, those of the head first, in its order: where each is, its place in the head or
        -1; and the number of each word among them."""
        known, odd = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        there = np.full(len(self.table), -1)
        there[place[known]] = known
        heads = np.flatnonzero(there >= 0)
        at = there[heads]
        there[heads] = np.arange(len(heads))
        own, first, inverse = np.unique(t.ids[odd], return_index=True, return_inverse=True)
        numbers = np.empty(len(place), np.int64)
        numbers[known], numbers[odd] = there[place[known]], len(heads) + inverse
        return np.concatenate([at, odd[first]]), np.concatenate([heads, np.full(len(own), -1)]), numbers

    def vectors(self, t: Text, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of the texts' distinct words and, last, of the end; the row of each word among them); a process
        spells head words once."""
        emb = self.gate.p["emb"]
        if "_vectors" not in self.__dict__:
            self._vectors = np.zeros((len(self.table), DIM), np.float32), np.zeros(len(self.table), bool)
        kept, made = self._vectors
        at, heads, words = self.distinct(t, place)
        a = int(np.searchsorted(heads < 0, True))
        heads = heads[:a]
        new = heads[~made[heads]]
        ids, n = t.spelled(np.concatenate([at[:a][~made[heads]], at[a:]]), self.tokenizer_path)
        first, order = np.cumsum(n) - n, np.argsort(-n, kind="stable")
        rows, n = np.empty((len(n), DIM), np.float32), n[order]
        rows[order] = _of_pieces(emb, ids, first[order], n) * n.astype(np.float32)[:, None] ** -0.5
        kept[new], made[new] = rows[: len(new)], True
        return np.concatenate([kept.take(heads, axis=0), rows[len(new) :], emb[-1:]]), words

    def lesson(self, t: Text, spelled: Spelled) -> tuple[np.ndarray, ...]:
        """Of texts what learn() wants: subword ids with their starts and numbers by word, the words that come, what has
        been read before each, where texts start, and what each expert gives a word. Words that are not broadcast count as
        unseen ones here."""
        at, place, numbers = self.distinct(t, self.head.find(t.ids))
        end = self.head.find(np.array([_END], np.uint64))[0]
        flat, first, sizes = spelled.of(t, at, place)
        given = np.empty((len(at) + 1, EXPERTS), np.float32)
        given[:-1][place >= 0], given[:-1][place < 0] = self.table[place[place >= 0]], self.first[t.first_bytes(at[place < 0])]
        given[-1] = self.table[end] if end >= 0 else self.first[_STOP << 8]
        words, starts, before = sequences(numbers, t.counts, len(at))
        return flat, first, sizes, words, before, starts, given

    def score(self, t: Text, held_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text log10 of the probability of its head words, and of the others: hash, text, weights of the
        experts in 255ths, and in texts that are held out log10 of the probability that an unseen word comes and is spelled
        like that (elsewhere 0: training has seen all their words)."""
        place = self.head.find(t.ids)
        rows, words = self.vectors(t, place)
        _, starts, before = sequences(words, t.counts, len(rows) - 1)
        come, _, _ = sequences(place.astype(np.int64), t.counts, int(self.head.find(np.array([_END], np.uint64))[0]))
        odd_at = np.flatnonzero(come < 0)
        value, z_odd, folded = np.zeros(len(come)), np.zeros((len(odd_at), EXPERTS), np.float32), self.gate.folded()
        rows, places = rows @ folded, self.gate.places(folded)  # once for each distinct word
        table = self.table if len(self.table) else np.ones((1, EXPERTS), np.float32)
        begin, stop, own = windows(starts)
        steps = np.arange(WINDOW)
        for skip in (0, WINDOW - STRIDE):  # a text's first window scores all its words, a later one what the one before has not
            mine = np.flatnonzero(own - begin == skip)
            for a in range(0, len(mine), _SIDE):
                some = mine[a : a + _SIDE]
                at = begin[some, None] + steps
                m = rows.take(before[np.minimum(at, len(before) - 1)], axis=0)
                m += places
                z, _ = self.gate.weigh(m, skip)
                scored = at[:, skip:] < stop[some, None]
                z, at = z[scored], at[:, skip:][scored]
                what = come[at]
                odd = np.flatnonzero(what < 0)
                p = _over_experts(table.take(what, axis=0) * z)[:, 0]
                p[odd] = 1  # these are weighed below
                value[at] = np.log10(np.maximum(p, _DEAD))
                z_odd[np.searchsorted(odd_at, at[odd])] = z[odd]
        text = np.repeat(np.arange(len(t.counts)), t.counts + 1)[odd_at]
        odd = odd_at - text  # among the words, as one end stands behind each text before
        end = odd_at == starts[1:][text] - 1
        hashes, spelling = np.full(len(odd_at), _END), np.zeros(len(odd_at))
        hashes[~end] = t.ids[odd[~end]]
        new = held_out[text]
        first, at = np.full(len(odd_at), _STOP << 8), np.flatnonzero(new & ~end)
        kinds, which, inverse = np.unique(hashes[at], return_index=True, return_inverse=True)
        pair, word, gram = t.bytes_of(odd[at[which]])
        further = np.bincount(word, self.speller.chance(gram), len(kinds))
        first[at], spelling[at] = pair[inverse], further[inverse]
        spelling[new] += np.log10(np.maximum(np.einsum("ne,ne->n", z_odd[new], self.first[first[new]]), _DEAD))
        weights = np.round(z_odd * 255).astype(np.uint8).view("<i8").ravel() if len(z_odd) else np.zeros(0, np.int64)
        return np.add.reduceat(value, starts[:-1]), hashes, text, weights, spelling


def sampled(docs: DataFrame) -> pa.Array:
    """The texts of the SAMPLE training documents with the smallest hashes of their ids (of those with one id, all that
    fit, by their texts' hashes), to look at; no model, count or threshold comes from them."""
    rows = training(docs).select(F.col("doc_id").cast("long").alias("_id"), common.null_as_empty("text").alias("text"))
    order = [F.crc32(F.concat(F.lit("lm:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))), F.col("_id")]
    chosen = F.broadcast(rows.select("_id").distinct().orderBy(*order).limit(SAMPLE).withColumnRenamed("_id", "_chosen"))  # at most SAMPLE numbers
    rows = rows.join(chosen, F.col("_id").eqNullSafe(F.col("_chosen"))).orderBy(*order, F.xxhash64("text"), "text").limit(SAMPLE)
    return rows.select("text").toArrow().column("text").combine_chunks()


def cells_of(t: Text) -> np.ndarray:
    """The cell of each text: the signs of its words' sums of hashed signs."""
    signs = 1 - 2 * (np.arange(CELLS)[:, None] >> np.arange(CELL_BITS) & 1)  # by a word's last bits
    last = (common.mix64(t.ids) & np.uint64(CELLS - 1)).astype(np.int64)
    sums = np.bincount(t.words.doc * CELLS + last, minlength=len(t.counts) * CELLS).reshape(-1, CELLS) @ signs
    return ((sums > 0) << np.arange(CELL_BITS)).sum(1)


def cells(docs: DataFrame) -> DataFrame:
    """(key, n, c0, c1, ...): of words their number, in all and by the cell of their texts, and for the end the number of
    words of any kind, and that of texts by cell. A run of at least MERGE_WORDS words, or all of a task, passes on what makes
    up COMMON of it, so that each word that makes up COMMON of the corpus is passed on by some run."""
    names = [f"c{k}" for k in range(CELLS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their cells, the texts by cell

        def counted(runs: int) -> pa.RecordBatch:
            ids, cell = (np.concatenate(x) for x in list(zip(*held[:runs], strict=True))[:2])
            own, n = np.unique(ids, return_counts=True)
            often = n >= COMMON * len(ids)
            own, n = own[often], n[often]
            place = Lookup(own).find(ids)
            mine = np.flatnonzero(place >= 0)
            by = np.bincount(place[mine].astype(np.int64) * CELLS + cell[mine], minlength=len(own) * CELLS).reshape(-1, CELLS)
            by = np.vstack([by, sum(x for _, _, x in held[:runs])])
            key, n = np.append(own, _END), np.append(n, len(ids))
            del held[:runs]
            return pa.RecordBatch.from_arrays([pa.array(common.signed(key)), pa.array(n), *(pa.array(np.ascontiguousarray(c)) for c in by.T)], names=["key", "n", *names])

        for batch in batches:
            for piece in common.slices(batch, "text", _SLICE):
                t = Text(piece.column("text"))
                cell = cells_of(t)
                held.append((t.ids, cell[t.words.doc].astype(np.uint8), np.bincount(cell, minlength=CELLS)))
                sizes = np.cumsum([len(x) for x, _, _ in held])
                if sizes[-1] >= 2 * MERGE_WORDS:
                    yield counted(int(np.searchsorted(sizes, MERGE_WORDS)) + 1)
        if held:
            yield counted(len(held))

    rows = docs.select(common.null_as_empty("text").alias("text")).mapInArrow(run, "key long, n long, " + ", ".join(f"{c} long" for c in names))
    return rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def _logs(found: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Log probabilities (words, EXPERTS) from the words' numbers by expert."""
    share = found.sum(1, keepdims=True) + 0.01
    return np.log(((found + smooth * share / max(share.sum(), 1)) / (found.sum(0) + smooth)).astype(np.float32))


def _prior(texts: np.ndarray) -> np.ndarray:
    return np.log((texts + 1) / (texts.sum() + EXPERTS))


def split_cells(found: np.ndarray, texts: np.ndarray, starts: int = 12, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """EM for a mixture of unigram experts over the mean texts of cells, from words' numbers (words, CELLS) and texts by
    cell: log probabilities (words, EXPERTS) and log prior, of several random starts the likeliest."""
    means, best = found / np.maximum(texts, 1), (-np.inf, None, None)
    for seed in range(starts):
        r = np.random.default_rng(seed).dirichlet(np.full(EXPERTS, 0.3), CELLS)
        for _ in range(rounds + 1):
            logs, prior = _logs(found @ r), _prior(texts @ r)
            total = means.T @ logs + prior
            top = total.max(1, keepdims=True)
            r = np.exp(total - top)
            fit_ = float(texts @ (top[:, 0] + np.log(r.sum(1))))
            r /= r.sum(1, keepdims=True)
        if fit_ > best[0]:
            best = fit_, logs, prior
    return best[1], best[2]


def assigned(docs: DataFrame, known: Lookup, logs: np.ndarray, prior: np.ndarray) -> DataFrame:
    """(place, n0, n1, ...): the number of each known word by the expert of its text; that of unknown ones and of texts in
    the places behind. Within a task EM goes on: STEP words or so are assigned, then the experts move by RATE towards them.
    Known words without log probabilities choose no expert."""
    shared = docs.sparkSession.sparkContext.broadcast((known, np.vstack([logs, np.zeros((1, EXPERTS), logs.dtype)]), prior))
    names = [f"n{k}" for k in range(EXPERTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, prior = shared.value
        logs, none = logs.copy(), len(logs) - 1
        found, active = np.zeros((none + 2, EXPERTS), np.int64), np.flatnonzero(logs.any(1))
        words, texts = np.exp(logs[active]) * np.exp(prior) * (STEP / RATE), np.zeros(EXPERTS)
        for batch in batches:
            for piece in common.slices(batch, "text", _SLICE):
                t = Text(piece.column("text"))
                place = known.find(t.ids)
                place[place < 0] = none
                edges = np.concatenate([[0], np.cumsum(t.counts)])
                i = 0
                while i < len(t.counts):
                    j = max(i + 1, int(np.searchsorted(edges, edges[i] + STEP, "right")) - 1)
                    own, counts = place[edges[i] : edges[j]], t.counts[i:j]
                    expert = best_experts(logs[own], counts, prior)
                    new = np.bincount(own.astype(np.int64) * EXPERTS + np.repeat(expert, counts), minlength=(none + 1) * EXPERTS).reshape(-1, EXPERTS)
                    texts += np.bincount(expert, minlength=EXPERTS)
                    found[:-1] += new
                    words += new[active] - RATE * words
                    logs[active] = _logs(words)
                    i = j
        found[-1] = texts
        there = np.flatnonzero(found.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(np.ascontiguousarray(c)) for c in found[there].T)], names=["place", *names])

    rows = docs.select(common.null_as_empty("text").alias("text")).mapInArrow(run, "place long, " + ", ".join(f"{c} long" for c in names))
    return rows.groupBy("place").agg(*[F.sum(c).alias(c) for c in names])


def _got(df: DataFrame) -> dict[str, np.ndarray]:
    return {c: x.to_numpy() for c, x in zip(df.columns, df.toArrow().combine_chunks().itercolumns(), strict=True)}


def split(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the common words' hashes, their log probabilities by expert, log prior) from all documents."""
    found = common.stash(cells(docs), "lm-cells", small=True)
    end = found.where(F.col("key") == int(_END)).first()
    if end is None:
        return np.zeros(0, np.uint64), np.zeros((0, EXPERTS), np.float32), _prior(np.zeros(EXPERTS))
    least = max(UNCOMMON, COMMON * end["n"])
    words = found.where(F.col("key") != int(_END))
    start = _got(words.where(F.col("n") >= least).orderBy("key"))  # 1 / COMMON rows at most
    own = np.sort(_got(words.select("key"))["key"].view(np.uint64))
    logs = np.zeros((len(own), EXPERTS), np.float32)
    by_cell = np.stack([start[f"c{k}"] for k in range(CELLS)], axis=1).astype(np.float64)
    logs[np.searchsorted(own, start["key"].view(np.uint64))], prior = split_cells(by_cell, np.array([end[f"c{k}"] for k in range(CELLS)], np.float64))
    for _ in range(ROUNDS):
        got = _got(assigned(docs, Lookup(own), logs, prior))
        by = np.zeros((len(own) + 2, EXPERTS))
        by[got["place"]] = np.stack([got[f"n{k}"] for k in range(EXPERTS)], axis=1)
        often, texts = by[: len(own)].sum(1) >= least, by[-1]
        own, by = own[often], by[: len(own)][often]
        logs, prior = _logs(by), _prior(texts)
    common.discard(found)
    return own, logs, prior


@dataclass
class Corpus:
    """What the counts over all training documents come to."""

    tokens: int
    types: int
    discount: float
    mass: np.ndarray  # by expert, with SMOOTH

    def share(self, n: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """(words, EXPERTS): the chance of seen words by expert, what is kept for unseen ones taken off."""
        return (n - self.discount)[:, None] * (shares + SMOOTH / max(self.tokens, 1)) / self.mass


def _statistics(words: DataFrame) -> tuple[Corpus, np.ndarray]:
    """The corpus, and by expert the chance of an unseen word."""
    part = lambda k: _byte(F.col("shares"), k) / 255
    sums = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"),
        *[F.coalesce(F.sum(F.col("n") * part(k)), F.lit(0.0)).alias(f"n{k}") for k in range(EXPERTS)], *[F.coalesce(F.sum(part(k)), F.lit(0.0)).alias(f"v{k}") for k in range(EXPERTS)],
    ).first()
    discount = min(max(sums["once"] / max(sums["once"] + 2 * sums["twice"], 1), 0.1), 0.95)
    mass, types = (np.array([float(sums[f"{c}{k}"]) for k in range(EXPERTS)]) for c in "nv")
    corpus = Corpus(sums["n"], sums["v"], discount, mass + SMOOTH)
    unseen = discount * (types + SMOOTH * sums["v"] / sums["n"]) / corpus.mass if sums["n"] else np.ones(EXPERTS)
    return corpus, np.minimum(unseen, 1.0)


def _head(words: DataFrame) -> DataFrame:
    """The most frequent words, HEAD at most: those in the steps of a logarithmic scale of counts that have room together."""
    step = F.floor(F.log2("n") * 16)
    sizes = {r["step"]: r["words"] for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}  # 16 rows for each power of two
    least, room = 2**62, HEAD
    for k in sorted(sizes, reverse=True):
        room -= sizes[k]
        if room < 0:
            break
        least = k
    return words.where(step >= least)


def taught(docs: DataFrame, model: Model, squares: np.ndarray, rate: float, turn: int) -> tuple[dict, np.ndarray, np.ndarray] | None:
    """(layers, embeddings, AdaGrad's squares) of the gate after all documents, averaged over tasks: layers by the windows
    that a task has gone over, an embedding by how often it changed there; None without documents."""
    shared = docs.sparkSession.sparkContext.broadcast((model, squares))
    layers, shapes = [k for k in model.gate.p if k != "emb"], {k: x.shape for k, x in model.gate.p.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, squares = shared.value
        task = TaskContext.get().partitionId()
        gate, state, rng = Gate(1, model.gate.p["b"]), {"emb": squares.copy()}, np.random.default_rng([3, turn, task])
        gate.p = {k: x.copy() for k, x in model.gate.p.items()}
        spelled, used, n = Spelled.kept(model), np.zeros(len(squares), np.int64), 0
        for batch in batches:
            for piece in common.slices(batch, "text", _SLICE):
                flat, first, sizes, words, before, starts, given = model.lesson(Text(piece.column("text")), spelled)
                used += learn(gate, state, flat, first, sizes, words, before, starts, given, rng, rate)
                n += len(words)
        if n:
            ids = np.flatnonzero(used)
            rows = np.column_stack([used[ids], state["emb"][ids], gate.p["emb"][ids]]).astype(np.float32)
            cuts = np.unique(ids // _CHUNK, return_index=True)
            parts = [(int(c), i, r) for c, i, r in zip(cuts[0], np.split(ids, cuts[1][1:]), np.split(rows, cuts[1][1:]), strict=True)]
            parts.append((-1, np.array([n]), np.concatenate([gate.p[k].ravel() for k in layers])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _, _ in parts], pa.int32()), pa.array([task] * len(parts), pa.int32()), *(pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in zip(list(zip(*parts, strict=True))[1:], ("<i4", "<f4"), strict=True))],
                names=["chunk", "task", "ids", "rows"],
            )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, ids, rows in zip(batch.column("chunk").to_pylist(), batch.column("ids").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                ids, rows = np.frombuffer(ids, "<i4"), np.frombuffer(rows, "<f4").astype(np.float64)
                if chunk < 0:
                    n = float(ids[0])
                    sums[chunk] = sums.get(chunk, 0.0) + np.append(n, rows * n)
                    continue
                rows = rows.reshape(len(ids), DIM + 2)
                mine = sums.setdefault(chunk, np.zeros((_CHUNK, DIM + 2)))
                mine[ids % _CHUNK, 0] += rows[:, 0]
                mine[ids % _CHUNK, 1:] += rows[:, 1:] * rows[:, :1]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "sums"])

    rows = docs.select(common.null_as_empty("text").alias("text")).mapInArrow(run, "chunk int, task int, ids binary, rows binary")
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "task").select("chunk", "ids", "rows").mapInArrow(merged, "chunk int, sums binary")
    found = {r["chunk"]: np.frombuffer(r["sums"]) for r in rows.collect()}  # a row for each chunk of pieces
    shared.unpersist()
    if not found:
        return None
    flat, at, out = found.pop(-1), 1, {}
    for k in layers:
        size = int(np.prod(shapes[k]))
        out[k] = (flat[at : at + size] / flat[0]).reshape(shapes[k]).astype(np.float32)
        at += size
    emb, squares = model.gate.p["emb"].copy(), squares.copy()
    for chunk, sums in found.items():
        sums = sums.reshape(-1, DIM + 2)
        mine = np.flatnonzero(sums[:, 0])
        mean = sums[mine, 1:] / sums[mine, :1]
        squares[chunk * _CHUNK + mine], emb[chunk * _CHUNK + mine] = mean[:, :1], mean[:, 1:]
    return out, emb, squares


def teach(docs: DataFrame, model: Model, tokens_: int) -> None:
    """Trains the model's gate in place on all words of all documents: in one pass, whose documents come in PARTS, so that
    the tasks go on from one gate; where there are fewer than LEAST_WINDOWS, in up to PASSES passes."""
    passes = min(PASSES, max(1, LEAST_WINDOWS * WINDOW // max(tokens_, 1)))
    place = F.crc32(F.concat(F.lit("gate:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) % PARTS[-1]
    squares = np.full((len(model.gate.p["emb"]), 1), 1e-8, np.float32)
    for turn, part in enumerate([docs] * passes if passes > 1 else [docs.where((place >= a) & (place < b)) for a, b in zip((0, *PARTS), PARTS)]):  # noqa: B905
        made = taught(part, model, squares, RATES[turn], turn)
        if made is not None:
            layers, emb, squares = made
            model.gate.p = model.gate.p | layers | {"emb": emb}


def fit(docs: DataFrame, path: str) -> tuple[Model, Corpus, DataFrame]:
    """The model, and the table of all words' counts."""
    rows = training(docs)
    words, logs, prior = split(rows)
    counts = common.stash(count(rows, Lookup(words), logs, prior), "lm-counts")
    corpus, unseen = _statistics(counts.where(F.col("kind") == _WORD))
    top = _got(_head(counts.where(F.col("kind") == _WORD)).select("key", "n", "shares"))
    head = Lookup(top["key"].view(np.uint64))
    n = top["n"].astype(np.float64)
    table = corpus.share(n, unpack(top["shares"])).astype(np.float32)
    kind = lambda k: _got(counts.where(F.col("kind") == k).select("key", "n", "shares"))  # noqa: E731  at most 2**16, 2**24 and 2**(8 + CONTEXT_BITS) keys
    firsts, first = kind(_FIRST), np.zeros((1 << 16, EXPERTS))
    first[firsts["key"]] = firsts["n"][:, None] * unpack(firsts["shares"])
    share = first.sum(1, keepdims=True) + 0.02
    first = unseen * (first + SMOOTH_FIRST * share / share.sum()) / (first.sum(0) + SMOOTH_FIRST)
    gate = Gate(tokens.encoder(path).n_vocab, prior)
    model = Model(path, head, table, np.log10(n + 0.1), first.astype(np.float32), None, gate)
    teach(rows, model, corpus.tokens)
    model.speller = Speller(*((x["key"].view(np.uint64), x["n"].astype(np.float64)) for x in map(kind, (_FAR, _NEAR))))
    return model, corpus, counts


def score(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null or empty text is its end alone. Documents whose crc32(doc_id as text) mod 10 is not 0 are for training
    (null counts as the empty text); without any, every count is 0 and the model knows spellings only. Whole texts
    are scored, however long; rows repeat as they come; no rows give no rows; columns besides doc_id and text are not
    read. Words are compared by 61-bit hashes."""
    spark = common.bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    model, corpus, counts = fit(docs, tokenizer_path or tokens.default_path())
    shared = spark.sparkContext.broadcast(model)
    scale = float(np.log10(corpus.tokens + 0.1 * (corpus.types + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in common.slices(batch, "text", _SLICE):
                t, n = Text(piece.column("text")), piece.num_rows
                value, hashes, text, weights, spelling = model.score(t, piece.column("held_out").to_numpy(zero_copy_only=False))
                place, end = model.head.find(t.ids), model.head.find(np.array([_END], np.uint64))[0]
                known = place >= 0
                base = np.bincount(t.words.doc[known], model.bases[place[known]], n) + (model.bases[end] if end >= 0 else 0.0)
                edges = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (common.signed(hashes), weights, spelling.astype(np.float32))]
                rows = pa.array(np.arange(at, at + n, dtype=np.int64))
                at += n
                yield pa.RecordBatch.from_arrays(
                    [rows, piece.column("doc_id"), pa.array(t.counts + 1), pa.array(np.bincount(t.words.doc[known], minlength=n) + int(end >= 0)), pa.array(base), pa.array(value), *lists],
                    names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "words", "weights", "spelling"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.null_as_empty("text").alias("text"), (common.crc_mod("doc_id", 10) == 0).alias("held_out"))
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, words array<long>, weights array<long>, spelling array<float>"
    scored = common.stash(rows.mapInArrow(run, schema), "lm-scored")
    odd = scored.select("row", F.explode(F.arrays_zip("words", "weights", "spelling")).alias("_w")).select("row", F.col("_w.words").alias("key"), F.col("_w.weights").alias("weights"), F.col("_w.spelling").cast("double").alias("spelling"))
    found = odd.join(counts.where(F.col("kind") == _WORD).select("key", "n", "shares"), "key", "left")
    # Corpus.share, mixed by the weights
    parts = [(_byte(F.col("weights"), k), _byte(F.col("shares"), k) / 255 + SMOOTH / max(corpus.tokens, 1), float(corpus.mass[k])) for k in range(EXPERTS)]
    mixed = sum((w * s / m for w, s, m in parts[1:]), parts[0][0] * parts[0][1] / parts[0][2]) / sum((w for w, _, _ in parts[1:]), parts[0][0])
    known = F.col("n").isNotNull()
    found = found.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("_base"),
        F.count("n").alias("_known"),
        F.sum(F.when(known, F.log10(F.greatest((F.col("n") - corpus.discount) * mixed, F.lit(_DEAD)))).otherwise(F.col("spelling"))).alias("_odd"),
    )
    return scored.select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(found, "row", "left").select(
        "doc_id",
        (common.crc_mod("doc_id", 10) == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(corpus.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("score") + F.coalesce("_odd", F.lit(0.0))).alias("score"),
    )
