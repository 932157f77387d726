"""Toxicity: a convolutional text classifier trained in numpy.

Words of letters (A-Z folded) get the joined rows of five hashed embedding tables: two by the word, two by its
first bytes and one by its last, so that two words share a whole embedding only if every hash collides, and a word
that training has not seen still has its stem and its ending. Filters of several widths run over the words, each is max-pooled over
the whole text, and a logistic layer turns the maxima into a score. Thresholds by language are calibrated on
training rows that the fit did not see; the score itself knows nothing but the text.

All labelled rows are learned from, in tasks: log odds are counted over all of them, and shards of about SHARD rows are gone
over side by side from one network; what they make of it is averaged, an embedding over the shards that change it, and goes
out again for the next round. Averages are sums of whole numbers, so that the order of tasks does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

TABLES, BUCKETS, PART = 5, 1 << 18, 6
#: Bytes of a short and a long stem, and of an ending.
STEM, LONG_STEM, ENDING = 4, 7, 4
WIDTHS, FILTERS = (1, 2, 3), 8
#: Labelled rows that one task learns from at once, about; words that it holds, at most (a longer text stands alone).
SHARD, SHARD_WORDS = 4500, 6_000_000
#: Rounds of averaging where there are several shards, and how often a shard goes over its rows in each.
ROUNDS, EPOCHS = 2, 2
THRESHOLD = 0.7
#: Steps of the scores that thresholds tell apart.
STEPS = 10_000
#: Texts that know nothing in the log odds that embeddings start with; steps of a fit, at least.
PRIOR, LEAST_STEPS = 5.0, 1200
#: Rows of zeros after each text; windows that begin behind the first of them are no windows.
_GAP = max(WIDTHS)
_SLICE = 1 << 20
#: Where each table begins among the rows of all, and the buckets of a gap.
_FIRST = np.arange(TABLES, dtype=np.int32) * (BUCKETS + 1)
_NONE = np.full((1, TABLES), BUCKETS, np.int32)


def hashed(words: common.Words, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """(words, TABLES) bucket numbers of all words or those at some places."""
    own = words.hash[at]
    out = np.empty((len(own), TABLES), np.int32)
    for t, h in enumerate((own, own >> np.uint64(30), words.affix(STEM, True, at), words.affix(LONG_STEM, True, at), words.affix(ENDING, False, at))):
        out[:, t] = (h & np.uint64(BUCKETS - 1)).astype(np.int32)
    return out


def distinct(words: common.Words, texts: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of words the distinct hashes in order, their bucket numbers, and the number of each word among them."""
    own, numbers = np.unique(words.hash[texts], return_inverse=True)
    at = np.empty(len(own), np.int64)
    at[numbers] = np.arange(len(numbers)) + (texts.start or 0)
    return own, hashed(words, at), numbers


def spread(words: common.Words, values: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of words with _GAP rows of gaps after each text, and where each text starts."""
    counts = words.counts()
    starts = np.zeros(words.n_docs, np.int64)
    starts[1:] = np.cumsum(counts + _GAP)[:-1]
    out = np.full((int(counts.sum()) + _GAP * words.n_docs, *values.shape[1:]), gap, values.dtype)
    out[np.arange(len(words.hash)) + _GAP * words.doc] = values
    return out, starts


def buckets_of(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """(rows, TABLES) bucket numbers with _GAP rows of zeros' buckets after each text, and where each text starts."""
    return spread(words, hashed(words), BUCKETS)


@dataclass
class Network:
    tables: np.ndarray = None  # (TABLES, BUCKETS + 1, PART); the last row is zero, for the gaps
    filters: list = field(default_factory=list)  # by width: (width, TABLES * PART, FILTERS)
    bias: list = field(default_factory=list)
    out: np.ndarray = None
    out_bias: float = 0.0
    constant: float | None = None
    thresholds: dict = field(default_factory=dict)

    def __getstate__(self):
        """Rows of zeros, which most buckets have, stay behind."""
        if self.tables is None:
            return self.__dict__
        used = [np.flatnonzero(t.any(1)) for t in self.tables]
        return self.__dict__ | {"tables": [(u, t[u]) for u, t in zip(used, self.tables, strict=True)]}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.tables is not None:
            parts, self.tables = self.tables, np.zeros((TABLES, BUCKETS + 1, PART), np.float32)
            for t, (used, rows) in enumerate(parts):
                self.tables[t, used] = rows

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        """(words, TABLES * PART) joined rows of the tables; bucket BUCKETS is zero."""
        return self.tables.reshape(-1, PART).take(buckets + _FIRST, axis=0).reshape(len(buckets), TABLES * PART)

    def maxima(self, x: np.ndarray, rows: np.ndarray, starts: np.ndarray, where: bool = False):
        """(texts, widths * FILTERS) maxima of the filters, and the rows they come from. x: vectors of distinct words, to which
        the filters are applied once each; rows: the words of the texts by their number in x, gaps by that of a zero."""
        n, ends = len(rows), np.append(starts[1:], len(rows))
        y = (x @ np.concatenate([f[0] for f in self.filters], axis=1)).take(rows, axis=0)
        for k in range(1, _GAP):
            wide = [f[k] for f in self.filters if len(f) > k]  # the last ones, as widths rise
            y[: n - k, -len(wide) * FILTERS :] += (x @ np.concatenate(wide, axis=1)).take(rows[k:], axis=0)
            y[ends - k] = -np.inf
        top = np.maximum.reduceat(y, starts, axis=0)
        at = None
        if where:
            at = np.full(top.shape, n, np.int64)
            hit, col = np.divmod(np.flatnonzero(y == np.repeat(top, ends - starts, axis=0)), top.shape[1])
            np.minimum.at(at, (np.searchsorted(starts, hit, "right") - 1, col), hit)
        return top + np.concatenate(self.bias), at

    def score(self, words: common.Words) -> np.ndarray:
        if self.constant is not None:
            return np.full(words.n_docs, self.constant)
        _, buckets, numbers = distinct(words)
        rows, starts = spread(words, numbers, len(buckets))
        best, _ = self.maxima(self.embed(np.append(buckets, _NONE, axis=0)), rows, starts)
        return 1 / (1 + np.exp(-np.clip(np.maximum(best, 0).astype(np.float64) @ self.out + self.out_bias, -30, 30)))


def _batches(order: np.ndarray, texts: list[np.ndarray], batch: int, words: int = 30_000) -> Iterator[np.ndarray]:
    """Runs of at most `batch` texts and about `words` words; a longer text stands alone."""
    at = 0
    while at < len(order):
        sizes = np.cumsum([len(texts[i]) for i in order[at : at + batch]])
        n = max(1, int(np.searchsorted(sizes, words, "right")))
        yield order[at : at + n]
        at += n


def log_odds(clean: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """How much likelier toxic texts hold a bucket than clean ones, in logs, from the numbers of both. PRIOR texts that know
    nothing come first, and of the toxic ones with a bucket one does not count, so that no text's own words name it."""
    return np.log((np.maximum(toxic - 1, 0) + PRIOR * share) / (clean + PRIOR * (1 - share)) * (1 - share) / share).astype(np.float32)


def start(keys: np.ndarray, odds: np.ndarray, seed: int = 7) -> tuple[Network, np.ndarray, np.random.Generator]:
    """A network before training, AdaGrad's squares for it, and the generator that drew it. An embedding's first number
    starts as the log odds of its bucket (table * BUCKETS + bucket), 0 for buckets that no text has."""
    net, rng, dim = Network(), np.random.default_rng(seed), TABLES * PART
    net.tables = rng.standard_normal((TABLES, BUCKETS + 1, PART), np.float32)
    net.tables *= np.float32(0.05)
    net.tables[:, :-1, 0] = 0
    net.tables[keys // BUCKETS, keys % BUCKETS, 0] = odds
    net.tables[:, -1] = 0
    net.filters = [rng.normal(0, (w * dim) ** -0.5, (w, dim, FILTERS)).astype(np.float32) for w in WIDTHS]
    net.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    net.out, net.out_bias = rng.uniform(0.1, 0.5, len(WIDTHS) * FILTERS) * np.resize([1.0, 1.0, 1.0, -1.0], len(WIDTHS) * FILTERS), -1.0
    return net, np.full((TABLES, BUCKETS + 1, 1), 1e-4, np.float32), rng


def learn(net: Network, squares: np.ndarray, rng: np.random.Generator, vocabulary: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, epochs: int, batch: int = 12, rate: float = 0.02) -> np.ndarray:
    """Trains net in place; texts: the words of each as rows of the vocabulary, which holds their buckets and,
    last, a gap's. Adam for filters, AdaGrad for the embedding rows that occur; gives the keys of those that it has changed."""
    changed, tables, squares = np.zeros((TABLES, BUCKETS + 1), bool), net.tables.reshape(-1, PART), squares.reshape(-1, 1)
    flags = changed.reshape(-1)
    params = [*net.filters, *net.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params] + [(np.zeros_like(net.out), np.zeros_like(net.out)), (np.zeros(1), np.zeros(1))]
    step, gap = 0, np.full(_GAP, len(vocabulary) - 1, np.int32)
    there, numbers = np.zeros(len(vocabulary), bool), np.zeros(len(vocabulary), np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for chosen in _batches(order, texts, batch):
            read = np.concatenate([p for i in chosen for p in (texts[i], gap)])
            there[read] = True
            own = np.flatnonzero(there)  # the gap is the last
            there[own] = False
            numbers[own] = np.arange(len(own))
            rows, buckets = numbers[read], vocabulary[own]
            starts = np.cumsum([0, *(len(texts[i]) + _GAP for i in chosen[:-1])])
            x = net.embed(buckets)
            best, at = net.maxima(x, rows, starts, where=True)
            active = best > 0
            hidden = np.where(active, best, 0).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))
            error = (p - labels[chosen]) * (1 + labels[chosen]) / len(chosen)  # the rarer toxic rows count twice
            grads_out = [hidden.T @ error + 1e-4 * net.out, np.array([error.sum()])]
            back = (error[:, None] * net.out[None, :] * active).astype(np.float32)
            grads, grads_bias, hit, change = [], [], [], []
            for w, f in enumerate(net.filters):
                g, where, df = back[:, w * FILTERS : (w + 1) * FILTERS], at[:, w * FILTERS : (w + 1) * FILTERS], np.zeros_like(f)
                for k in range(len(f)):
                    inside = where + k < len(rows)
                    row = np.minimum(where + k, len(rows) - 1)
                    gk = g * inside
                    df[k] = np.einsum("bfd,bf->df", x[rows[row]], gk)
                    text, filter_ = np.nonzero(gk)
                    hit.append(rows[row[text, filter_]])
                    change.append(gk[text, filter_, None] * f[k].T[filter_])
                grads.append(df)
                grads_bias.append(g.sum(0))
            step += 1
            for value, (m, v), g in zip([*params, net.out], moments, [*grads, *grads_bias, grads_out[0]], strict=False):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value -= (rate * 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(value.dtype)
            m, v = moments[-1]
            m += 0.1 * (grads_out[1] - m)
            v += 0.01 * (grads_out[1] ** 2 - v)
            net.out_bias -= float((rate * 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))[0])
            used, place = np.unique(np.concatenate(hit), return_inverse=True)
            dx = np.zeros((len(used), x.shape[1]), np.float32)
            np.add.at(dx, place, np.concatenate(change))
            real = used < len(own) - 1
            keys, inverse = np.unique(buckets[used[real]] + _FIRST, return_inverse=True)
            g = np.zeros((len(keys), PART), np.float32)
            np.add.at(g, inverse.ravel(), dx[real].reshape(-1, PART))
            squares[keys] += (g * g).mean(1, keepdims=True)
            tables[keys] -= rate * 5 * g / np.sqrt(squares[keys])
            flags[keys] = True
    return np.flatnonzero(changed[:, :-1])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_shard, _lang, _toxic, _left, text), a work table: all labelled documents whose crc32(doc_id) mod 3 is not 1, those of
    a shard together in the order of their ids' hashes. Every fifth or so is left out of the first fit."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropna()
    known = known.where(common.crc_mod("_id", 3) != 1).groupBy("_id").agg(F.max("_toxic").alias("_toxic")).where("_toxic in (0, 1)")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), common.null_as_empty("text").alias("text"), F.col("lang").cast("string").alias("_lang"))
    rows = rows.where(F.col("_id").isNotNull() & (common.crc_mod("_id", 3) != 1))  # before the join moves texts
    shards = max(1, -(-rows.select("_id").join(known, "_id").count() // SHARD))
    place = lambda what: F.crc32(F.concat(F.lit(what), F.col("_id").cast("string")))
    rows = rows.join(known.hint("merge"), "_id").withColumn("_order", place("fit:")).withColumn("_shard", (place("shard:") % shards).cast("int")).withColumn("_left", place("left:") % 5 == 4)
    rows = rows.repartition(4 * shards, "_shard").sortWithinPartitions("_shard", "_order", "_id", F.xxhash64("text"), "text", "_lang")
    return common.stash(rows.select("_shard", "_lang", "_toxic", "_left", "text"), "toxicity-labelled")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(shard, part, vocabulary and a gap, texts, labels) from a task's rows, the shards one after the other; a shard of more
    than SHARD_WORDS words comes in parts. The vocabulary is in the order of its hashes, wherever batches end."""
    shard, part, held = None, 0, 0
    runs: list[tuple[np.ndarray, ...]] = []  # distinct hashes, their buckets, words by their numbers, where texts end
    labels: list[int] = []

    def done():
        hashes, buckets, numbers, ends = zip(*runs, strict=True)
        _, first, places = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        places, texts, at = places.astype(np.int32), [], 0
        for own, words, last in zip(hashes, numbers, ends, strict=True):
            texts += np.split(places[at : at + len(own)][words], last[:-1])
            at += len(own)
        return shard, part, np.concatenate([np.concatenate(buckets)[first], _NONE]), texts, np.array(labels, np.float64)

    for batch in batches:
        for piece in common.slices(batch, "text", _SLICE):
            words = common.Words(*common.text_buffers(piece.column("text")), within=common.LETTERS)
            edges, numbers, toxic = np.concatenate([[0], np.cumsum(words.counts())]), piece.column("_shard").to_pylist(), piece.column("_toxic").to_pylist()
            i = 0
            while i < len(numbers):
                if labels and (numbers[i] != shard or held + edges[i + 1] - edges[i] > SHARD_WORDS):
                    yield done()
                    part = part + 1 if numbers[i] == shard else 0
                    runs, labels, held = [], [], 0
                shard, j = numbers[i], i + 1
                while j < len(numbers) and numbers[j] == shard and held + edges[j + 1] - edges[i] <= SHARD_WORDS:
                    j += 1
                own, buckets, places = distinct(words, slice(int(edges[i]), int(edges[j])))
                runs.append((own, buckets, places.astype(np.int32), edges[i + 1 : j + 1] - edges[i]))
                labels += toxic[i:j]
                held, i = held + int(edges[j] - edges[i]), j
    if labels:
        yield done()


def _sorted(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; np.unique hashes them, which is slower by far."""
    x = np.sort(x, axis=None)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """key (table * BUCKETS + bucket) and by toxic and left the number of texts that hold it: n00, n01, n10, n11."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, TABLES * BUCKETS), np.int32)
        flat = counts.reshape(-1)
        for batch in batches:
            for piece in common.slices(batch, "text", _SLICE):
                words = common.Words(*common.text_buffers(piece.column("text")), within=common.LETTERS)
                kinds = np.array([2 * int(t) + int(left) for t, left in zip(piece.column("_toxic").to_pylist(), piece.column("_left").to_pylist(), strict=True)], np.int64)
                _, buckets, numbers = distinct(words)
                pairs = _sorted(words.doc << 32 | numbers)  # text and word, then text and key
                pairs = _sorted((pairs >> 32 << 32)[:, None] | (buckets + np.arange(TABLES) * BUCKETS)[pairs & 0xFFFFFFFF])
                np.add.at(flat, kinds[pairs >> 32] * (TABLES * BUCKETS) + (pairs & 0xFFFFFFFF), 1)
        key = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[key].astype(np.int64)) for c in counts)], names=["key", *_KINDS])

    found = rows.select("_toxic", "_left", "text").mapInArrow(run, "key long, " + ", ".join(f"{c} long" for c in _KINDS))
    return _arrays(found.groupBy(F.col("key").cast("int").alias("key")).agg(*[F.sum(c).cast("int").alias(c) for c in _KINDS]))  # at most TABLES * BUCKETS rows


_KINDS = ["n00", "n01", "n10", "n11"]
#: Numbers are summed in whole parts of this size.
_UNIT = 2.0**-28


def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    return {c: x.to_numpy() for c, x in zip(df.columns, df.toArrow().combine_chunks().itercolumns(), strict=True)}


def _dense(net: Network) -> np.ndarray:
    """Filters, biases and the last layer in rows of PART + 1 numbers, zeros behind them."""
    flat = np.concatenate([*(x.ravel() for x in (*net.filters, *net.bias, net.out)), [net.out_bias]]).astype(np.float64)
    return np.resize(np.append(flat, np.zeros(-len(flat) % (PART + 1))), (-(-len(flat) // (PART + 1)), PART + 1))


def _set_dense(net: Network, rows: np.ndarray) -> None:
    flat, at = rows.ravel(), 0
    for x in (*net.filters, *net.bias, net.out):
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    net.out_bias = float(flat[at])


def fit(rows: DataFrame, sizes: tuple[int, int], keys: np.ndarray, odds: np.ndarray) -> Network:
    """The network after all rounds over rows, of which there are sizes (clean, toxic); keys are in order. A single shard goes over its rows
    eight times in one round, few rows more often: LEAST_STEPS steps in all."""
    alone = rows.agg(F.max("_shard")).first()[0] == 0
    epochs = max(8, -(-LEAST_STEPS * 12 // sum(sizes))) if alone else EPOCHS
    state, names = None, [f"v{k}" for k in range(PART + 1)]
    for turn in range(1 if alone else ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast((keys, odds, state))

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            keys, odds, state = shared.value
            found: list[np.ndarray] = [np.zeros((0, PART + 3), np.int64)]  # key, texts, whole parts
            for shard, part, vocabulary, texts, labels in _shards(batches):
                net, squares, rng = start(keys, odds)
                if shard or part or turn:
                    rng = np.random.default_rng([7, turn, shard, part])
                if state is not None:
                    _restore(net, squares, *state)
                used = learn(net, squares, rng, vocabulary, texts, labels, epochs, rate=0.02 / (1 + turn))
                t, bucket = used // BUCKETS, used % BUCKETS
                values = np.concatenate([np.concatenate([net.tables[t, bucket], squares[t, bucket]], axis=1), _dense(net)]).astype(np.float64)
                key = np.concatenate([used, TABLES * BUCKETS + np.arange(len(values) - len(used))])
                found.append(np.column_stack([key, np.full(len(key), len(labels)), np.rint(values * (len(labels) / _UNIT)).astype(np.int64)]))
                del net, squares
                both = np.concatenate(found)
                both = both[np.argsort(both[:, 0])]
                own, first = np.unique(both[:, 0], return_index=True)
                found = [np.add.reduceat(both, first, axis=0)]
                found[0][:, 0] = own
            yield pa.RecordBatch.from_arrays([pa.array(found[0][:, 0].astype(np.int32)), *(pa.array(c) for c in found[0][:, 1:].T)], names=["key", "n", *names])

        made = rows.select("_shard", "_toxic", "text").mapInArrow(run, "key int, n long, " + ", ".join(f"{c} long" for c in names))
        got = _arrays(made.groupBy("key").agg(*[(F.sum(c).cast("double") / F.sum("n") * _UNIT).cast("float").alias(c) for c in names]))  # at most a row for each bucket
        if state is None:
            net, squares, _ = start(keys, odds)
            t, bucket = keys // BUCKETS, keys % BUCKETS
            state = keys, np.concatenate([net.tables[t, bucket], squares[t, bucket]], axis=1), _dense(net)
            del net, squares
        changed, values = got["key"], np.stack([got.pop(c) for c in names], axis=1)
        layers = changed >= TABLES * BUCKETS
        state[1][np.searchsorted(keys, changed[~layers])] = values[~layers]
        state[2][changed[layers] - TABLES * BUCKETS] = values[layers]
        shared.unpersist()
    net, squares, _ = start(keys[:0], odds[:0])
    net.tables[:] = 0  # a word that no text has says nothing
    _restore(net, squares, *state)
    return net


def _restore(net: Network, squares: np.ndarray, keys: np.ndarray, values: np.ndarray, dense: np.ndarray) -> None:
    t, bucket = keys // BUCKETS, keys % BUCKETS
    net.tables[t, bucket], squares[t, bucket] = values[:, :PART], values[:, PART:]
    _set_dense(net, dense)


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fits on all labelled rows. A first fit leaves about every fifth out, which sets the thresholds by language."""
    common.bound_batches(docs.sparkSession)
    rows = labelled(docs, labels)
    sizes = {(r["_toxic"] != 0, r["_left"]): r["n"] for r in rows.groupBy("_toxic", "_left").agg(F.count("*").alias("n")).collect()}
    of = lambda toxic, lefts: sum(sizes.get((toxic, left), 0) for left in lefts)
    n, kept = ((of(False, x), of(True, x)) for x in ((False, True), (False,)))
    if not min(n):
        return Network(constant=n[1] / sum(n) if sum(n) else 0.0)
    counts = _counts(rows)
    order = np.argsort(counts["key"])
    counts = {c: x[order] for c, x in counts.items()}
    thresholds = {}
    if min(kept):
        there = counts["n00"] + counts["n10"] > 0
        odds = log_odds(counts["n00"][there], counts["n10"][there], kept[1] / sum(kept))
        thresholds = calibrate(rows.where("_left"), fit(rows.where("not _left"), kept, counts["key"][there], odds))
    odds = log_odds(counts["n00"] + counts["n01"], counts["n10"] + counts["n11"], n[1] / sum(n))
    net = fit(rows, n, counts["key"], odds)
    net.thresholds = thresholds
    common.discard(rows)
    return net


def calibrate(rows: DataFrame, net: Network) -> dict[str, float]:
    """Thresholds by language from all rows, of which net has seen none; scores count in STEPS steps."""
    found = score(rows.withColumnRenamed("_lang", "lang"), net, ["lang", "_toxic"])
    step = F.round(F.col("score") * STEPS).cast("int").alias("step")
    found = found.groupBy(F.coalesce("_row.lang", F.lit("")).alias("lang"), step).agg(F.count_if(F.col("_row._toxic") == 0).alias("clean"), F.count_if(F.col("_row._toxic") != 0).alias("toxic"))
    by_lang: dict[str, list[tuple[float, int, int]]] = {}
    for r in found.orderBy("lang", "step").collect():  # STEPS rows and one a language
        by_lang.setdefault(r["lang"], []).append((r["step"] / STEPS, r["clean"], r["toxic"]))
    return {lang: _threshold(steps) for lang, steps in by_lang.items()}


def _threshold(steps: list[tuple[float, int, int]], least: int = 5) -> float:
    """Between the two scores whose split makes the fewest errors, nearest to THRESHOLD, from (score, clean, toxic) in
    order; THRESHOLD for few rows."""
    p, clean, toxic = (np.array(x, float) for x in zip(*steps, strict=True))
    if min(clean.sum(), toxic.sum()) < least:
        return THRESHOLD
    edges = np.unique([0.0, 1.0, *p])
    cuts = np.array([THRESHOLD, *((edges[1:] + edges[:-1]) / 2)])
    at = np.searchsorted(p, cuts)  # scores from here on are at or above the cut
    errors = np.append(0, np.cumsum(toxic))[at] + clean.sum() - np.append(0, np.cumsum(clean))[at]
    return float(cuts[np.lexsort((np.abs(cuts - THRESHOLD), errors))[0]])


def score(docs: DataFrame, net: Network, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (default: doc_id) in a struct _row, score, and flagged (score at or above the
    threshold of the row's language).

    Null and empty texts have no words and get the score of none; whole texts of any length are scored; with no
    labelled rows of one kind the score is the share of toxic ones (0 without any). Rows repeat as they come; no
    rows give no rows; other columns are not read."""
    carry = ["doc_id"] if carry is None else carry
    shared = common.bound_batches(docs.sparkSession).sparkContext.broadcast(net)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.col("lang").cast("string").alias("_lang"), common.null_as_empty("text").alias("_text"))

    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["t"])
        parts = [shared.value.score(common.Words(*common.text_buffers(s.column("t")), within=common.LETTERS)) for s in common.slices(batch, "t", _SLICE)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    limits = {k: v for k, v in net.thresholds.items() if k}
    limit = F.lit(net.thresholds.get("", THRESHOLD))
    if limits:
        limit = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.coalesce("_lang", F.lit(""))], F.lit(THRESHOLD))
    return rows.withColumn("score", score_of("_text")).select("_row", "score", (F.col("score") >= limit).alias("flagged"))
