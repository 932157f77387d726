"""MinHash near-duplicates with odd sketches.

One pass over the texts gives each document a key of its shingle set, band keys of MinHash samples, and an odd sketch:
the parity bitmap of one MinHash sample for each of BINS ranges of hashes. The XOR population count of two sketches
tells how many samples differ, which is precise where most agree. Documents with equal sets are one node, named by the
set's hash; nodes of one doc_id are linked. Nodes that share a band are compared with the band's smallest node first; a pair whose sketches differ too much for the threshold
drops out, the others are confirmed on the full shingle sets. Links become components by min-label propagation. A
band that then still joins several components is compared in full across them, in blocks of bounded size that hold
the shingle sets, so that no link between its nodes is lost and only links that join components leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SHINGLE = 5
#: 100 * intersection >= PERCENT * union links two documents.
PERCENT = 75
BANDS, ROWS = 24, 4
SAMPLES = BANDS * ROWS
#: Ranges of hashes with one sample each in the odd sketch, and the sketch's bits.
BINS, BITS = 512, 2048
#: A pair drops out if fewer samples agree than expected at the threshold, less so many standard deviations and samples.
DEVIATIONS, SLACK = 5.0, 4.0
#: Nodes, and shingles, of a band in a block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
MOST_IDS = 1 << 20
_SLICE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(75))
_XOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_ODD = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(words: common.Words, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted 64-bit shingle hashes of each text: its runs of `width` words, or all words if there are fewer."""
    h, counts = words.hash, words.counts()
    ends = np.cumsum(counts)
    grams = h.copy()
    factor = np.uint64(0x9E3779B97F4A7C15)
    if len(h) >= width:
        run = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            run = run * factor + h[k : len(h) - width + 1 + k]
        grams = common.mix64(run)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(grams[end - n : end - width + 1]))
        elif n:
            one = np.uint64(n)
            for v in h[end - n : end]:
                one = common.mix64(np.array([one], np.uint64) * factor + v)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys of ROWS MinHash samples each, for sets that are not empty."""
    x = np.concatenate(sets)
    x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), np.uint64(b + 1))
        for k in range(b * ROWS, (b + 1) * ROWS):
            sample = np.minimum.reduceat((x ^ _XOR[k]) * _ODD[k], starts)
            key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + sample)
        keys[:, b] = key
    return keys


def odd_sketch(one: np.ndarray) -> tuple[np.ndarray, int]:
    """The parity bitmap of a sorted set's smallest hash in each range, and their number."""
    bins = (one >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    first = np.ones(len(one), bool)
    first[1:] = bins[1:] != bins[:-1]
    samples = common.mix64(one[first]) % np.uint64(BITS)
    bits = (np.bincount(samples.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.uint64), int(first.sum())


def agreeing(bits, samples):
    """How many samples agree, by the XOR population count of two sketches of so many samples together."""
    return (samples + BITS / 2 * np.log(np.maximum(1 - 2 * np.asarray(bits, float) / BITS, 1e-9))) / 2


def least_agreeing(shingles):
    """What a pair of sets of so many shingles together must reach in agreeing(): the expectation at the threshold,
    less DEVIATIONS standard deviations (of a sample of the union without replacement) and SLACK."""
    t = PERCENT / 100
    union = np.asarray(shingles, float) / (1 + t)
    samples = BINS * (1 - np.exp(-union / BINS))
    return t * samples - DEVIATIONS * np.sqrt(t * (1 - t) * samples * (1 - samples / np.maximum(union, 1))) - SLACK


def node_of(one: np.ndarray) -> int:
    """A set's 64-bit name, as a signed number."""
    a = np.bitwise_xor.reduce(common.mix64(one + np.uint64(1)))
    b = np.add.reduce(common.mix64(one ^ np.uint64(0xA0761D6478BD642F)))
    return int(common.mix64(np.array([a], np.uint64) ^ common.mix64(np.array([b + np.uint64(len(one))], np.uint64))).view(np.int64)[0])


_SIGNED = "doc_id long, n_shingles long, node long, bands array<long>, sketch array<long>, n_samples int"


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, band keys and odd sketch (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text", _SLICE):
                sets = shingle_sets(common.Words(*common.text_buffers(piece.column("text"))))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                nodes: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                sketches: list = [None] * len(sets)
                samples = np.zeros(len(sets), np.int32)
                if len(full):
                    keys = band_keys([sets[i] for i in full])
                    for j, i in enumerate(full):
                        nodes[i] = node_of(sets[i])
                        sk, samples[i] = odd_sketch(sets[i])
                        bands[i], sketches[i] = common.signed(keys[j]), common.signed(sk)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(samples)],
                    names=["doc_id", "n_shingles", "node", "bands", "sketch", "n_samples"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.null_as_empty("text").alias("text"))
    return rows.mapInArrow(run, _SIGNED)


def _close(a: dict, b: dict):
    """Whether two rows' sizes and sketches allow a link; columns by name."""
    union = (a["n_shingles"] + b["n_shingles"]).cast("double") / (1 + PERCENT / 100)
    bits = sum((F.bit_count(a["sketch"][k].bitwiseXOR(b["sketch"][k])) for k in range(1, BITS // 64)), F.bit_count(a["sketch"][0].bitwiseXOR(b["sketch"][0])))
    agree = (a["n_samples"] + b["n_samples"] + BITS / 2 * F.log(F.greatest(1 - 2 * bits / BITS, F.lit(1e-9)))) / 2
    t, samples = PERCENT / 100, BINS * (1 - F.exp(-union / BINS))
    least = t * samples - DEVIATIONS * F.sqrt(t * (1 - t) * samples * F.greatest(1 - samples / F.greatest(union, F.lit(1.0)), F.lit(0.0))) - SLACK
    sizes = F.least(a["n_shingles"], b["n_shingles"]) * 100 >= F.greatest(a["n_shingles"], b["n_shingles"]) * PERCENT
    return sizes & (agree >= least)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, _set) of nodes (node, doc_id): shingle sets, made again from the texts with these doc_ids. Where texts
    share a doc_id, the sets of its other texts come along.

    Up to MOST_IDS ids are broadcast (8 bytes each), so that no text moves; more are joined by a shuffle."""
    ids = nodes.select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if ids.limit(MOST_IDS + 1).count() <= MOST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), common.null_as_empty("text").alias("text")).join(ids, "_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text", _SLICE):
                made = [x for x in shingle_sets(common.Words(*common.text_buffers(piece.column("text")))) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in made], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], names=["node", "_set"])

    return rows.select("text").mapInArrow(run, "node long, _set binary")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets, one of them not empty, are alike enough."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < PERCENT * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of nodes those whose full shingle sets are alike enough, as a work table; ids: (node, doc_id)."""
    table = common.stash(_sets(docs, ids.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")), "neardups-sets")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("_x"), batch.column("_y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = table.select(F.col("node").alias("a"), F.col("_set").alias("_x"))
    right = table.select(F.col("node").alias("b"), F.col("_set").alias("_y"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(alike, "a long, b long")
    out = common.stash(found.distinct(), "neardups-links", small=True)
    common.discard(table)
    return out


def components(links: DataFrame, most_rounds: int = 30) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches.

    Each round takes the smallest label among a node and its neighbours, then the label's own label, so that
    chains shorten quickly; links and labels stay distributed."""
    both = links.select(F.col("a").alias("_x"), F.col("b").alias("_y")).unionByName(links.select(F.col("b").alias("_x"), F.col("a").alias("_y")))
    labels = common.stash(both.groupBy(F.col("_x").alias("node")).agg(F.least(F.col("node"), F.min("_y")).alias("component")), "neardups-labels", small=True)
    for _ in range(most_rounds):
        after = labels.withColumn("_old", F.col("component"))
        for _ in range(2):  # rounds a work table
            known = after.select("node", "component")
            near = both.join(known.select(F.col("node").alias("_y"), "component"), "_y").groupBy(F.col("_x").alias("node")).agg(F.min("component").alias("_near"))
            step = after.join(near, "node").select("node", F.least("component", "_near").alias("component"), "_old")
            jump = known.select(F.col("node").alias("_k"), F.col("component").alias("_to"))
            after = step.join(jump, F.col("component") == F.col("_k")).select("node", F.least("component", "_to").alias("component"), "_old")
        after = common.stash(after, "neardups-labels", small=True)
        common.discard(labels)
        labels = after.select("node", "component")
        if after.where("component < _old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _across(banded: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) across components within a band, in blocks: everything outside a band's largest component against
    all of the band. Rows are copied once per block of the other side. Sketches leave the rows of a block that have a
    close one on its other side; these come back with their sets, and the block gives links that join components."""
    rows = banded.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = rows.select("key", "node", "component", "n_shingles")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_s"))
    top = sizes.groupBy("key").agg(F.max(F.struct("_n", "component", "_s")).alias("_top"), F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.count("*").alias("_parts"))
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    top = top.where("_parts > 1").select(
        "key", F.col("_top.component").alias("_major"),
        blocks(F.col("_top._n"), F.col("_top._s")).alias("_main"), blocks(F.col("_n") - F.col("_top._n"), F.col("_s") - F.col("_top._s")).alias("_rest"),
    )
    rows = rows.join(top, "key")
    minor = F.col("component") != F.col("_major")
    rows = rows.withColumn("_minor", minor).withColumn("_own", F.pmod(F.xxhash64("node"), F.when(minor, F.col("_rest")).otherwise(F.col("_main"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda side, i, kind, j: F.struct(F.lit(side).alias("side"), i.alias("i"), kind.alias("kind"), j.alias("j"))
    # a block (i, kind, j): minor rows of i against major rows (kind 0) or minor rows (kind 1) of j
    against = F.concat(F.transform(every(F.col("_main")), lambda j: place(0, F.col("_own"), F.lit(0), j)), F.transform(F.filter(every(F.col("_rest")), lambda j: j >= F.col("_own")), lambda j: place(0, F.col("_own"), F.lit(1), j)))
    to = F.transform(F.filter(every(F.col("_rest")), lambda i: ~F.col("_minor") | (i <= F.col("_own"))), lambda i: place(1, i, F.col("_minor").cast("int"), F.col("_own")))
    rows = rows.select("key", "node", "component", F.explode(F.when(F.col("_minor"), F.concat(against, to)).otherwise(to)).alias("_b"))
    rows = rows.select("key", "node", "component", F.col("_b.i").alias("_i"), F.col("_b.kind").alias("_k"), F.col("_b.j").alias("_j"), F.col("_b.side").alias("_side"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = lambda df: df.repartition(parts, *_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY, "_side", "node")
    sketched = dealt(rows.join(nodes.select("node", "n_shingles", "sketch", "n_samples"), "node").select(*_BLOCK_ROW, "n_shingles", "sketch", "n_samples"))
    rows = common.stash(sketched.mapInArrow(_close_rows, _BLOCK_SCHEMA), "neardups-close")
    sets = _sets(docs, nodes.select("node", "doc_id").join(rows.select("node").distinct(), "node", "left_semi")).dropDuplicates(["node"])
    found = dealt(rows.join(sets, "node").select(*_BLOCK_ROW, "_set")).mapInArrow(_links, "a long, b long")
    return common.stash(found.distinct(), "neardups-more", small=True)


_BLOCK_KEY = ("key", "_i", "_k", "_j")
_BLOCK_ROW = (*_BLOCK_KEY, "_side", "node", "component")
_BLOCK_SCHEMA = "key long, _i int, _k int, _j int, _side int, node long, component long"


def _blocks(batches: Iterator[pa.RecordBatch], values: tuple[str, ...]) -> Iterator[tuple[tuple, list, list]]:
    """(block, rows of side 0, rows of side 1) from rows sorted by block and side; rows are (node, component, values...)."""
    block, sides = None, ([], [])
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*_BLOCK_ROW, *values)), strict=True):
            if block != row[:4]:
                if sides[0] and sides[1]:
                    yield block, *sides
                block, sides = row[:4], ([], [])
            sides[row[4]].append(row[5:])
    if sides[0] and sides[1]:
        yield block, *sides


def _close_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block whose sketch is close to one of another component on the other side."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(_BLOCK_ROW))
        out.clear()
        return batch

    for block, left, right in _blocks(batches, ("n_shingles", "sketch", "n_samples")):
        sk = np.array([r[3] for r in right], np.int64).view(np.uint64)
        component, sizes, samples = (np.array([r[k] for r in right]) for k in (1, 2, 4))
        hit = np.zeros(len(right), bool)
        for node, its, n, own, m in left:
            agree = agreeing(np.bitwise_count(sk ^ np.array(own, np.int64).view(np.uint64)).sum(1, dtype=np.int64), samples + m)
            near = (component != its) & (agree >= least_agreeing(sizes + n)) & (100 * np.minimum(sizes, n) >= PERCENT * np.maximum(sizes, n))
            if near.any():
                hit |= near
                out.append((*block, 0, node, its))
        out += [(*block, 1, right[k][0], right[k][1]) for k in np.flatnonzero(hit).tolist()]
        if len(out) > 5000:
            yield flush()
    if out:
        yield flush()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's links that join components not yet joined in the block, by the full sets."""
    for _, left, right in _blocks(batches, ("_set",)):
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        found = []
        right = [(node, component, np.frombuffer(s, np.uint64)) for node, component, s in right]
        sketches = [odd_sketch(s) for _, _, s in right]
        sk = np.stack([s for s, _ in sketches])
        samples, sizes = np.array([m for _, m in sketches]), np.array([len(s) for _, _, s in right])
        for node, component, own in left:
            own = np.frombuffer(own, np.uint64)
            mine, m = odd_sketch(own)
            agree = agreeing(np.bitwise_count(sk ^ mine).sum(1, dtype=np.int64), samples + m)
            near = np.flatnonzero(agree >= least_agreeing(sizes + len(own)))
            for k in near[np.argsort(-agree[near], kind="stable")].tolist():
                other, its, theirs = right[k]
                x, y = find(component), find(its)
                if x != y and linked(own, theirs):
                    root[max(x, y)] = min(x, y)
                    found.append((min(node, other), max(node, other)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def link(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, A-Z folded. A
    document of fewer than five words is one shingle, all its words; a null, empty or blank text has no shingles and
    links with nothing, so it is kept. Equal sets link, however many there are. Rows with one doc_id link, whatever
    their texts; a null doc_id takes the component of its equals, or null, and is not kept unless its text is empty. No
    rows give no rows. Columns besides doc_id and text are not read. Shingles and sets are compared by 64-bit hashes,
    whole texts."""
    common.bound_batches(docs.sparkSession)
    signed = common.stash(sign(docs), "neardups-signed")
    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = signed.join(classes, ["node", "doc_id"], "left_semi")  # a class of null ids alone is no node
    nodes = common.stash(nodes.select("node", "doc_id", "n_shingles", "bands", "sketch", "n_samples").dropDuplicates(["node"]), "neardups-nodes")
    keyed = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("key", "_first")
    banded = common.stash(keyed.join(shared, "key"), "neardups-banded")
    star = banded.where("node <> _first").select(F.col("_first").alias("a"), F.col("node").alias("b")).distinct()
    parts = ("n_shingles", "sketch", "n_samples")
    for side in ("a", "b"):
        star = star.join(nodes.select(F.col("node").alias(side), F.struct(*parts).alias(f"_{side}")), side)
    fits = _close(*({p: F.col(f"_{side}.{p}") for p in parts} for side in ("a", "b")))
    links = confirm(common.stash(star.where(fits).select("a", "b"), "neardups-star"), nodes.select("node", "doc_id"), docs)
    same = common.stash(_same_id(signed), "neardups-same", small=True)
    links = links if same.isEmpty() else common.stash(links.unionByName(same), "neardups-links", small=True)
    labels = components(links)
    more = _across(banded.select("key", "node", "n_shingles"), labels, nodes, docs)
    if not more.isEmpty():
        merged = more.join(labels.select(F.col("node").alias("a"), F.col("component").alias("_a")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("_b")), "b", "left")
        merged = merged.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()
        top = components(common.stash(merged, "neardups-merged", small=True)).select(F.col("node").alias("_c"), F.col("component").alias("_top"))
        everyone = labels.unionByName(top.select(F.col("_c").alias("node"), F.col("_c").alias("component")).join(labels.select("node"), "node", "left_anti"))
        labels = everyone.join(top, F.col("component") == F.col("_c"), "left").select("node", F.coalesce("_top", "component").alias("component"))
    joined = labels.join(classes, "node").groupBy("component").agg(F.min("doc_id").alias("_component"))
    ends = classes.join(labels, "node", "left").join(joined, "component", "left").select("node", F.coalesce("_component", "doc_id").alias("_component"))
    out = signed.select("doc_id", "n_shingles", "node").join(ends, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("_component"))
    kept = F.when(F.col("n_shingles") == 0, True).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _same_id(signed: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of each doc_id that has several."""
    own = signed.where("node is not null and doc_id is not null").select("doc_id", "node")
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_most")).where("a < _most")
    return own.join(several, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id stands for its component, once each (of several rows
    with it, that with the smallest hash of its columns); rows without words all stay if their doc_id is null, else
    once a doc_id. A null doc_id with words goes."""
    found = link(docs).where("kept")
    named = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_kept_id")).agg(F.count("*").alias("_n"))
    named = common.stash(named, "neardups-kept", small=True)
    of = lambda ids: docs.join(ids, docs["doc_id"].cast("long") == F.col("_kept_id"), "left_semi")
    out = of(named.where("_n = 1"))
    twice = named.where("_n > 1")
    if not twice.isEmpty():
        rows = of(twice).withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        first = rows.groupBy("doc_id").agg(F.min("_hash").alias("_hash"))
        out = out.unionByName(rows.join(first, ["doc_id", "_hash"], "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
    blank = docs.where(docs["doc_id"].isNull() & ~F.coalesce(docs["text"], F.lit("")).rlike(common.WORD_PATTERN))
    return out.unionByName(blank)
