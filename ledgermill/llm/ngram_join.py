"""N-gram Jaccard self-join of documents by a MinHash LSH forest, verified exactly.

A document is the set of its five-word shingles (words as separated by ASCII
white space; of fewer words, one shingle of all). Documents with equal sets
form a class; one of each class goes on.

The forest has TREES tries. In each, a document's signature is a path of DEPTH
MinHash values: LEVEL4 bits for each of the first FLOOR, four bits for the
deeper ones. Two documents meet in a trie under the node of their common prefix.
A document's prefixes are matched at DEPTH first and then shortened, a level at
a time, until a partner at the threshold would meet it in some trie with the
target recall. In a trie where nobody shares its first FLOOR levels, shortening
to there is free, so documents with few matches keep long prefixes elsewhere;
of the last level only as many tries are shortened as the recall needs, those
with the smallest nodes first. With the defaults all can be reached at FLOOR.

Documents under a node of FLOOR levels come together in a task, sorted by the
rest of their paths, in which each finds the range of its own prefix. There the
documents' sketches (a bit of each MinHash value) are compared: a pair at the
threshold agrees in fewer than SKETCH_AGREE bits with probability 1e-9, so
that others, which met by chance or by a moderate likeness, are not linked. Each
document leaves the task once, with the least document that it is linked to
there. Nodes of over BLOCK documents are cut into blocks, and every two blocks
meet in a task of their own. The links' components are the candidate groups, and
each document's text travels to its own group once.

In a group all pairs are compared by their exact sets, counted by way of shared
shingles. Groups of over BLOCK documents (or BLOCK_SHINGLES shingles) are cut
into blocks in the same way. What leaves a task is one row per document:
how many documents it is linked to, and the least document that it is connected
to; pairs are not written out. Shingles are compared by 64-bit hashes.

Defined cases: null text counts as empty; a text without words is linked to
nothing and is its own class; rows that repeat a document are copies of each
other; rows with a null doc_id are left out; other columns are not read, and
`one_of_each` passes them on, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import BROADCAST_ROWS, bounded, shuffled, stored
from ledgermill.llm.components import components

N, THRESHOLD = 5, 0.8
TREES, DEPTH, FLOOR, RECALL = 32, 8, 4, 1 - 1e-6
LEVEL4, SKETCH_BITS = 12, TREES * DEPTH
#: Of SKETCH_BITS; 0.9 of them agree for a pair at the threshold. This is six standard deviations under that.
SKETCH_AGREE = 201
BLOCK, BLOCK_SHINGLES = 800, 4_000_000
#: Documents whose signatures are computed together: at most so many shingles, if one has no more.
CHUNK = 100_000
DENSE = 12
_ODD = np.random.default_rng(17).integers(0, 1 << 63, (3, 512), dtype=np.uint64)
_POWERS = _ODD[2, :N] | np.uint64(1)


def gain(level: int, threshold: float = THRESHOLD) -> float:
    """By how much (as a logarithm) a trie matched at this level lowers the probability to miss a pair at the threshold."""
    return -math.log(1 - threshold**level)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        return _mixed(np.array([(h * _POWERS[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))]))
    out = h[: len(h) - n + 1] * _POWERS[0]
    for k in range(1, n):
        out = out + h[k : len(h) - n + 1 + k] * _POWERS[k]
    return np.unique(_mixed(out))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set (none is empty): its path in each trie (64 bits), and its sketch."""
    x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    paths, bits = np.zeros((len(sets), TREES), np.uint64), np.empty((len(sets), SKETCH_BITS), np.uint8)
    for t in range(TREES):
        for d in range(DEPTH):
            k = t * DEPTH + d
            least = _mixed(np.minimum.reduceat(x * (_ODD[0, k] | np.uint64(1)) + _ODD[1, k], starts))
            width = np.uint64(LEVEL4 if d < FLOOR else 4)
            paths[:, t] = (paths[:, t] << width) | (least >> (np.uint64(64) - width))
            bits[:, k] = least & np.uint64(1)
    return paths, np.packbits(bits, axis=1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "digest", "n", "paths", "sketch"]

    def batch(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [k for k, s in enumerate(sets) if len(s)]
        paths: list = [None] * len(sets)
        sketches: list = [None] * len(sets)
        if full:
            for k, path, sketch in zip(full, *signatures([sets[k] for k in full]), strict=True):
                paths[k], sketches[k] = path.view(np.int64), sketch.tobytes()
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(paths, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=names)

    for b in batches:
        ids, sets, held = [], [], 0
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = shingles(text.as_py())
            if sets and held + len(s) > CHUNK:
                yield batch(ids, sets)
                ids, sets, held = [], [], 0
            ids.append(doc_id)
            sets.append(s)
            held += len(s)
        if sets:
            yield batch(ids, sets)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two sets share, by way of the shingles: rare ones by their pairs, frequent ones by products of 0/1 matrices."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    x, row = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(x, kind="stable")
    x, row = x[order], row[order]
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    many = np.diff(np.r_[starts, len(x)])
    counts = np.zeros((n, n), np.int64)
    for d in range(2, DENSE + 1):
        at = starts[many == d]
        if not len(at):
            continue
        members = row[at[:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                counts += np.bincount(members[:, i] * np.int64(n) + members[:, j], minlength=n * n).reshape(n, n) if n * n <= 4 * len(at) else 0
                if n * n > 4 * len(at):
                    np.add.at(counts, (members[:, i], members[:, j]), 1)
    frequent = np.flatnonzero(many > DENSE)
    for part in range(0, len(frequent), 2048):
        pick = frequent[part : part + 2048]
        column = np.repeat(np.arange(len(pick)), many[pick])
        where = np.repeat(starts[pick], many[pick]) + (np.arange(many[pick].sum()) - np.repeat(np.cumsum(many[pick]) - many[pick], many[pick]))
        m = np.zeros((n, len(pick)), np.float32)
        m[row[where], column] = 1
        product = m @ m.T
        counts += np.triu(product, 1).astype(np.int64)
    counts += counts.T
    counts[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return counts


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two sets have a Jaccard similarity of threshold or more."""
    both = shared(sets)
    size = np.diag(both)
    out = both >= threshold * (size[:, None] + size[None] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _roots(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each row is connected to."""
    root = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        least = np.minimum(root, np.where(link, root[None], big).min(axis=1))
        if (least == root).all():
            return root
        root = least


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each key (which arrive together), as slices of the batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = b.column(key).to_pylist()
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if held and keys[at] != now:
                yield held
                held = []
            now = keys[at]
            held.append(b.slice(at, end - at))
            at = end
    if held:
        yield held


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, int]] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 3
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rep", "links", "root"])

    for group in by_key(batches, "key"):
        t = pa.Table.from_batches(group)
        sets, keep = [], []
        for k, (text, digest) in enumerate(zip(t["text"], t["digest"].to_pylist(), strict=True)):
            s = shingles(text.as_py())
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:  # else another text under the same doc_id
                keep.append(k)
                sets.append(s)
        ids, one = np.unique(t["rep"].to_numpy()[keep], return_index=True)  # a repeated row comes twice
        if len(ids) > 1:
            block, other, weight = (t[c].to_numpy()[keep][one] for c in ("block", "crossed", "copies"))
            link = linked([sets[k] for k in one], threshold)
            if other[0]:
                link &= block[:, None] != block[None]
            links, roots = (link * weight[None]).sum(axis=1), _roots(link, ids)
            rows += [(i, n, r) for i, n, r in zip(ids.tolist(), links.tolist(), roots.tolist(), strict=True) if n]
        if len(rows) > 20_000:
            yield batch()
    yield batch()


def levels(matched: DataFrame, threshold: float, recall: float) -> DataFrame:
    """rep, and of each trie where it matches: node, rest (of its path) and level, the length that its prefix is shortened to. matched: rep, node, rest and size (documents under the node).

    With u tries free at FLOOR, the others start at DEPTH. The level is the highest at which all of them reach the recall; of those, only as many as it takes, smallest nodes first, go to it, the rest stay one above.
    """
    need = -math.log(1 - recall)
    rows = matched.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("size", "node", "rest"))).alias("tries"))  # at most TREES
    m = F.size("tries")
    left = F.lit(need) - (TREES - m) * F.lit(gain(FLOOR, threshold))
    level, short = F.lit(FLOOR), m  # if even this doesn't reach it
    for x in range(FLOOR, DEPTH):
        low, high = gain(x, threshold), gain(x + 1, threshold)
        reached = m * F.lit(low) >= left
        level = F.when(reached, F.lit(x)).otherwise(level)
        short = F.when(reached, F.greatest(F.lit(0), F.least(m, F.ceil((left - m * F.lit(high)) / F.lit(low - high)).cast("int")))).otherwise(short)
    rows = rows.select("rep", level.alias("at"), short.alias("short"), F.posexplode("tries").alias("i", "trie"))
    return rows.select("rep", "trie.node", "trie.rest", F.when(F.col("i") < F.col("short"), F.col("at")).otherwise(F.least(F.lit(DEPTH), F.col("at") + 1)).alias("level"))


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which sketches of a and b agree in SKETCH_AGREE bits."""
    differ = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        differ += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return differ <= SKETCH_BITS - SKETCH_AGREE


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Under each node: documents and the least one that each is linked to by way of prefixes and sketches. Rows come sorted by the rest of their paths."""
    us: list[int] = []
    vs: list[int] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        us.clear()
        vs.clear()
        return out

    for group in by_key(batches, "key"):
        t = pa.Table.from_batches(group)
        rep = t["rep"].to_numpy()
        if len(rep) < 2:
            continue
        rest, level, part = t["rest"].to_numpy(), t["level"].to_numpy(), t["block"].to_numpy()
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(rep), -1)
        link = np.zeros((len(rep), len(rep)), bool)
        for x in np.unique(level).tolist():
            prefix = rest >> 4 * (DEPTH - x)
            start = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
            for i, j in zip(start.tolist(), [*start[1:].tolist(), len(rep)], strict=True):
                asks = np.flatnonzero(level[i:j] == x) + i
                if j - i > 1 and len(asks):
                    link[asks, i:j] |= _alike(sketch[asks], sketch[i:j])
        if t["crossed"][0].as_py():
            link &= part[:, None] != part[None]
        link |= link.T
        roots = _roots(link, rep)
        moved = roots < rep
        us += rep[moved].tolist()
        vs += roots[moved].tolist()
        if len(us) > 50_000:
            yield batch()
    yield batch()


def in_blocks(rows: DataFrame, key: str, blocks, by: str) -> DataFrame:
    """rows with `key` (text), `block` and `crossed`: rows of one key are cut into so many blocks by a hash of `by`; every two blocks meet (crossed), and each one itself."""
    own = F.pmod(F.xxhash64(by, F.lit("block")), blocks).cast("int")
    rows = rows.withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("key", F.concat_ws("/", key, F.least("block", "with"), F.greatest("block", "with"))).withColumn("crossed", F.col("block") != F.col("with")).drop("with")


def candidates(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links u > v between classes (rep, paths, sketch) that the forest brings together."""
    entries = classes.select("rep", F.posexplode("paths").alias("tree", "path"))
    low = 4 * (DEPTH - FLOOR)
    node = F.shiftleft(F.col("tree").cast("long"), 64 - low).bitwiseOR(F.shiftrightunsigned("path", low))
    entries = entries.select("rep", node.alias("node"), F.col("path").bitwiseAND((1 << low) - 1).cast("int").alias("rest"))
    sizes = entries.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    matched = entries.join(shuffled(sizes), "node")
    rows = levels(matched, threshold, recall).join(shuffled(classes.select("rep", "sketch")), "rep")
    sizes = rows.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(bounded(stored(sizes), BROADCAST_ROWS), "node", "left")
    dealt = in_blocks(rows, "node", F.coalesce("blocks", F.lit(1)), "rep").select("key", "rest", "level", "rep", "block", "crossed", "sketch")
    return dealt.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(_descend, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least doc_id that the document is connected to), text_class (the least doc_id with the same shingles), n_shingles and n_links (other documents of at least this similarity, copies counted) of every row.

    Thresholds under 0.8 need more trees for the same recall, and sketches' bound is set for 0.8.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = stored(texts.mapInArrow(_sign, "doc_id long, digest binary, n int, paths array<long>, sketch binary"))
    classes = stored(signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")))
    groups = components(candidates(classes, threshold, recall))
    members = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(shuffled(classes.select(F.col("rep").alias("node"), "digest", "copies", "n")), "node")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = stored(members.join(shuffled(sizes), "root"))
    met = bounded(members, BROADCAST_ROWS)
    rows = texts.join(met, F.col("doc_id") == F.col("node")).select("root", "blocks", F.col("node").alias("rep"), "digest", "copies", "text")
    rows = in_blocks(rows, "root", F.col("blocks"), "rep").select("key", "rep", "block", "crossed", "digest", "copies", "text")
    found = stored(rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(lambda it: _verify(it, threshold), "rep long, links long, root long"))
    connected = components(found.where("rep != root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).join(shuffled(connected.select(F.col("node").alias("rep"), "root")), "rep", "left")
    of_class = classes.select("digest", "rep", "copies").join(shuffled(links), "rep", "left")
    out = signed.select("doc_id", "digest", "n").join(shuffled(of_class), "digest", "left")
    has = F.col("n") > 0
    return out.select(
        "doc_id",
        F.when(has, F.coalesce("root", "rep")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(has, F.col("rep")).otherwise(F.col("doc_id")).alias("text_class"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(has, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs without near copies: of each class the document with the least doc_id, once; rows without doc_id stay."""
    kept = near_duplicates(docs, **kw).where("doc_id = class_id").select("doc_id").distinct()
    rows = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))
