"""Hard-negative mining by ball trees with branch and bound.

An anchor's positives are the k rows of its own label with the highest inner
products; for each positive, its hard negatives are the rows of other labels
with the highest inner products within a window of shares of the positive's
score. Both are searches over the same index, one after the other.

The index is dealt by a hash of vec_id into blocks of about BLOCK_ROWS rows,
the anchors into blocks of about BLOCK_ANCHORS. Every block of anchors meets
every block of rows once, in a task that holds one block of each: a stated set
of queries against all rows. There every label has a ball tree of its own. Of
a node with centre c and radius r, the inner products with an anchor q lie
between c.q - r|q| and c.q + r|q|. A node whose bounds miss the score window
is left out with all below it, level by level; the leaves that are left are
scored from the highest upper bound on, a few more at a time, until the next
bound is strictly beneath the kth score found so far (an equal one may hold a
smaller vec_id). Each task gives at most k rows for an anchor and
window; the best of these are the result, so nothing is approximate.

Hashed blocks are equal in size whatever the vectors and labels are: a vector
or label that a third of all rows have is spread over all blocks, and a tree of
equal vectors is one leaf of radius 0.

Components are quantised to floor(scale * x), so that scores are whole numbers
and ties are true ones. They are computed as doubles where that is exact (the
greatest possible score is under 2**53), else as Python integers; scores beyond
a long are held at its ends (and so are the windows that follow from them).

Defined cases: rows with a null vec_id, a null label, a null vector, or a null
or non-finite component take no part; a component that overflows when scaled is held at the end of doubles; zero and empty vectors do; shorter
vectors count as filled up with zeros; of rows that repeat a vec_id the one
with the least (label, vector) counts; an anchor without another row of its
label, or without a row in a window, has no rows in the result; other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import stored

BLOCK_ROWS, BLOCK_ANCHORS, LEAF = 16_384, 16_384, 64
#: Anchors whose bounds to all nodes of a block are held at once.
AT_ONCE = 512
EXACT = float(1 << 53)
LONG = 1 << 63


def quantised(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label and v (array<double> of whole numbers) of the rows that take part."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x")).where("vec_id is not null and label is not null and x is not null")
    rows = rows.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    most = float(np.finfo(np.float64).max)
    floor = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(most)), F.lit(-most)))
    whole = F.transform("x", lambda e: floor(e * scale))
    once = rows.select("vec_id", "label", whole.alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return once.select("vec_id", "r.label", "r.v")


class Forest:
    """A ball tree for each label over rows of one block, held in arrays: nodes by level, parents before children; rows in the order of leaves, by vec_id within a leaf."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids, labels))
        ids, labels, v = ids[order], labels[order], v[order]
        starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]) if len(ids) else np.array([], int)
        level = [(-1, np.arange(a, b)) for a, b in zip(starts, np.r_[starts[1:], len(ids)])]  # a root for each label
        centres, radii, parents, self.levels, leaves = [], [], [], [], []
        while level:
            self.levels.append(np.arange(len(parents), len(parents) + len(level)))
            below = []
            for parent, rows in level:
                x, at = v[rows], len(parents)
                centre = x.mean(0)
                away = ((x - centre) ** 2).sum(1)
                parents.append(parent)
                centres.append(centre)
                radii.append(math.sqrt(away.max()) * (1 + 1e-9))
                if len(rows) <= leaf or radii[-1] == 0:
                    leaves.append((at, rows))
                    continue
                far = x[away.argmax()]
                half = np.argsort(x @ (x[((x - far) ** 2).sum(1).argmax()] - far), kind="stable")
                below += [(at, rows[np.sort(half[: len(half) // 2])]), (at, rows[np.sort(half[len(half) // 2 :])])]
            level = below
        self.centres, self.radii, self.parents = np.array(centres), np.array(radii), np.array(parents, int)
        dealt = np.concatenate([rows for _, rows in leaves]) if leaves else np.array([], int)
        self.ids, self.v = ids[dealt], v[dealt]
        self.leaves, self.sizes = np.array([at for at, _ in leaves], int), np.array([len(rows) for _, rows in leaves], int)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.leaf_labels = np.array([labels[rows[0]] for _, rows in leaves])
        self.visited = 0  # leaves whose rows were scored

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every node and each of the queries q, the least and the greatest inner product it can hold."""
        size = np.sqrt((q**2).sum(1))[:, None]
        mid, reach = q @ self.centres.T, size * self.radii
        slack = 1 + 1e-9 * (size * np.sqrt((self.centres**2).sum(1)) + reach)  # rounding
        low, high = mid - reach - slack, mid + reach + slack
        for level in self.levels[1:]:  # a node lies within its parent as well
            up = self.parents[level]
            low[:, level], high[:, level] = np.maximum(low[:, level], low[:, up]), np.minimum(high[:, level], high[:, up])
        return low, high

    def best(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, label: int, same: bool, k: int, window: tuple[float, float], omit: int) -> list[tuple[float, int]]:
        """The k rows (score, vec_id) of the same label, or of all others, with the highest scores within the window, ties to the smaller vec_id."""
        opened = (high >= window[0]) & (low <= window[1])
        for level in self.levels[1:]:
            opened[level] &= opened[self.parents[level]]
        some = np.flatnonzero(opened[self.leaves] & ((self.leaf_labels == label) == same))
        upper = high[self.leaves[some]]
        order = np.argsort(-upper, kind="stable")
        some, upper = some[order], upper[order]
        scores, ids, at, step = np.empty(0), np.empty(0, np.int64), 0, 8
        while at < len(some):
            # Only what is strictly beneath the kth score is left out.
            end = len(some) if len(ids) < k else int(np.searchsorted(-upper, -scores[-1], side="right"))
            part = some[at : min(at + step, end)]
            if not len(part):
                break
            self.visited += len(part)
            n = self.sizes[part]
            rows = np.repeat(self.starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            s, i = self.v[rows] @ q, self.ids[rows]
            fit = (s >= (window[0] if len(ids) < k else max(window[0], scores[-1]))) & (s <= window[1]) & (i != omit)
            s, i = np.r_[scores, s[fit]], np.r_[ids, i[fit]]
            first = np.lexsort((i, -s))[:k]
            scores, ids = s[first], i[first]
            at, step = at + step, 16
        return list(zip(scores.tolist(), ids.tolist()))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _exact(x: np.ndarray) -> np.ndarray:
    whole = np.empty(x.shape, object)
    whole[...] = [[int(e) for e in r] for r in x]
    return whole


def _plain(ids, labels, v, q, label, same, k, window, omit):
    """All rows of a block by Python integers, where doubles aren't exact."""
    fit = [(s, -i) for s, i, other in zip((v @ q).tolist(), ids.tolist(), labels.tolist()) if i != omit and (other == label) == same and window[0] <= s <= window[1]]
    return [(s, -i) for s, i in heapq.nlargest(k, fit)]


_FOUND = "anchor_id long, anchor_label long, positive_id long, positive_score long, vec_id long, score long"


def _meet(batches: Iterator[pa.RecordBatch], dim: int, k: int, same: bool, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by meeting, those of the index first."""
    key, parts, forest = None, [], None
    for b in batches:
        keys, anchor = b.column("key").to_pylist(), b.column("anchor").to_numpy(zero_copy_only=False)
        ids, labels, x = b.column("vec_id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("v"), dim)
        windows = b.column("windows").to_pylist()
        at, out = 0, []
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at] and anchor[end] == anchor[at]:
                end += 1
            if keys[at] != key:
                key, parts, forest = keys[at], [], None
            if not anchor[at]:
                parts.append((ids[at:end].copy(), labels[at:end].copy(), x[at:end].copy()))
            elif parts:
                if forest is None:
                    block = [np.concatenate(c) for c in zip(*parts)]
                    forest, parts = (block[0], block[1], _exact(block[2])) if not exact else Forest(*block), [()]
                out += _answers(forest, ids[at:end], labels[at:end], x[at:end], windows[at:end], k, same, exact)
            at = end
        clip = lambda s: min(max(int(s), -LONG), LONG - 1)
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c if n not in (3, 5) else [None if s is None else clip(s) for s in c], pa.int64()) for n, c in enumerate(columns)], names=[c.split()[0] for c in _FOUND.split(", ")])


def _answers(forest, ids, labels, x, windows, k, same, exact) -> list[tuple]:
    out: list[tuple] = []
    if len(ids) > AT_ONCE:
        for c in range(0, len(ids), AT_ONCE):
            part = slice(c, c + AT_ONCE)
            out += _answers(forest, ids[part], labels[part], x[part], windows[part], k, same, exact)
        return out
    low, high = forest.bounds(x) if exact else (None, None)
    for j, (a, label) in enumerate(zip(ids.tolist(), labels.tolist())):
        for w in windows[j]:
            ends = (w["low"], w["high"])
            if exact:
                best = forest.best(x[j], low[j], high[j], label, same, k, ends, a)
            else:
                # Shares of whole numbers are taken as whole numbers again.
                p = w["positive_score"]
                ends = ends if p is None else (-(-w["low_share"] * p // 100), w["high_share"] * p // 100)
                best = _plain(*forest, _exact(x[j : j + 1])[0], label, same, k, ends, a)
            out += [(a, label, w["positive_id"], w["positive_score"], i, s) for s, i in best]
    return out


def _search(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], dim: int, k: int, same: bool, exact: bool) -> DataFrame:
    """For each anchor and each of its windows the best k rows of every block."""
    n, n_anchors = (max(1, math.ceil(x / y)) for x, y in zip(sizes, (BLOCK_ROWS, BLOCK_ANCHORS)))
    number = lambda of, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(of))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    none = F.array().cast(anchors.schema["windows"].dataType)
    index = rows.withColumn("i", number(n, "row")).withColumn("j", every(n_anchors)).select(F.concat_ws("/", "i", "j").alias("key"), F.lit(False).alias("anchor"), "vec_id", "label", "v", none.alias("windows"))
    asked = anchors.withColumn("j", number(n_anchors, "anchor")).withColumn("i", every(n)).select(F.concat_ws("/", "i", "j").alias("key"), F.lit(True).alias("anchor"), "vec_id", "label", "v", "windows")
    met = index.unionByName(asked).repartition(n * n_anchors, "key").sortWithinPartitions("key", "anchor")
    return met.mapInArrow(lambda it: _meet(it, dim, k, same, exact), _FOUND)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score: for each anchor and each of its positives the hard negatives whose score is low to high percent of the positive's."""
    rows = stored(quantised(vectors, F.col("label") if label is None else label, scale))
    n, dim, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dim, exact = max(dim or 0, 1), (most or 0.0) ** 2 * max(dim or 0, 1) * 100 < EXACT
    asked = rows.where(is_anchor)
    sizes = (n, asked.count())
    window = "array<struct<low: double, high: double, low_share: int, high_share: int, positive_id: bigint, positive_score: bigint>>"
    spell = lambda a, b, i, s: F.struct(a.alias("low"), b.alias("high"), F.lit(low).alias("low_share"), F.lit(high).alias("high_share"), i.alias("positive_id"), s.alias("positive_score"))
    nothing = F.lit(None).cast("long")
    everything = asked.withColumn("windows", F.array(spell(F.lit(float("-inf")), F.lit(float("inf")), nothing, nothing)).cast(window))
    near = _search(rows, everything, sizes, dim, positives, True, exact)
    place = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = stored(near.withColumn("p", F.row_number().over(place)).where(F.col("p") <= positives))
    # low * p <= 100 * s <= high * p in whole numbers; where doubles aren't exact, tasks find the ends themselves.
    over, under = f"-((-score * {low} - pmod(-score * {low}, 100)) div 100)", f"(score * {high} - pmod(score * {high}, 100)) div 100"
    ends = [F.expr(e if exact else "0").cast("double") for e in (over, under)]
    windows = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(spell(*ends, F.col("vec_id"), F.col("score"))).alias("w"))
    found = _search(rows, asked.join(windows, "vec_id").select("vec_id", "label", "v", F.col("w").cast(window).alias("windows")), sizes, dim, negatives, False, exact)
    place = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
