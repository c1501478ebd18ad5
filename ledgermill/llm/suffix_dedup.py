"""Exact removal of byte strings that an earlier document has, by suffix arrays over shards.

A byte goes if it lies in a string of LENGTH bytes that also starts in a
document with a smaller doc_id. The documents' suffixes can't be sorted in one
place; so equal strings are brought together by their content:

1. Texts are shuffled once, into a table of buckets by document; whatever is
   found about a document later joins this table where it lies.
2. The anchor of a string is the least hash of its GRAM-byte pieces. Equal
   strings have equal anchors. Consecutive strings of one anchor are one group;
   a document has one group in about (LENGTH - GRAM + 2) / 2 bytes, and a run of
   a repeated piece, however long, is one group. Anchors are dealt to shards;
   only those that two documents have go on.
3. The bytes of a group with such an anchor form a segment, which goes to the
   anchor's shard. Equal strings so lie in segments of one shard.
4. A shard's distinct segments are joined, their suffix array is induced
   (suffix_array.py), and permuted common prefixes of LENGTH or more make groups
   of equal strings with the least doc_id of each. Strings whose document is not
   the least are reported, as spans of their document.

Tasks read their documents in batches, and what leaves a batch names documents
by their place in it; a row with the batch's documents goes along. What many
documents share is reduced there: of the documents of a batch that have a
segment in common, only the least one's bytes go to the shard, once. Documents
that are equal as a whole are settled by their checksums.

Defined cases: null text counts as empty; rows that repeat a document (same
doc_id and text) don't shorten each other; rows without doc_id are neither
shortened nor compared; documents under LENGTH bytes stay as they are. Cuts may
split a character: `kept_text` gives whole characters of the rest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import BROADCAST_ROWS, bounded, bucketed, fresh, stored
from ledgermill.llm.ngram_join import by_key
from ledgermill.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH, GRAM = 50, 24
#: Bytes of text for one shard of segments, one shard of anchors, one bucket of documents.
SHARD_BYTES, ANCHOR_BYTES, BUCKET_BYTES, MAX_BUCKETS = 8_000_000, 32_000_000, 16_000_000, 50_000
#: Documents (their numbers take two bytes), and bytes, that a task reduces together.
BATCH_DOCS, BATCH_BYTES = 8_000, 24_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(8)]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of every piece of GRAM (16 + 8) bytes."""
    h = b.astype(np.uint64) + np.uint64(1)
    by = {}
    for k in range(4):
        h = h[: len(h) - (1 << k)] * _POWERS[k] + h[1 << k :]
        by[2 << k] = h
    n = len(b) - GRAM + 1
    h = by[16][:n] * _POWERS[3] + by[8][16 : 16 + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's bytes, for each group of consecutive strings with one anchor: the anchor, the first string and the one after the last."""
    n = len(b) - LENGTH + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    m = gram_hashes(b)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    m = np.minimum(m[:n], m[width - span : width - span + n])
    first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    return m[first], first, np.r_[first[1:], n]


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)]).tolist()
    return list(zip(at, [*at[1:], len(x)])) if at else []


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


class _Batch:
    """Documents that a task reduces together, in the order of doc_id. `number` is the batch's own among all of the job."""

    def __init__(self, number: int, rows: list[tuple[int, int, bytes, bytes]]):
        self.number = number
        self.rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.uids = np.array([r[0] for r in self.rows], np.int64)
        self.docs = np.array([r[1] for r in self.rows], np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    """Rows of uid, doc_id, text and, if there are any, anchors. Tasks that run again read the same stored rows, so numbers mean the same then."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        claimed = b.column(3).to_pylist() if b.num_columns > 3 else [b""] * b.num_rows
        for uid, doc, text, claims in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), claimed, strict=True):
            raw = text.as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            held.append((uid, doc, raw, claims))
            size += len(raw)
            if len(held) >= BATCH_DOCS or size >= BATCH_BYTES:
                yield _Batch(number, held)
                number, held, size = number + 1, [], 0
    if held:
        yield _Batch(number, held)


def _table(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _keys(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard and 32 further bits: what is known of an anchor later. Should two anchors share it, the segments tell them apart."""
    return (_shard(h, shards).astype(np.int64) << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


#: Rows for shards. kind 0: work for the shard; on their way to their batch, 1: what is found already; 2: the batch's documents.
DEALT = "shard int, kind int, batch long, which binary, a binary, b binary"
_DEALT = ([pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3], ["shard", "kind", "batch", "which", "a", "b"])
#: Rows for batches: places of documents, and what is found about each (anchors' keys, or starts and ends).
FOUND = "batch long, kind int, which binary, a binary, b binary"
_FOUND = ([pa.int64(), pa.int32(), *[pa.binary()] * 3], ["batch", "kind", "which", "a", "b"])


def _documents(batch: _Batch, shards: int) -> tuple:
    return (batch.number % shards, 2, batch.number, b"", batch.uids.tobytes(), batch.docs.tobytes())


def _forwarded(t: pa.Table) -> pa.Table:
    """Rows of a shard that are only on their way to their batch."""
    return t.filter(pc.greater(t["kind"], 0)).select(["batch", "kind", "which", "a", "b"])


def _anchor_rows(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """For each shard: the batch's anchors (one entry where its documents share one, which they claim at once) and whether they are shared."""
    for batch in _batches(batches):
        hs = [np.unique(anchors(np.frombuffer(raw, np.uint8))[0]) for _, _, raw, _ in batch.rows]
        h, doc = np.concatenate(hs), np.repeat(np.arange(len(hs)), [len(x) for x in hs]).astype(np.uint16)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        many = np.diff(np.r_[start, len(h)])
        shared = np.repeat(many > 1, many)
        out = [_documents(batch, shards)]
        if shared.any():
            out.append((batch.number % shards, 1, batch.number, doc[shared].tobytes(), _keys(h[shared], shards).tobytes(), b""))
        x, d, again = h[start], doc[start], many > 1
        s = _shard(x, shards)
        order = np.argsort(s, kind="stable")
        x, d, again, s = x[order].astype(np.uint32), d[order], again[order], s[order]
        out += [(int(s[i]), 0, batch.number, d[i:j].tobytes(), x[i:j].tobytes(), np.packbits(again[i:j]).tobytes()) for i, j in _runs(s)]
        yield _table(out, *_DEALT)


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Claims of the anchors that two batches have; those shared within a batch are claimed there already."""
    for group in by_key(batches, "shard"):
        t = pa.Table.from_batches(group)
        yield from _forwarded(t).to_batches()
        work = t.filter(pc.equal(t["kind"], 0))
        if not len(work):
            continue
        shard = work["shard"][0].as_py()
        parts = [np.frombuffer(x.as_py(), np.uint32) for x in work["a"]]
        size = np.array([len(x) for x in parts])
        h, which = np.concatenate(parts), np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in work["which"]])
        again = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(work["b"], size, strict=True)])
        row = np.repeat(np.arange(len(parts), dtype=np.int32), size)
        order = np.argsort(h, kind="stable")
        many = np.diff(np.r_[np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]), len(h)])
        keep = np.zeros(len(h), bool)
        keep[order] = np.repeat(many > 1, many)
        keep &= ~again
        h, which, row = h[keep], which[keep], row[keep]  # still in the order of rows
        number = work["batch"].to_numpy()
        keys = h.astype(np.int64) | (shard << 32)
        yield _table([(int(number[row[i]]), 1, which[i:j].tobytes(), keys[i:j].tobytes(), b"") for i, j in _runs(row)], *_FOUND)


def _by_document(found: DataFrame, name: str, partitions: int, merge: bool) -> DataFrame:
    """uid, doc_id and what is found about it (keys of anchors, or maximal runs of starts and ends), from the rows of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, "batch"):
            t = pa.Table.from_batches(group)
            of = t.filter(pc.equal(t["kind"], 2))
            rest = t.filter(pc.equal(t["kind"], 1))
            if not len(rest):
                continue
            uids, docs = np.frombuffer(of["a"][0].as_py(), np.int64), np.frombuffer(of["b"][0].as_py(), np.int64)
            col = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in rest[c]])  # noqa: E731, B023
            which, a = col("which", np.uint16), col("a", np.int64)
            order = np.argsort(which, kind="stable")
            if merge:
                b = col("b", np.int64)[order]
            which, a = which[order], a[order]
            rows = []
            for i, j in _runs(which):
                value = merged(a[i:j], b[i:j]) if merge else a[i:j]
                rows.append((int(uids[which[i]]), int(docs[which[i]]), value.tobytes()))
                if len(rows) == 1000:
                    yield _table(rows, [pa.int64(), pa.int64(), pa.binary()], ["uid", "doc_id", "found"])
                    rows = []
            yield _table(rows, [pa.int64(), pa.int64(), pa.binary()], ["uid", "doc_id", "found"])

    rows = found.repartition(partitions, "batch").sortWithinPartitions("batch")
    # Rows that repeat a document get what each of them is found to have.
    return rows.mapInArrow(run, "uid long, doc_id long, found binary").withColumnRenamed("found", name)


def _segment_rows(batches: Iterator[pa.RecordBatch], anchor_shards: int, shards: int) -> Iterator[pa.RecordBatch]:
    """For each shard: the batch's segments around shared anchors, once each with the least document's number and all its places there; other documents that have one of them lose it at once.

    which: numbers; a: doc_ids, starts and sizes (of a segment's further places: -1 - the entry that has its bytes); b: bytes.
    """
    for batch in _batches(batches):
        by: dict[int, tuple[list, list]] = {}
        seen: dict[bytes, tuple[int, int]] = {}
        done: list[tuple[int, int, int]] = []
        for k, (_, doc, raw, claims) in enumerate(batch.rows):
            h, first, last = anchors(np.frombuffer(raw, np.uint8))
            ok = np.isin(_keys(h, anchor_shards), np.frombuffer(claims, np.int64))
            for s, i, j in zip(_shard(h[ok], shards).tolist(), first[ok].tolist(), (last[ok] + LENGTH - 1).tolist(), strict=True):
                segment = raw[i:j]
                entries, data = by.setdefault(s, ([], []))
                least, entry = seen.setdefault(segment, (doc, len(entries)))
                if least < doc:
                    done.append((k, i, j))
                elif entry == len(entries):
                    entries.append((k, doc, i, j - i))
                    data.append(segment)
                else:
                    entries.append((k, doc, i, -1 - entry))
        out = [_documents(batch, shards)]
        for s, (entries, data) in by.items():
            if entries:
                e = np.array(entries, np.int64)
                out.append((s, 0, batch.number, e[:, 0].astype(np.uint16).tobytes(), e[:, 1].tobytes() + e[:, 2].astype(np.int32).tobytes() + e[:, 3].astype(np.int32).tobytes(), b"".join(data)))
        if done:
            e = np.array(done, np.int64)
            out.append((batch.number % shards, 1, batch.number, e[:, 0].astype(np.uint16).tobytes(), e[:, 1].tobytes(), e[:, 2].tobytes()))
        yield _table(out, *_DEALT)


def repeated(segments: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct segments joined (each with a separator after it): each position's least document that has the same string (-1 where no string starts), and the segments' places. least: the least document of each segment."""
    sizes = np.array([len(s) for s in segments])
    text = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
    begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
    inside = np.ones(len(text), bool)
    inside[begin + sizes] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    sa = suffix_array(text)
    common = permuted_prefixes(text, sa)
    owner = np.repeat(least, sizes + 1)
    end = np.repeat(begin + sizes, sizes + 1)
    starts = np.arange(len(text)) + LENGTH <= end
    group = np.flatnonzero(common[sa] < LENGTH)
    lowest = np.minimum.reduceat(owner[sa], group)
    out = np.empty(len(text), np.int64)
    out[sa] = np.repeat(lowest, np.diff(np.r_[group, len(sa)]))
    out[~starts] = -1
    return out, begin


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of every document that isn't the first to have a string, for each batch."""
    for group in by_key(batches, "shard"):
        t = pa.Table.from_batches(group)
        yield from _forwarded(t).to_batches()
        work = t.filter(pc.equal(t["kind"], 0))
        if not len(work):
            continue
        number: dict[bytes, int] = {}
        cols: list[list] = [[], [], [], [], []]
        for row, (w, a, b) in enumerate(zip(work["which"].to_pylist(), work["a"].to_pylist(), work["b"].to_pylist(), strict=True)):
            n = len(w) // 2
            doc, start, size = np.frombuffer(a, np.int64, n), np.frombuffer(a, np.int32, n, 8 * n), np.frombuffer(a, np.int32, n, 12 * n).astype(np.int64)
            segment, at = np.empty(n, np.int64), 0
            for k, length in enumerate(size.tolist()):
                if length >= 0:
                    segment[k] = number.setdefault(b[at : at + length], len(number))
                    at += length
            again = np.flatnonzero(size < 0)
            segment[again] = segment[-1 - size[again]]
            for c, x in zip(cols, (np.full(n, row, np.int64), np.frombuffer(w, np.uint16), doc, start.astype(np.int64), segment), strict=True):
                c.append(x)
        row, which, doc, start, segment = map(np.concatenate, cols)
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, segment, doc)
        lowest, begin = repeated(list(number), least)
        size = np.diff(np.r_[begin, len(lowest)]) - 1
        # All strings of a segment are earlier in a document that isn't the least to have the segment.
        whole = doc > least[segment]
        out = [(np.flatnonzero(whole), start[whole], (start + size[segment])[whole])]
        own = np.repeat(least, size + 1)
        gone = (lowest >= 0) & (lowest < own)
        if gone.any():
            edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            of = np.searchsorted(begin, a, side="right") - 1
            first = np.searchsorted(of, np.arange(len(number)))
            runs = np.bincount(of, minlength=len(number))
            k = np.flatnonzero(~whole & (runs[segment] > 0))
            n = runs[segment[k]]
            run = np.repeat(first[segment[k]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            k = np.repeat(k, n)
            shift = start[k] - begin[segment[k]]
            out.append((k, a[run] + shift, b[run] - 1 + LENGTH + shift))
        entry, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(row[entry], kind="stable")
        entry, a, b = entry[order], a[order], b[order]
        batch = work["batch"].to_numpy()
        yield _table([(int(batch[row[entry[i]]]), 1, which[entry[i:j]].tobytes(), a[i:j].tobytes(), b[i:j].tobytes()) for i, j in _runs(row[entry])], *_FOUND)


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal removed runs (rows of start and end) from spans."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    at = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return np.stack([start[at], reach[np.r_[at[1:], len(start)] - 1]], axis=1).astype(np.int64)


def _pairs(spans: bytes) -> list[list[int]]:
    return np.frombuffer(spans, np.int64).reshape(-1, 2).tolist()


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for a, b in runs:
        out.append(raw[last:a])
        last = b
    return b"".join([*out, raw[last:]])


def _uid() -> Column:
    """Names a document's text; joins go by it and doc_id together."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _facts(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n_bytes, sha256 and copy (an earlier document has the same text of LENGTH bytes or more) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    facts = stored(texts.select(_uid().alias("uid"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))
    least = facts.groupBy("sha256").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("sha256", "least")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    return stored(facts.join(bounded(stored(least), BROADCAST_ROWS), "sha256", "left").select("uid", "doc_id", "n_bytes", "sha256", copy.alias("copy")), facts)


def _dealt(docs: DataFrame, facts: DataFrame, uid: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """The documents that are compared, stored in buckets by `uid` and `doc` (columns put in front; whoever joins them needs no shuffle of texts), and spans: uid, doc_id and packed runs of those that lose bytes."""
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    part = lambda size: max(4, math.ceil(total / size))
    buckets, anchor_shards, shards = min(MAX_BUCKETS, part(BUCKET_BYTES)), part(ANCHOR_BYTES), part(SHARD_BYTES)
    copies = facts.where("copy").select(F.col("uid").alias(uid), F.col("doc_id").alias(doc)).distinct()
    rows = docs.where("doc_id is not null").where(F.octet_length("text") >= LENGTH).select(_uid().alias(uid), F.col("doc_id").cast("long").alias(doc), "*")
    table = bucketed(rows.join(bounded(stored(copies), BROADCAST_ROWS), [uid, doc], "left_anti"), buckets, uid, doc)
    texts = table.select(F.col(uid).alias("uid"), F.col(doc).alias("doc_id"), F.col("text").cast("string").alias("text"))
    claims = texts.mapInArrow(lambda it: _anchor_rows(it, anchor_shards), DEALT).repartition(anchor_shards, "shard").sortWithinPartitions("shard")
    claims = _by_document(claims.mapInArrow(_shared_anchors, FOUND), "anchors", buckets, False).repartition(buckets, "uid", "doc_id").dropDuplicates(["uid", "doc_id"])
    segments = texts.join(claims, ["uid", "doc_id"]).select("uid", "doc_id", "text", "anchors").mapInArrow(lambda it: _segment_rows(it, anchor_shards, shards), DEALT)
    settled = segments.repartition(2 * shards, "shard").sortWithinPartitions("shard").mapInArrow(_settled, FOUND)
    return table, stored(_by_document(settled, "spans", buckets, True).dropDuplicates(["uid", "doc_id"]))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    facts = _facts(docs)
    table, spans = _dealt(docs.select("doc_id", "text"), facts, "lm_uid", "lm_doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for uid, doc, text, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                runs = _pairs(packed)
                rows.append((uid, doc, sum(y - x for x, y in runs), len(runs), hashlib.sha256(kept_bytes(text.as_py().encode(), runs)).hexdigest()))
            yield _table(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()], ["uid", "doc_id", "n_removed", "n_spans", "kept"])

    found = spans.select(F.col("uid").alias("lm_uid"), F.col("doc_id").alias("lm_doc"), "spans")
    shorter = table.join(found, ["lm_uid", "lm_doc"]).select("lm_uid", "lm_doc", F.col("text").cast("string"), "spans").mapInArrow(cut, "uid long, doc_id long, n_removed long, n_spans long, kept string")
    shorter = shorter.dropDuplicates(["uid", "doc_id"])  # of repeated rows
    out = facts.join(shorter, ["uid", "doc_id"], "left")
    copy, none = F.col("copy"), F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )


def kept_text(text: str | None, spans: bytes | None) -> str | None:
    """text without its removed runs; bytes of a character that a cut split go too."""
    return text if text is None or not spans else kept_bytes(text.encode(), _pairs(spans)).decode("utf-8", "ignore")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with what earlier documents have taken out of `text`, other columns as they are; rows of which nothing is left go."""
    uid, doc, packed = fresh(docs, "lm_uid", "lm_doc", "lm_spans")
    table, spans = _dealt(docs, _facts(docs), uid, doc)
    keep = docs.columns
    rows = table.join(spans.select(F.col("uid").alias(uid), F.col("doc_id").alias(doc), F.col("spans").alias(packed)), [uid, doc], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            old = b.column(at)
            found = b.column(b.schema.get_field_index(packed))
            texts = [kept_text(t.as_py(), s.as_py()) if s.is_valid else t.as_py() for t, s in zip(old, found, strict=True)]
            left = pa.array([not s.is_valid or bool((t or "").strip()) for t, s in zip(texts, found, strict=True)])
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).select(keep).filter(left)

    # What isn't compared stays as it is.
    others = docs.where(f"doc_id is null or text is null or octet_length(text) < {LENGTH}")
    return rows.select(*keep, packed).mapInArrow(cut, docs.schema).unionByName(others)
