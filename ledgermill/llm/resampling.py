"""Importance resampling towards a target distribution, over hashed n-gram features.

Features are runs of consecutive words, counted in buckets by their checksum.
A bucket's gain is the log ratio of its smoothed shares of the target's and of
the corpus's features; a document's weight is the mean gain of its features; a
draw takes the highest weights with Gumbel noise, which is sampling without
replacement in proportion to exp(weight).

Texts are worked on in chunks: texts of over CHUNK_BYTES are split at word
boundaries and their chunks dealt out anew, so that a few very long texts don't
make slow tasks. A chunk owns the n-grams that start in it and carries the
next n - 1 words, so that the last of these are whole; counts and sums of gains
are added up by document. Splitting looks at a few bytes around each cut only.
A word is never cut: one of many megabytes makes one chunk.

Counts over the corpus come by bucket from every task (at most `buckets` rows
each); gains are an array of `buckets` numbers. Texts are read twice, for the
counts and for the weights. Ranks come from ranges (ranges.ranked).

Defined cases: null and empty texts have no features and weight 0; rows that
repeat a doc_id or a whole row stay rows of their own; a null doc_id has the noise
of an empty number and ranks last among equal scores; empty tables give empty results,
and without benchmark texts T and t are 0; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import stored
from ledgermill.llm.ranges import ranked

CHUNK_BYTES = 1 << 15
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_CHUNKS = "uid long, doc_id long, own long, body binary"


def chunks(text: bytes, n: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(own, body) of each chunk of a text: n-grams that start before own are the chunk's, the rest of the body completes them."""
    begin = 0
    while len(text) - begin > size:
        gap = _GAP.search(text, begin + size)
        if gap is None:
            break
        cut = end = gap.start()
        for _ in range(n - 1):
            word = re.compile(rb"[0-9A-Za-z\x80-\xff]+").search(text, end)
            if word is None:
                break
            end = word.end()
        yield cut - begin, text[begin:end]
        begin = cut
    yield len(text) - begin, text[begin:]


def grams(own: int, body: bytes, least: int, most: int) -> list[bytes]:
    """The runs of least to most words that start before own."""
    low = body.lower()  # of bytes: A-Z alone
    if most == 1:
        return WORD.findall(low, 0, own) if least == 1 else []
    found = [(m.start(), m.group()) for m in WORD.finditer(low)]
    words = [w for _, w in found]
    n_own = sum(at < own for at, _ in found)
    return [b" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(n_own) if i + n <= len(words)]


def _buckets(own: int, body: bytes, least: int, most: int, buckets: int) -> np.ndarray:
    found = grams(own, body, least, most)
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found)) % buckets


def chunked(docs: DataFrame, n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """uid, doc_id, own and body of the only chunk of every short text (uid is null; null texts are empty), and of the chunks of long texts, which are dealt out anew."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    long = F.octet_length("text") > size
    short = rows.where(~long).select(F.lit(None).cast("long").alias("uid"), "doc_id", F.octet_length("text").cast("long").alias("own"), F.col("text").alias("body"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u, d, t in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                held = []
                for own, body in chunks(t.as_py(), n, size):
                    held.append((u, d, own, body))
                    if len(held) == 64:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    # Numbers hold within the one job that makes, deals and adds up the chunks.
    cut = rows.where(long).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(split, _CHUNKS)
    return short, cut.repartition(F.xxhash64("uid", F.crc32("body")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["uid", "doc_id", "own", "body"])


def counted(docs: DataFrame, least: int, most: int, buckets: int, size: int = CHUNK_BYTES) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for own, body in zip(b.column("own").to_pylist(), b.column("body")):
                total += np.bincount(_buckets(own, body.as_py(), least, most, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    short, long = chunked(docs, most, size)
    found = short.unionByName(long).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Of every bucket floor(1000 ln of the ratio of its smoothed shares)."""
    b = len(target)
    return np.floor(1000 * np.log((target + 1) * float(corpus.sum() + b) / ((corpus + 1) * float(target.sum() + b)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, least: int, most: int, size: int = CHUNK_BYTES) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_features and weight."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total, words = [], [], []
            for own, body in zip(b.column("own").to_pylist(), b.column("body")):
                body = body.as_py()
                found = _buckets(own, body, least, most, len(held.value))
                n.append(len(found))
                total.append(int(held.value[found].sum()))
                words.append(len(found) if least == most == 1 else len(grams(own, body, 1, 1)))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, total, words))], names=["uid", "doc_id", "n", "total", "words"])

    short, long = (part.mapInArrow(weigh, "uid long, doc_id long, n long, total long, words long") for part in chunked(docs, most, size))
    whole = long.groupBy("uid", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n", "total", "words")])
    floored = F.when(F.col("n") > 0, F.expr("(total - pmod(total, n)) div n")).otherwise(F.lit(0)).cast("long")
    return short.unionByName(whole).select("doc_id", F.col("words").alias("n_words"), F.col("n").alias("n_features"), floored.alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    least, most = n
    gain = gains(counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), least, most, buckets, chunk_bytes), counted(docs, least, most, buckets, chunk_bytes))
    scored = weighed(docs, gain, least, most, chunk_bytes)
    scored = stored(scored.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")))
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    placed = ranked(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")])
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    both = placed.withColumn("rank", rank).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return both.select("doc_id", "n_features", "weight", "score", "rank")
