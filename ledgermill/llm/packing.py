"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Documents are tokenised, closed with an end id, and cut into pieces only where
they are longer than a sequence. Best-fit decreasing takes the pieces from the
longest to the shortest and puts each where it leaves the least room. What it
does depends on the pieces' lengths alone, and pieces of one length are
interchangeable: so the driver runs it over the histogram of lengths (at most
`capacity` rows, at any size of input) and finds the tightest open sequence with
a segment tree over remaining capacities, for all pieces that go to equally full
sequences in one step. The result is a list of runs: pieces number a to b of one
length go to sequences s, s+1, ... with q in each, from an offset on. Executors
number the pieces of each length and look up their runs.

Defined cases: null text counts as empty (its only token is the end id); rows
that repeat a document are packed as often as they occur; empty input gives no
rows; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import BROADCAST_ROWS, bounded, stored

CAPACITY = 4096
END = 1
#: Words whose ids a worker keeps.
MEMO_WORDS = 400_000
#: Pieces of one length numbered by one task at a time.
RANK_ROWS = 10_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words(dict):
    """Ids (packed, 32 bits each) by word, for a tokenizer that treats words separately.

    Texts of common Latin characters are split here, by the tokenizer's own pattern; any other text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.load(open(path))
        self.simple = [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        known = [chr(c) for c in range(0x250) if not 0x1C <= c <= 0x1F and c != 0x85]
        of = lambda kind: "".join(re.escape(c) for c in known if unicodedata.category(c)[0] == kind)
        letters, numbers = of("L"), of("N")
        for a, b in (("[\\p{L}]", f"[{letters}]"), ("[\\p{N}]", f"[{numbers}]"), ("\\p{L}", letters), ("\\p{N}", numbers)):
            pattern = pattern.replace(a, b)
        self.split = re.compile(pattern).findall
        self.odd = re.compile(f"[^{re.escape(''.join(known))}–—‘’“”…•€™]").search

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = ids = self.whole(word)
        return ids

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not self.simple or self.odd(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.split(text.lower())))


@functools.lru_cache(1)
def words(path: str) -> Words:
    return Words(path)


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encode, end = words(path).encode, struct.pack("<I", END)
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py() or "") + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                piece = ids[at : at + 4 * capacity]
                out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document with their lengths and checksums."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _cut(it, path, capacity), PIECES)


class Capacities:
    """A segment tree over remaining capacities 0 to n: which have open sequences."""

    def __init__(self, n: int):
        self.size = 1 << (n + 1).bit_length()
        self.any = bytearray(2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]

    def put(self, room: int, first: int, count: int) -> None:
        """Sequences first to first + count - 1 have so much room now."""
        self.ranges[room].append((first, count))
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i //= 2

    def take(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        if not self.ranges[room]:
            i = room + self.size
            self.any[i] = 0
            while i > 1 and not self.any[i ^ 1]:
                i //= 2
                self.any[i] = 0
        return out

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of need or more: up from the leaf to the first right sibling that has some, then down its left edge."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i ^ 1]:
                i ^= 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces in a sequence, offset of its first) and the number of sequences. Runs of one length follow one another."""
    rooms, runs, opened = Capacities(capacity), [], 0
    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            left, room = count - rank, rooms.tightest(length)
            if room is None:
                each = capacity // length
                full = max(1, left // each)
                first, many, room = opened, full, capacity
                opened += full
            else:
                first, many = rooms.take(room)
            # The tightest sequence stays the tightest until no further piece fits: it takes `each` at once.
            each = room // length
            full = min(many, left // each)
            if not full:
                each, full = left, 1
            runs.append((length, rank, first, each, capacity - room))
            rooms.put(room - each * length, first, full)
            if many > full:
                rooms.put(room, first + full, many - full)
            rank += each * full
    return runs, opened


def _ranked(rows: DataFrame, histogram: list[tuple[int, int]]) -> DataFrame:
    """rows with `rank`: gapless numbers from 0 among pieces of one length; a length is numbered in as many parts as its own count needs."""
    many = {n: math.ceil(count / RANK_ROWS) for n, count in histogram if count > RANK_ROWS}
    parts = F.lit(1)
    if many:
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), F.col("length")), parts)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), parts).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    return rows.withColumn("place", F.row_number().over(inside)).join(bounded(stored(starts), BROADCAST_ROWS), ["length", "part"]).withColumn("rank", (F.col("first") + F.col("place") - 1).cast("long"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = stored(pieces(docs, path, capacity))
    histogram = [tuple(r) for r in cut.groupBy("length").count().collect()]  # at most `capacity` rows
    runs, _ = best_fit(histogram, capacity)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    held = docs.sparkSession.sparkContext.broadcast(table)  # its size follows from the capacity, not from the input

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_, rank_, first, each, offset = held.value.T
        keys = (length_ << 44) + rank_
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            n = rank - rank_[k]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[k] + n // each[k]), pa.array(offset[k] + n % each[k] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = _ranked(cut, histogram)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
