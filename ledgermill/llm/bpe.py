"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes if and only if every two
neighbours are: the merges, run on the two tokens' bytes alone, give the two
tokens back. So every prefix of a piece has an encoding that ends in one last
token, and that token extends the encoding of the shorter prefix before it.
This makes encoding a finite-state transduction from left to right. A state
holds the bytes that a future token may still start in (the longest suffix
that begins some token) and, for each position in them, the tokens since the
last boundary that all positions share. A byte leads to the state where the
one compatible token ending there has been added; tokens on which all
positions agree are emitted, which takes a lookahead of no more than a few
tokens. States and transitions are made when first met ("lazy") and forgotten
together once there are too many; whether two tokens are compatible is
compiled from the merges when first asked.

Pieces are encoded separately, as the pattern splits the text, so a worker
also keeps the transducer's output for whole pieces. Decoding feeds token bytes
to an incremental UTF-8 machine whose steps are remembered by (state, token);
bytes that are not UTF-8 come out as U+FFFD.

Defined cases: null text counts as empty (no tokens, the checksums of nothing);
texts of any length are encoded whole; repeated documents row by row.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_PIECES = 400_000
MEMO_STATES = 250_000
MEMO_STEPS = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class State:
    __slots__ = ("window", "last", "paths", "next")

    def __init__(self, window: bytes, last: tuple, paths: tuple):
        #: last and paths: for each position in window, the token that ends there (None at a piece's start) and the tokens not yet emitted.
        self.window, self.last, self.paths, self.next = window, last, paths, {}


class Transducer:
    """Encodes the bytes of one piece into tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.beginnings = {t[:i] for t in ranks for i in range(1, len(t))}
        self.longest = max(map(len, ranks), default=1)
        self.token = {v: k for k, v in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.start = State(b"", (None,), ((),))
        self.states = {(b"", (None,), ((),)): self.start}

    def merged(self, piece: bytes) -> list[bytes]:
        """What the merges make of a few bytes."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get, none = self.ranks.get, 1 << 60
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, left: int | None, right: int) -> bool:
        if left is None:
            return True
        if (known := self.fits.get((left, right))) is None:
            if len(self.fits) >= MEMO_STEPS:
                self.fits.clear()
            a, b = self.token[left], self.token[right]
            known = self.fits[left, right] = a + b not in self.ranks and self.merged(a + b) == [a, b]
        return known

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The transition for a byte: the state after it and the tokens that are certain now."""
        read = state.window + bytes((byte,))
        n = len(read)
        for at in range(n):
            token = self.ranks.get(read[at:])
            if token is not None and self.compatible(state.last[at], token):
                break
        last, paths = (*state.last, token), (*state.paths, (*state.paths[at], token))
        keep = next((i for i in range(max(0, n - self.longest), n) if read[i:] in self.beginnings), n)
        window, last, paths = read[keep:], last[keep:], list(paths[keep:])
        same, short = 0, paths[0]
        if len(paths) == 1:
            same = len(short)
        elif short:
            low, high = min(paths), max(paths)  # their common beginning is that of all
            while same < len(low) and same < len(high) and low[same] == high[same]:
                same += 1
        # Paths agree as tokens only if they agree as boundaries: each starts at the boundary that all share.
        emitted = paths[0][:same]
        key = (window, last, tuple(p[same:] for p in paths))
        if (after := self.states.get(key)) is None:
            after = self.states[key] = State(*key)
        state.next[byte] = after, emitted
        return after, emitted

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if len(self.states) > MEMO_STATES:
            self.reset()
        state, out = self.start, []
        for byte in piece:
            known = state.next.get(byte)
            state, emitted = known if known is not None else self.step(state, byte)
            if emitted:
                out += emitted
                if len(self.states) > 4 * MEMO_STATES:  # within one very long piece: keep the place, forget the rest
                    self.reset()
                    state = self.states[state.window, state.last, state.paths] = State(state.window, state.last, state.paths)
        return (*out, *state.paths[-1])


class Utf8:
    """The incremental machine: pending bytes of a character are its state."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.steps: dict[bytes, dict[int, tuple[bytes, str]]] = {}

    @staticmethod
    def feed(pending: bytes, data: bytes) -> tuple[bytes, str]:
        """Characters completed by data, and the bytes still pending: the longest end that may begin a character."""
        out, data = [], pending + data
        i = 0
        while i < len(data):
            b = data[i]
            need = 1 if b < 0x80 else 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            k = i + 1
            while need and k < min(i + need, len(data)) and low <= data[k] <= high:
                k, low, high = k + 1, 0x80, 0xBF
            if need and k == i + need:
                out.append(data[i:k].decode())
            elif need and k == len(data):
                return data[i:], "".join(out)
            else:
                out.append("�")  # the bytes up to where the character broke off
            i = k
        return b"", "".join(out)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        state = b""
        steps = self.steps.setdefault(state, {})
        for t in ids:
            known = steps.get(t)
            if known is None:
                if len(steps) >= MEMO_STEPS:
                    steps.clear()
                known = steps[t] = self.feed(state, self.token[t])
            after, text = known
            if after != state:
                state, steps = after, self.steps.setdefault(after, {})
            yield text
        if state:
            yield "�"


class Codec(dict):
    """Token ids (and their decimal string) by piece of text; encode and decode for whole texts."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(load_ranks(path))
        self.machine = Utf8(self.transducer.token)
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str]:
        ids = self.transducer.encode(piece.encode())
        if len(piece) > 200:  # odd long pieces don't repeat
            return ids, " ".join(map(str, ids))
        if len(self) >= MEMO_PIECES:
            self.clear()
        self[piece] = out = ids, " ".join(map(str, ids))
        return out

    def encode(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        return list(map(self.__getitem__, self.split(text)))

    def encode_ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(p[0] for p in self.encode(text)))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.machine.decode(ids))


@functools.lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode_ids(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = [c.decode(x.as_py() or ()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded again in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            n, ids, decoded = [], [], []
            for text in b.column(1):
                parts = c.encode(text.as_py() or "")
                tokens = list(chain.from_iterable(p[0] for p in parts))
                n.append(len(tokens))
                ids.append(sha(" ".join([p[1] for p in parts])))
                decoded.append(sha(c.decode(tokens)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
