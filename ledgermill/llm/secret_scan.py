"""Secret scans: exact patterns, and a character convolutional network for what they miss.

The patterns (assignments to telling names, access keys, long hexadecimal runs)
always count. Besides, every candidate, a run of at least MIN_CANDIDATE key
characters, or what the patterns' matches leave of one, is read by a small
convolutional network in numpy, together with CONTEXT characters on either
side. A run of over BODY characters is read in windows of BODY, one every STEP
characters and one at its end, and its score is the highest of theirs; it counts
as a whole.

The network is trained on labelled findings of all documents: what the patterns
find (positives, half of them with their telling names masked) and the
candidates that are words or numbers all through (negatives). Other candidates
have no label, since any of them may be a secret that the patterns miss. A
finding counts once however often it occurs, and so does a window, of runs of
any length all of them. Generated findings of both kinds, with fixed seeds, make
up half of every step; of a made-up key behind a path, the windows with most of
the key are positive and those with none of it negative.

Windows are dealt by a hash into shards of about SHARD. In each of ROUNDS every
shard takes the network once over all its windows, in a task of its own, and the
mean of what the shards come to is where the next round begins (iterative
parameter mixing); the mean is of integers, so the order of tasks is no matter. A
finding's hash keeps a fifth of the findings for calibrating the network's score
(Platt scaling) and a fifth of the positives for the threshold: the highest
whose recall has an exact binomial lower bound of MIN_RECALL, over all these
positives and over the made-up ones alone.

Defined cases: null text counts as empty and has no spans; texts of any length
are scanned whole; where no document has a finding, the generated ones train
alone; repeated rows are scanned row by row; `redact` passes other columns on,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import stored
from ledgermill.llm.ranges import ranked

ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs are whole either way
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "learned")
MIN_CANDIDATE, CONTEXT, BODY = 16, 24, 48
RUN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{MIN_CANDIDATE},}}")  # looking back only saves time: the runs are whole either way
STEP, STEPS, BATCH = BODY // 2, 900, 64
WIDTH = 2 * CONTEXT + BODY
SHARD, ROUNDS, GENERATED, MIN_RECALL, CONFIDENCE = 4800, 6, 3000, 0.95, 0.95
FIT, CHECK, LAST = range(3)  # what a finding is for: the weights, their calibration, the threshold
FIXED = 1 << 32  # weights are added up as integers, in units of 1 / FIXED
ROWS = 10_000  # windows that one batch of rows holds
ALPHABET = {c: i + 2 for i, c in enumerate(string.printable)}  # 0: nothing, 1: any other character


def long_runs(text: str) -> list[tuple[int, int]]:
    """The runs of at least MIN_CANDIDATE key characters."""
    return [m.span() for m in RUN.finditer(text)]


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find; runs: the text's, if known."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    runs = long_runs(text) if runs is None else runs
    out += [(m.start(), 2, m.end()) for s, e in runs for m in HEX.finditer(text, s, e)]  # hexadecimal digits are key characters
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]], runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Runs of key characters, and what base spans leave of them; runs: the text's, if known."""
    out, near = [], 0
    for start, end in long_runs(text) if runs is None else runs:
        while near < len(base) and base[near][2] <= start:  # spans before the run; base is in order of starts
            near += 1
        at = start
        for s, _, e in base[near:]:
            if s >= end:
                break
            if s - at >= MIN_CANDIDATE:
                out.append((at, s))
            at = max(at, e)
        if end - at >= MIN_CANDIDATE:
            out.append((at, end))
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The windows of at most BODY characters that a candidate is read in: they overlap and cover all of it."""
    if end - start <= BODY:
        return [(start, end)]
    return [(s, s + BODY) for s in (*range(start, end - BODY, STEP), end - BODY)]


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of a window and its context, in fixed places: (WIDTH,) bytes."""
    body = text[start : min(end, start + BODY)]
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    row = np.zeros(WIDTH, np.uint8)
    for at, s in ((CONTEXT - len(left), left), (CONTEXT, body), (CONTEXT + BODY, right)):
        row[at : at + len(s)] = [ALPHABET.get(c, 1) for c in s]
    return row


PART = re.compile(r"[A-Za-z0-9]+")


def ordinary(run: str) -> bool:
    """Whether every part of a run is a word (of one case, or capitalised) or a number of up to 19 digits."""
    return all(p.isdigit() and len(p) < 20 or p.isalpha() and p in (p.lower(), p.upper(), p.capitalize()) for p in PART.findall(run))


def findings(text: str, hide: bool) -> Iterator[tuple[bool, str, int, int]]:
    """Labelled findings of a text (secret, text as shown, start, end): the patterns' values are secrets, candidates of words and numbers are not."""
    runs = long_runs(text)
    base = base_spans(text, runs)
    for start, kind, end in base:
        m = ASSIGN.match(text, start) if kind == 0 else None
        s, e = (m.start(2), m.end(2)) if m else (start, end)
        if e - s >= MIN_CANDIDATE:
            lead = "".join("x" if c.isalpha() else c for c in text[start:s]) if hide else text[start:s]
            yield True, text[max(0, start - CONTEXT) : start] + lead + text[s : e + CONTEXT], min(start, CONTEXT) + s - start, min(start, CONTEXT) + e - start
    for s, e in candidates(text, base, runs):
        if ordinary(text[s:e]):
            yield False, text, s, e


def purpose(secret: bool, text: str, start: int, end: int) -> tuple[int, int]:
    """What a finding is for, and its number: by a hash of what the network reads of it, so that copies go together."""
    at = max(0, start - CONTEXT)
    codes = bytes(ALPHABET.get(c, 1) for c in text[at : end + CONTEXT])
    key = hashlib.blake2b(bytes([secret, start - at, min(CONTEXT, len(text) - end)]) + codes, digest_size=8).digest()
    number = int.from_bytes(key, "little", signed=True)
    return CHECK if number % 5 == 3 else LAST if secret and number % 5 == 4 else FIT, number


def made_up(n: int, seed: int = 7) -> Iterator[tuple[bool, bytes, list[int]]]:
    """Made-up findings, each with the codes of its windows and their labels (-1: neither): random keys of common shapes, and digits, names, paths, dates and addresses that are none."""
    r = random.Random(seed)
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda: some(string.ascii_lowercase, 2, 9)
    b64, hexa = string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    yes = [
        lambda: some(b64, 24, 64) + r.choice(["", "=", "=="]),
        lambda: some(string.ascii_letters + string.digits, 20, 44),
        lambda: r.choice(["sk_live_", "ghp_", "xoxb-", "glpat-", "pk_test_"]) + some(string.ascii_letters + string.digits, 20, 40),
        lambda: some(hexa, 32, 64).upper(),
        lambda: some(string.ascii_letters, 20, 44),
        lambda: "eyJ" + some(b64, 20, 40) + "." + some(b64, 20, 40),
    ]
    no = [
        lambda: some(string.digits, 16, 24),
        lambda: "-".join(some(string.digits, 3, 4) for _ in range(4)),
        lambda: "/".join(word() for _ in range(4)) + "/" + some(string.digits, 1, 4),
        lambda: "_".join(word() for _ in range(4)) + some(string.digits, 1, 2),
        lambda: f"20{some(string.digits, 2, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{r.randint(0, 9)}.00.00",
        lambda: ".".join(word() for _ in range(3)) + f".v{r.randint(1, 9)}.{r.randint(0, 20)}",
        lambda: word() + some(string.digits, 1, 2) + "=" + word() + "+" + word(),
        lambda: r.choice([str, str.capitalize])("".join(word() for _ in range(r.randint(4, 7)))),
        lambda: r.choice("-_.=/") * r.randint(16, 60),
        lambda: "-".join(word().title() for _ in range(5)),
        lambda: path() + r.choice(["", word() + ".html", some(string.digits, 4, 9)]),
    ]
    tag = lambda: r.choice("TBCU") + some(string.ascii_uppercase + string.digits, 7, 9)
    path = lambda: "//" + ".".join(word() for _ in range(3)) + "/" + "".join(r.choice([word, word, tag])() + "/" for _ in range(r.randint(2, 8)))
    for _ in range(n):
        secret = r.random() < 0.5
        body = r.choice(yes if secret else no)()
        lead = path() if secret and r.random() < 0.3 else ""
        before = " ".join(word() for _ in range(4)) + r.choice([" ", ": ", ' = "', "=", " ("])
        text = before + lead + body + r.choice([" ", '" ', ") ", ".\n"]) + " ".join(word() for _ in range(4))
        key = len(before) + len(lead)
        parts = windows(len(before), key + len(body))
        held = [min(e, key + len(body)) - max(s, key) for s, e in parts]
        labels = [int(secret) if x >= MIN_CANDIDATE else 0 if x <= 0 else -1 if lead else int(secret) for x in held]
        yield secret, b"".join(encoded(text, s, e).tobytes() for s, e in parts), labels


def generated(n: int, seed: int = 7) -> Iterator[tuple[bool, bytes]]:
    """The labelled windows of n made-up findings."""
    for _, codes, labels in made_up(n, seed):
        for i, label in enumerate(labels):
            if label >= 0:
                yield bool(label), codes[i * WIDTH : (i + 1) * WIDTH]


@dataclass
class Network:
    """Embedding, two convolutions, maximum over the body and over everything, one output."""

    w: list[np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def new(cls, seed: int = 1, dim: int = 8, filters: int = 16) -> "Network":
        g = np.random.default_rng(seed)
        n = len(ALPHABET) + 2
        he = lambda *s: (g.standard_normal(s) * math.sqrt(2 / s[0])).astype(np.float32)
        return cls([g.standard_normal((n, dim)).astype(np.float32) * 0.5, he(5 * (dim + 1), filters), np.zeros(filters, np.float32), he(3 * filters, filters), np.zeros(filters, np.float32), he(2 * filters, 1), np.zeros(1, np.float32)])

    @staticmethod
    def _windows(x: np.ndarray, k: int) -> np.ndarray:
        v = np.lib.stride_tricks.sliding_window_view(x, k, axis=1)  # n, length, channels, k
        return v.transpose(0, 1, 3, 2).reshape(x.shape[0], -1, k * x.shape[2])

    def forward(self, codes: np.ndarray, keep: bool = False):
        e, w1, b1, w2, b2, w3, b3 = self.w
        body = np.zeros((len(codes), WIDTH, 1), np.float32)
        body[:, CONTEXT : CONTEXT + BODY] = 1
        x0 = self._windows(np.concatenate([e[codes], body], axis=2), 5)
        h1 = np.maximum(x0 @ w1 + b1, 0)
        x1 = self._windows(h1, 3)
        h2 = np.maximum(x1 @ w2 + b2, 0)
        whole, mean = h2.argmax(axis=1), h2[:, CONTEXT : CONTEXT + BODY].mean(axis=1)
        top = np.take_along_axis(h2, whole[:, None], 1)[:, 0]
        f = np.concatenate([top, mean], axis=1)
        logit = (f @ w3 + b3)[:, 0]
        return (logit, (codes, x0, h1, x1, h2, whole, f)) if keep else logit

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        e, w1, _, w2, _, w3, _ = self.w
        logit, (codes, x0, h1, x1, h2, whole, f) = self.forward(codes, True)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - target).astype(np.float32)[:, None] / len(codes)
        n = w2.shape[1]
        g3, gb3, df = f.T @ d, d.sum(0), d @ w3.T
        d2 = np.zeros_like(h2)
        np.put_along_axis(d2, whole[:, None], df[:, None, :n], 1)
        d2[:, CONTEXT : CONTEXT + BODY] += df[:, None, n:] / BODY
        d2 *= h2 > 0
        d2 = d2.reshape(-1, n)
        g2, gb2, dx1 = x1.reshape(len(d2), -1).T @ d2, d2.sum(0), (d2 @ w2.T).reshape(*h2.shape[:2], 3, -1)
        d1 = np.zeros_like(h1)
        for k in range(3):
            d1[:, k : k + h2.shape[1]] += dx1[:, :, k]
        d1 *= h1 > 0
        d1 = d1.reshape(-1, n)
        g1, gb1, dx0 = x0.reshape(len(d1), -1).T @ d1, d1.sum(0), (d1 @ w1.T).reshape(*h1.shape[:2], 5, -1)
        d0 = np.zeros((*codes.shape, e.shape[1]), np.float32)
        for k in range(5):
            d0[:, k : k + h1.shape[1]] += dx0[:, :, k, :-1]
        ge = np.stack([np.bincount(codes.ravel(), d0[:, :, c].ravel(), len(e)) for c in range(e.shape[1])], axis=1).astype(np.float32)
        return [ge, g1, gb1, g2, gb2, g3, gb3]

    def descend(self, batches: Iterable[tuple[np.ndarray, np.ndarray]], rate: float = 3e-3) -> "Network":
        """A step (Adam) for each batch of codes and targets."""
        m, v = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w]
        for t, (codes, target) in enumerate(batches, 1):
            for i, d in enumerate(self.gradients(codes, target)):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                self.w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self

    def fit(self, codes: np.ndarray, target: np.ndarray, steps: int = 300, batch: int = 64, rate: float = 3e-3, seed: int = 3) -> "Network":
        g = np.random.default_rng(seed)
        sides = [np.flatnonzero(target == k) for k in (0, 1)]
        picks = (np.concatenate([g.choice(s, batch // 2) for s in sides]) for _ in range(steps))
        return self.descend(((codes[p], target[p]) for p in picks), rate)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w])

    def put(self, flat: np.ndarray) -> "Network":
        """The weights as flat has them, one after the other."""
        ends = np.cumsum([x.size for x in self.w])
        self.w = [p.reshape(x.shape).astype(np.float32) for p, x in zip(np.split(flat, ends[:-1]), self.w, strict=True)]
        return self

    def calibrate(self, codes: np.ndarray, target: np.ndarray) -> "Network":
        """Platt scaling by Newton steps."""
        x = self.forward(codes).astype(np.float64)
        y = np.where(target == 1, (target.sum() + 1) / (target.sum() + 2), 1 / ((1 - target).sum() + 2))

        def sums(a: float, b: float) -> list[float]:
            q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = q * (1 - q) + 1e-9
            return [((q - y) * x).sum(), (q - y).sum(), (w * x * x).sum(), (w * x).sum(), w.sum()]

        self.scale, self.shift = platt(sums)
        return self

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self.forward(codes[i : i + 512]) for i in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(codes))

    def scaled(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * np.asarray(logits, np.float64) + self.shift, -30, 30)))


def platt(sums: Callable[[float, float], list[float]]) -> tuple[float, float]:
    """Scale and shift by Newton steps; sums gives, for such a pair, the sums that gradient and Hessian consist of."""
    p = np.array([0.1, 0.0])
    for _ in range(50):
        gx, g, hxx, hx, h = sums(float(p[0]), float(p[1]))
        step = np.clip(np.linalg.solve(np.array([[hxx + 1e-3, hx], [hx, h]]), np.array([gx + 1e-3 * p[0], g])), -1, 1)
        p -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(p[0]), float(p[1])


def allowed_misses(n: int, recall: float = MIN_RECALL, confidence: float = CONFIDENCE) -> int:
    """How many of n positives may be missed so that recall's exact lower bound holds; -1 if n is too small for any."""
    misses, total = -1, 0.0
    for k in range(n):  # P(at most k misses) if the true miss rate were 1 - recall
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(1 - recall) + (n - k) * math.log(recall))
        if total > 1 - confidence:
            break
        misses = k
    return misses


def recall_threshold(positives: np.ndarray, recall: float = MIN_RECALL, confidence: float = CONFIDENCE) -> float:
    """The highest threshold that misses so few positives that recall's exact lower bound holds; 0.5 if there are too few for any."""
    misses = allowed_misses(len(positives), recall, confidence)
    return float(np.sort(positives)[misses]) if misses >= 0 else 0.5


def labelled(docs: DataFrame) -> DataFrame:
    """The different labelled windows of all documents: part (FIT, CHECK, LAST), finding (its number in LAST, else 0), secret, codes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, None] = {}
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for secret, text, start, end in findings(t.as_py() or "", bool((i or 0) % 2)):
                    part, number = purpose(secret, text, start, end)
                    for s, e in windows(start, end):
                        seen[part, number if part == LAST else 0, secret, encoded(text, s, e).tobytes()] = None
                        if len(seen) == ROWS:
                            yield packed(seen)
                            seen = {}
        yield packed(seen)

    def packed(seen: dict[tuple, None]) -> pa.RecordBatch:
        cols = list(zip(*seen, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["part", "finding", "secret", "codes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "part int, finding long, secret boolean, codes binary").distinct()


def dealt(codes: np.ndarray, target: np.ndarray, made: tuple[np.ndarray, np.ndarray], passes: int, least: int, g: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of passes over all windows, in a new order each pass; half of a batch is made up, of both kinds alike. Few windows come up several times, so that a pass has `least` steps."""
    half, n = BATCH // 2, len(codes)
    sides = [np.flatnonzero(made[1] == k) for k in (0, 1)]
    for _ in range(passes):
        steps = max(least, -(-n // half))
        order = np.concatenate([g.permutation(n) for _ in range(-(-steps * half // n))]) if n else np.zeros(0, np.int64)
        for k in range(steps):
            real, fake = order[k * half : (k + 1) * half], np.concatenate([g.choice(s, half // 2) for s in sides])
            yield np.concatenate([codes[real], made[0][fake]]), np.concatenate([target[real], made[1][fake]])


def learned(net: Network, codes: list[bytes], secret: list[bool], made: tuple[np.ndarray, np.ndarray], passes: int, least: int, seed: tuple[int, int]) -> Network:
    """The network after so many passes over these windows, whatever their order."""
    both = sorted(zip(codes, secret, strict=True))
    x = np.frombuffer(b"".join(c for c, _ in both), np.uint8).reshape(-1, WIDTH)
    return Network([w.copy() for w in net.w]).descend(dealt(x, np.array([int(s) for _, s in both], np.int64), made, passes, least, np.random.default_rng(seed)))


def mixed(net: Network, rows: DataFrame, made: tuple[np.ndarray, np.ndarray], shard: int, rounds: int, least: int) -> Network:
    """The network, trained on all rows (codes, secret), dealt into shards of about `shard`."""
    n = rows.count()
    if not n:
        return learned(net, [], [], made, rounds, least, (0, 0))
    sc, shards = rows.sparkSession.sparkContext, -(-n // shard)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("codes"), F.lit(shards))).repartition(shards, "shard")  # few rows, much work: tasks are not to be put together by bytes
    given = sc.broadcast(made)
    turns, passes = (rounds, 1) if shards > 1 else (1, rounds)  # a single shard meets no other between its passes
    for turn in range(turns):
        held = sc.broadcast(net)

        def taken(key, t):  # no type hints: Spark would read them; it's sent off within this turn
            w = learned(held.value, t["codes"].to_pylist(), t["secret"].to_pylist(), given.value, passes, least, (turn, key[0].as_py())).flat()
            return pa.table({"place": pa.array(np.arange(len(w)), pa.int32()), "weight": pa.array(np.rint(w.astype(np.float64) * FIXED).astype(np.int64))})

        sums = rows.groupBy("shard").applyInArrow(taken, "place int, weight long").groupBy("place").agg(F.sum("weight"), F.count("*")).collect()
        net = Network(net.w).put(np.array([s / k / FIXED for _, s, k in sorted(map(tuple, sums))]))
        held.unpersist()
    return net


def scored(net: Network, rows: DataFrame) -> DataFrame:
    """part, finding, secret and the network's logit of rows' windows."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("finding"), b.column("secret"), pa.array(held.value.logits(x).astype(np.float64))], names=["part", "finding", "secret", "logit"])

    return rows.mapInArrow(run, "part int, finding long, secret boolean, logit double")


def calibrated(net: Network, rows: DataFrame) -> Network:
    """The network with its score calibrated on all rows (logit, secret), as Network.calibrate does."""
    yes, no = rows.agg(F.count_if("secret"), F.count_if(~F.col("secret"))).first()
    x, y = F.col("logit"), F.when(F.col("secret"), (yes + 1) / (yes + 2)).otherwise(1 / (no + 2))

    def sums(a: float, b: float) -> list[float]:
        q = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * x + b))))
        t = rows.select(x.alias("x"), (q - y).alias("d"), (q * (1 - q) + 1e-9).alias("w"))
        return list(t.agg(F.sum(F.expr("d * x")), F.sum("d"), F.sum(F.expr("w * x * x")), F.sum(F.expr("w * x")), F.sum("w")).first())

    net.scale, net.shift = platt(sums)
    return net


def train(docs: DataFrame, shard: int = SHARD, rounds: int = ROUNDS, steps: int = STEPS) -> Network:
    """The network for these documents: from the labelled findings of all of them and generated ones."""
    spark = docs.sparkSession
    cases = list(made_up(GENERATED))
    x = [np.frombuffer(c[1], np.uint8).reshape(-1, WIDTH) for c in cases]

    def some(parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        chosen = [i for i in range(len(cases)) if i % 5 in parts]
        y = np.array([k for i in chosen for k in cases[i][2]], np.int64)
        return np.concatenate([x[i] for i in chosen])[y >= 0], y[y >= 0]

    rows = stored(labelled(docs))
    net = mixed(Network.new(), rows.where(F.col("part") == FIT).select("codes", "secret"), some((0, 1, 2)), shard, rounds, steps // rounds)
    scores = stored(scored(net, rows.where(F.col("part") != FIT)))
    check, target = some((3,))
    made = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(net.logits(check), target, strict=True)], "logit double, secret boolean")
    net = calibrated(net, stored(scores.where(F.col("part") == CHECK).select("logit", "secret").union(made)))
    last = [x[i] for i, c in enumerate(cases) if i % 5 == 4 and c[0]]
    own = highest(net.logits(np.concatenate(last)), np.array([len(a) for a in last]))
    found = scores.where(F.col("part") == LAST).groupBy("finding").agg(F.max("logit").alias("logit")).select("logit")
    found = stored(found.union(spark.createDataFrame([(float(a),) for a in own], "logit double")))
    at = ranked(found, [F.col("logit")]).where(F.col("rank") == allowed_misses(found.count()) + 1).first()
    net.threshold = min(float(net.scaled(at["logit"])), recall_threshold(net.scaled(own)))
    return net


def highest(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The highest of each candidate's windows; size holds the number of each one's windows."""
    return np.maximum.reduceat(p, np.cumsum(size) - size) if len(size) else np.zeros(0)


def scan(text: str, net: Network) -> list[tuple[int, int, int]]:
    """All spans of a text: (start, kind, end), in order."""
    runs = long_runs(text)
    base = base_spans(text, runs)
    more = candidates(text, base, runs)
    if more:
        parts = [windows(s, e) for s, e in more]
        p = highest(net.probability(np.stack([encoded(text, *w) for ws in parts for w in ws])), np.array([len(ws) for ws in parts]))
        base = sorted(base + [(s, 3, e) for (s, e), q in zip(more, p, strict=True) if q >= net.threshold])
    return base


def _rows(docs: DataFrame, net: Network, fields: str, row, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [row(t.as_py() or "", scan(t.as_py() or "", held.value)) for t in b.column("text")]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + fields)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_learned of every document."""

    def row(_: str, spans: list) -> tuple:
        count = [sum(k == x for _, k, _ in spans) for x in range(4)]
        base = written([x for x in spans if x[1] < 3])
        return *count[:3], hashlib.sha256(base.encode()).hexdigest(), written(spans), count[3]

    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
    return _rows(docs, train(docs), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long", row, ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"], kinds)


def redacted_text(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """text with every span (overlapping ones as one) replaced by mark."""
    out, last = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[last:s], mark]
        last = e
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """docs with secrets in `text` replaced; other columns as they are. Null texts stay null."""
    held = docs.sparkSession.sparkContext.broadcast(net or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else redacted_text(t, scan(t, held.value)) for t in b.column("text").to_pylist()]
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
