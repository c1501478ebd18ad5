"""Language identification by compression.

For each language, bounded training text becomes a raw-content zstandard
dictionary. A text (its words in lower case) is compressed in blocks with each
dictionary; the language whose dictionary makes it smallest is the answer.
Blocks keep the dictionary in play to a text's end; the whole text is used, and
texts of every length are compressed alike. Sizes of short texts often tie; ties
go to the smaller sum over single words, then to the language with more training
documents. `accepted` is false where the margin over the second language is
narrow.

The dictionaries are fitted on a bounded sample of labelled rows: about
SAMPLE_DOCS training documents for each language, chosen by a hash of doc_id,
and of each the first SAMPLE_CHARS characters, so that a few long ones don't
fill the dictionary; DICT_BYTES are used. Where there are more than MANY
languages, documents and bytes for each are fewer in proportion, so that the
whole sample and model stay bounded.

Defined cases: a text that is null or has no letter is `und` with score 0; with
no training rows every text is `und`; null languages are not learned; repeated
rows are predicted row by row; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, MANY = 300, 4000, 65_536, 200
BLOCK = 4_000
MARGIN = 0.02
#: Matches from four bytes on, found by thorough search in binary trees: told languages of short and long texts apart best.
SEARCH = dict(strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, search_log=4, target_length=32, window_log=17, hash_log=16, chain_log=17)
WORDS = re.compile(r"[^\W\d_]+").findall
#: Numbers that are no decimal digits (fractions, numerals) count as word characters there, but not as letters.
NUMERALS = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in {"No", "Nl"}) + "]")
UNKNOWN = "und"


def normalised(text: str) -> bytes:
    words = WORDS(text.lower())
    if not all(map(str.isalpha, words)):  # few texts have numerals, and looking for them is slow
        words = WORDS(NUMERALS.sub(" ", " ".join(words)))
    return " ".join(words).encode()


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame) -> list[tuple[str, bytes, int]]:
    """Language, dictionary and number of training documents, the most frequent language first; from rows that are not held out."""
    train = docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(train.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect())  # a row for each language
    if not counts:
        return []
    part = min(1.0, MANY / len(counts))
    size = max(1, int(DICT_BYTES * part))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_DOCS * part / n))])
    spot = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / F.lit(float(1 << 53))
    sample = train.where(spot < F.element_at(share, F.col("lang"))).select("lang", spot.alias("spot"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    texts: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(sample.collect()):
        texts.setdefault(lang, []).append(normalised(text))
    out = []
    for lang, n in counts.items():
        have = [t for t in texts.get(lang, []) if t]
        each = max(1, size // max(1, len(have)))
        long = sum(max(0, each - len(t)) for t in have)  # what short texts leave
        some = max(1, sum(len(t) > each for t in have))
        out.append((lang, b" ".join(t[: each + long // some] for t in have)[:size], n))
    return [x for x in out if x[1]]


class Classifier:
    def __init__(self, model: list[tuple[str, bytes, int]]):
        self.langs = [m[0] for m in model]
        self.compress = [self._compressor(m[1]) for m in model]

    @staticmethod
    def _compressor(content: bytes):
        settings = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_dict_id=False, write_checksum=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (the margin over the second as a share of its size) and whether the margin is wide enough."""
        data = normalised(text or "")
        if not data or not self.langs:
            return UNKNOWN, 0.0, False
        sizes = self.sizes(data)
        best = min(sizes)
        tied = [i for i, s in enumerate(sizes) if s == best]
        pick = tied[0]
        if len(tied) > 1:
            words = [b" " + w + b" " for w in data.split()]
            pick = min(tied, key=lambda i: (sum(len(self.compress[i](w)) for w in words), i))
        second = min((s for i, s in enumerate(sizes) if i != pick), default=2 * best)
        score = max(0.0, min(1.0, 1 - best / second))
        return self.langs[pick], score, score >= MARGIN


@functools.lru_cache(2)
def _classifier(model: tuple) -> Classifier:
    return Classifier(list(model))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every document."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(fit(docs)))  # at most MANY * DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _classifier(held.value)
        for b in batches:
            lang, score, ok = zip(*[predict(t.as_py()) for t in b.column(2)], strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
