"""Quality rules with risk-controlled thresholds, as DataFrame expressions only.

Each rule scores a text; a text is rejected if a score is above the rule's
cutoff for the text's stratum (its language). All rules' cutoffs are tightened
together, in STEPS fixed steps from ones that hardly a text fails to ones that
most texts fail. In each stratum the steps are tested in this order on labelled
holdouts: may the share of good texts that any rule rejects at this step be over
`alpha`? The test is an exact binomial one (the Clopper-Pearson bound) at level
`delta / strata`. Testing stops at the first step that fails; a fixed sequence
needs no further correction within a stratum, and the division by the number of
strata corrects for the rest: with probability 1 - delta, no stratum loses more
than the share alpha of its good texts to the rules, at any step certified. Of
these the first is taken that rejects as many labelled bad texts as the last, so
that good texts aren't lost for nothing. Without a certified step (a
stratum of under log(delta / strata) / log(1 - alpha) good texts, 174 with the
defaults and four strata, has none) the rules reject nothing there.

Defined cases: null text counts as empty; null language is a stratum of its
own; labels that repeat for a document count once (the worst quality), null
labels not at all; repeated documents are judged row by row; other columns
pass through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import BROADCAST_ROWS, bounded, fresh, let, stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
STEPS = 60
#: Cutoffs by rule and step. mean_word_short is negated, so that larger is worse for all.
CUTOFFS = {
    "symbol_ratio": [round(0.5 * 0.9**i, 5) for i in range(STEPS)],
    "exclaim_ratio": [round(0.5 * 0.9**i, 5) for i in range(STEPS)],
    "dup_line_ratio": [round(0.9 * 0.95**i, 5) for i in range(STEPS)],
    "repeat_ratio": [round(0.29 * 0.95**i, 5) for i in range(STEPS)],
    "mean_word_long": [round(12 - 0.1 * i, 5) for i in range(STEPS)],
    "mean_word_short": [round(-1.5 - 0.05 * i, 5) for i in range(STEPS)],
}
ALPHA, DELTA = 0.025, 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _matches(text: Column, one: str) -> Column:
    """How many characters of text are in the class `one`. (Splitting is several times as fast here as translate.)"""
    return F.size(F.split(text, one)).cast("long") - 1


def _repeated(words: Column) -> Column:
    """Words inside windows of WINDOW words that the text has twice or more. Windows are compared by 64-bit hashes of 64-bit hashes of their words."""

    def covered(hashes: Column) -> Column:
        def spans(at: Column) -> Column:
            total = F.aggregate(
                at,
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
            )
            return total["n"]

        def flagged(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), spans)

        numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(numbered), flagged))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # Two equal windows need a text of WINDOW + 1 words.
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(let(hashed, windows), covered)).cast("long")


def counts(text: Column) -> Column:
    """A struct of the base counts of a text and what the rules need besides."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated(w).alias("rep")))
    return let(
        F.struct(by_word.alias("w"), dup.alias("l")),
        lambda x: F.struct(
            x["w"]["n"].alias("n_words"),
            x["w"]["chars"].alias("word_chars"),
            _matches(text, SYMBOLS).alias("n_symbols"),
            x["l"]["dup"].alias("n_dup_lines"),
            x["w"]["rep"].alias("n_repeat_words"),
            x["l"]["lines"].alias("n_lines"),
            _matches(text, "[!?]").alias("n_exclaims"),
        ),
    )


def scores(c: Column) -> dict[str, Column]:
    """By rule: its score; larger is worse, 0 (or the length itself) for texts without words."""
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    mean = share(c["word_chars"], c["n_words"])
    return {
        "symbol_ratio": share(c["n_symbols"], c["word_chars"]),
        "exclaim_ratio": share(c["n_exclaims"], c["word_chars"]),
        "dup_line_ratio": share(c["n_dup_lines"], c["n_lines"]),
        "repeat_ratio": share(c["n_repeat_words"], c["n_words"]),
        "mean_word_long": mean,
        "mean_word_short": -mean,
    }


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n draws at p, summed exactly in the log domain."""
    step = F.log(F.lit(p / (1 - p)))
    first = n * F.log1p(F.lit(-p))
    out = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda a, j: let(
            a["term"] + F.log((n - j + 1) / j) + step,
            lambda t: F.struct(t.alias("term"), (F.greatest(a["sum"], t) + F.log1p(F.exp(-F.abs(a["sum"] - t)))).alias("sum")),
        ),
    )
    return F.exp(out["sum"])


def thresholds(features: DataFrame, labels: DataFrame, stratum: str, cutoffs: dict = CUTOFFS, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with labels: `stratum` and a map from rule to certified cutoff. features: doc_id, the stratum and `c` (see counts)."""
    worst = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = worst.join(features.select("doc_id", stratum, "c"), "doc_id").where(~base_failed(F.col("c")))
    score = scores(F.col("c"))
    steps = len(next(iter(cutoffs.values())))
    # The step from which on some rule rejects the text: cutoffs fall, so it is the number of those that the score isn't above.
    reached = lambda value, xs: F.size(F.filter(F.array(*map(F.lit, xs)), lambda x: x >= value))
    first = F.least(*[reached(score[r], xs) for r, xs in cutoffs.items()])
    good = F.col("quality") >= 1
    by_step = lambda which: F.array(*[F.sum((which & (F.col("first") <= i)).cast("long")) for i in range(steps)])
    table = seen.select(stratum, "quality", first.alias("first")).groupBy(stratum).agg(F.sum(good.cast("long")).alias("n"), by_step(good).alias("rejected"), by_step(~good).alias("bad")).where("n > 0")
    level = F.lit(delta) / F.count("*").over(_whole())
    table = table.withColumn("level", level)
    passes = F.transform("rejected", lambda k: F.when(k >= F.col("n") * alpha, F.lit(False)).otherwise(binomial_tail(k, F.col("n"), alpha) <= F.col("level")))
    last = let(passes, lambda y: F.array_position(F.concat(y, F.array(F.lit(False))), F.lit(False)).cast("int")) - 2  # the one before the first that fails
    table = table.withColumn("last", last).withColumn("step", F.when(F.col("last") >= 0, F.array_position("bad", F.get("bad", F.col("last"))).cast("int") - 1))
    pairs = [x for r, xs in cutoffs.items() for x in (F.lit(r), F.when(F.col("step") >= 0, F.get(F.array(*map(F.lit, xs)), F.col("step"))))]
    return table.select(stratum, F.create_map(*pairs).alias("cutoffs"))


def _whole():
    from pyspark.sql import Window

    # One row per stratum: a few rows in one partition.
    return Window.partitionBy(F.lit(1))


def verdict(c: Column, cuts: Column, rules=tuple(CUTOFFS)) -> Column:
    """Whether a text is kept under its stratum's cutoffs (null: no rule holds)."""
    score = scores(c)
    fires = [F.coalesce(score[r] > F.element_at(cuts, F.lit(r)), F.lit(False)) for r in rules]
    return ~base_failed(c) & ~reduce(lambda a, b: a | b, fires)


def _stratum(df: DataFrame) -> Column:
    return F.coalesce(F.col("lang"), F.lit("\x00"))


def _features(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", _stratum(docs).alias("stratum"), counts(F.col("text")).alias("c")))


def score_documents(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed and kept. The text is read once; what follows runs on the stored counts."""
    features = _features(docs)
    cuts = bounded(stored(thresholds(features, labels, "stratum", **kw)), BROADCAST_ROWS)
    return features.join(cuts, "stratum", "left").select("doc_id", *[F.col("c")[x].alias(x) for x in COUNTS], base_failed(F.col("c")).alias("base_failed"), verdict(F.col("c"), F.col("cutoffs")).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. The counts are computed again for the filter, which spares a shuffle of the texts."""
    features = _features(docs)
    cuts = bounded(stored(thresholds(features, labels, "stratum", **kw)), BROADCAST_ROWS)
    s, m = fresh(docs, "lm_stratum", "lm_cutoffs")
    cuts = cuts.select(F.col("stratum").alias(s), F.col("cutoffs").alias(m))
    return docs.withColumn(s, _stratum(docs)).join(cuts, s, "left").where(let(counts(F.col("text")), lambda c: verdict(c, F.col(m)))).select(*docs.columns)
