"""Quality rules whose thresholds come from quantile sketches of the data itself.

Every document gets a few counts. For each (lang, source) a sketch of each
derived ratio gives quartiles; a document fails a rule when its ratio lies
above ``q75 + fence * max(q75 - q25, least spread)`` of its own group. Groups
with fewer than ``MIN_GROUP`` documents use the merged sketch of their
language, and languages with fewer the merged sketch of everything: sketches
merge, so no text is read again for that.

A sketch counts values in bins of equal relative width (``GAMMA``), zero in a
bin of its own; a quantile is the upper bound of the bin that holds it. Counts
add, so sketches merge exactly: thresholds and verdicts are the same whatever
the partitions, the order of rows or tasks that ran twice. A quantile's rank is
exact, its value at most ``GAMMA - 1`` (1 %) too great.

The main path has DataFrame functions only. One document is one row while its
text is read; only its four bins are exploded, and counted before they move, so
no document, source or passage can gather in a task.

Cases: null or blank text has no words and fails the base rule; null lang or
source is a group of its own; repeated rows are judged each for itself; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, fits_broadcast, words_of

#: Least interquartile spread for each ratio, so that a group in which a ratio
#: hardly varies does not reject documents for one stray symbol or line.
LEAST_SPREAD = {"symbol_ratio": 0.05, "dup_line_ratio": 0.08, "repeat_ratio": 0.08, "word_length": 1.0}
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FENCE = 3.0
#: Ratio of a bin's bounds.
GAMMA = 1.01
#: Bin of zero, below the bins of all positive ratios.
ZERO_BIN = -100_000
MIN_GROUP = 200
MAX_BROADCAST_GROUPS = 200_000

_LEVELS = ("source", "lang", "all")


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select("doc_id", "lang", "source", words_of(F.col("text")).alias("words"), lines.alias("lines"), (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"))
    hashed = first.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    # `codes` is used twice below, which keeps the optimizer from inlining it into the lambda.
    spans = hashed.withColumn("spans", F.when(F.size("codes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("codes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("codes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))).drop("codes")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = spans.withColumn("ordered", F.when(F.size(F.array_distinct("spans")) < F.size("spans"), F.sort_array(F.transform("spans", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty)).drop("spans")

    def repeated(x, j):
        return F.when((x["h"] == F.get("ordered", j - 1)["h"]) | (x["h"] == F.get("ordered", j + 1)["h"]), x["i"])

    starts = ordered.withColumn("starts", F.when(F.size("ordered") > 0, F.sort_array(F.filter(F.transform("ordered", repeated), lambda i: i.isNotNull()))).otherwise(F.array().cast("array<int>"))).drop("ordered")
    covered = F.aggregate(F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return starts.withColumn("n_repeat_words", covered.cast("long")).drop("starts")


def _ratios(counts: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns({
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    })


def bin_of(value: Column) -> Column:
    """Number of the bin (GAMMA^(i-1), GAMMA^i] that holds a positive value."""
    return F.when(value > 0, F.ceil(F.log(value) / math.log(GAMMA))).otherwise(F.lit(ZERO_BIN)).cast("int")


def upper_bound(number: Column) -> Column:
    return F.when(number == ZERO_BIN, F.lit(0.0)).otherwise(F.exp(number * F.lit(math.log(GAMMA))))


def sketches(ratios: DataFrame) -> DataFrame:
    """lang, source, ratio, bin and n: how many documents of each group have a ratio in each bin."""
    bins = F.array(*(F.struct(F.lit(name).alias("ratio"), bin_of(F.col(name)).alias("bin")) for name in LEAST_SPREAD))
    return ratios.select("lang", "source", F.explode(bins).alias("b")).groupBy("lang", "source", "b.ratio", "b.bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total and q25 and q75 of each ratio as columns ``q25_<ratio>``; bins of different sketches merge by adding."""
    merged = sketch.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "ratio")  # as many rows as there are bins: some thousands at most
    ranked = merged.withColumns({"upto": F.sum("n").over(own.orderBy("bin")), "total": F.sum("n").over(own)})
    at = lambda q, name: upper_bound(F.min(F.when((F.col("ratio") == name) & (F.col("upto") >= F.ceil(F.col("total") * q)), F.col("bin")))).alias(f"q{int(q * 100)}_{name}")
    return ranked.groupBy(*keys).agg(F.max("total").alias("total"), *(at(q, name) for name in LEAST_SPREAD for q in (0.25, 0.75)))


def _fences(sketch: DataFrame, keys: list[str], level: str, fence: float) -> DataFrame:
    def upper(name):
        low, high = F.col(f"q25_{name}"), F.col(f"q75_{name}")
        return high + fence * F.greatest(high - low, F.lit(LEAST_SPREAD[name]))

    return quartiles(sketch, keys).select(*keys, F.col("total").alias(f"n_{level}"), F.struct(*(upper(name).alias(name) for name in LEAST_SPREAD)).alias(f"by_{level}"))


def thresholds(ratios: DataFrame, fence: float = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source, level (whose sketch is used) and the upper limit of each ratio."""
    parts = checkpointed(sketches(ratios))
    by_lang = _fences(parts, ["lang"], "lang", fence).withColumnRenamed("lang", "same_lang")
    everything = _fences(parts, [], "all", fence)
    joined = _fences(parts, ["lang", "source"], "source", fence).join(by_lang, F.expr("lang <=> same_lang")).crossJoin(F.broadcast(everything))  # one row
    level = F.when(F.col("n_source") >= min_group, "source").when(F.col("n_lang") >= min_group, "lang").otherwise("all")
    chosen = F.when(level == "source", F.col("by_source")).when(level == "lang", F.col("by_lang")).otherwise(F.col("by_all"))
    return joined.select("lang", "source", level.alias("level"), chosen.alias("most")).select("lang", "source", "level", *(F.col(f"most.{name}").alias(f"max_{name}") for name in LEAST_SPREAD))


def quality_rules(docs: DataFrame, fence: float = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts, ratios, thresholds and verdict for each row of ``docs`` (doc_id, text, lang, source)."""
    ratios = checkpointed(_ratios(text_counts(docs)))  # texts are read once
    limits = checkpointed(thresholds(ratios, fence, min_group)).withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    if fits_broadcast(limits, MAX_BROADCAST_GROUPS):
        limits = F.broadcast(limits)
    judged = ratios.join(limits, F.expr("lang <=> limit_lang and source <=> limit_source"), "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = [F.when(F.col(name) > F.col(f"max_{name}"), F.lit(name)) for name in LEAST_SPREAD]
    judged = judged.withColumn("base_failed", base).withColumn("failed_rules", F.array_compact(F.array(*failed)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("limit_lang", "limit_source")
