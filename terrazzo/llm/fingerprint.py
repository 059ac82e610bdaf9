"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k smallest distinct hashes of a text's
word shingles. Two sketches merge into the sketch of the union by taking the k
smallest of both, so a text can be sketched in parts. From sketches alone come
the resemblance (Jaccard), the containment and the number of distinct
shingles. DataFrame functions only.

Shingles have five words; a text with fewer words is one shingle of all its
words; one without words has an empty sketch. Two empty sketches resemble each
other fully (1.0), an empty and a filled one not at all (0.0). Null text is
empty text. Repeated rows get equal sketches. Each word is hashed once; a
shingle's hash combines those of its words. Other columns travel along, but
those named like the result's own (``into``, ``next_*``) are replaced.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, unused, words_of

SHINGLE = 5
K = 128
#: Rows in each range of `with_next`; ranges bound what one task sorts.
ROWS_PER_RANGE = 4000
MAX_RANGES = 100_000
#: Rows that one row with a number of equals becomes at once.
COPIES_AT_ONCE = 1000


def shingle_hashes(codes: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of the word shingles, in no order, from the words' hashes. ``codes`` must be a plain column."""
    many = F.transform(F.sequence(F.lit(1), F.size(codes) - (size - 1)), lambda i: F.xxhash64(F.slice(codes, i, size)))
    few = F.when(F.size(codes) > 0, F.array(F.xxhash64(codes))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.when(F.size(codes) >= size, many).otherwise(few))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def merge(*sketches: Column, k: int = K) -> Column:
    """The sketch of the union of the sketched sets."""
    return bottom_k(F.array_distinct(F.concat(*sketches)), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest of the union that lie in both sketches."""
    smallest = merge(a, b, k=k)
    shared = F.size(F.array_intersect(smallest, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(F.try_divide(shared.cast("double"), F.size(smallest)), F.lit(0.0)))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    largest = F.element_at(sketch, -1).cast("double") + float(1 << 63)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * float(1 << 64) / largest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k=k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def encode(sketch: Column) -> Column:
    """Sketch as text: 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def sketched(docs: DataFrame, text: str = "text", into: str = "sketch", size: int = SHINGLE, k: int = K) -> DataFrame:
    """``docs`` with a column ``into`` that sketches its column ``text``."""
    codes = unused(docs, f"_{into}_codes")
    hashed = docs.withColumn(codes, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    return hashed.withColumn(into, bottom_k(shingle_hashes(F.col(codes), size), k)).drop(codes)


def corpus_sketch(sketches: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """Merges sketches of many rows: the k smallest distinct hashes of each group.

    Each task first keeps k hashes for each group and random salt, so a hot
    group moves k hashes for each task and salt instead of all its own.
    """
    salted = sketches.select(*by, F.explode(column).alias("_h"), F.spark_partition_id().alias("_salt"))
    kept = salted.distinct()
    for keys in ([*by, "_salt"], by):
        order = Window.partitionBy(*keys).orderBy("_h")
        kept = kept.select(*by, *(["_salt"] if "_salt" in keys else []), "_h").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    return kept.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))  # k at most


def with_next(docs: DataFrame, columns: list[str], rows_per_range: int = ROWS_PER_RANGE, text: str = "text") -> DataFrame:
    """``docs`` with ``next_<column>`` of the next row in descending doc_id order, the first after the last.

    Null ids come last. Of rows with equal ids the one whose ``text`` has the
    greater hash comes first, then the greater text; rows with equal id and text
    follow one another.

    Rows are dealt into ranges of this order, as many partitions as ranges.
    Each is sorted by itself, and the first row of each range is given to the
    range before it too, where it follows the last row. So texts move once and
    no task sees all rows. An id of more than ``rows_per_range`` rows (null too)
    has ranges of its own, cut by the text's hash; its fully equal rows, which
    are one another's next, are one row there and copied afterwards. So such an
    id or text may hold any share of the rows. The driver holds some numbers
    for each range, ``2 * MAX_RANGES`` at most.
    """
    docs = docs.drop(*(f"next_{c}" for c in columns))
    own, spark = docs.columns, docs.sparkSession
    hash_, range_, extra, n, block = (unused(docs, c) for c in ("_hash", "_range", "_extra", "_n", "_block"))
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
    rows = max(rows_per_range, -(-seen["n"] // MAX_RANGES))
    ranges = max(1, seen["n"] // rows)
    hot = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).collect() if ranges > 1 else []  # seen / rows of them at most
    cuts = {i for r in hot if (i := r["doc_id"]) is not None} | {i + 1 for r in hot if (i := r["doc_id"]) is not None and i + 1 < 1 << 63}
    if seen["ids"] and ranges > 1:
        cuts |= {*docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q")).first()["q"]}
    ordered = sorted(cuts)
    parts = [1] * (len(ordered) + 2)  # ranges of null ids and between any two cuts
    for r in hot:
        parts[0 if r["doc_id"] is None else 1 + bisect_right(ordered, r["doc_id"])] = -(-r["n"] // rows)
    first = [0, *accumulate(parts)]
    between = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + _cuts_up_to(F.col("doc_id"), ordered))
    number = F.xxhash64(text)
    within = F.get(_literal(parts, "array<int>"), between)
    share = F.least(within - 1, F.floor((number / float(1 << 64) + 0.5) * within).cast("int"))
    placed = docs.withColumns({hash_: number, range_: F.get(_literal(first, "array<int>"), between) + share, n: F.lit(1).cast("bigint")})
    copies = None
    if hot:
        many = within > 1
        gathered = checkpointed(placed.where(many).groupBy(*(F.col(f"`{c}`") for c in own), hash_, range_).agg(F.sum(n).alias(n)))
        placed = placed.where(~many).unionByName(gathered)
        blocks = gathered.where(F.col(n) > 1).withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 2) / COPIES_AT_ONCE))))
        blocks = blocks.repartition(F.xxhash64(*own, block)).withColumn(block, F.least(F.lit(COPIES_AT_ONCE).cast("bigint"), F.col(n) - 1 - F.col(block) * COPIES_AT_ONCE))
        copies = blocks.withColumn(block, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(block)))).select(*(F.col(f"`{c}`") for c in own), *(F.col(f"`{c}`").alias(f"next_{c}") for c in columns))
    tops = placed.groupBy(F.col(range_).alias("r")).agg(F.max(F.struct("doc_id", hash_)).alias("t")).select("r", "t.*").collect()  # one for each range
    tops.sort(key=lambda t: t["r"])
    above = [t["r"] for t in tops][1:] + [t["r"] for t in tops][:1]
    leading = spark.createDataFrame([(t["r"], t[1], t[2], a) for t, a in zip(tops, above)], "_top_range int, _top_id bigint, _top_hash bigint, _top_home int")
    leading = leading.toDF(*(unused(placed, c) for c in leading.columns))
    top_range, top_id, top_hash, top_home = (F.col(c) for c in leading.columns)
    is_top = F.col("doc_id").eqNullSafe(top_id) & (F.col(hash_) == top_hash)
    deal = lambda at, is_extra: F.struct(at.alias("at"), F.lit(is_extra).alias("extra"))
    joined = placed.join(F.broadcast(leading), F.col(range_) == top_range, "left")
    dealt = joined.withColumn(block, F.explode(F.when(is_top, F.array(deal(F.col(range_), False), deal(top_home, True))).otherwise(F.array(deal(F.col(range_), False)))))
    dealt = dealt.select(*(F.col(f"`{c}`") for c in own), hash_, F.col(f"{block}.at").alias(range_), F.col(f"{block}.extra").alias(extra)).repartition(max(1, len(tops)), range_)
    order = Window.partitionBy(range_).orderBy(extra, F.desc_nulls_last("doc_id"), F.desc(hash_), F.desc_nulls_last(text))
    found = dealt.select("*", *(F.lead(F.col(f"`{c}`")).over(order).alias(f"next_{c}") for c in columns)).where(~F.col(extra)).drop(hash_, range_, extra)
    return found if copies is None else found.unionByName(copies)


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def _cuts_up_to(value: Column, cuts: list[int]) -> Column:
    """Number of the sorted cuts that are <= value, by a search in two levels."""
    if not cuts:
        return F.lit(0)
    side = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    block = F.size(F.filter(_literal([b[0] for b in blocks], "array<bigint>"), lambda c: c <= value))
    inner = F.size(F.filter(F.get(_literal(blocks, "array<array<bigint>>"), block - 1), lambda c: c <= value))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * side + inner)


def fingerprints(docs: DataFrame, size: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, sketch, fingerprint and n_shingles (estimated, exact below k) of each row's whole text."""
    sketch = sketched(docs.select("doc_id", "text"), "text", "sketch", size, k)
    return sketch.select("doc_id", "sketch", encode(F.col("sketch")).alias("fingerprint"), distinct_shingles(F.col("sketch"), k).alias("n_shingles"))
