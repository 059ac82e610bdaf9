"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output mass
over its share of the input mass. Each document draws its number of copies by
inverting the Poisson distribution with that mean at a uniform number hashed
from (seed, the row's contents, its ordinal among equal rows); it is exploded by that number and all copies are dealt
out and sorted by a hash, so the output is one global random order.

A rate above ``MAX_RATE_PER_DRAW`` is the sum of several independent draws
with equal smaller means, which is again exactly Poisson.

The mass of a document is its characters plus one (an end mark), so that no
source has mass zero. DataFrame functions only. Explode comes after the draw,
so only copies that are kept travel, once.

A row's key is a digest of all its columns, so rows that share an id, or have
none, draw independently and spread over all partitions. Only fully equal rows
need ordinals: groups of them are found by counting 64-bit row hashes, and the
rows of those groups alone are gathered with their number (combined before the
shuffle, so a hot group moves one row a task), then numbered 1, 2, ...

Cases: null text has mass one; a null source is a source of its own; rows with
equal or null doc_id, and fully equal rows, draw independently; an empty table
gives an empty result; further columns travel with their row, but input columns
named like the operator's own (``mix_*``) are replaced by them. Columns of map
or variant type cannot be hashed and raise Spark's error.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, fits_broadcast

MAX_RATE_PER_DRAW = 32.0
MAX_BROADCAST_SOURCES = 100_000
#: Groups of equal rows whose hashes are broadcast; beyond it all rows are gathered.
MAX_BROADCAST_GROUPS = 500_000
#: Marks between the columns of a digest and for a null in it.
FIELD, NULL = "\x1f", "\x1e"
SEED = 20240229
TEMPERATURE = 0.7


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from 48 bits of an MD5 digest of the keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, expansion: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """source, mass, rate (mean copies of each of its documents), draws and the distribution of one draw.

    ``weights`` are target weights for each source (sources not named: 0);
    without them a source's target is its mass to the power ``temperature``.
    ``expansion`` is the output mass over the input mass.
    """
    mass = (F.length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("double")
    found = docs.groupBy("source").agg(F.sum(mass).alias("mass"))
    if weights is None:
        found = found.withColumn("weight", F.pow("mass", F.lit(float(temperature))))
    else:
        listed = F.lit(0.0)
        for name, weight in weights.items():
            listed = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(listed)
        found = found.withColumn("weight", listed)
    found = checkpointed(found)
    total = found.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rated = found.crossJoin(F.broadcast(total))  # one row
    rated = rated.withColumn("rate", F.coalesce(F.try_divide(F.col("weight") * F.col("all_mass") * F.lit(float(expansion)), F.col("all_weight") * F.col("mass")), F.lit(0.0)))
    rated = rated.withColumn("draws", F.greatest(F.ceil(F.col("rate") / MAX_RATE_PER_DRAW), F.lit(1)).cast("int"))
    rated = rated.withColumn("mean", F.col("rate") / F.col("draws"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def add(state, k):
        p = state["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return rated.select("source", "mass", "rate", "draws", F.aggregate(F.sequence(F.lit(1), last), start, add)["cdf"].alias("cdf"))


def row_digest(docs: DataFrame) -> Column:
    """MD5 of all columns as text; nulls differ from empty strings."""
    plain = lambda f: F.col(f"`{f.name}`").cast("string") if not f.dataType.typeName() in ("struct", "array", "binary") else F.to_json(F.struct(F.col(f"`{f.name}`")))
    return F.md5(F.concat_ws(FIELD, *(F.coalesce(plain(f), F.lit(NULL)) for f in docs.schema)).cast("binary"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_ordinal: 1 for rows that no other equals, else 1, 2, ... within each group of equal rows."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not columns:
        raise ValueError("documents have no columns")
    equal = checkpointed(docs.groupBy(F.xxhash64(*columns).alias("mix_hash")).agg(F.count(F.lit(1)).alias("mix_n")).where("mix_n > 1").select("mix_hash"))
    gather = lambda df: df.groupBy(*columns).agg(F.count(F.lit(1)).alias("mix_n")).withColumn("mix_ordinal", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_n")))).drop("mix_n")
    if equal.isEmpty():
        return docs.withColumn("mix_ordinal", F.lit(1).cast("bigint"))
    if not fits_broadcast(equal, MAX_BROADCAST_GROUPS):
        return gather(docs)
    hashed = docs.withColumn("mix_hash", F.xxhash64(*columns))
    alone = hashed.join(F.broadcast(equal), "mix_hash", "left_anti").drop("mix_hash").withColumn("mix_ordinal", F.lit(1).cast("bigint"))
    return alone.unionByName(gather(hashed.join(F.broadcast(equal), "mix_hash", "left_semi").drop("mix_hash")))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, expansion: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` for each copy, with mix_rate, mix_copies (of its row) and mix_copy (from 1), in a global random order."""
    docs = docs.drop(*(c for c in docs.columns if c.lower().startswith("mix_")))
    rated = checkpointed(rates(docs, weights, expansion, temperature)).select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), F.col("draws").alias("mix_draws"), F.col("cdf").alias("mix_cdf"))
    if fits_broadcast(rated, MAX_BROADCAST_SOURCES):
        rated = F.broadcast(rated)
    keyed = numbered(docs).withColumn("mix_key", F.concat_ws(":", row_digest(docs), F.col("mix_ordinal").cast("string"))).drop("mix_ordinal")
    drawn = keyed.join(rated, F.expr("source <=> mix_source"), "left")
    key = F.col("mix_key")
    count = F.aggregate(F.sequence(F.lit(1), F.col("mix_draws")), F.lit(0), lambda a, j: a + F.size(F.filter("mix_cdf", lambda c: c <= uniform(seed, key, j))))
    single = F.size(F.filter("mix_cdf", lambda c: c <= F.col("mix_u")))
    drawn = drawn.withColumn("mix_u", uniform(seed, key, F.lit(1)))
    drawn = drawn.withColumn("mix_copies", F.when(F.col("mix_draws") == 1, single).otherwise(count)).where("mix_copies > 0")
    copies = drawn.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    placed = copies.select(*docs.columns, "mix_rate", "mix_copies", "mix_copy", F.xxhash64(F.lit(seed), key, F.col("mix_copy")).alias("mix_place"))
    return placed.repartition("mix_place").sortWithinPartitions("mix_place").drop("mix_place")
