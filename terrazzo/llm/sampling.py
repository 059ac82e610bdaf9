"""Bounded, hash-ordered samples of labelled rows, from which classifiers are fitted.

A sample is the rows with the least hashes, so it does not depend on
partitions or on the order of rows. Only its number of rows is bounded: texts
are whole, whatever their length, and come to the driver one part of the
sample at a time. What a fitted model is then applied to is every row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, held_out

SEED = 7
#: Parts of a sample; the driver holds the texts of one.
PARTS = 8


def _place(*columns: str):
    return F.xxhash64(F.lit(SEED), *columns)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int] | int) -> Iterator[tuple[int, str]]:
    """(label, whole text) of labelled documents outside the held-out fold, in hash order. ``rows``: most labelled rows of all, or of each label."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and _id is not null").where(~held_out(F.col("_id"))).withColumn("_place", _place("_id"))
    if isinstance(rows, int):
        chosen = known.orderBy("_place", "_id").limit(rows)
    else:
        parts = [known.where(F.col("label") == value).orderBy("_place", "_id").limit(most) for value, most in rows.items()]
        chosen = parts[0]
        for part in parts[1:]:
            chosen = chosen.unionByName(part)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), F.expr("doc_id = _id")).select("_place", "doc_id", "text", "label")  # broadcast: `rows` at most
    ordered = found.repartitionByRange(PARTS, "_place", "doc_id", "text").sortWithinPartitions("_place", "doc_id", "text", "label")
    for row in ordered.toLocalIterator():
        yield row["label"], row["text"]


def _grouped(docs: DataFrame, group: str) -> DataFrame:
    return docs.select("doc_id", "text", F.col(group).alias("_group")).where(F.col("_group").isNotNull()).where(~held_out(F.col("doc_id")))


def group_counts(docs: DataFrame, group: str) -> dict[str, int]:
    """Documents outside the held-out fold for each value of ``group``, by value."""
    known = _grouped(docs.select("doc_id", F.lit(None).alias("text"), group), group)
    return dict(sorted((r["_group"], r["count"]) for r in known.groupBy("_group").count().collect()))  # one number for each value


class GroupedTexts:
    """Whole texts of documents outside the held-out fold for each value of ``group`` in ``counts`` (`group_counts`): at most ``rows`` for each.

    The sample is written to the shared folder once; each pass over it yields
    (group, place in the group, text), groups by value, texts in hash order.
    """

    def __init__(self, docs: DataFrame, group: str, counts: dict[str, int], rows: int):
        self.rows, self.sample = rows, None
        if not counts:
            return
        known = _grouped(docs, group).where(F.col("_group").isin(*counts) & F.col("text").isNotNull()).withColumn("_place", _place("doc_id"))
        share = F.lit(0.0)
        for value, n in counts.items():
            share = F.when(F.col("_group") == value, F.lit(min(1.0, 1.5 * rows / n))).otherwise(share)
        place = F.shiftrightunsigned("_place", 11).cast("double") / float(1 << 53)
        order = ["_group", "_at", "doc_id", "text"]
        found = known.where(place <= share).select("_group", place.alias("_at"), "doc_id", "text")  # about 1.5 * rows for each group
        self.sample = checkpointed(found.repartitionByRange(PARTS, *order).sortWithinPartitions(*order))

    def __iter__(self) -> Iterator[tuple[str, int, str]]:
        now, n = None, 0
        for row in self.sample.toLocalIterator() if self.sample is not None else ():
            now, n = row["_group"], (n + 1 if row["_group"] == now else 0)
            if n < self.rows:
                yield now, n, row["text"]
