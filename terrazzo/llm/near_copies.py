"""Near-duplicates of a stage: SimHash links, and those that SimHash cannot reach at a similarity of ``SIMILARITY``.

Fingerprints of five-word shingles link as in `simhash`, by pigeonring
filtering at 4 of 64 bits. That finds edited texts of a Jaccard similarity of
about 0.95 and up: at 0.8, fingerprints differ in 9.7 bits on average, and a
ring with that budget has no chain selective enough to look up (the README has
the figures). So texts whose sets of shingles have a Jaccard similarity of
``SIMILARITY`` or more are linked too.

Candidates for that come from MinHash: ``BANDS`` times ``ROWS`` minima of a text's
shingles; two texts are compared if all minima of any band agree. A pair of
resemblance s is missed with chance ``(1 - s ** ROWS) ** BANDS``: 1.3e-7 at
0.8, less above. Each candidate is then verified by its exact sets of
shingles, so no pair below ``SIMILARITY`` links. Links go to connected
components.

Equal texts are one node from the start (64-bit hash of the words), so groups
of copies cost nothing. Buckets with the same members are one. A bucket's
pairs are counted inside a kernel and never are rows: what leaves it is a
forest of the links, one less than its members at most. Its time still grows
with the square of a bucket of texts that differ. Nothing is capped or sampled.

Texts: A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``, shingles have
``size`` words (fewer words: one shingle of all). Texts without words (null
too) equal each other. Rows with a null doc_id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .shared import checkpointed, fits_broadcast, unused

SIMILARITY = 0.8
SIZE = 5
BANDS = 40
ROWS = 5
SEED = 42
#: Shingles whose permuted hashes are in memory at once.
AT_ONCE = 2048
#: Document ids (one number each) that are broadcast; beyond it texts are shuffled to them.
MAX_BROADCAST_IDS = 4_000_000

_NODE_SEED = 43


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only the six separators split


def shingles(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; empty without words."""
    from xxhash import xxh64_intdigest as digest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], dtype=np.uint64))


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A forest over the places of non-empty ``sets`` with the components of all pairs of Jaccard similarity ``similarity`` or more."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, found = np.zeros(len(values), dtype=np.uint8), np.arange(len(sets)), []
    for i in range(1, len(sets)):
        own = numbers[starts[i] : ends[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[numbers[: starts[i]]], starts[:i], dtype=np.int64)
        mark[own] = 0
        near = np.nonzero(shared / (sizes[:i] + sizes[i] - shared) >= similarity)[0]
        kinds, first = np.unique(label[near], return_index=True)
        found += [(i, int(near[j])) for j in first]
        label[:i][np.isin(label[:i], kinds)] = i
    return found


class Bands:
    """Keys of a set's bands: equal where all of a band's minima are."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.mixers = rng.integers(0, 1 << 64, (bands, rows), dtype=np.uint64) | np.uint64(1)
        self.offsets = rng.integers(0, 1 << 64, bands, dtype=np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, dtype=np.uint32)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), AT_ONCE):
            permuted = np.multiply.outer(short[at : at + AT_ONCE], self.factors)
            permuted += self.shifts
            np.minimum(least, permuted.min(axis=0), out=least)
        x = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.mixers).sum(axis=1, dtype=np.uint64) + self.offsets
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return (x ^ (x >> np.uint64(33))).view(np.int64)


def banded(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, raw (hash of the text as it is), node (hash of its words), fp (SimHash) and keys (of the bands; null without words) of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest as digest

        bands = Bands()
        for batch in batches:
            nodes, keys, prints = [], [], []
            for text in batch.column(2):
                text = text.as_py()
                words = _words(text)
                prints.append(simhash.fingerprint_of(text, size))
                nodes.append(digest(b" ".join(words), _NODE_SEED))
                keys.append(bands.of(shingles(words, size)) if words else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64), pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64), pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "raw", "node", "fp", "keys"])

    return _with_raw(docs).mapInArrow(run, "doc_id bigint, raw bigint, node bigint, fp bigint, keys array<bigint>")


def _with_raw(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("raw"), text.alias("text"))


def verified(buckets: DataFrame, similarity: float = SIMILARITY, size: int = SIZE) -> DataFrame:
    """Links (u, v) of nodes within each bucket of ``buckets`` (key, node, text), as a forest for each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def links(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            pairs = linked(sets, similarity) if len(sets) > 1 else []
            ends = [pa.array([nodes[pair[k]] for pair in pairs], pa.int64()) for k in (0, 1)]
            return pa.record_batch(ends, names=["u", "v"])

        now, nodes, sets = None, [], []
        for batch in batches:
            done = []
            for key, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key != now:
                    done.append(links(nodes, sets))
                    now, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(shingles(_words(text.as_py()), size))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        yield links(nodes, sets)

    return buckets.select("key", "node", "text").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u bigint, v bigint")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, size: int = SIZE) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable over links) of each row of ``docs`` (doc_id, text)."""
    marked = checkpointed(banded(docs, size))
    nodes = checkpointed(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "raw")).alias("one"), F.first("keys").alias("keys"), F.min("fp").alias("fp")))
    prints = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = nodes.join(prints, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    near = simhash.fingerprint_links(prints)
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("head").alias("u")), "a").join(prints.select(F.col("fp").alias("b"), F.col("head").alias("v")), "b").select("u", "v")
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"_s{k}") for k in range(2)]
    heads = buckets.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"), *members).where("head <> last")
    shared = checkpointed(buckets.join(heads.groupBy("head", "last", "_s0", "_s1").agg(F.min("key").alias("key")).select("key"), "key"))
    chosen = nodes.join(shared.select("node").distinct(), "node").select("node", F.col("one.doc_id").alias("_id"), F.col("one.raw").alias("_raw"))
    chosen = checkpointed(chosen)
    wanted = chosen.select(F.coalesce("_id", F.lit(0)).alias("_key")).distinct()
    candidates = _with_raw(docs)
    if fits_broadcast(wanted, MAX_BROADCAST_IDS):  # only texts that are compared are shuffled; a null id counts as 0 here, the join below is exact
        candidates = candidates.join(F.broadcast(wanted), F.coalesce("doc_id", F.lit(0)) == F.col("_key"), "left_semi")
    found = candidates.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")))
    texts = found.dropDuplicates(["node"]).select("node", "text")
    links = checkpointed(verified(shared.join(texts, "node"), similarity, size).distinct())
    grouped = nodes.select("node", "least").join(components(links.unionByName(equal).unionByName(near)), "node", "left")
    classed = checkpointed(grouped.select("node", "least", F.coalesce("component", "node").alias("component")))
    least = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "node").join(classed.join(least, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` but for those whose component has a lesser doc_id; rows with a null doc_id all stay, and rows with equal ids stay or go together."""
    gone = unused(docs, "_gone")
    ids = checkpointed(near_copies(docs, similarity, size).where("doc_id > component_id").select(F.col("doc_id").alias(gone)).distinct())
    if fits_broadcast(ids, MAX_BROADCAST_IDS):
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")
