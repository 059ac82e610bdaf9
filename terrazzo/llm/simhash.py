"""Near-duplicates by SimHash, with candidates from the pigeonring principle.

A fingerprint has 64 bits; two link when at most ``distance`` (4) differ. Cut
the bits into a ring of ``segments`` (5). If a pair links, there is a segment
from which, clockwise, the first l segments together differ in at most
``l * distance / segments`` bits, for every l from 1 to all of them. So:

* the first two segments of such a chain (25 or 26 bits) differ in at most one
  bit, and that bit lies in the second: each fingerprint is put in a table
  under the chain from each start, and looked up under each chain value within
  that budget. A lookup that flips a bit is made only by the side that has the
  bit set, so each start meets each pair once;
* with many fingerprints the chains that are looked up have three segments
  (``LONG_CHAIN_FROM``): what meets by chance falls from N * N / 2^25 to
  N * N / 2^38 a lookup. Either finds the same links;
* a meeting pair must keep the budgets of three and four segments before the
  full Hamming distance is taken. All this is the join's condition, so pairs
  that fail are never rows.

Equal fingerprints are one node from the start, so groups of copies cost
nothing. Links go to connected components. No caps; nothing is sampled. The
nodes are the least doc_ids of the fingerprints.

Texts: A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``, shingles have
``size`` words (fewer words: one shingle of all); a shingle counts as often as
it occurs. A text without words (null too) has fingerprint zero and links like
any other. Rows with a null doc_id get a fingerprint, and the component of the
rows with an id that they link to, else null. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import checkpointed, unused

BITS = 64
DISTANCE = 4
SEGMENTS = 5
CHAIN = 2
#: Fingerprints from which a chain of three segments (38 bits, but twenty times the lookups) is cheaper than one of two.
LONG_CHAIN_FROM = 1 << 29
SIZE = 4
SEED = 42


def fingerprint_of(text: str | None, size: int = SIZE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only the six separators split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    counts = np.zeros(BITS, dtype=np.int64)
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(packed), 1 << 14):
        counts += np.unpackbits(packed[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint_of(t.as_py(), size, seed) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


class Ring:
    """Masks and budgets of a pigeonring over ``BITS`` bits."""

    def __init__(self, distance: int = DISTANCE, segments: int = SEGMENTS, chain: int = CHAIN):
        if not 1 <= chain < segments <= BITS:
            raise ValueError("need 1 <= chain < segments <= 64")
        borders = [round(BITS * i / segments) for i in range(segments + 1)]
        self.distance, self.segments, self.chain = distance, segments, chain
        self.bits = [list(range(borders[i], borders[i + 1])) for i in range(segments)]

    def budget(self, length: int) -> int:
        return length * self.distance // self.segments

    def mask(self, start: int, length: int) -> int:
        return sum(1 << b for i in range(length) for b in self.bits[(start + i) % self.segments])

    def flips(self, start: int) -> list[int]:
        """All sets of differing bits in the chain from ``start`` that keep the budgets of its prefixes."""
        found = [0]
        for length in range(1, self.chain + 1):
            own, grown = self.bits[(start + length - 1) % self.segments], []
            for mask in found:
                for more in range(self.budget(length) - mask.bit_count() + 1):
                    grown += [mask | sum(1 << b for b in chosen) for chosen in combinations(own, more)]
            found = grown
        return found


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(_signed(v)).cast("bigint") for v in values))


def links(nodes: DataFrame, ring: Ring | None = None) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``nodes.fp`` that differ in at most ``ring.distance`` bits; a pair may come more than once."""
    ring = ring or Ring()
    starts = range(ring.segments)
    chains = _longs([ring.mask(s, ring.chain) for s in starts])
    tables = nodes.select(F.col("fp").alias("b"), F.posexplode(chains).alias("start_b", "chain")).select("b", "start_b", F.col("b").bitwiseAND(F.col("chain")).alias("key_b"))
    # The side with the highest differing bit set makes the lookup.
    lookups = [(s, _signed(m), _signed(1 << (m.bit_length() - 1)) if m else 0) for s in starts for m in ring.flips(s)]
    tried = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(m).cast("bigint").alias("m"), F.lit(t).cast("bigint").alias("t")) for s, m, t in lookups))
    asked = nodes.select(F.col("fp").alias("a"), F.explode(F.filter(tried, lambda x: (x["t"] == 0) | (F.col("fp").bitwiseAND(x["t"]) != 0))).alias("x"))
    asked = asked.select("a", F.col("x.s").alias("start_a"), F.col("x.m").alias("flip"), F.col("a").bitwiseAND(F.get(chains, F.col("x.s"))).bitwiseXOR(F.col("x.m")).alias("key_a"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    keeps = (F.col("start_a") == F.col("start_b")) & (F.col("key_a") == F.col("key_b")) & ((F.col("flip") != 0) | (F.col("a") < F.col("b")))
    for length in range(ring.chain + 1, ring.segments):
        prefix = F.get(_longs([ring.mask(s, length) for s in starts]), F.col("start_a"))
        keeps = keeps & (F.bit_count(differ.bitwiseAND(prefix)) <= ring.budget(length))
    return asked.join(tables, keeps & (F.bit_count(differ) <= ring.distance)).select("a", "b")


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct pairs (a, b) of `links`, by the chain that suits the number of fingerprints; written to the shared folder."""
    chain = CHAIN if nodes.count() < LONG_CHAIN_FROM else CHAIN + 1
    return checkpointed(links(nodes, Ring(distance, max(SEGMENTS, distance + 1), chain)).distinct())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of each row of ``docs`` (doc_id, text)."""
    marked = checkpointed(fingerprints(docs, size, seed))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = fingerprint_links(nodes, distance)
    # Components of fingerprints, then the least doc_id of each.
    grouped = components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("fp"), F.col("component").alias("_c"))
    classed = checkpointed(nodes.join(grouped, "fp", "left").withColumn("_c", F.coalesce("_c", "fp")))
    least = classed.groupBy("_c").agg(F.min("least").alias("component_id"))
    return marked.join(classed.join(least, "_c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, distance: int = DISTANCE, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` but for those whose component has a lesser doc_id; rows with a null doc_id all stay, and rows with equal ids stay or go together."""
    gone = unused(docs, "_gone")
    ids = near_duplicates(docs, distance, size, seed).where("doc_id > component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
