"""URL filters: host and path rules, then a blocked Bloom filter before an exact join.

A page that no rule fits is judged by a list of URLs. The canonical listed URLs
fill a blocked Bloom filter: one hash picks a block of eight 64-bit words, six
bits of a second hash pick one bit in each word. The filter is a table of
blocks (block, w0..w7), at most ``MAX_BLOCKS`` rows or 151 MB (44 million URLs
at full width), so it can always be broadcast; a longer list only passes more
false hits. Possible hits go on to an exact hash join with the list, which
removes the false ones: the join's key is null for all other pages, and a
null key meets nothing.

Everything is DataFrame functions: filling is a ``bit_or`` aggregation that
combines before the shuffle, probing is a broadcast join on the block.

Cases: null or malformed URLs (no ``://``) have an empty host and path, fit no
rule, are listed nowhere and are allowed; repeated pages are judged each for
itself; an empty list or table works; other columns are ignored. The list is
written once and read from there. Up to ``MAX_BROADCAST_URLS`` listed URLs the
exact join is a broadcast hash join, so pages do not move; beyond it adaptive
execution splits a hot URL, since the listed side is distinct, and pages that
are no hit get a random key, since a null one would gather them in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

MAX_BLOCKS = 1 << 21
#: Listed URLs that are broadcast for the exact join.
MAX_BROADCAST_URLS = 1_000_000
BITS_PER_URL = 24
WORDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^/?#]*)", 1)
    return F.when(at == 0, "").otherwise(F.translate(host, _UPPER, _LOWER))


def path_of(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at == 0, "").otherwise(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1))


def canonical(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment, tracking parameters, index page and last slash; null if no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", ""), r"^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct<rule, verdict>; of equally long ones the first by name; null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _bits(url: Column) -> list[Column]:
    second = F.xxhash64(url, F.lit(1))
    places = [F.shiftrightunsigned(second, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), place) for place in places]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7 of the filter of ``listed.canonical``."""
    filled = listed.select(F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"), *(b.alias(f"w{j}") for j, b in enumerate(_bits(F.col("canonical")))))
    return filled.groupBy("block").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)))


def listed_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Distinct canonical forms, without nulls."""
    return urls.select(canonical(F.col(column)).alias("canonical")).where("canonical is not null").distinct()


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical and listed for each row of ``pages`` (page_id, url).

    ``listed`` has distinct, non-null ``canonical`` URLs to block (`listed_urls`).
    """
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    seen = seen.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    listed = checkpointed(listed.select("canonical"))
    known = listed.count()
    blocks = min(MAX_BLOCKS, max(1, -(-known * BITS_PER_URL // (64 * WORDS))))
    bloom = F.broadcast(bloom_blocks(listed, blocks))  # MAX_BLOCKS rows at most
    probed = seen.withColumn("_block", F.when(F.col("_rule").isNull(), F.pmod(F.xxhash64("canonical"), F.lit(blocks))))
    probed = probed.join(bloom, F.expr("_block = block and canonical is not null"), "left")
    passes = F.col("block").isNotNull()
    for j, bit in enumerate(_bits(F.col("canonical"))):
        passes = passes & (F.col(f"w{j}").bitwiseAND(bit) != 0)
    if known <= MAX_BROADCAST_URLS:
        exact, miss = F.broadcast(listed.select(F.col("canonical").alias("_listed"))), F.lit(None).cast("string")
    else:  # a NUL is in no canonical URL
        exact, miss = listed.select(F.col("canonical").alias("_listed")), F.concat(F.lit("\0"), F.xxhash64("page_id", "canonical").cast("string"))
    probed = probed.select("page_id", "host", "path", "canonical", "_rule", F.when(F.coalesce(passes, F.lit(False)), F.col("canonical")).otherwise(miss).alias("_hit"))
    joined = probed.join(exact, F.expr("_hit = _listed"), "left").withColumn("listed", F.col("_listed").isNotNull())
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "canonical", "listed")
