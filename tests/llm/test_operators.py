"""Operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrazzo.llm import components, fingerprint, langid, mixing, near_copies, packing, preference, quality_knn, quality_rules, simhash, toxicity, url_filter
from terrazzo.llm.queries import URL_RULES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SEPARATORS = " \t\n\x0b\f\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SEPARATORS:
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*out, word] if w]


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        text = " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))
        if kind < 0.2 and rows:  # near copy
            own = (rows[rng.randrange(len(rows))][1] or "a b").split()
            own[rng.randrange(len(own))] = "changed" if own else "x"
            text = " ".join(own)
        elif kind < 0.3:
            text = "\n".join([" ".join(rng.choices(WORDS, k=9))] * rng.randint(1, 5))
        elif kind < 0.35:
            text = rng.choice([None, "", "   ", "\n\n", "one", "héé ñ \x0b", "#*$ %&|<>", "Ünï 日本語 テスト", "  two  spaces ", "A B C"])
        rows.append((i * 7 % n, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None))
    rows.append((n, " ".join(rng.choices(WORDS, k=9000)), "en", "s0", 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Quality rules


def brute_counts(text):
    text = text or ""
    words = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts_are_those_of_brute_force(docs):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == docs.count()
    for i, text, *_ in corpus():
        want = brute_counts(text)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, (i, text)
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[i]["base_failed"] == failed
        assert not (failed and got[i]["kept"])


def test_quality_thresholds_follow_the_group(spark):
    twice = WORDS + WORDS[::-1]
    clean, marked = " ".join(twice), " ".join(w + "*" for w in twice)
    rows = [(i, clean + f" n{i}", "en", "s0", 0) for i in range(300)] + [(1000, marked, "en", "s0", 0)]
    rows += [(2000 + i, marked + f" n{i}", "en", "s1", 0) for i in range(300)]  # here marks are usual
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[1000] and all(got[i] for i in range(300)) and all(got[2000 + i] for i in range(300))


def test_quality_thresholds_do_not_depend_on_partitions(spark):
    """Over 100,000 rows a group, in any order and partitioning: equal limits, each within a bin of the exact quantile."""
    ratios = spark.range(120_000).select(F.lit("en").alias("lang"), F.lit("s").alias("source"), *(((F.xxhash64("id", F.lit(k)) % 1_000_003).cast("double") / 1_000_003 + 1.0).alias(name) for k, name in enumerate(quality_rules.LEAST_SPREAD)))
    found = [quality_rules.thresholds(df).first().asDict() for df in (ratios, ratios.repartition(7), ratios.orderBy(F.desc("id")).coalesce(2))]
    assert found[0] == found[1] == found[2]
    for name, spread in quality_rules.LEAST_SPREAD.items():
        values = np.sort([r[0] for r in ratios.select(name).collect()])
        low, high = (values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75))
        within = lambda x: {math.exp(math.log(quality_rules.GAMMA) * math.ceil(math.log(x) / math.log(quality_rules.GAMMA)))}
        (a,), (b,) = within(low), within(high)
        assert 1 <= a / low < quality_rules.GAMMA and 1 <= b / high < quality_rules.GAMMA
        assert found[0][f"max_{name}"] == pytest.approx(b + quality_rules.FENCE * max(b - a, spread))


def test_quality_verdicts_repeat(spark):
    """Groups of over 2,048 rows, twice each row; verdicts are equal whatever the partitions."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.concat(F.substring(F.md5(F.concat("id", i).cast("binary")), 1, 6), F.when(F.pmod(F.xxhash64("id", i), F.lit(40)) < F.when(F.col("id") % 50 == 0, 40).otherwise(F.col("id") % 9), "*").otherwise(""))), " ")
    docs = spark.range(5000).select((F.col("id") % 2500).alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), text.alias("text"), F.lit(1).alias("spans"))
    runs = [sorted(tuple(r) for r in quality_rules.quality_rules(d).select("doc_id", "n_symbols", "kept").collect()) for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == 5000 and len({r[2] for r in runs[0]}) == 2


def test_quality_of_nothing(spark):
    assert quality_rules.quality_rules(empty(spark)).count() == 0


# Packing


def test_packing_is_an_exact_round_trip(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in corpus()}
    pieces = packing.pack(docs, path, length=64).collect()
    by_doc, by_window = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0 and p["doc_tokens"] == len(want[p["doc_id"]])
        by_doc.setdefault(p["doc_id"], []).append((p["start"], ids))
        by_window.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["padded_length"]))
    assert {i: [x for _, ids in sorted(v) for x in ids] for i, v in by_doc.items()} == want
    for k, v in by_window.items():
        at = 0
        for offset, length, _ in sorted(v):
            assert offset == at
            at += length
        assert at == 64 or k == max(by_window)
        assert v[0][2] == (at if at & (at - 1) == 0 else 64)
    assert sorted(by_window) == list(range(len(by_window)))
    assert packing.pack(empty(spark), path).count() == 0


def test_chunks_have_the_tokenizers_own_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, chunked = Tokenizer.from_file(path), packing.ChunkTokenizer(path, kept=5)
    rng = random.Random(1)
    texts = ["", " ", "a  b", " a", "a ", "x <|endoftext|> y", "it's  don't\n\n we'll\t bar", "é  b", "a　b c", "\U0001f600 x", "1234 5 67!?", "a\n b", "﻿q r"]
    texts += ["".join(rng.choices("ab '\n\té日1.|", k=rng.randint(1, 40))) for _ in range(400)]
    assert chunked.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


# SimHash


def brute_fingerprint(text, size=4):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance=4):
    ids = sorted(values)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (values[a] ^ values[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_components_are_those_of_brute_force(docs):
    want = {i: brute_fingerprint(t) for i, t, *_ in corpus()}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == want
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(want)


@pytest.mark.parametrize(("segments", "chain"), [(5, 1), (5, 2), (8, 3), (4, 1)])
def test_pigeonring_loses_no_link(spark, segments, chain):
    rng = random.Random(segments)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(6):
            values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    got = {frozenset(r) for r in simhash.links(nodes, simhash.Ring(4, segments, chain)).collect()}
    ordered = sorted(values)
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(ordered) for b in ordered[:i] if (a ^ b).bit_count() <= 4}
    assert got == want


def test_simhash_edges(spark):
    rows = [(None, "a b c d", None, None, None), (5, "a b c d", None, None, None), (5, "a b c d", None, None, None), (9, None, None, None, None), (8, " ", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [(5, 5), (5, 5), (8, 8), (9, 8), (None, 5)]
    kept = [r["doc_id"] for r in simhash.deduplicated(df).collect()]
    assert sorted(kept, key=str) == [5, 5, 8, None]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_long_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 201: 200} | ({0: 0} if 0 in got else {}) | ({200: 200} if 200 in got else {})


# URL filter


def brute_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


URLS = [
    "http://a.example.net/en/1", "https://example.net/en/", "http://example.net/de/2", "http://net/x", "http://xnet/", "http://b.example.com/de/9?x#y", "http://EXAMPLE.com/DE/9",
    "http://c.org/fr/", "http://c.org/fr", "http://c.org?q=/fr/", "http://d.org#/fr/", "nothing", "", None, "://", "http://", "http://é.net/", "HTTP://A.NET", "http://a.net://b/fr/",
    "https://www.bad.example.org/x/?utm_source=q", "http://bad.example.org/x", "http://bad.example.org/xy", "http://bad.example.org:80/x/index.html", "http://bad.example.org/x",
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    listed = url_filter.listed_urls(spark.createDataFrame([("http://bad.example.org/x#top",), (None,)], "url string"))
    got = {r["page_id"]: r for r in url_filter.url_verdicts(pages, listed, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = brute_url(url)
        assert (got[i]["host"], got[i]["path"]) == (host, path), url
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert got[i]["rule"] == (best.name if best else None)
        assert got[i]["verdict"] == (best.verdict if best else "block" if i in (19, 20, 22, 23) else "allow"), url


def test_bloom_filter_passes_every_listed_url_and_few_others(spark, monkeypatch):
    listed = url_filter.listed_urls(spark.range(2000).select(F.concat(F.lit("http://l.example/"), "id").alias("url")))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://l.example/"), "id").alias("url"))
    for most in (url_filter.MAX_BLOCKS, 3):  # a filter far too small gives the same verdicts
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", most)
        assert url_filter.url_verdicts(pages, listed).where("verdict = 'block'").count() == 2000


def test_url_empty(spark):
    pages, none = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string"), spark.createDataFrame([], "canonical string")
    assert url_filter.url_verdicts(pages, none).first()["verdict"] == "allow"
    assert url_filter.url_verdicts(pages.limit(0), none).count() == 0


# Fingerprints


def brute_sketch(text, size=5, k=fingerprint.K):
    words = words_of(text)
    shingles = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())

    def combined(shingle):
        h = 42
        for word in shingle:
            h = xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(word.encode(), 42).to_bytes(8, "little"), h)
        return h - (1 << 64) if h >> 63 else h

    return sorted(map(combined, shingles))[:k], len(shingles)


def test_fingerprints_are_those_of_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    for i, text, *_ in corpus():
        sketch, n = brute_sketch(text)
        assert got[i]["sketch"] == sketch
        assert got[i]["fingerprint"] == "".join(f"{h & (1 << 64) - 1:016x}" for h in sketch)
        assert got[i]["n_shingles"] == n if n < fingerprint.K else abs(got[i]["n_shingles"] / n - 1) < 0.4
    assert fingerprint.fingerprints(empty(spark)).count() == 0


def test_sketches_merge_and_estimate(spark):
    one, two = list(range(0, 3000)), list(range(1000, 4000))
    text = lambda own: " ".join(f"w{i}" for i in own)
    df = spark.createDataFrame([(text(one), text(two), "", "a b")], "a string, b string, e string, f string")
    for c in "abef":
        df = fingerprint.sketched(df, c, f"s{c}")
    s = {c: F.col(f"s{c}") for c in "abef"}
    r = df.select(fingerprint.resemblance(s["a"], s["b"]).alias("j"), fingerprint.containment(s["a"], s["b"]).alias("c"), fingerprint.distinct_shingles(fingerprint.merge(s["a"], s["b"])).alias("n"), fingerprint.resemblance(s["e"], s["e"]).alias("ee"), fingerprint.resemblance(s["e"], s["f"]).alias("ef"), fingerprint.resemblance(s["a"], s["a"]).alias("aa")).first()
    assert abs(r["j"] - 0.5) < 0.15 and abs(r["c"] - 2 / 3) < 0.2 and abs(r["n"] / 4000 - 1) < 0.3 and (r["ee"], r["ef"], r["aa"]) == (1.0, 0.0, 1.0)
    parts = df.select(F.lit(1).alias("g"), "sa").unionByName(df.select(F.lit(1).alias("g"), F.col("sb").alias("sa")))
    both = fingerprint.corpus_sketch(parts, ["g"], "sa").first()["sa"]
    assert both == df.select(fingerprint.merge(s["a"], s["b"]).alias("m")).first()["m"]


@pytest.mark.parametrize("rows_per_range", [3, 17, 1000])
def test_next_document(spark, docs, rows_per_range):
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(docs, ["text"], rows_per_range).collect()}
    order = sorted(corpus(), key=lambda r: -r[0])
    want = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    assert got == want
    assert fingerprint.with_next(empty(spark), ["text"]).count() == 0


def test_next_of_shared_ids_texts_and_names(spark):
    """Ids and texts that most rows share, null ids, ties and columns named like the operator's own."""
    rows = [(None, "same")] * 90 + [(None, f"t{i % 25}") for i in range(50)] + [(7, "x")] * 60 + [(7, None)] * 3 + [(7, f"y{i}") for i in range(40)] + [(i, f"z{i}") for i in range(100, 130)] + [((1 << 63) - 1, "top")] * 9
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"_n": F.lit(1), "_range": F.lit("r"), "next_text": F.lit("old"), "_top_id": F.lit(0)}).repartition(3)
    hashed = dict(df.select("text", F.xxhash64("text")).distinct().collect())
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashed[r[1]]))
    want = Counter((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    for size in (4, 20, 1000):
        out = fingerprint.with_next(df, ["text"], size)
        assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in out.collect()) == want
        assert sorted(out.columns) == sorted(df.columns)


def test_fingerprint_query_edits_texts_as_asked(spark, tmp_path):
    from terrazzo.llm.queries import op9_fingerprint

    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op9_fingerprint(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = ({*brute_sketch(t)[0]} for t in (text, edited, after))
        like = lambda x, y: 1.0 if not x and not y else len({*sorted(x | y)[: fingerprint.K]} & x & y) / len(sorted(x | y)[: fingerprint.K])
        assert got[i]["near_edited"] == pytest.approx(like(a, b)) and got[i]["near_next"] == pytest.approx(like(a, c))


# Mixing


def brute_copies(row, ordinal, rate, seed=mixing.SEED):
    digest = hashlib.md5("\x1f".join("\x1e" if v is None else str(v) for v in row).encode()).hexdigest()
    draws = max(1, math.ceil(rate / mixing.MAX_RATE_PER_DRAW))
    mean, total = rate / draws, 0
    for j in range(1, draws + 1):
        u = int(hashlib.md5(f"{seed}:{digest}:{ordinal}:{j}".encode()).hexdigest()[:12], 16) / (1 << 48)
        k, p = 0, math.exp(-mean)
        cdf = p
        while cdf <= u:
            k += 1
            p *= mean / k
            cdf += p
        total += k
    return total


@pytest.mark.parametrize("weights", [None, {"s0": 1.0, "s1": 200.0}])
def test_copies_are_those_of_brute_force(docs, weights):
    rows = corpus()
    mass = Counter()
    for _, text, _, source, _ in rows:
        mass[source] += len(text or "") + 1
    weight = {s: m**0.7 for s, m in mass.items()} if weights is None else {s: weights.get(s, 0.0) for s in mass}
    rate = {s: weight[s] / sum(weight.values()) * sum(mass.values()) / mass[s] for s in mass}
    got = Counter(r["doc_id"] for r in mixing.mix_sources(docs, weights).collect())
    assert got == Counter({r[0]: n for r in rows if (n := brute_copies(r, 1, rate[r[3]]))})
    twice = Counter(r["doc_id"] for r in mixing.mix_sources(docs.unionByName(docs), weights).collect())
    assert twice == Counter({r[0]: n for r in rows if (n := sum(brute_copies(r, k, rate[r[3]]) for k in (1, 2)))})


def test_mixture_reaches_its_target_and_is_shuffled(spark):
    rows = [(i, "x" * 9, "en", f"s{i % 3}", 9) for i in range(6000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS).withColumn("mix_rate", F.lit(-1.0)), {"s0": 1, "s1": 2, "s2": 1}).collect()
    share = Counter(r["source"] for r in out)
    assert abs(share["s1"] / len(out) - 0.5) < 0.03 and abs(len(out) / 6000 - 1) < 0.05
    ids = [r["doc_id"] for r in out]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.05
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_mixture_of_rows_without_ids_and_of_equal_rows(spark, request):
    """Each row draws by itself, and copies spread over partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    none = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1000 + 1000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).alias("n_chars"))
    for rows in (none, none.withColumn("text", F.lit("one text for all")), none.withColumn("doc_id", F.lit(5))):
        out = mixing.mix_sources(rows)
        assert abs(out.count() - 4000) < 250
        per_part = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(per_part) > 1 and max(r["count"] for r in per_part) < 2500


# Preference formatting


def test_preference_pairs(spark):
    turns = "pair_id bigint, turn bigint, role string, text string"
    chosen = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 0, "user", "only"), (3, 0, "user", "same"), (3, 1, "assistant", None), (None, 0, "user", "x"), (4, 1, "assistant", "b"), (4, 0, "user", "a")]
    rejected = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "more"), (1, 4, "assistant", "é"), (3, 0, "user", "same"), (3, 1, "assistant", ""), (4, 0, "assistant", "a")]
    out = {r["pair_id"]: r for r in preference.preference_pairs(spark.createDataFrame(chosen, turns).withColumn("prompt", F.lit(1)), spark.createDataFrame(rejected, turns)).collect()}
    assert sorted(out) == [1, 2, 3, 4]
    one = out[1]
    assert one["prompt_turns"] == 2 and one["prompt"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n" and one["complete"]
    masked = lambda r, side: [r[side][s["start"] : s["end"]] for s in r[f"{side}_mask"]]
    assert masked(one, "chosen") == ["good<|im_end|>\n"] and masked(one, "rejected") == ["bad<|im_end|>\n", "é<|im_end|>\n"]
    assert not out[2]["complete"] and out[2]["prompt"] == "" and masked(out[2], "chosen") == []
    assert out[3]["prompt_turns"] == 2 and out[3]["chosen"] == out[3]["rejected"] == ""
    assert out[4]["prompt_turns"] == 0 and masked(out[4], "rejected") == ["a<|im_end|>\n"]
    none = spark.createDataFrame([], turns)
    assert preference.preference_pairs(none, none).count() == 0


# Classifiers


def language_texts(rng, letters, n):
    return [" ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(rng.randint(5, 60))) for _ in range(n)]


def brute_kneser_ney(texts, order, symbols=langid.SYMBOLS):
    """p(symbol | context) of an interpolated Kneser-Ney model, by dictionaries."""
    full = Counter()
    for t in texts:
        points = (langid._START,) * (order - 1) + tuple(langid.symbols_of(t).tolist())
        full.update(points[i : i + order] for i in range(len(points) - order + 1))
    counts = {order: full}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(gram[1:] for gram in counts[n + 1])
    stats = {}
    for n, own in counts.items():
        once, twice = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        totals, kinds = Counter(), Counter()
        for gram, v in own.items():
            totals[gram[:-1]] += v
            kinds[gram[:-1]] += 1
        stats[n] = own, (once / (once + 2 * twice) if once and twice else 0.5), totals, kinds

    def p(symbol, context, n=order):
        if n == 0:
            return 1 / symbols
        own, discount, totals, kinds = stats[n]
        context = context[len(context) - n + 1 :]
        lower = p(symbol, context, n - 1)
        if not totals[context]:
            return lower
        return max(own[context + (symbol,)] - discount, 0) / totals[context] + discount * kinds[context] / totals[context] * lower

    return p


def test_kneser_ney_is_that_of_brute_force():
    rng = random.Random(2)
    texts = {lang: [" ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(12)) for _ in range(8)] for lang, letters in (("a", "abcde"), ("b", "xyzab"), ("c", "مرحبا"))}
    models = langid.fit(texts, order=3)
    tried = [" ".join("".join(rng.choices("abcxyzé日", k=4)) for _ in range(5)) for _ in range(6)] + ["a", "ab", texts["a"][0]]
    entropy, counts = models.entropies(tried)
    for j, lang in enumerate(models.languages):
        p = brute_kneser_ney(texts[lang], 3)
        for i, t in enumerate(tried):
            points = (langid._START,) * 2 + tuple(langid.symbols_of(t).tolist())
            want = -sum(math.log(p(points[k], points[k - 2 : k])) for k in range(2, len(points)))
            assert entropy[i, j] == pytest.approx(want / counts[i], rel=1e-6)
        seen = {x for t in texts[lang] for x in langid.symbols_of(t).tolist()} | {langid._START}
        unseen = max(seen) + 1
        for context in (points[:2], tuple(map(ord, "ab")), tuple(map(ord, "qq"))):
            total = sum(p(x, context) for x in seen) + (langid.SYMBOLS - len(seen)) * p(unseen, context)
            assert total == pytest.approx(1.0, abs=1e-6)


def test_texts_without_letters_are_und(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en") for i in range(1, 30)] + [(i, "der hund und die katze " * 3, "de") for i in range(30, 60)]
    known = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    tried = spark.createDataFrame([(1, "\u0301\u0301"), (2, None), (3, ""), (4, "12 !?"), (5, "a"), (6, "the\u0301 cat " * 4000), (None, "die katze und der hund")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identified(tried, langid.fitted(known)).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert got[5][0] in ("en", "de") and got[6][0] == "en" and got[None][0] == "de"


def test_more_symbols_than_numbers_halve_a_block(spark, monkeypatch):
    rows = [(k * 100 + i, "".join(chr(0x4E00 + (k * 400 + (i * 37 + j * 11) % 390)) for j in range(60)), f"l{k}") for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(langid, "_BITS", 10)
    blocks = langid.fitted(df)
    assert sorted(lang for b in blocks for lang in b.value.languages) == ["l0", "l1", "l2"] and len(blocks) > 1
    got = langid.identified(df.drop("lang"), blocks).select("doc_id", "lang_pred").collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] // 100}" for r in got)


def test_language_identification(spark):
    rng = random.Random(2)
    rows = [(i, t, lang, "s", 1) for lang, letters in (("aa", "abcdefg"), ("bb", "efghijk")) for i, t in enumerate(language_texts(rng, letters, 150), 0 if lang == "aa" else 1000)]
    rows += [(5000, None, "aa", "s", 1), (5001, "12 !! 34", "aa", "s", 1), (5002, "", None, None, None), (5003, "日本語日本語日本語 日本語日本語", None, "s", 1), (5003, "ABC ABC", None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("clash")).repartition(3)
    models = langid.fitted(df)
    out = langid.identified(df, models).collect()
    held = [r for r in out if r["doc_id"] < 5000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 30 and all(r["lang_pred"] == r["lang"] and not r["lang_rejected"] for r in held)
    odd = {(r["doc_id"], r["text"]): r for r in out if r["doc_id"] >= 5000}
    assert {odd[k]["lang_pred"] for k in odd if k[0] in (5000, 5001, 5002)} == {"und"}
    assert odd[5003, "日本語日本語日本語 日本語日本語"]["lang_rejected"] and odd[5003, "ABC ABC"]["lang_pred"] == "aa"
    assert all(0 <= r["lang_score"] <= 1 for r in out)
    none = langid.identified(empty(spark), langid.fitted(empty(spark)))
    assert none.count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None, None, None)], DOCS)
    assert langid.identified(unlabelled, langid.fitted(unlabelled)).first()["lang_pred"] == "und"


def labelled(spark, label, positive, negative, n=240):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        rows.append((i, (positive if good else negative)(rng), "en", "s", 1))
        labels.append((i, int(good), int(good)))
    rows += [(n, None, None, None, None), (n + 1, "", None, None, None), (n + 1, "", None, None, None)]
    labels += [(n, 1, 0), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_voting(spark):
    plain = lambda rng: " ".join(rng.choices(WORDS, k=rng.randint(10, 60))) + "."
    junk = lambda rng: " ".join(w + rng.choice(["***", "&&&", "$$$"]) for w in rng.choices(WORDS, k=rng.randint(10, 60)))
    docs, labels = labelled(spark, "quality", plain, junk)
    out = quality_knn.scored(docs.withColumn("quality_score", F.lit("clash")), quality_knn.fitted(docs, labels)).collect()
    held = [r for r in out if r["doc_id"] < 240 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all((r["quality_score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in held) and len(out) == docs.count()
    assert quality_knn.scored(empty(spark), quality_knn.fitted(empty(spark), labels)).count() == 0


def test_blocked_cosines_are_exact(monkeypatch):
    rng = random.Random(8)
    sample = [(rng.randint(0, 1), " ".join(rng.choices([*WORDS, "A*", "9!", "B|"], k=30))) for _ in range(50)]
    model = quality_knn.fit(sample)
    texts = [" ".join(rng.choices([*WORDS, "A*", "9!"], k=20)) for _ in range(23)]
    v = model.latent(texts)
    want = []
    for x in v:
        cosine = model.vectors @ x
        near = np.argsort(-cosine, kind="stable")[: model.neighbours]
        w = np.maximum(cosine[near], 0).astype(float) ** quality_knn.POWER
        want.append((w * model.labels[near]).sum() / w.sum())
    monkeypatch.setattr(quality_knn, "BLOCK", 7)
    assert model.scores(texts) == pytest.approx(want, abs=1e-5)


def test_toxicity(spark):
    insults = ["horribleword", "nastyterm", "vileslur"]
    clean = lambda rng: " ".join("".join(rng.choices("abcdeghinoprst", k=rng.randint(3, 9))) for _ in range(60))
    toxic = lambda rng: clean(rng) + " " + " ".join(rng.choices(insults, k=3)) + " " + clean(rng)
    docs, labels = labelled(spark, "toxic", toxic, clean, 400)
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((out[i] >= 0.5) == (i % 3 > 0) for i in held)
    assert right >= 0.95 * len(held) and all(0 <= v <= 1 for v in out.values())
    assert toxicity.scored(empty(spark), toxicity.fitted(empty(spark), labels)).count() == 0
    one = toxicity.fit([(0, "a b c")] * 3)
    assert one.scorer()("anything") == 0.0


def test_samples_hold_whole_texts(spark):
    """No text is too long to be learned from, and only rows are bounded."""
    long = "word " * 60_000
    docs = spark.createDataFrame([(i, long if i % 7 == 0 else f"text {i}") for i in range(1, 60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id bigint, quality int")
    from terrazzo.llm import sampling

    found = list(sampling.labelled_texts(docs, labels, "quality", 1000))
    learned = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    assert len(found) == len(learned) and sum(t == long for _, t in found) == sum(i % 7 == 0 for i in learned)
    assert found == list(sampling.labelled_texts(docs.repartition(7), labels, "quality", 1000)) and len(list(sampling.labelled_texts(docs, labels, "quality", {0: 3, 1: 2}))) == 5
    grouped = list(sampling.GroupedTexts(docs.withColumn("lang", F.lit("x")), "lang", {"x": len(learned)}, 10))
    assert [i for _, i, _ in grouped] == list(range(10))


def test_names_like_the_operators_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y")], "doc_id bigint, text string").withColumns({c: F.lit("k") for c in ("_gone", "_id", "fp", "node", "quality_score", "toxicity", "part", "ids", "words", "codes", "label")})
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in near_copies.deduplicated(docs).collect()) == [1, 3]
    assert fingerprint.with_next(docs, ["text"]).count() == 3 and fingerprint.fingerprints(docs).count() == 3
    assert quality_rules.quality_rules(docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")})).count() == 3
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).agg(F.countDistinct("doc_id")).first()[0] == 3
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert quality_knn.scored(docs, quality_knn.fitted(docs, labels)).where("quality_score between 0 and 1").count() == 3
    assert toxicity.scored(docs, toxicity.fitted(docs, labels)).where("toxicity between 0 and 1").count() == 3


def test_stale_replies_of_ties_and_missing_ids(spark):
    turns = [("c", 1, "assistant", "b"), ("c", 1, "assistant", "a"), ("c", 2, "user", "q"), ("c", 3, "assistant", None), ("d", 1, "assistant", "only"), (None, 1, "assistant", "x"), ("e", 1, "user", "q")]
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in preference.stale_replies(spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")).collect())
    assert got == [("c", 1, "assistant", "a"), ("c", 1, "assistant", "b"), ("c", 2, "user", "q"), ("c", 3, "assistant", "a"), ("d", 1, "assistant", ""), ("e", 1, "user", "q")]


def test_long_chains_find_the_same_links(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (0, 1, 3, 4, 5)}
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    both = lambda: {frozenset(r) for r in simhash.fingerprint_links(nodes).collect()}
    short = both()
    monkeypatch.setattr(simhash, "LONG_CHAIN_FROM", 0)
    assert both() == short and len(short) > 100


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    from terrazzo.llm import shared

    class Context:
        master = "spark://somewhere"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session)


def test_near_copies_at_their_resemblance(spark, monkeypatch):
    rng, size = random.Random(11), 5
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, wanted = [], {}
    for k in range(60):
        n = rng.choice([100, 300, 900])
        base, least = [word() for _ in range(n)], (0.8, 0.85, 0.9, 0.6)[k % 4]
        copy, i = list(base), 0
        while True:  # scattered edits until the next would fall below
            tried = list(copy)
            tried[rng.randrange(n)] = word()
            a, b = ({tuple(t[j : j + size]) for j in range(n - size + 1)} for t in (base, tried))
            if len(a & b) / len(a | b) < least:
                break
            copy = tried
        a, b = ({tuple(t[j : j + size]) for j in range(n - size + 1)} for t in (base, copy))
        wanted[2 * k + 1] = len(a & b) / len(a | b) >= 0.8
        rows += [(2 * k, " ".join(base), "aa", "s", 1), (2 * k + 1, " ".join(copy).upper(), "aa", "s", 1)]
    assert 40 <= sum(wanted.values()) <= 45
    rows += [(500, "one two", None, None, 1), (501, "One  two", None, None, 1), (None, rows[0][1], "aa", "s", 1), (502, None, None, None, None), (503, " ", None, None, 1)]
    rows += [(600, rows[4][1], "aa", "s", 1), (600, rows[6][1] + " end", "aa", "s", 1)]  # one id, two texts
    gone = {i for i, near in wanted.items() if near} | {501, 503, 600}
    for most in (near_copies.MAX_BROADCAST_IDS, 0):  # ids broadcast, texts shuffled to them
        monkeypatch.setattr(near_copies, "MAX_BROADCAST_IDS", most)
        kept = [r["doc_id"] for r in near_copies.deduplicated(spark.createDataFrame(rows, DOCS).repartition(5)).collect()]
        assert sorted(i for i in kept if i is not None) == sorted({r[0] for r in rows} - gone - {None}) and kept.count(None) == 1


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = [(0, " ".join(base), "aa", "s", 1)]
    for k, edits in enumerate((3, 4, 6), 1):  # resemblance about 0.9, 0.87 and 0.82
        copy = list(base)
        for at in range(20, 20 + 40 * edits, 40):
            copy[at] = f"edit{k}"
        rows.append((k, " ".join(copy), "aa", "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [0]


def test_langid_learns_every_language_in_blocks(spark):
    rng, rows, letters = random.Random(2), [], "abcdefghijklmnopqrstuvwxyz"
    for k in range(70):  # more than a block; the last by name are the rarest
        own = random.Random(k).sample(letters, 5)
        for i in range(14 - k // 10):
            rows.append((1000 * k + i, " ".join("".join(rng.choices(own, k=rng.randint(2, 7))) for _ in range(60)), f"l{k:02}", "s", 1))
    df = spark.createDataFrame([*rows, (9, None, None, None, None)], DOCS).repartition(4)
    out = {}
    for block in (64, 16, 100):
        models = langid.fitted(df, block=block)
        assert len(models) == -(-70 // block)
        out[block] = {r["doc_id"]: (r["lang_pred"], round(r["lang_score"], 9), round(r["lang_entropy"], 5), r["lang_rejected"]) for r in langid.identified(df.drop("lang"), models).collect()}
    assert out[64] == out[100] == out[16]
    assert {r[2] for r in rows} == {v[0] for i, v in out[64].items() if i != 9} and sum(out[64][r[0]][0] == r[2] for r in rows) > 0.95 * len(rows)


def test_toxicity_sees_the_whole_run_of_letters():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(300)]
    signs = [chr(0x4E00 + k) for k in range(400)]

    def compound(toxic):  # its first twelve letters say nothing
        return " ".join([*rng.choices(vocabulary, k=40), "gemeinsamvor" + ("zyxwvuts" if toxic else "nopqrabc"), *rng.choices(vocabulary, k=20)])

    def unspaced(toxic):
        run = rng.choices(signs, k=120)
        for at in (30, 60, 90) if toxic else ():
            run[at + rng.randint(0, 15) : at + 16] = "\u6076\u6bd2\u8a00\u8bed\u8f31\u9a82\u4eba"
        return "".join(run)

    for text in (compound, unspaced):
        score = toxicity.fit([(k % 3 == 0, text(k % 3 == 0)) for k in range(300)]).scorer()
        right = [(score(text(toxic)) >= toxicity.THRESHOLD) == toxic for toxic in (True, False) for _ in range(50)]
        assert sum(right) >= 95
    assert all(any("z" in w for w in toxicity.windows(s)) for s in ("a" * 9 + "z", "a" * 40 + "z", "a" * 20 + "z" + "a" * 20))
