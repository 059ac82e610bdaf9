"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` for each language, fitted on a bounded number of
whole texts (`FIT_ROWS` for each language, `ASIDE_ROWS` more for the limits).
Every value of lang is learned, in blocks of `BLOCK` languages by name. The
models of a block share one store: the n-grams of all its languages and orders
as sorted 64-bit hashes, beside them for each language the interpolated
log-probability of the n-gram's last character and the back-off weight of the
n-gram as a context. Entries are distinct n-grams of the texts fitted on; a
worker holds one block at a time and keeps each text's best over the blocks,
so memory is bounded whatever the number of languages. The driver reads the
texts one at a time and keeps counts only. A block with more than ``2**16 - 1``
different symbols is halved; a single language beyond that has one number for
all symbols after.

A text is scored whole: the language with the least cross-entropy for each
character wins. A text is rejected when it has no letter or when its
cross-entropy is above what held-aside texts of that language show at its
length (``REJECT_MARGIN``).

Letters and marks on them are kept, letters lowered; runs of anything else
count as one space, so case, digits and markup do not matter. Null text or no
letter (marks alone are none): ``und``, score 0, rejected. Without any labelled text every text is ``und`` and rejected.
Equal cross-entropies: the first language by name. Rows are scored each for
itself; null ids, lang and source are no matter; other columns travel along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .sampling import GroupedTexts, group_counts

ORDER = 4
#: Languages that are fitted, broadcast and held at once.
BLOCK = 64
FIT_ROWS = 400
ASIDE_ROWS = 100
#: Size of the uniform distribution below unigrams.
SYMBOLS = 1 << 16
#: Rejected above the mean by so many standard deviations, and by half as much again as any held-aside text.
REJECT_MARGIN = 8.0
#: Least deviation, in nats, between texts of one language.
LEAST_BETWEEN = 0.15
CHARACTERS_AT_ONCE = 1 << 18
UNKNOWN = "und"

_START = 2  # stands before a text
_BITS = 16  # of a symbol's number in a packed n-gram
_LAGS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)  # odd multipliers
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point: itself or its lower case if a letter or mark, else a space."""
    global _fold
    if _fold is None:
        import unicodedata

        table = np.full(0x110000, 32, dtype=np.uint32)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind in "LM":
                low = chr(cp).lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _fold = table
    return _fold


def symbols_of(text: str) -> np.ndarray:
    """Folded code points, runs of spaces as one."""
    points = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = points == 32
    return points[np.r_[True, ~(space[1:] & space[:-1])]] if len(points) else points


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _mixed(keys: np.ndarray, order: int) -> np.ndarray:
    x = keys + np.uint64(order * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _rolling(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the unmixed key of the n symbols that end at each place (places before n-1 are wrong and must not be used)."""
    wide = points.astype(np.uint64)
    keys = [wide * _LAGS[0]]
    for n in range(1, order):
        more = np.zeros_like(wide)
        more[n:] = wide[:-n] * _LAGS[n]
        keys.append(keys[-1] + more)
    return keys


@dataclass
class CharModels:
    languages: list[str]
    hashes: np.ndarray  # uint64, sorted
    logs: np.ndarray  # float32 [hash, language]: log p(last symbol | the rest)
    backs: np.ndarray  # float32 [hash, language]: log back-off weight as a context
    floor: np.ndarray  # float32 [language]: log p of a symbol in no unigram
    limits: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))  # mean, deviation for one character, deviation between texts
    margins: np.ndarray = field(default_factory=lambda: np.zeros(0))
    order: int = ORDER
    directory: np.ndarray | None = None

    _DIRECTORY_BITS = 20

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the sorted store, -1 if absent: a directory of leading bits, then steps."""
        shift = np.uint64(64 - self._DIRECTORY_BITS)
        if self.directory is None:
            self.directory = np.r_[0, np.cumsum(np.bincount((self.hashes >> shift).astype(np.int64), minlength=1 << self._DIRECTORY_BITS))].astype(np.int32)
        lead = (hashes >> shift).astype(np.int64)
        place, end = self.directory[lead], self.directory[lead + 1]
        found = np.full(len(hashes), -1, dtype=np.int32)
        last = len(self.hashes) - 1
        at = np.minimum(place, last)
        hit = (self.hashes[at] == hashes) & (place < end)
        found[hit] = at[hit]
        left = np.nonzero(~hit & (place + 1 < end))[0]
        place = place[left]
        while len(left):
            place = place + 1
            hit = self.hashes[place] == hashes[left]
            found[left[hit]] = place[hit]
            go = ~hit & (place + 1 < end[left])
            left, place = left[go], place[go]
        return found

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats for each character [text, language], and the number of characters; 0 where there are none."""
        pad = np.full(self.order - 1, _START, dtype=np.uint32)
        parts, counts = [], []
        for text in texts:
            points = symbols_of(text) if has_letter(text) else np.zeros(0, dtype=np.uint32)
            counts.append(len(points))
            parts += [pad, points]
        counts = np.array(counts, dtype=np.int64)
        sums = np.zeros((len(texts), len(self.languages)), dtype=np.float64)
        if not counts.sum():
            return sums, counts
        stream = np.concatenate(parts)
        starts = np.cumsum(counts + self.order - 1) - counts  # first scored place of each text
        scored = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        keys = _rolling(stream, self.order)
        place = self.find(_mixed(keys[-1][scored], self.order))
        logs = self.logs[np.maximum(place, 0)]
        miss = np.nonzero(place < 0)[0]
        total = np.zeros((len(miss), len(self.languages)), dtype=np.float32)
        open_ = np.ones(len(miss), dtype=bool)
        for n in range(self.order - 1, 0, -1):
            todo = np.nonzero(open_)[0]
            if not len(todo):
                break
            at = scored[miss[todo]]
            context = self.find(_mixed(keys[n - 1][at - 1], n))
            total[todo[context >= 0]] += self.backs[context[context >= 0]]
            gram = self.find(_mixed(keys[n - 1][at], n))
            known = gram >= 0
            total[todo[known]] += self.logs[gram[known]]
            open_[todo[known]] = False
        total[open_] += self.floor
        logs[miss] = total
        filled = np.nonzero(counts)[0]
        sums[filled] = -np.add.reduceat(logs.astype(np.float64), (np.cumsum(counts) - counts)[filled], axis=0)
        sums[filled] /= counts[filled, None]
        return sums, counts


class Verdict:
    """The best language of each text over the blocks that were added, in the order of names."""

    def __init__(self, texts: int):
        self.lang = [UNKNOWN] * texts
        self.n = np.zeros(texts, dtype=np.int64)
        self.least = np.full(texts, np.inf)
        self.total = np.zeros(texts)  # likelihoods over at most 50 characters, relative to the best
        self.far = np.zeros(texts, dtype=bool)

    def add(self, models: CharModels, texts: list[str], at: int = 0) -> None:
        """Compares the texts from place ``at`` on with the languages of ``models``."""
        own = slice(at, at + len(texts))
        entropy, n = models.entropies(texts)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        length, before = np.minimum(n, 50), self.least[own]
        better = least < before
        now = np.where(better, least, before)
        kept = np.zeros(len(texts))
        old = np.isfinite(before)
        kept[old] = self.total[own][old] * np.exp(-(before - now)[old] * length[old])
        self.total[own] = kept + np.exp(-(entropy - now[:, None]) * length[:, None]).sum(axis=1)
        self.n[own], self.least[own] = n, now
        far = np.zeros(len(texts), dtype=bool)
        if len(models.limits):
            mean, by_character, between = models.limits[best].T
            far = (least - mean) / np.sqrt(by_character**2 / np.maximum(n, 1) + between**2) > models.margins[best]
        self.far[own] = np.where(better, far, self.far[own])
        for i in np.nonzero(better & (n > 0))[0].tolist():
            self.lang[at + i] = models.languages[best[i]]

    def columns(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score (share of the best language's likelihood over at most 50 characters), cross-entropy and whether rejected."""
        score = np.where(self.n > 0, 1.0 / np.where(self.total > 0, self.total, 1.0), 0.0)
        return self.lang, score, np.where(self.n > 0, self.least, 0.0), (self.n == 0) | self.far


class TooManySymbols(Exception):
    """More symbols than numbers for them."""


class Counts:
    """Packed n-grams of the full order (last symbol lowest) of each language, and how often each occurs, from texts added one by one."""

    _PENDING = 1 << 21

    def __init__(self, order: int = ORDER, strict: bool = False):
        self.order, self.strict = order, strict
        self.number = np.full(0x110000, -1, dtype=np.int32)
        self.number[_START], self.symbols = 0, [np.array([_START], dtype=np.uint32)]
        self.known, self.pending, self.size = 1, {}, {}

    def add(self, lang: str, text: str) -> None:
        if not has_letter(text):
            return
        points = symbols_of(text)
        new = np.unique(points)
        new = new[self.number[new] < 0]
        if self.known + len(new) > (1 << _BITS) - 1 and self.strict:
            raise TooManySymbols
        room = (1 << _BITS) - 1 - self.known
        self.number[new[:room]] = np.arange(self.known, self.known + len(new[:room]), dtype=np.int32)
        self.number[new[room:]] = (1 << _BITS) - 1
        self.symbols.append(new[:room])
        self.known += len(new[:room])
        ids = self.number[np.r_[np.full(self.order - 1, _START, dtype=np.uint32), points]].astype(np.uint64)
        packed = np.zeros(len(points), dtype=np.uint64)
        for lag in range(self.order):
            packed |= ids[self.order - 1 - lag : len(ids) - lag] << np.uint64(_BITS * lag)
        self.pending.setdefault(lang, []).append(np.unique(packed, return_counts=True))
        self.size[lang] = self.size.get(lang, 0) + len(self.pending[lang][-1][0])
        if self.size[lang] > self._PENDING and len(self.pending[lang]) > 1:
            self.pending[lang] = [self.of(lang)]
            self.size[lang] = 0

    def of(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        parts = self.pending.get(lang, [])
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, dtype=np.uint64), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]) if parts else None, minlength=len(keys)).astype(np.int64)

    def points(self) -> np.ndarray:
        """Code point of each number."""
        known = np.concatenate(self.symbols)
        return np.r_[known, np.zeros((1 << _BITS) - len(known), dtype=np.uint32)]


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key, 0 where absent."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.float64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], 0).astype(np.float64)


def fit(texts: dict[str, list[str]], order: int = ORDER, aside: dict[str, list[str]] | None = None) -> CharModels:
    """Models of the languages that are keys of ``texts``; ``aside`` sets the limits for rejection."""
    counts = Counts(order)
    for lang, own in texts.items():
        for text in own:
            counts.add(lang, text)
    models = fit_counts(counts, [lang for lang, own in texts.items() if own])
    if aside:
        set_limits(models, ((lang, t) for lang, own in aside.items() for t in own))
    return models


def fit_counts(counts: Counts, wanted: list[str]) -> CharModels:
    """Models from counted n-grams."""
    languages, order = sorted(wanted), counts.order
    if not languages:
        return CharModels([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), order=order)
    seen = counts.points()
    # For each language and n: sorted n-grams and their counts, below the full order counts of distinct left neighbours.
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        by_n = {order: counts.of(lang)}
        for n in range(order - 1, 0, -1):
            by_n[n] = np.unique(by_n[n + 1][0] & np.uint64((1 << (_BITS * n)) - 1), return_counts=True)
        grams.append([by_n[n] for n in range(1, order + 1)])
    width = len(languages)
    stores, below, floor = [], np.zeros((0, width)), np.full(width, -np.log(SYMBOLS))
    contexts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in languages]
    tables = []
    for n in range(1, order + 1):
        union = np.unique(np.concatenate([g[n - 1][0] for g in grams] + ([np.unique(np.concatenate([g[n][0] >> np.uint64(_BITS) for g in grams]))] if n < order else [])))
        logs = np.zeros((len(union), width))
        for j, own in enumerate(grams):
            keys, counts = own[n - 1]
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            heads, inverse = np.unique(keys >> np.uint64(_BITS), return_inverse=True)
            totals = np.bincount(inverse, weights=counts, minlength=len(heads))
            kinds = np.bincount(inverse, minlength=len(heads))
            back = discount * kinds / totals
            contexts[j].append((heads, back, totals))
            lower = np.full(len(union), 1.0 / SYMBOLS) if n == 1 else np.exp(tables[-1][1][np.searchsorted(tables[-1][0], union & np.uint64((1 << (_BITS * (n - 1))) - 1)), j])
            head = union >> np.uint64(_BITS)
            total = _at(heads, totals, head)
            share = np.where(total > 0, np.maximum(_at(keys, counts, union) - discount, 0) / np.maximum(total, 1), 0)
            weight = np.where(total > 0, _at(heads, back, head), 1.0)
            logs[:, j] = np.log(share + weight * lower)
            if n == 1:
                floor[j] = np.log(weight[0] / SYMBOLS)
        tables.append((union, logs))
    for n, (union, logs) in enumerate(tables, 1):
        backs = np.zeros((len(union), width))
        if n < order:
            for j in range(width):
                heads, back, _ = contexts[j][n]
                value = _at(heads, back, union)
                backs[:, j] = np.where(value > 0, np.log(np.maximum(value, 1e-30)), 0.0)
        keys = np.zeros(len(union), dtype=np.uint64)
        for lag in range(n):
            keys += seen[(union >> np.uint64(_BITS * lag)) & np.uint64((1 << _BITS) - 1)].astype(np.uint64) * _LAGS[lag]
        stores.append((_mixed(keys, n), logs, backs))
    hashes = np.concatenate([s[0] for s in stores])
    place = np.argsort(hashes, kind="stable")
    models = CharModels(languages, hashes[place], np.concatenate([s[1] for s in stores])[place].astype(np.float32), np.concatenate([s[2] for s in stores])[place].astype(np.float32), floor.astype(np.float32), order=order)
    return models


def set_limits(models: CharModels, aside) -> None:
    """What cross-entropies held-aside texts (language, text) show: the limits for rejection."""
    width = len(models.languages)
    seen: list[list[tuple[float, int]]] = [[] for _ in range(width)]
    place = {lang: j for j, lang in enumerate(models.languages)}
    for lang, text in aside:
        if lang in place and has_letter(text):
            entropy, n = models.entropies([text])
            seen[place[lang]].append((float(entropy[0, place[lang]]), int(n[0])))
    limits, margins = np.zeros((width, 3)), np.full(width, np.inf)
    for j, own in enumerate(seen):
        if len(own) < 3:
            continue
        x, n = (np.array(v) for v in zip(*own))
        long = n >= np.median(n)
        mean, between = np.average(x, weights=np.minimum(n, 2000)), max(x[long].std(), LEAST_BETWEEN)
        by_character = max(1.5, np.sqrt(max(0.0, np.median((x - mean) ** 2 * n))))
        limits[j] = mean, by_character, between
        margins[j] = max(REJECT_MARGIN, 1.5 * ((x - mean) / np.sqrt(by_character**2 / n + between**2)).max())
    limits[~np.isfinite(margins), 1] = 1.0
    models.limits, models.margins = limits, margins


def fitted(docs: DataFrame, order: int = ORDER, block: int = BLOCK) -> list[Broadcast]:
    """Broadcast models, in blocks of languages, from the labelled texts of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    counts, blocks = group_counts(docs, "lang"), []
    todo = [[*counts][start : start + block] for start in range(0, len(counts), block)]
    every = (FIT_ROWS + ASIDE_ROWS) // ASIDE_ROWS  # one text of so many is held aside
    while todo:
        names = todo.pop(0)
        sample = GroupedTexts(docs, "lang", {lang: counts[lang] for lang in names}, FIT_ROWS + ASIDE_ROWS)
        grams, found = Counts(order, strict=len(names) > 1), []
        try:
            for lang, i, text in sample:
                if i % every != every - 1:
                    grams.add(lang, text)
                if not i:
                    found.append(lang)
        except TooManySymbols:
            todo[:0] = [names[: len(names) // 2], names[len(names) // 2 :]]
            continue
        models = fit_counts(grams, found)
        if models.languages:
            set_limits(models, ((lang, text) for lang, i, text in sample if i % every == every - 1))
            blocks.append(docs.sparkSession.sparkContext.broadcast(models))
    return blocks


def chunks(texts: list[str], characters: int = CHARACTERS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about so many characters."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > characters:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def identified(docs: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """All columns of ``docs`` but its own ``lang_*``, with lang_pred, lang_score, lang_entropy and lang_rejected; ``blocks``: from `fitted`."""
    docs = docs.drop("lang_pred", "lang_score", "lang_entropy", "lang_rejected")
    at = docs.columns.index("text")
    schema = StructType([*docs.schema]).add("lang_pred", "string").add("lang_score", "double").add("lang_entropy", "double").add("lang_rejected", "boolean")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            verdict = Verdict(len(texts))
            for shared in blocks:
                models = shared.value
                for start, end in chunks(texts):
                    verdict.add(models, texts[start:end], start)
                if len(blocks) > 1:  # one block in memory; the next batch reads it again from the worker's disk
                    del models
                    shared.__dict__.pop("_value", None)
            lang, score, entropy, rejected = verdict.columns()
            yield pa.record_batch([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], names=schema.names)

    return docs.mapInArrow(run, schema)
