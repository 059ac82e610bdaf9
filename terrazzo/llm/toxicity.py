"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary
windows, and each window of a text is compressed with either. A word of up to
``WINDOW`` letters is one window with its boundaries; over a longer run of
letters (compounds, scripts without spaces) a window slides by one letter to
the run's end, so each letter is seen wherever a phrase starts. No window spans
two words. Each letter is written ``STRETCH`` times, so that a phrase of a
dictionary is long against zstandard's fixed costs. Toxic documents consist mostly of ordinary windows;
the toxic dictionary is therefore trained on those windows of toxic documents
with a beginning that is at least ``CONTRAST`` times as frequent in toxic as in
ordinary documents.

Calibration: a table gives for each triple of lengths (plain, ordinary, toxic)
the log of how much likelier it is in toxic documents (``table``); a window
counts at the thresholds ``TIERS`` of that. A logistic regression over the
document's counts gives the score, moved to the label's true share.

What is fitted comes from a bounded number of labelled rows (`SAMPLE_ROWS` of
each label, whole texts); the ordinary dictionary is trained on
`ORDINARY_WINDOWS` of their windows; the dictionaries have `TOXIC_BYTES` and `ORDINARY_BYTES`, the table one
entry for each triple of lengths under 100. Every document is scored whole.

Cases: null and empty texts have no window and score by the regression's
constant; without labels of both kinds every score is the share of label 1
among the sample (0 without any); repeated rows score equally; other columns
are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_texts
from .shared import held_out

SAMPLE_ROWS = {0: 6000, 1: 3000}
ORDINARY_WINDOWS = 40_000
WINDOW = 9
STRETCH = 3
CONTRAST = 15.0
#: Least length of a beginning, boundary included.
BEGINNING = 4
LEVEL = 9
TOXIC_BYTES = 8192
ORDINARY_BYTES = 16384
TIERS = (1.0, 2.0, 3.0, 4.0)
THRESHOLD = 0.5
#: Windows whose lengths a worker keeps.
KEPT_WINDOWS = 500_000

_WORD = re.compile(r"[^\W\d_]+")
_EDGE = "\x01"


def windows(text: str) -> list[str]:
    """The boundary and letters of each word and the last boundary where it fits; of a longer run all windows up to its last boundary."""
    found = []
    for w in _WORD.findall(text.lower()):
        edged = _EDGE + w + _EDGE
        found.append(edged[: WINDOW + 1])
        if len(w) > WINDOW:
            found += [edged[i : i + WINDOW + 1] for i in range(1, len(edged) - WINDOW)]
    return found


def stretched(window: str) -> bytes:
    return "".join([c * STRETCH for c in window]).encode("utf-8", "surrogatepass")


def _compressor(content: bytes):
    import zstandard

    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False, write_checksum=False)


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
        return b"".join(dict.fromkeys(samples))[-size:]


class Lengths:
    """(plain, ordinary, toxic) length of windows as one number, each below 100."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)

    def of(self, window: str) -> int:
        plain = stretched(window)
        sizes = len(plain), len(self.ordinary.compress(plain)), len(self.toxic.compress(plain))
        return (min(sizes[0], 99) * 100 + min(sizes[1], 99)) * 100 + min(sizes[2], 99)


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    table: dict[int, float]
    weights: np.ndarray
    share: float  # of label 1

    def scorer(self):
        lengths, table, weights, kept = (Lengths(self.ordinary, self.toxic) if len(self.weights) else None), self.table, self.weights, {}

        def score(text: str | None) -> float:
            if not len(weights):
                return self.share
            if len(kept) > KEPT_WINDOWS:
                kept.clear()
            found = windows(text or "")
            for window in {*found}.difference(kept):
                kept[window] = table.get(lengths.of(window), 0.0)
            logs = np.array(list(map(kept.__getitem__, found)))
            return _sigmoid(float(_features(logs) @ weights))

        return score


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + float(np.exp(-max(-50.0, min(50.0, x)))))


def _features(logs: np.ndarray) -> np.ndarray:
    n = len(logs)
    counts = [(logs > tier).sum() for tier in TIERS] if n else [0] * len(TIERS)
    return np.array([1.0, *np.log1p(counts), logs.max() if n else 0.0, np.log1p(n), counts[1] / max(n, 1), counts[2] / max(n, 1)])


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression with standardized features and ridge; weights for the raw features."""
    mean, spread = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x[:, 1:] - mean) / spread]
    w, penalty = np.zeros(z.shape[1]), ridge * np.r_[0.0, np.ones(z.shape[1] - 1)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[0] - (w[1:] * mean / spread).sum(), w[1:] / spread]


def fit(sample: Iterable[tuple[int, str]], share: float | None = None, seed: int = 1) -> ToxicityModel:
    """A model from (label, text); ``share``: of label 1 where it counts, if the sample's differs. Of each text its windows' numbers are kept."""
    number: dict[str, int] = {}
    found, marks = [], []
    for label, text in sample:
        found.append(np.array([number.setdefault(w, len(number)) for w in windows(text)], dtype=np.int32))
        marks.append(bool(label))
    labels, all_windows = np.array(marks, dtype=bool), list(number)
    share = float(labels.mean()) if share is None and len(labels) else (share or 0.0)
    if len(labels) == 0 or labels.all() or not labels.any():
        return ToxicityModel(b"", b"", {}, np.zeros(0), share)
    beginnings = lambda w: [w[:k] for k in range(BEGINNING, WINDOW + 2) if len(w) >= k]
    seen = {True: Counter(), False: Counter()}
    for label, own in zip(labels, found):
        seen[bool(label)].update({h for w in np.unique(own).tolist() for h in beginnings(all_windows[w])})
    toxic, ordinary = int(labels.sum()), int((~labels).sum())
    least = max(2.0, 0.005 * toxic)
    contrast = {h for h, n in seen[True].items() if n >= least and n / toxic >= CONTRAST * (seen[False][h] + 0.5) / ordinary}
    seen.clear()
    marked = np.array([any(h in contrast for h in beginnings(w)) for w in all_windows], dtype=bool)
    toxic_windows = [stretched(all_windows[w]) for label, own in zip(labels, found) if label for w in own[marked[own]].tolist()]
    ordinary_texts, rng = [own for label, own in zip(labels, found) if not label], random.Random(seed)
    ends = np.cumsum([len(own) for own in ordinary_texts])
    places = sorted(rng.sample(range(int(ends[-1])), min(ORDINARY_WINDOWS, int(ends[-1]))))
    plain = [stretched(all_windows[ordinary_texts[i][place - int(ends[i]) + len(ordinary_texts[i])]]) for i, place in zip(np.searchsorted(ends, places, side="right").tolist(), places)]
    model = ToxicityModel(_dictionary(ORDINARY_BYTES, plain), _dictionary(TOXIC_BYTES, toxic_windows), {}, np.zeros(0), share)
    lengths = Lengths(model.ordinary, model.toxic)
    code_of = np.array([lengths.of(w) for w in all_windows], dtype=np.int64)
    counts = {kind: np.bincount(np.concatenate([code_of[own] for label, own in zip(labels, found) if label == kind]), minlength=1_000_000) for kind in (True, False)}
    totals = {kind: c.sum() + 1 for kind, c in counts.items()}
    log_of = np.where(counts[True] >= 3, np.log((counts[True] + 0.1) / totals[True]) - np.log((counts[False] + 0.5) / totals[False]), 0.0)
    model.table = {int(code): float(log_of[code]) for code in np.nonzero(counts[True] >= 3)[0]}
    x = np.array([_features(log_of[code_of[own]]) for own in found])
    model.weights = _regression(x, labels.astype(float))
    inside = labels.mean()
    model.weights[0] += np.log(share / (1 - share)) - np.log(inside / (1 - inside)) if 0 < share < 1 else 0.0
    return model


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """Model from the labelled documents outside the held-out fold."""
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = {r[0]: r[1] for r in usable.groupBy(F.col(label).cast("int")).count().collect()}
    total = sum(known.values())
    return fit(labelled_texts(docs, labels, label, SAMPLE_ROWS), known.get(1, 0) / total if total else 0.0)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and toxicity (0 to 1) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries and one table, see above

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = shared.value.scorer()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "toxicity"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, toxicity double")
