"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its letter trigrams (lowered, hashed to `TRIGRAMS`
numbers), pairs of neighbouring character classes (letters by case, digits,
space, line end, each common mark by itself) and its repetitions (words
equal to the one before, four-word runs seen before). Weighted by tf-idf they
are projected on the leading singular vectors of the labelled texts (latent
semantic analysis). The labelled vectors, `SAMPLE_ROWS` at most of `RANK`
numbers, are broadcast; each document's exact cosines with all of them are
taken in blocks as matrix products, and its ``NEIGHBOURS`` nearest vote with
their label, weighted by a power of the cosine.

Cases: null or empty text has the zero vector, cosine 0 with all, and gets the
share of label 1; without labels every score is 1 (nothing is rejected); ties
among neighbours go to the earlier in the sample's hash order by value;
repeated rows score equally; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .langid import chunks, symbols_of
from .sampling import labelled_texts

SAMPLE_ROWS = 6000
TRIGRAMS = 512
#: Weight of all trigrams against all other terms.
TRIGRAM_SHARE = 0.3
RANK = 48
NEIGHBOURS = 15
POWER = 8
BLOCK = 512
THRESHOLD = 0.3

_MARKS = ".,!?|#*$%&<>:;-'\"()/@=_+[]{}\\"
_CLASSES = 6 + len(_MARKS) + 1
_PAIRS = _CLASSES * _CLASSES
_STYLE = _PAIRS + 3
TERMS = _STYLE + TRIGRAMS
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)  # odd multipliers
_class_of: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of each code point of the basic plane: line end, space, upper, other letter, digit, each mark, all else."""
    global _class_of
    if _class_of is None:
        table = np.full(1 << 16, _CLASSES - 1, dtype=np.uint8)
        for cp in range(1 << 16):
            c = chr(cp)
            table[cp] = 0 if c == "\n" else 1 if c.isspace() else 2 if c.isupper() else 3 if c.isalpha() else 4 if c.isdigit() else 5 + _MARKS.index(c) if c in _MARKS else _CLASSES - 1
        _class_of = table
    return _class_of


def term_frequencies(texts: list[str]) -> np.ndarray:
    """[text, term]: square roots of relative frequencies."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    points = [np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF) for t in texts]
    sizes = np.array([len(p) for p in points])
    if sizes.sum():
        kinds = class_table()[np.concatenate(points)].astype(np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        same = row[1:] == row[:-1]
        code = (row[:-1] * _PAIRS + kinds[:-1] * _CLASSES + kinds[1:])[same]
        out[:, :_PAIRS] = np.bincount(code, minlength=len(texts) * _PAIRS).reshape(len(texts), _PAIRS)
        out[:, :_PAIRS] /= np.maximum(sizes - 1, 1)[:, None]
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if n > 1:
            again = sum(map(eq, words, words[1:])) / (n - 1)
            runs = n - 3
            before = 1 - len({*zip(words, words[1:], words[2:], words[3:])}) / runs if runs > 0 else 0.0
            out[i, _PAIRS:_STYLE] = again, before, 1 / n
    for i, text in enumerate(texts):
        letters = symbols_of(text).astype(np.uint64)
        if len(letters) > 2:
            mixed = (letters[:-2] * _MIX[0] + letters[1:-1] * _MIX[1] + letters[2:] * _MIX[2]) >> np.uint64(64 - TRIGRAMS.bit_length() + 1)
            out[i, _STYLE:] = np.bincount(mixed.astype(np.int64), minlength=TRIGRAMS) / len(mixed)
    return np.sqrt(out)


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of tf-idf, style and trigrams each with its share; takes the place of ``rows``."""
    rows *= idf
    for part, share in ((rows[:, :_STYLE], 1 - TRIGRAM_SHARE), (rows[:, _STYLE:], TRIGRAM_SHARE)):
        part *= np.float32(share**0.5) / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), np.float32(1e-12))
    return rows


@dataclass
class QualityModel:
    idf: np.ndarray  # [term]
    axes: np.ndarray  # [term, rank]
    vectors: np.ndarray  # [sample, rank], unit length
    labels: np.ndarray  # [sample]
    neighbours: int = NEIGHBOURS

    def latent(self, texts: list[str]) -> np.ndarray:
        return _unit(weighted(term_frequencies(texts), self.idf) @ self.axes)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(texts))
        vectors, share = self.latent(texts), float(self.labels.mean())
        out = np.empty(len(texts))
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            cosines = vectors[at : at + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            out[at : at + BLOCK] = np.where(total > 1e-12, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), share)
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(sample: Iterable[tuple[int, str]], rank: int = RANK) -> QualityModel:
    """A model from (label, text); of each text its terms are kept."""
    labels, parts, texts, size = [], [], [], 0
    for label, text in sample:
        labels.append(label)
        texts.append(text)
        size += len(text)
        if size > 1 << 20:
            parts.append(term_frequencies(texts))
            texts, size = [], 0
    if texts:
        parts.append(term_frequencies(texts))
    if not labels:
        return QualityModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    rows = np.empty((len(labels), TERMS), dtype=np.float32)
    at = len(labels)
    while parts:  # one copy of the terms
        part = parts.pop()
        rows[at - len(part) : at] = part
        at -= len(part)
    idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    rows = weighted(rows, idf)
    values, axes = np.linalg.eigh(rows.T @ rows if len(rows) >= TERMS else rows @ rows.T)
    order = np.argsort(values)[::-1][: min(rank, len(values))]
    axes = axes[:, order] if len(rows) >= TERMS else _unit((rows.T @ axes[:, order]).T).T
    axes = axes.astype(np.float32)
    return QualityModel(idf, axes, _unit(rows @ axes), np.array(labels, dtype=np.float64))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Model from the labelled documents outside the held-out fold."""
    return fit(labelled_texts(docs, labels, label, SAMPLE_ROWS))


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All columns of ``docs`` but its own ``quality_score``, with quality_score (0 to 1) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_ROWS * RANK + TERMS * RANK numbers at most
    docs = docs.drop("quality_score")
    at = docs.columns.index("text")
    schema = StructType([*docs.schema]).add("quality_score", "double")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for start, end in chunks(texts, 1 << 20):
                rows = batch.slice(start, end - start)
                yield pa.record_batch([*rows.columns, pa.array(shared.value.scores(texts[start:end]))], names=schema.names)

    return docs.mapInArrow(run, schema)
