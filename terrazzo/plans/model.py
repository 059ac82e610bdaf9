"""A fitted additive model as plain data, and its evaluation as Columns, arrays and SQL.

A model is a baseline and rounds; a round is an intercept and terms; a term is
a table over the zones of one, two or three columns, or a spline of one, and a
weight. Every prediction is the sum of its terms, so explaining needs nothing
else. Tables are looked up softly: linear between zone centers (by the share
``lam`` of the column, 1 if not learned), constant outside, multilinear for
pairs and triples.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import scalar

#: Lookups of a row that do not consolidate, up to which a model is evaluated in generated code.
MAX_COLUMN_LOOKUPS = 2
#: Categories from which a lookup is a join with the category table instead of a CASE.
MAX_CASE_CATEGORIES = 200

Term = tuple[str, ...]


@dataclass
class Zoning:
    """Zones of one column: cuts and centers, or categories. The zone after the last real one is "missing"; categories also have "unseen"."""

    column: str
    cuts: list[float] = field(default_factory=list)
    centers: list[float] = field(default_factory=list)
    categories: list[str] | None = None
    lam: float = 1.0

    @property
    def real(self) -> int:
        return len(self.cuts) + 1 if self.categories is None else len(self.categories)

    @property
    def size(self) -> int:
        return self.real + (1 if self.categories is None else 2)

    def soft(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own zone, neighbour and the neighbour's weight of each value."""
        if self.categories is not None:
            own = x.astype(np.int64) if x.dtype.kind in "iu" else category_codes(x, self.categories)
            return own, own, np.zeros(len(own))
        x = x.astype(float)
        missing = np.isnan(x)
        own = np.where(missing, self.real, np.searchsorted(self.cuts, np.where(missing, 0.0, x), side="right"))
        centers = np.append(self.centers, 0.0)
        here = centers[own]
        other = np.where(missing, own, np.clip(np.where(x >= here, own + 1, own - 1), 0, self.real - 1))
        gap = centers[other] - here
        weight = np.where(missing | (other == own) | (gap == 0), 0.0, np.clip((np.where(missing, 0.0, x) - here) / np.where(gap == 0, 1.0, gap), 0.0, 1.0))
        return own, other, weight * self.lam

    def soft_columns(self) -> tuple[Column, Column, Column]:
        """Two zones and the second one's weight, on the same line as `soft`."""
        x = F.col(f"`{self.column}`")
        if self.categories is not None:
            own = scalar.category_index(x, self.categories)
            return own, own, F.lit(0.0)
        if self.lam < 1.0:
            return scalar.soft_weights(x.cast("double"), self.centers, self.cuts, self.lam)
        place = scalar.interpolated(x.cast("double"), self.centers, [float(i) for i in range(self.real)], float(self.real))
        low = place.cast("int")
        return low, F.least(low + 1, F.lit(self.size - 1)), place - low


def category_codes(x: np.ndarray, categories: Sequence[str]) -> np.ndarray:
    """Place of each value among sorted ``categories``; missing: their number; unseen: one more."""
    import pandas as pd

    codes = pd.Categorical(x, categories=list(categories)).codes.astype(np.int64)
    return np.where(codes >= 0, codes, np.where(pd.isna(x), len(categories), len(categories) + 1))


@dataclass
class Spline:
    """A continuous piecewise-linear main effect: intercept, slope and one bend for each knot; a value of its own for missing x."""

    knots: list[float]
    coef: list[float]
    missing: float = 0.0

    def design(self, x: np.ndarray) -> np.ndarray:
        """[1, x, max(x - knot, 0), ...] with missing x as 0."""
        x = np.where(np.isnan(x), 0.0, x)
        return np.stack([np.ones(len(x)), x, *(np.maximum(x - k, 0.0) for k in self.knots)], axis=1)

    def values(self, x: np.ndarray, coef: np.ndarray | None = None, missing: np.ndarray | float | None = None) -> np.ndarray:
        coef, missing = np.asarray(self.coef if coef is None else coef), self.missing if missing is None else missing
        return np.where(np.isnan(x), missing, (self.design(x) * coef).sum(axis=1))

    def column(self, x: Column) -> Column:
        total = F.lit(float(self.coef[0])) + x * F.lit(float(self.coef[1]))
        for k, bend in zip(self.knots, self.coef[2:]):
            total = total + F.greatest(x - F.lit(float(k)), F.lit(0.0)) * F.lit(float(bend))
        return F.when(x.isNull(), F.lit(float(self.missing))).otherwise(total)


@dataclass
class Round:
    zonings: dict[str, Zoning]
    tables: dict[Term, np.ndarray | Spline]
    weights: dict[Term, float]
    intercept: float = 0.0

    def soft(self, frame: dict[str, np.ndarray]) -> dict[str, tuple]:
        """Each column's soft lookup and its values."""
        return {c: (*z.soft(frame[c]), frame[c]) for c, z in self.zonings.items()}

    def values(self, term: Term, soft: dict[str, tuple], table=None, fold: np.ndarray | None = None) -> np.ndarray:
        """Looked-up values of a term; with ``fold`` the table has a leading axis of folds (splines: coefficients and missing values of each)."""
        table = self.tables[term] if table is None else table
        if isinstance(self.tables[term], Spline):
            x = soft[term[0]][3].astype(float)
            return table.values(x) if fold is None else self.tables[term].values(x, table[0][fold], table[1][fold])
        shape = table.shape if fold is None else table.shape[1:]
        flat, total = np.ravel(table), 0.0
        sides = [(0,) if self.zonings[c].categories is not None else (0, 1) for c in term]
        for corner in product(*sides):
            at, weight = fold, None
            for c, size, upper in zip(term, shape, corner):
                own, other, w, _ = soft[c]
                zone = other if upper else own
                at = zone if at is None else at * size + zone
                if self.zonings[c].categories is None:
                    w = w if upper else 1.0 - w
                    weight = w if weight is None else weight * w
            found = flat.take(at)
            total = total + (found if weight is None else weight * found)
        return total

    def column(self, term: Term) -> Column:
        table = self.tables[term]
        if isinstance(table, Spline):
            return table.column(F.col(f"`{term[0]}`").cast("double"))
        flat, sizes, total = scalar.array_literal([float(v) for v in np.ravel(table)]), table.shape, None
        places = [self.zonings[c].soft_columns() for c in term]
        for corner in product((0, 1), repeat=len(term)):
            if any(upper and self.zonings[c].categories is not None for c, upper in zip(term, corner)):
                continue
            at, weight = F.lit(0), F.lit(1.0)
            for (own, other, w), c, size, upper in zip(places, term, sizes, corner):
                at = at * F.lit(int(size)) + (other if upper else own)
                if self.zonings[c].categories is None:
                    weight = weight * (w if upper else 1 - w)
            part = weight * F.get(flat, at)
            total = part if total is None else total + part
        return total


@dataclass
class Model:
    baseline: float
    learning_rate: float
    rounds: list[Round]
    history: list[float] = field(default_factory=list)

    def terms(self) -> list[Term]:
        return list(dict.fromkeys(t for r in self.rounds for t in r.tables))

    def only(self, term: Term) -> Model:
        """The model of one term's contribution."""
        rounds = [Round({c: r.zonings[c] for c in term}, {term: r.tables[term]}, {term: r.weights.get(term, 0.0)}) for r in self.rounds if term in r.tables]
        return Model(0.0, self.learning_rate, rounds)

    def base(self) -> float:
        return self.baseline + self.learning_rate * sum(r.intercept for r in self.rounds)

    def shift(self) -> float:
        """All rounds' intercepts, without the baseline."""
        return self.learning_rate * sum(r.intercept for r in self.rounds)

    def _lines(self, column: str) -> list[Round]:
        """Rounds with a weighted main effect of ``column`` that is a line between zone centers."""
        own = [r for r in self.rounds if (column,) in r.tables and r.weights.get((column,), 0.0)]
        return own if all(r.zonings[column].categories is None and r.zonings[column].lam >= 1.0 and not isinstance(r.tables[(column,)], Spline) for r in own) else []

    def consolidated_main(self, column: str) -> tuple[list[float], list[float], float] | None:
        """All rounds' main effects of a continuous column as one line through the union of their centers; and the missing value."""
        own = self._lines(column)
        if not own:
            return None
        knots = np.unique(np.concatenate([r.zonings[column].centers for r in own]))
        total, missing = np.zeros(len(knots)), 0.0
        for r in own:
            z, table, w = r.zonings[column], r.tables[(column,)], self.learning_rate * r.weights[(column,)]
            total += w * np.interp(knots, z.centers, table[: z.real])
            missing += w * float(table[z.real])
        return knots.tolist(), total.tolist(), missing

    def term_columns(self) -> dict[Term, Column]:
        """Each term's whole contribution on the link scale."""
        out: dict[Term, Column] = {}
        for term in self.terms():
            line = self.consolidated_main(term[0]) if len(term) == 1 else None
            if line:
                out[term] = scalar.interpolated(F.col(f"`{term[0]}`").cast("double"), *line)
                continue
            parts = [F.lit(self.learning_rate * r.weights[term]) * r.column(term) for r in self.rounds if term in r.tables and r.weights.get(term, 0.0)]
            out[term] = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
        return out

    def score_column(self) -> Column:
        return sum(self.term_columns().values(), F.lit(self.base()))

    def lookups(self) -> int:
        """Lookups of a row that do not consolidate: those of pairs, triples, splines, hard zones and large category sets."""
        count = 0
        for r in self.rounds:
            for t, w in r.weights.items():
                if w and (len(t) > 1 or r.zonings[t[0]].categories is None and not self._lines(t[0])):
                    count += 1
                elif w and len(r.zonings[t[0]].categories or ()) > MAX_CASE_CATEGORIES:
                    count += MAX_COLUMN_LOOKUPS + 1
        return count

    def with_terms(self, df: DataFrame, into: str = "_terms") -> tuple[DataFrame, dict[Term, Column]]:
        """``df`` and each term's contribution as a Column.

        Up to ``MAX_COLUMN_LOOKUPS`` lookups that do not consolidate these are
        built-in expressions over ``df`` itself; beyond it generated code would
        be too long to be compiled, so one Arrow kernel appends an array of all
        terms.
        """
        if self.lookups() <= MAX_COLUMN_LOOKUPS:
            return df, self.term_columns()
        terms, model = self.terms(), self
        return with_arrays(df, [c for t in terms for c in t], self._text(), lambda frame, n: [np.broadcast_to(found.get(t, 0.0), n) for found in [model.arrays(frame)] for t in terms], into), {t: F.get(F.col(into), F.lit(i)) for i, t in enumerate(terms)}

    def _text(self) -> set[str]:
        return {c for r in self.rounds for c, z in r.zonings.items() if z.categories is not None}

    def arrays(self, frame: dict[str, np.ndarray]) -> dict[Term, np.ndarray]:
        out, kept = {}, {}
        for r in self.rounds:
            own = {c for t, w in r.weights.items() if w for c in t}
            for c in own:  # a column's categories are looked up once for all rounds
                if r.zonings[c].categories is not None and c not in kept:
                    kept[c] = category_codes(frame[c], r.zonings[c].categories) if frame[c].dtype.kind not in "iu" else frame[c]
            soft = {c: (*r.zonings[c].soft(kept.get(c, frame[c])), frame[c]) for c in own}
            for term in r.tables:
                if r.weights.get(term, 0.0):
                    out[term] = out.get(term, 0.0) + self.learning_rate * r.weights[term] * r.values(term, soft)
        return out

    def score(self, frame: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(frame.values()))) if frame else 0
        return self.base() + sum(self.arrays(frame).values(), np.zeros(n))

    def importance(self) -> dict[Term, float]:
        """Mean absolute table value by term, weighted as in the sum."""
        out: dict[Term, float] = {}
        for r in self.rounds:
            for t, table in r.tables.items():
                size = float(np.abs(np.asarray(table.coef[1:])).mean() if isinstance(table, Spline) else np.abs(table).mean())
                out[t] = out.get(t, 0.0) + abs(self.learning_rate * r.weights.get(t, 0.0)) * size
        return dict(sorted(out.items(), key=lambda kv: -kv[1]))

    def to_json(self) -> str:
        plain = lambda v: asdict(v) if isinstance(v, Spline) else v.tolist()
        rounds = [{"zonings": {c: asdict(z) for c, z in r.zonings.items()}, "tables": [[list(t), plain(v)] for t, v in r.tables.items()], "weights": [[list(t), w] for t, w in r.weights.items()], "intercept": r.intercept} for r in self.rounds]
        return json.dumps({"baseline": self.baseline, "learning_rate": self.learning_rate, "rounds": rounds, "history": self.history})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        whole = lambda v: Spline(**v) if isinstance(v, dict) else np.array(v)
        rounds = [Round({c: Zoning(**z) for c, z in r["zonings"].items()}, {tuple(t): whole(v) for t, v in r["tables"]}, {tuple(t): w for t, w in r["weights"]}, r["intercept"]) for r in d["rounds"]]
        return cls(d["baseline"], d["learning_rate"], rounds, d["history"])

    def to_sql(self, source: str, name: str = "prediction", link: str = "identity", keys: Sequence[str] = (), quote: str = '"') -> str:
        """One SELECT that any SQL engine with CASE, LEAST and GREATEST can run; mains are consolidated lines, pairs bilinear. Triples are refused."""
        if any(len(t) > 2 for t in self.terms()):
            raise ValueError("triples have no SQL form")
        q = lambda c: f"{quote}{c.replace(quote, 2 * quote)}{quote}"
        lit = lambda v: f"({float(v)!r})" if v < 0 else f"{float(v)!r}"

        def line(column: str, knots: list[float], values: list[float], missing: float) -> str:
            x = q(column)
            steps = [f"WHEN {x} IS NULL THEN {lit(missing)}", f"WHEN {x} <= {lit(knots[0])} THEN {lit(values[0])}"]
            for a, b, va, vb in zip(knots, knots[1:], values, values[1:]):
                steps.append(f"WHEN {x} <= {lit(b)} THEN {lit(va)} + ({x} - {lit(a)}) * {lit((vb - va) / (b - a))}")
            return f"(CASE {' '.join(steps)} ELSE {lit(values[-1])} END)"

        def over(z: Zoning, parts: list[str]) -> str:
            """Value by the column's zone: a line between the parts, which are expressions themselves."""
            x = q(z.column)
            if z.categories is not None:
                quoted = [c.replace("'", "''") for c in z.categories]
                steps = [f"WHEN {x} IS NULL THEN {parts[z.real]}", *(f"WHEN {x} = '{c}' THEN {p}" for c, p in zip(quoted, parts))]
                return f"(CASE {' '.join(steps)} ELSE {parts[z.real + 1]} END)"
            steps = [f"WHEN {x} IS NULL THEN {parts[z.real]}", f"WHEN {x} <= {lit(z.centers[0])} THEN {parts[0]}"]
            for a, b, pa, pb in zip(z.centers, z.centers[1:], parts, parts[1:]):
                steps.append(f"WHEN {x} <= {lit(b)} THEN {pa} + ({pb} - {pa}) * ({x} - {lit(a)}) / {lit(b - a)}")
            soft = f"(CASE {' '.join(steps)} ELSE {parts[z.real - 1]} END)"
            if z.lam >= 1.0:
                return soft
            steps = [f"WHEN {x} IS NULL THEN {parts[z.real]}", *(f"WHEN {x} < {lit(c)} THEN {p}" for c, p in zip(z.cuts, parts))]
            hard = f"(CASE {' '.join(steps)} ELSE {parts[z.real - 1]} END)"
            return f"({hard} + {lit(z.lam)} * ({soft} - {hard}))"

        def bent(column: str, s: Spline, w: float) -> str:
            x = q(column)
            total = " + ".join([lit(w * s.coef[0]), f"{x} * {lit(w * s.coef[1])}", *(f"GREATEST({x} - {lit(k)}, 0.0) * {lit(w * b)}" for k, b in zip(s.knots, s.coef[2:]))])
            return f"(CASE WHEN {x} IS NULL THEN {lit(w * s.missing)} ELSE {total} END)"

        sums = [lit(self.base())]
        for term in self.terms():
            whole = self.consolidated_main(term[0]) if len(term) == 1 else None
            if whole:
                sums.append(line(term[0], *whole))
                continue
            for r in self.rounds:
                w = self.learning_rate * r.weights.get(term, 0.0)
                if term in r.tables and w:
                    table, first = r.tables[term], r.zonings[term[0]]
                    if isinstance(table, Spline):
                        sums.append(bent(term[0], table, w))
                    elif len(term) == 1:
                        sums.append(over(first, [lit(w * v) for v in table]))
                    else:
                        sums.append(over(first, [over(r.zonings[term[1]], [lit(w * v) for v in row]) for row in table]))
        total = "\n  + ".join(sums)
        if link == "exp":
            total = f"EXP(LEAST(GREATEST({total}, -30.0), 30.0))"
        elif link == "sigmoid":
            total = f"1.0 / (1.0 + EXP(-LEAST(GREATEST({total}, -30.0), 30.0)))"
        return f"SELECT {', '.join([*map(q, keys), f'{total} AS {q(name)}'])}\nFROM {source}"


def with_arrays(df: DataFrame, columns: Sequence[str], text: set[str], kernel, into: str) -> DataFrame:
    """``df`` with an array column: ``kernel(frame, rows)`` gives a list of arrays from the named columns' values, over Arrow batches."""
    needed = list(dict.fromkeys(columns))
    inputs = [f"_in{i}" for i in range(len(needed))]
    given = df.withColumns({n: F.col(f"`{c}`").cast("string" if c in text else "double") for n, c in zip(inputs, needed)})
    schema = StructType([*df.schema, StructField(into, ArrayType(DoubleType()))])
    kept = df.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            frame = {c: batch.column(n).to_numpy(zero_copy_only=False) for n, c in zip(inputs, needed)}
            values = np.stack(kernel(frame, batch.num_rows), axis=1)
            flat = pa.array(np.ascontiguousarray(values, dtype=float).ravel())
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * values.shape[1])
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(offsets, flat)], names=[*kept, into])

    return given.mapInArrow(run, schema)


def with_scores(df: DataFrame, models: Sequence[Model], into: str = "_scores") -> DataFrame:
    """``df`` with an array column of each model's score, in one pass."""
    columns = [c for m in models for t in m.terms() for c in t]
    text = set().union(*(m._text() for m in models)) if models else set()
    return with_arrays(df, columns, text, lambda frame, n: [m.base() + sum(m.arrays(frame).values(), np.zeros(n)) for m in models], into)
