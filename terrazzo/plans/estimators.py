"""Estimators: regression, classification, survival, intervals, ensembles, periods.

Each takes a DataFrame and column names, fits by `boost` and returns
DataFrames. Replicates, periods, classes and quantiles are channels of one fit
over all rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, replace
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import losses, scalar
from ..operators import diagnostics, survival
from ..sources import frames
from ..operators.transformers import _lookup
from . import boost
from .model import Model, with_arrays, with_scores

class ZoneRegressor:
    """Boosted zone statistics for a numeric target. Every prediction is the sum of named terms."""

    def __init__(self, features: Sequence[str], target: str, categorical: Sequence[str] = (), offset: str | None = None, key: str = "row_id", validation: float = 0.2, calibration: float = 0.0, mondrian: str | None = None, mondrian_least: int = 20, refit: bool = False, weight: str | None = None, local: int | None = None, **settings):
        self.features, self.target, self.categorical, self.offset, self.key, self.weight, self.local = list(features), target, list(categorical), offset, key, weight, local
        self.validation, self.calibration, self.mondrian, self.mondrian_least, self.refit = validation, calibration, mondrian, mondrian_least, refit
        self.settings = boost.Settings(**settings)
        if offset and self.settings.loss not in losses.LOG_LINK:
            raise ValueError("an offset needs a log link")
        if refit and not calibration:
            raise ValueError("a refit needs calibration rows")
        self.overrides: list[tuple[str, float, float, float]] = []

    def with_model(self, model: Model, held: DataFrame | None = None, fitted_on: DataFrame | None = None) -> ZoneRegressor:
        """This estimator with a model from elsewhere (JSON, another fit) and the rows that intervals and evidence need."""
        self.model, self.held, self.fitted_on = model, held, fitted_on
        return self

    def fit(self, df: DataFrame) -> ZoneRegressor:
        cal = self.calibration
        for name in (self.offset, self.weight, self.mondrian):
            if name is not None and name not in df.columns:
                raise ValueError(f"unknown column {name!r}")
        fitted = lambda rows, settings, validation, calibration: boost.fit_frame(rows, self.features, self.target, settings, self.categorical, self.offset, self.key, validation, calibration, self.weight, self.local)
        self.model = fitted(df, self.settings, self.validation, cal)
        self.fitted_on = boost.cal_part(df, "fit", self.settings, self.validation, cal, self.key)
        if self.refit:
            rest = boost.cal_part(df, "val", self.settings, self.validation, cal, self.key).unionByName(self.fitted_on)
            again = replace(self.settings, rounds=len(self.model.rounds), patience=None)
            self.model, self.fitted_on = fitted(rest, again, 0.0, 0.0), rest
        self.held = boost.cal_part(df, "cal", self.settings, self.validation, cal, self.key) if cal else None
        return self

    def _edited(self, terms: dict[tuple[str, ...], Column]) -> dict[tuple[str, ...], Column]:
        for column, low, high, value in self.overrides:
            x = F.col(f"`{column}`")
            terms[(column,)] = F.when(x.between(low, high), F.lit(float(value))).otherwise(terms.get((column,), F.lit(0.0)))
        return terms

    def _base(self) -> Column:
        return F.lit(self.model.base()) + (F.col(self.offset) if self.offset else F.lit(0.0))

    def score(self) -> Column:
        return sum(self._edited(self.model.term_columns()).values(), self._base())

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        rows, terms = self.model.with_terms(df)
        total = sum(self._edited(terms).values(), self._base())
        return rows.withColumn(name, boost.link(self.settings, total)).drop("_terms")

    def explain(self, df: DataFrame, keep: Sequence[str] | None = None, purify: bool = False) -> DataFrame:
        """The key (or the columns ``keep``), ``baseline`` and one column for each term, named by its columns; they sum to the score.

        ``purify``: what pair terms hold of their columns' main effects is moved there.
        """
        if purify:
            return self._purified(df, keep)
        rows, terms = self.model.with_terms(df)
        named = {"baseline": self._base(), **{scalar.term_name(*t): c for t, c in self._edited(terms).items()}}
        return rows.select(*(F.col(f"`{c}`") for c in keep or [self.key]), *(c.alias(n) for n, c in named.items()))

    def _purified(self, df: DataFrame, keep: Sequence[str] | None) -> DataFrame:
        pairs = [t for t in self.model.terms() if len(t) == 2]
        sides = list(dict.fromkeys(c for t in pairs for c in t))
        bins = {}
        for c in sides:
            z = next(r.zonings[c] for r in reversed(self.model.rounds) if c in r.zonings)
            bins[c] = scalar.zone_index(F.col(f"_x_{c}"), z.cuts) if z.categories is None else scalar.category_index(F.col(f"_x_{c}"), z.categories)
        rows, terms = self.model.with_terms(df)
        terms = self._edited(terms)
        kept = keep or [self.key]
        named = {scalar.term_name(*t): v for t, v in terms.items()}
        rows = rows.select(*(F.col(f"`{c}`").alias(f"_k_{i}") for i, c in enumerate(kept)), *(F.col(f"`{c}`").alias(f"_x_{c}") for c in sides), self._base().alias("baseline"), *(v.alias(n) for n, v in named.items()))
        rows = rows.withColumns({f"_z_{c}": e for c, e in bins.items()}).withColumns({c: F.lit(0.0) for c in sides if c not in named})
        for t in pairs:
            name, (a, b) = scalar.term_name(*t), t
            cells = rows.groupBy(f"_z_{a}", f"_z_{b}").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(f"`{name}`").alias("v")).toPandas()  # zones x zones
            _, *gains = diagnostics.purify_gains(cells, f"_z_{a}", f"_z_{b}", "n", "v")
            taken = {c: F.get(scalar.array_literal([float(g.get(z, 0.0)) for z in range(int(max(g, default=0)) + 1)]), F.col(f"_z_{c}")) for c, g in zip(t, gains)}
            rows = rows.withColumns({name: F.col(f"`{name}`") - taken[a] - taken[b], a: F.col(f"`{a}`") + taken[a], b: F.col(f"`{b}`") + taken[b]})
        return rows.select(*(F.col(f"_k_{i}").alias(c) for i, c in enumerate(kept)), "baseline", *(F.col(f"`{n}`") for n in dict.fromkeys([*named, *sides])))

    def explain_long(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """key, term, contribution."""
        key = key or self.key
        wide = self.explain(df, [key])
        names = ["baseline", *(scalar.term_name(*t) for t in self._edited(dict.fromkeys(self.model.terms(), F.lit(0.0))))]
        return wide.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("term"), F.col(f"`{n}`").alias("contribution")) for n in names))).alias("t")).select(key, "t.*")

    def importance(self, df: DataFrame) -> DataFrame:
        """term, importance: mean absolute contribution over the rows."""
        long = self.explain_long(df).where("term <> 'baseline'")
        return long.groupBy("term").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(F.desc("importance"), "term")

    def override(self, column: str, low: float, high: float, value: float) -> ZoneRegressor:
        """A governed edit: where low <= column <= high the column's own contribution is ``value``; the last edit wins."""
        self.overrides.append((column, low, high, value))
        return self

    def reset_overrides(self) -> ZoneRegressor:
        self.overrides = []
        return self

    def edit_report(self, df: DataFrame, column: str, low: float, high: float, value: float) -> DataFrame:
        """Rows touched by an edit, and the mean and largest change of the prediction."""
        edited = ZoneRegressor.__new__(ZoneRegressor)
        edited.__dict__ = self.__dict__ | {"overrides": [*self.overrides, (column, low, high, value)]}
        rows, terms = self.model.with_terms(df)
        total = lambda model: boost.link(self.settings, sum(model._edited(dict(terms)).values(), self._base()))
        change = total(edited) - total(self)
        touched = F.col(column).between(low, high)
        return rows.agg(F.count(F.when(touched, 1)).alias("rows_touched"), F.avg(change).alias("mean_change"), F.max(F.abs(change)).alias("max_change"))

    def margins(self, alpha: float) -> DataFrame:
        if self.held is None:
            raise ValueError("intervals need calibration rows")
        if self.settings.loss != "squared_error":
            raise ValueError("intervals need the squared error")
        scored = self.predict(self.held, "_p").withColumn("_e", F.abs(F.col(self.target) - F.col("_p")))
        if self.mondrian:
            return diagnostics.mondrian_margins(scored, "_e", self.mondrian, alpha, self.mondrian_least)
        return diagnostics.order_statistic(scored, "_e", alpha)

    def predict_interval(self, df: DataFrame, alpha: float = 0.1) -> DataFrame:
        """prediction, lower and upper by split conformal margins, by group where one is named."""
        found = self.predict(df)
        margins = self.margins(alpha)
        if self.mondrian:
            everything = diagnostics.order_statistic(self.predict(self.held, "_p").withColumn("_e", F.abs(F.col(self.target) - F.col("_p"))), "_e", alpha).first()["margin"]
            own = margins.select(F.col(self.mondrian).alias("_g"), F.col("margin").alias("_m"))
            found = _lookup(found, own, F.col(self.mondrian).eqNullSafe(F.col("_g"))).withColumn("_m", F.coalesce("_m", F.lit(everything))).drop("_g")
        else:
            found = found.withColumn("_m", F.lit(margins.first()["margin"]))
        return found.withColumns({"lower": F.col("prediction") - F.col("_m"), "upper": F.col("prediction") + F.col("_m")}).drop("_m")

    def _grid(self, column: str, points: int) -> np.ndarray:
        found = [c for r in self.model.rounds if column in r.zonings and r.zonings[column].categories is None for c in r.zonings[column].centers]
        if not found:
            raise ValueError(f"{column} has no continuous effect")
        return np.linspace(min(found), max(found), points)

    def counterfactual(self, df: DataFrame, column: str | Sequence[str], target: float, points: int = 200, rounds: int = 3) -> DataFrame:
        """For each row the values of the named columns, on grids over their fitted ranges, whose score is nearest to ``target``.

        One column: the best of its grid, the least on ties. Several: each alone is tried first;
        then, from the best, one column at a time is moved to its best value, ``rounds`` times.
        The grid is tried inside the row: no rows are multiplied and none are shuffled. Edits count.
        Returns the key, the columns and ``gap``.
        """
        names = [column] if isinstance(column, str) else list(column)
        grids = {c: self._grid(c, points) for c in names}
        model, overrides, base = self.model, list(self.overrides), self.model.base()
        needed = list(dict.fromkeys([*names, *(c for t in model.terms() for c in t)]))

        def score(frame: dict) -> np.ndarray:
            found = model.arrays(frame)
            n = len(next(iter(frame.values())))
            for c, low, high, value in overrides:
                x = frame[c].astype(float)
                found[(c,)] = np.where((x >= low) & (x <= high), value, found.get((c,), np.zeros(n)))
            return base + sum(found.values(), np.zeros(n))

        def best(frame: dict, c: str, n: int) -> tuple[np.ndarray, np.ndarray]:
            """The value of ``c`` nearest to the target, and its gap; only terms with ``c`` change, so blocks of rows stay small."""
            value, gap = np.empty(n), np.empty(n)
            step = max(1, 200_000 // points)
            for at in range(0, n, step):
                block = {k: np.repeat(v[at : at + step], points) for k, v in frame.items()}
                size = min(step, n - at)
                block[c] = np.tile(grids[c], size)
                gaps = np.abs(score(block) - target).reshape(size, points)
                chosen = gaps.argmin(axis=1)
                value[at : at + size], gap[at : at + size] = grids[c][chosen], gaps[np.arange(size), chosen]
            return value, gap

        def kernel(frame: dict, n: int) -> list[np.ndarray]:
            frame = {c: v.astype(float) if c in names else v for c, v in frame.items()}
            tried = {c: best(frame, c, n) for c in names}
            first = np.stack([tried[c][1] for c in names]).argmin(axis=0)
            now = {**frame, **{c: np.where(first == i, tried[c][0], frame[c]) for i, c in enumerate(names)}}
            gap = np.stack([tried[c][1] for c in names]).min(axis=0)
            for _ in range(rounds if len(names) > 1 else 0):
                for c in names:
                    value, new = best(now, c, n)
                    better = new < gap - 1e-12
                    now[c], gap = np.where(better, value, now[c]), np.where(better, new, gap)
            return [*(now[c] for c in names), gap]

        found = with_arrays(df.select(*dict.fromkeys([self.key, *needed])), needed, model._text(), kernel, "_found")
        return found.select(self.key, *(F.when(~F.isnan(v := F.get("_found", F.lit(i))), v).alias(c) for i, c in enumerate(names)), F.get("_found", F.lit(len(names))).alias("gap"))

    def to_sql(self, source: str, keys: Sequence[str] = ()) -> str:
        if self.overrides:
            raise ValueError("edits are not part of the SQL form")
        return self.model.to_sql(source, link="exp" if self.settings.loss in losses.LOG_LINK else "identity", keys=keys)

    def card(self, df: DataFrame) -> str:
        """A model card as JSON: data, settings, rounds, terms and losses."""
        data = frames.fingerprint(df).first().asDict()
        terms = [{"term": scalar.term_name(*t), "importance": v} for t, v in self.model.importance().items()]
        settings = {k: (sorted(map(sorted, v)) if isinstance(v, frozenset) else v) for k, v in asdict(self.settings).items()}
        evidence = {c: {"rounds": len(own), "zones": [r.zonings[c].size for r in own][-1]} for c in self.features if (own := [r for r in self.model.rounds if (c,) in r.tables])}
        shapes = {"monotone": self.settings.monotone, "convex": self.settings.convex, "bounded": self.settings.bounded, "forbidden": settings["forbidden"]}
        return json.dumps({"evidence": evidence, "constraints": shapes, "data": data, "target": self.target, "features": self.features, "settings": settings, "rounds": len(self.model.rounds), "terms": terms, "loss": self.model.history}, default=str)

    def reliability(self, df: DataFrame) -> DataFrame:
        """Evidence for each row of ``df``: the fitted rows' support of its zones, averaged over the rounds, extrapolation and a quality class."""
        lines, outside = {}, F.lit(False)
        for c in self.features:
            own = [r.zonings[c] for r in self.model.rounds if (c,) in r.tables and r.zonings[c].categories is None]
            if not own:
                continue
            cuts = sorted({x for z in own for x in z.cuts})
            counts = {r["z"]: r["n"] for r in self.fitted_on.groupBy(scalar.zone_index(F.col(c), cuts).alias("z")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each piece between cuts
            piece = np.array([counts.get(i, 0) for i in range(len(cuts) + 2)], dtype=float)
            support = np.zeros(len(piece))
            for z in own:
                zone = np.r_[np.searchsorted(z.cuts, [cuts[0] - 1, *cuts] if cuts else [0.0], side="right"), len(z.cuts) + 1]
                support += np.bincount(zone, weights=piece, minlength=zone.max() + 1)[zone]
            lines[c] = F.get(scalar.array_literal((support / len(own)).tolist()), scalar.zone_index(F.col(c), cuts))
            outside = outside | diagnostics.outside_range(F.col(c), [x for z in own for x in z.centers])
        return diagnostics.evidence(df, list(lines.values()) or [F.lit(0.0)], outside)


class ZoneClassifier:
    """Log-odds boosting for two classes, joint softmax boosting for more.

    In a softmax round each class has tables of its own for the residual of its
    probability; the classes' steps are centred to sum to zero in each row.
    ``calibrate``: probabilities pass through isotonic lines fitted to held-out
    rows (the calibration part, else the validation part) and are divided by
    their sum; where all are zero they are equal.
    """

    def __init__(self, features: Sequence[str], label: str, categorical: Sequence[str] = (), key: str = "row_id", undersample: bool = False, validation: float = 0.0, calibration: float = 0.0, calibrate: bool = False, local: int | None = None, **settings):
        self.features, self.label, self.categorical, self.key, self.undersample = list(features), label, list(categorical), key, undersample
        self.validation, self.calibration, self.calibrate, self.local = validation, calibration, calibrate, local
        lacking = {"loss", "quantile", "power", "learn_m", "strict", "group", "trim", "splines"} & set(settings)
        if lacking:
            raise ValueError(f"a classifier has no {sorted(lacking)}")
        if calibrate and not (validation or calibration):
            raise ValueError("calibrating needs rows held out")
        self.settings = boost.Settings(**settings, loss="log_loss")

    def fit(self, df: DataFrame) -> ZoneClassifier:
        df = df.where(F.col(self.label).isNotNull())
        part = lambda name: boost.cal_part(df, name, self.settings, self.validation, self.calibration, self.key)
        self.held = part("cal" if self.calibration else "val") if self.calibrate else None
        if self.undersample:  # rows to fit only
            own = frames.undersample(part("fit"), self.label, self.key, self.settings.seed + 1)
            df = own.unionByName(part("val")).unionByName(part("cal")) if self.validation or self.calibration else own
        self.classes = [r[0] for r in df.groupBy(self.label).count().orderBy(self.label).collect()]  # one row for each class
        k = len(self.classes)
        if k < 2:
            raise ValueError("two classes at least are needed")
        number = F.lit(None).cast("double")
        for i, value in enumerate(self.classes):
            number = F.when(F.col(self.label) == F.lit(value), F.lit(float(i))).otherwise(number)
        settings = [self.settings] if k == 2 else [replace(self.settings, loss="softmax")] * k
        self.models = boost.fit_channels(df, self.features, number, settings, self.categorical, None, self.key, self.validation, self.calibration, None, self.local, classes=0 if k == 2 else k)
        self.lines = None
        if self.calibrate:
            self.lines = [self._isotonic(i) for i in (range(k) if k > 2 else (1,))]
        return self

    def _isotonic(self, i: int, levels: int = 10_000) -> tuple[list[float], list[float]]:
        """Points of the isotonic line of class i; probabilities are counted on a grid of ``levels`` first."""
        p = F.round(F.col("p") * levels)
        scored = self._with_probabilities(self.held, raw=True).select(F.get("_p", F.lit(i)).alias("p"), (F.col(self.label) == F.lit(self.classes[i])).cast("double").alias("y"))
        found = sorted(tuple(r) for r in scored.groupBy(p.alias("g")).agg(F.count(F.lit(1)).cast("double"), F.avg("y"), F.avg("p")).collect())  # `levels` at most
        if not found:
            return [0.0, 1.0], [0.0, 1.0]
        x, w, y = (np.array([r[j] for r in found]) for j in (3, 1, 2))
        fitted = boost.isotonic(y, w)
        turn = [j for j in range(len(x)) if j in (0, len(x) - 1) or fitted[j] != fitted[j - 1] or fitted[j] != fitted[j + 1]]
        return x[turn].tolist(), fitted[turn].tolist()

    def _with_probabilities(self, df: DataFrame, raw: bool = False) -> DataFrame:
        """``df`` with ``_p``, the classes' probabilities in their order."""
        models, lines, two = self.models, None if raw else self.lines, len(self.classes) == 2
        columns = [c for m in models for t in m.terms() for c in t] or self.features[:1]
        text = set().union(*(m._text() for m in models)) | {c for c in self.features[:1] if df.schema[c].dataType.typeName() == "string"}

        def kernel(frame: dict, n: int) -> list[np.ndarray]:
            if two:
                score = models[0].base() + sum(models[0].arrays(frame).values(), np.zeros(n))
                p = 1 / (1 + np.exp(-np.clip(score, -scalar.CLIP, scalar.CLIP)))
                p = np.interp(p, *lines[0]) if lines else p
                return [1 - p, p]
            step = np.stack([m.shift() + sum(m.arrays(frame).values(), np.zeros(n)) for m in models])
            z = np.array([m.baseline for m in models])[:, None] + step - step.mean(axis=0)
            e = np.exp(z - z.max(axis=0))
            p = e / e.sum(axis=0)
            if lines:
                p = np.stack([np.interp(x, *line) for x, line in zip(p, lines)])
                total = p.sum(axis=0)
                p = np.where(total > 0, p / np.where(total > 0, total, 1.0), 1 / len(p))
            return list(p)

        return with_arrays(df, columns, text, kernel, "_p")

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p_<class>`` for each class and ``predicted``; the first class wins ties."""
        rows = self._with_probabilities(df)
        out = rows.withColumns({f"p_{c}": F.get("_p", F.lit(i)) for i, c in enumerate(self.classes)}).drop("_p")
        best = F.greatest(*(F.col(f"`p_{c}`") for c in self.classes))
        choice = F.lit(self.classes[-1])
        for c in reversed(self.classes[:-1]):
            choice = F.when(F.col(f"`p_{c}`") >= best, F.lit(c)).otherwise(choice)
        return out.withColumn("predicted", choice)

    def explain(self, df: DataFrame, value=None, keep: Sequence[str] | None = None) -> DataFrame:
        """The key (or ``keep``), ``baseline`` and one column for each term of the score of class ``value`` (two classes: the second's log-odds).

        With more classes ``_softmax_centering`` is what centring takes from every class in a row;
        with it, the columns sum to the class's score.
        """
        kept = list(keep or [self.key])
        if len(self.classes) == 2:
            rows, terms = self.models[0].with_terms(df)
            named = {"baseline": F.lit(self.models[0].base()), **{scalar.term_name(*t): c for t, c in terms.items()}}
            return rows.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(n) for n, c in named.items()))
        if value not in self.classes:
            raise ValueError(f"unknown class {value!r}")
        model, models = self.models[self.classes.index(value)], self.models
        terms = model.terms()

        def kernel(frame: dict, n: int) -> list[np.ndarray]:
            own = model.arrays(frame)
            mean = sum(m.shift() + sum(m.arrays(frame).values(), np.zeros(n)) for m in models) / len(models)
            return [*(np.broadcast_to(own.get(t, 0.0), n) for t in terms), -mean]

        text = set().union(*(m._text() for m in models))
        rows = with_arrays(df, [c for m in models for t in m.terms() for c in t], text, kernel, "_terms")
        named = {scalar.term_name(*t): F.get("_terms", F.lit(i)) for i, t in enumerate(terms)} | {"_softmax_centering": F.get("_terms", F.lit(len(terms)))}
        return rows.select(*(F.col(f"`{c}`") for c in kept), F.lit(model.base()).alias("baseline"), *(c.alias(n) for n, c in named.items()))

    def importance(self, df: DataFrame) -> DataFrame:
        """term, importance: mean absolute contribution over the rows, averaged over the classes."""
        parts = []
        for value in (self.classes if len(self.classes) > 2 else self.classes[1:]):
            wide = self.explain(df, value)
            names = [c for c in wide.columns if c not in (self.key, "baseline", "_softmax_centering")]
            if names:
                means = wide.agg(*(F.avg(F.abs(F.col(f"`{n}`"))).alias(f"v{i}") for i, n in enumerate(names)))
                parts.append(means.select(F.explode(F.array(*(F.struct(F.lit(n).alias("term"), F.col(f"v{i}").alias("importance")) for i, n in enumerate(names)))).alias("t")).select("t.*"))
        if not parts:
            return df.sparkSession.createDataFrame([], "term string, importance double")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("term").agg((F.sum("importance") / len(parts)).alias("importance")).orderBy(F.desc("importance"), "term")

    def card(self, df: DataFrame) -> str:
        """A model card as JSON: data, classes, settings and terms."""
        settings = {k: (sorted(map(sorted, v)) if isinstance(v, frozenset) else v) for k, v in asdict(self.settings).items()}
        terms = [[{"term": scalar.term_name(*t), "importance": v} for t, v in m.importance().items()] for m in self.models]
        return json.dumps({"data": frames.fingerprint(df).first().asDict(), "label": self.label, "classes": self.classes, "features": self.features, "settings": settings, "rounds": len(self.models[0].rounds), "terms": terms, "loss": self.models[0].history}, default=str)


class ConformalQuantiles:
    """Two quantile models, fitted together, widened by the margin of how far held-out targets fall outside."""

    def __init__(self, features: Sequence[str], target: str, alpha: float = 0.1, calibration: float = 0.25, categorical: Sequence[str] = (), key: str = "row_id", validation: float = 0.0, local: int | None = None, **settings):
        if not 0 < alpha < 1 or not 0 < calibration < 1:
            raise ValueError("alpha and calibration lie in (0, 1)")
        self.features, self.alpha, self.target, self.calibration, self.categorical, self.key, self.validation, self.local = list(features), alpha, target, calibration, list(categorical), key, validation, local
        self.settings = [boost.Settings(**settings, loss="quantile", quantile=q) for q in (alpha / 2, 1 - alpha / 2)]

    def _scored(self, df: DataFrame) -> DataFrame:
        low, high = F.get("_scores", F.lit(0)), F.get("_scores", F.lit(1))
        return with_scores(df, self.models).withColumns({"lower": F.least(low, high), "upper": F.greatest(low, high)}).drop("_scores")

    def fit(self, df: DataFrame) -> ConformalQuantiles:
        self.models = boost.fit_channels(df, self.features, F.col(self.target), self.settings, self.categorical, None, self.key, self.validation, self.calibration, None, self.local)
        held = boost.cal_part(df, "cal", self.settings[0], self.validation, self.calibration, self.key)
        scored = self._scored(held).withColumn("_c", diagnostics.conformal_score(F.col(self.target), F.col("lower"), F.col("upper")))
        self.margin = diagnostics.order_statistic(scored, "_c", self.alpha).first()["margin"]
        return self

    def predict_interval(self, df: DataFrame) -> DataFrame:
        margin = F.lit(float(self.margin))
        return self._scored(df).withColumns({"lower": F.col("lower") - margin, "upper": F.col("upper") + margin})


class ZoneForest:
    """Mean of models, each fitted to a bootstrap of the rows (a Poisson number of each) and a share of the columns; all in one pass."""

    def __init__(self, features: Sequence[str], target: str, categorical: Sequence[str] = (), estimators: int = 10, column_share_of_models: float = 1.0, key: str = "row_id", local: int | None = None, **settings):
        if estimators < 2 or not 0 < column_share_of_models <= 1:
            raise ValueError("two estimators at least, and a column share in (0, 1]")
        self.features, self.target, self.categorical, self.estimators, self.share, self.key, self.local = list(features), target, list(categorical), estimators, column_share_of_models, key, local
        self.settings = boost.Settings(**settings)

    def _columns(self, replicate: int) -> list[str]:
        rng = np.random.default_rng([self.settings.seed, replicate])
        chosen = set(rng.permutation(self.features)[: max(1, round(self.share * len(self.features)))].tolist())
        return [c for c in self.features if c in chosen]

    def fit(self, df: DataFrame) -> ZoneForest:
        subsets = [self._columns(k) for k in range(self.estimators)]
        self.models = boost.fit_channels(df, self.features, F.col(self.target), [self.settings] * self.estimators, self.categorical, None, self.key, local=self.local, replicates=True, subsets=subsets)
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        mean = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x) / len(self.models)
        return with_scores(df, self.models).withColumn(name, mean).drop("_scores")

    def _long(self, df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
        """``keep`` and ``_terms``, each replicate's contributions in the order of the names that are also returned."""
        models = self.models
        names = list(dict.fromkeys(scalar.term_name(*t) for m in models for t in m.terms()))

        def kernel(frame: dict, n: int) -> list[np.ndarray]:
            out = []
            for m in models:
                own = {scalar.term_name(*t): v for t, v in m.arrays(frame).items()}
                out += [np.full(n, m.base()), *(np.broadcast_to(own.get(name, 0.0), n) for name in names)]
            return out

        rows = with_arrays(df, [c for m in models for t in m.terms() for c in t], set().union(*(m._text() for m in models)), kernel, "_terms")
        return rows.select(*(F.col(f"`{c}`") for c in keep), "_terms"), names

    def _over(self, place: int, width: int) -> Column:
        """One term's contributions over the replicates."""
        return F.array(*(F.get("_terms", F.lit(k * width + place)) for k in range(len(self.models))))

    def explain(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """The key (or ``keep``) and the mean of each term over all models, absent ones as zero."""
        kept = list(keep or [self.key])
        rows, names = self._long(df, kept)
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / len(self.models)
        return rows.select(*(F.col(f"`{c}`") for c in kept), *(mean(self._over(i, len(names) + 1)).alias(n) for i, n in enumerate(["baseline", *names])))


def _percentile(values: Column, count: int, q: float) -> Column:
    """Interpolated percentile of an array of ``count`` numbers."""
    low = int(q * (count - 1))
    a, b = F.get(values, F.lit(low)), F.get(values, F.lit(min(low + 1, count - 1)))
    return a + (b - a) * F.lit(q * (count - 1) - low)


class BootstrapStability(ZoneForest):
    """How stable terms and contributions are over replicates."""

    def __init__(self, *args, alpha: float = 0.1, **options):
        if not 0 < alpha < 1:
            raise ValueError("alpha lies in (0, 1)")
        super().__init__(*args, **options)
        self.alpha = alpha

    def inclusion(self) -> dict[str, float]:
        """Share of replicates in which a term has weight."""
        seen: dict[str, int] = {}
        for m in self.models:
            for t in {scalar.term_name(*t) for r in m.rounds for t, w in r.weights.items() if w}:
                seen[t] = seen.get(t, 0) + 1
        return {t: n / len(self.models) for t, n in sorted(seen.items())}

    def importance_interval(self, alpha: float = 0.1) -> dict[str, tuple[float, float]]:
        found: dict[str, list[float]] = {}
        every = [{scalar.term_name(*t): v for t, v in m.importance().items()} for m in self.models]
        for name in sorted({t for e in every for t in e}):
            found[name] = [e.get(name, 0.0) for e in every]
        return {t: tuple(np.quantile(v, [alpha / 2, 1 - alpha / 2])) for t, v in found.items()}

    def contribution_interval(self, df: DataFrame, alpha: float | None = None, keep: Sequence[str] | None = None) -> DataFrame:
        """The key (or ``keep``), term, mean, low and high of each term's contribution to each row over the replicates."""
        kept, alpha = list(keep or [self.key]), self.alpha if alpha is None else alpha
        rows, names = self._long(df, kept)
        n, width = len(self.models), len(names) + 1
        parts = []
        for i, name in enumerate(["baseline", *names]):
            values = F.array_sort(self._over(i, width))
            parts.append(F.struct(F.lit(name).alias("term"), (F.aggregate(values, F.lit(0.0), lambda x, y: x + y) / n).alias("mean"), _percentile(values, n, alpha / 2).alias("low"), _percentile(values, n, 1 - alpha / 2).alias("high")))
        return rows.select(*(F.col(f"`{c}`") for c in kept), F.explode(F.array(*parts)).alias("t")).select(*(F.col(f"`{c}`") for c in kept), "t.*")

    def difference_interval(self, df: DataFrame, other: DataFrame, on: str, alpha: float | None = None) -> DataFrame:
        """``on`` and low and high over the replicates of how much greater the prediction of a row of ``df`` is than that of its partner in ``other``."""
        n, alpha = len(self.models), self.alpha if alpha is None else alpha
        a, b = (with_scores(d, self.models).select(on, F.col("_scores").alias(f"_{i}")) for i, d in enumerate((df, other)))
        gap = F.array_sort(F.zip_with("_0", "_1", lambda x, y: x - y))
        return a.join(b, on).withColumn("_gap", gap).select(on, _percentile(F.col("_gap"), n, alpha / 2).alias("low"), _percentile(F.col("_gap"), n, 1 - alpha / 2).alias("high"))

    def prediction_interval(self, df: DataFrame, alpha: float = 0.1) -> DataFrame:
        """low and high of the replicates' predictions for each row."""
        n = len(self.models)
        rows = with_scores(df, self.models).withColumn("_scores", F.array_sort("_scores"))
        return rows.withColumns({"low": _percentile(F.col("_scores"), n, alpha / 2), "high": _percentile(F.col("_scores"), n, 1 - alpha / 2)}).drop("_scores")


class ZoneSurvival:
    """Piecewise-exponential survival: a Poisson model of events by interval with log exposure as offset."""

    INTERVAL = "interval_start"

    def __init__(self, features: Sequence[str], duration: str, event: str, intervals: int = 5, categorical: Sequence[str] = (), key: str = "row_id", points: Sequence[float] | None = None, **settings):
        self.features, self.duration, self.event, self.intervals, self.points, self.key = list(features), duration, event, intervals, points, key
        self.categorical, self.settings = list(categorical), settings

    def fit(self, df: DataFrame) -> ZoneSurvival:
        bad = df.where((F.col(self.duration) <= 0) | ~F.col(self.event).isin(0, 1) | F.col(self.duration).isNull()).limit(1).count()
        if bad:
            raise ValueError("durations are positive, events 0 or 1")
        self.points = list(self.points or survival.breakpoints(df, self.duration, self.event, self.intervals))
        if self.points[0] != 0 or any(b <= a for a, b in pairwise(self.points)):
            raise ValueError("breakpoints start at 0 and rise")
        rows = survival.person_period(df, self.duration, self.event, self.points).withColumn("_offset", F.log("exposure"))
        rows = rows.withColumn("_pk", F.xxhash64(self.key, "interval"))
        self.model = ZoneRegressor([*self.features, self.INTERVAL], "y", self.categorical, "_offset", "_pk", loss="poisson", **self.settings).fit(rows)
        return self

    def predict_hazard(self, df: DataFrame, t: Column) -> DataFrame:
        """The key, cumulative_hazard and survival of each row at t: each interval's rate times the time in it, within the row."""
        model, starts = self.model.model, [float(a) for a in self.points[:-1]]
        ends = [float(b) for b in self.points[1:-1]] + [float("inf")]
        interval = self.INTERVAL
        needed = [c for c in dict.fromkeys(c for term in model.terms() for c in term) if c != interval]

        def kernel(frame: dict, n: int) -> list[np.ndarray]:
            until, total = frame["_t"].astype(float), np.zeros(n)
            for a, b in zip(starts, ends):
                own = {**{c: frame[c] for c in needed}, interval: np.full(n, a)}
                score = model.base() + sum(model.arrays(own).values(), np.zeros(n))
                total = total + np.exp(np.clip(score, -scalar.CLIP, scalar.CLIP)) * np.clip(np.minimum(until, b) - a, 0.0, None)
            return [total]

        found = with_arrays(df.withColumn("_t", t.cast("double")), ["_t", *needed], model._text(), kernel, "_h")
        hazard = F.get("_h", F.lit(0))
        return found.select(self.key, F.when(~F.isnan(hazard), hazard).alias("cumulative_hazard")).withColumn("survival", F.exp(-F.col("cumulative_hazard")))


class ZoneTimeSeries:
    """One model for each period, fitted to the periods before it (all or the last few); all periods in parallel."""

    def __init__(self, features: Sequence[str], target: str, time: str, unit: str = "month", window: str = "expanding", periods: int = 3, categorical: Sequence[str] = (), key: str = "row_id", together: int = 16, local: int | None = None, **settings):
        if window not in ("expanding", "rolling"):
            raise ValueError(f"unknown window {window!r}")
        self.features, self.target, self.time, self.unit, self.window, self.periods, self.categorical, self.key = list(features), target, time, unit, window, periods, list(categorical), key
        self.together, self.local = together, local
        self.settings = boost.Settings(**settings)

    def fit(self, df: DataFrame) -> ZoneTimeSeries:
        marked = df.withColumn("_p", scalar.period(F.col(self.time), self.unit))
        known = [r[0] for r in marked.select("_p").where("_p is not null").distinct().orderBy("_p").collect()]  # one row for each period
        if len(known) < 2:
            raise ValueError("two periods at least are needed")
        place = F.lit(None).cast("int")
        for i, p in enumerate(known):
            place = F.when(F.col("_p") == F.lit(p), i).otherwise(place)
        marked = marked.withColumn("_place", place).where("_place is not null")
        windows = [(0 if self.window == "expanding" else max(0, k - self.periods), k) for k in range(1, len(known) + 1)]
        self.known, self.models = known, {}
        for at in range(0, len(windows), self.together):  # scores of so many models are held beside each row
            some = windows[at : at + self.together]
            fitted = boost.fit_channels(marked, self.features, F.col(self.target), [self.settings] * len(some), self.categorical, None, self.key, local=self.local, windows=some, period=F.col("_place"))
            self.models |= {high: m for (_, high), m in zip(some, fitted)}
        return self

    def flags(self, df: DataFrame, margin: float) -> list[dict]:
        """For each two consecutive models the mean change of predictions over ``df``, and whether it is beyond ``margin``."""
        order = sorted(self.models)
        rows = with_scores(df, [self.models[k] for k in order])
        means = rows.agg(*(F.avg(F.get("_scores", F.lit(i + 1)) - F.get("_scores", F.lit(i))).alias(f"s{i}") for i in range(len(order) - 1))).first()
        return [{"old": a, "new": b, "shift": means[f"s{i}"], "drift": means[f"s{i}"] is not None and abs(means[f"s{i}"]) > margin} for i, (a, b) in enumerate(pairwise(order))]

    def shifts(self, df: DataFrame) -> list[dict]:
        """For each feature the mean and greatest change of zone centers, and of zones that rows of ``df`` lie in, between consecutive models."""
        order, out = sorted(self.models), []
        for c in (f for f in self.features if f not in self.categorical):
            pairs = [(a, b) for k, l in pairwise(order) if (a := _last_zoning(self.models[k], c)) and (b := _last_zoning(self.models[l], c)) and a.categories is None]
            if not pairs:
                continue
            moved = [abs(x - y) for a, b in pairs for x, y in zip(a.centers, b.centers)]
            shares = df.agg(*(F.avg((scalar.zone_index(F.col(c), a.cuts) != scalar.zone_index(F.col(c), b.cuts)).cast("double")).alias(f"m{i}") for i, (a, b) in enumerate(pairs))).first()
            out.append({"feature": c, "n": len(pairs), "mean_migration": float(np.mean(list(shares))), "max_migration": float(max(shares)), "mean_center_shift": float(np.mean(moved)), "max_center_shift": float(max(moved))})
        return out

    def stability(self) -> list[dict]:
        """Importance change between consecutive period models."""
        out, order = [], sorted(self.models)
        for a, b in zip(order, order[1:]):
            old, new = ({scalar.term_name(*t): v for t, v in self.models[k].importance().items()} for k in (a, b))
            out += [{"period": str(self.known[b]) if b < len(self.known) else "next", "term": t, "change": new.get(t, 0.0) - old.get(t, 0.0)} for t in sorted({*old, *new})]
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Each row by the model of the periods before its own; the first period has none."""
        at = scalar.period(F.col(self.time), self.unit)
        out = F.lit(None).cast("double")
        for k, model in self.models.items():
            if k < len(self.known):
                out = F.when(at == F.lit(self.known[k]), model.score_column()).otherwise(out)
        if len(self.known) in self.models:
            out = F.when(at > F.lit(self.known[-1]), self.models[len(self.known)].score_column()).otherwise(out)
        return df.withColumn(name, out)


def _last_zoning(model: Model, column: str):
    return next((r.zonings[column] for r in reversed(model.rounds) if column in r.zonings), None)


def compare_models(old: ZoneRegressor, new: ZoneRegressor, df: DataFrame, margin: float | None = None) -> dict[str, DataFrame]:
    """Five comparisons over the same rows, as DataFrames.

    importance: term, old, new, change. terms: those that one model has alone. boundaries: feature, and both
    ranges of zone centers with the change of their middle. migration: feature and the share of rows whose
    zone's number differs in the last rounds. performance: loss of both. prediction: mean shift of
    predictions, and whether it is beyond ``margin``.
    """
    spark = df.sparkSession
    importance = diagnostics.importance_change(old.importance(df), new.importance(df))
    named = [spark.createDataFrame([(scalar.term_name(*t),) for t in m.model.terms()], "term string") for m in (old, new)]
    ranges, zones = [], {}
    for c in (c for c in old.features if c in new.features):  # the columns that both know
        own = [[x for r in m.model.rounds if c in r.zonings and r.zonings[c].categories is None for x in r.zonings[c].centers] for m in (old, new)]
        if all(own):
            (a, b), (x, y) = ((min(v), max(v)) for v in own)
            ranges.append((c, a, b, x, y, (x + y) / 2 - (a + b) / 2))
            zones[c] = [scalar.zone_index(F.col(c), _last_zoning(m.model, c).cuts) for m in (old, new)]
    boundaries = spark.createDataFrame(ranges, "feature string, old_low double, old_high double, new_low double, new_high double, middle_shift double")
    shares = F.array(*(F.struct(F.lit(c).alias("feature"), F.avg((a != b).cast("double")).alias("migration")) for c, (a, b) in zones.items()))
    migration = df.agg(shares.alias("s")).select(F.explode("s").alias("s")).select("s.*") if zones else spark.createDataFrame([], "feature string, migration double")
    loss = lambda m, name: F.avg(losses.loss_of(m.settings.loss, F.col(m.target), F.col(name), m.settings.quantile, m.settings.power))
    rows, terms = old.model.with_terms(df, "_old_terms")
    rows = rows.withColumn("_old", sum(old._edited(terms).values(), old._base()))
    rows, terms = new.model.with_terms(rows, "_new_terms")
    rows = rows.withColumn("_new", sum(new._edited(terms).values(), new._base()))
    performance = rows.agg(loss(old, "_old").alias("old_loss"), loss(new, "_new").alias("new_loss"))
    shift = F.avg(boost.link(new.settings, F.col("_new")) - boost.link(old.settings, F.col("_old")))
    prediction = rows.agg(shift.alias("shift")).withColumn("drift", F.abs("shift") > F.lit(float("inf") if margin is None else float(margin)))
    return {"importance": importance, "terms": diagnostics.term_changes(*named), "boundaries": boundaries, "migration": migration, "performance": performance, "prediction": prediction}


def prediction_shift(old: ZoneRegressor, new: ZoneRegressor, df: DataFrame, margin: float, groups: Sequence[str] = ()) -> DataFrame:
    return diagnostics.drift_flags(df, old.score(), new.score(), margin, groups)


def zone_names(prompt_for: Callable[[list[dict]], str], summaries: list[dict], client: Callable[[str], str]) -> dict[str, str]:
    """Names for zones from an injected callable; nothing is called by default. The answer is a JSON object of zone to name."""
    answer = json.loads(client(prompt_for(summaries)))
    return {s["zone"]: str(answer.get(s["zone"], s["zone"])) for s in summaries}
