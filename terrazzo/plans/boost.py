"""Fitting: a round's plan is made on the driver from small aggregates.

The rows of a fit are coded once (a bin for each continuous column, a number
for each category). From then on every aggregate of a round is a kernel: a
function from a batch of coded rows to one array, and arrays add up. `Rows`
runs kernels over Spark partitions, adding in executors (`SparkRows`), or over
one batch in memory where a table is small (`ArrayRows`, up to
``LOCAL_VALUES``); the kernels, and so the models, are the same.

Several models are fitted in one pass as channels that share the coded rows:
the classes of a softmax, bootstrap replicates (a Poisson number as each row's
weight), periods (rows of a window) or quantiles. A channel has its own scores,
weights, folds and cuts.

Rows that built a round's tables are scored with tables of the other folds, so
no row votes for itself. Chance is a linear function, new for each round, of a
31-bit number hashed from the row's key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import losses, scalar
from ..operators import zones
from ..operators.transformers import dersimonian_laird
from ..sources import frames
from .model import Model, Round, Spline, Zoning, category_codes

#: Rows times features up to which a fit gathers its rows and runs in memory (about 130 MB with codes and scores).
LOCAL_VALUES = 6_000_000
#: Categories of one column that a model can hold.
MAX_CATEGORIES = 1_000_000
#: Rounds after which scores are written to the checkpoint folder, so that a lost executor repeats as many at most.
CHECKPOINT_ROUNDS = 10
#: Partitions from which arrays are added in executors first.
TREE_FROM = 64
#: Bins of the residual from which quantiles and trimmed means of zones are taken.
LEVELS = 512
PRIME = 2**31 - 1  # of the linear draws
CODE = "_b_"
#: Where rows in memory keep the values of a round's terms between its kernels.
_KEPT = "_kept"


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    learning_rate: float = 0.1
    row_share: float = 0.7
    column_share: float = 0.7
    max_zones: int = 7
    min_zone_share: float = 0.02
    patience: int | None = None
    folds: int = 5
    m: float = 10.0
    learn_m: bool = False
    alpha: float = 0.01
    max_pairs: int | None = None
    order: int = 2
    max_triples: int = 5
    triple_gain: float = 0.1
    loss: str = "squared_error"
    quantile: float = 0.5
    power: float = 1.5
    trim: float = 0.0
    splines: tuple[str, ...] = ()
    spline_m: float = 10.0
    smooth: bool = False
    smooth_m: float = 50.0
    monotone: dict[str, int] = field(default_factory=dict)
    convex: dict[str, int] = field(default_factory=dict)
    bounded: dict[str, tuple[float, float]] = field(default_factory=dict)
    strict: bool = False
    forbidden: frozenset = frozenset()
    group: str | None = None
    bins: int = 256
    seed: int = 42

    def __post_init__(self):
        shapes = bool(self.monotone or self.convex or self.bounded)
        wrong = [
            (self.loss not in (*losses.LOSSES, "log_loss", "softmax"), f"unknown loss {self.loss!r}"),
            (not 0 < self.quantile < 1, "quantile must lie in (0, 1)"),
            (self.order not in (1, 2, 3), "order is 1, 2 or 3"),
            (not 0 <= self.trim < 0.5, "trim must lie in [0, 0.5)"),
            (self.trim > 0 and self.loss == "quantile", "a quantile loss cannot be trimmed"),
            (bool(self.splines) and (self.loss == "quantile" or self.trim > 0), "splines need means: no quantile loss, no trim"),
            (self.strict and shapes and self.loss == "quantile", "strict shapes need means: no quantile loss"),
            (any(d not in (-1, 1) for d in self.monotone.values()), "monotone directions are 1 or -1"),
            (any(d not in (-1, 1) for d in self.convex.values()), "convex directions are 1 or -1"),
            (any(len(b) != 2 or b[0] > b[1] for b in self.bounded.values()), "bounds are (lower, upper)"),
            (any(len(frozenset(p)) != 2 for p in self.forbidden), "a forbidden pair has two columns"),
            (not (0 < self.row_share <= 1 and 0 < self.column_share <= 1 and self.folds >= 2), "shares lie in (0, 1], folds are 2 or more"),
            (self.rounds < 1 or self.max_zones < 1 or self.bins < 2, "rounds, zones and bins are positive"),
        ]
        for bad, message in wrong:
            if bad:
                raise ValueError(message)

    @property
    def ordered(self) -> bool:
        """Whether zones are summed up by order statistics."""
        return self.loss == "quantile" or self.trim > 0


@dataclass(frozen=True)
class Channel:
    """One of the models that are fitted in a pass: its place, settings, and which rows it learns from."""

    index: int
    settings: Settings
    features: tuple[str, ...]
    replicate: int | None = None
    window: tuple[int, int] | None = None  # periods low..high-1
    classes: int = 0  # of a softmax, whose class is `index`

    def weights(self, cols: dict) -> np.ndarray:
        w = cols["_w"]
        if self.replicate is not None:
            w = w * poisson(draw(cols["_h"], self.settings.seed, -1, self.replicate))
        if self.window is not None:
            w = w * ((cols["_p"] >= self.window[0]) & (cols["_p"] < self.window[1]))
        return w

    def mean(self, cols: dict) -> np.ndarray:
        s, loss = cols[f"_s{self.index}"], self.settings.loss
        if loss in losses.LOG_LINK:
            return np.exp(np.clip(s, -scalar.CLIP, scalar.CLIP))
        if loss == "log_loss":
            return 1 / (1 + np.exp(-np.clip(s, -scalar.CLIP, scalar.CLIP)))
        if loss == "softmax":
            if "_softmax" not in cols:  # once for all classes
                z = np.stack([cols[f"_s{k}"] for k in range(self.classes)])
                e = np.exp(z - z.max(axis=0))
                cols["_softmax"] = e / e.sum(axis=0)
            return cols["_softmax"][self.index]
        return s

    def target(self, cols: dict) -> np.ndarray:
        return (cols["_y"] == self.index).astype(float) if self.classes else cols["_y"]

    def residual(self, cols: dict) -> np.ndarray:
        y, mu, s = self.target(cols), self.mean(cols), self.settings
        if s.loss == "gamma":
            return y / mu - 1.0
        if s.loss == "tweedie":
            return mu ** (1.0 - s.power) * (y - mu)
        return y - mu

    def loss(self, cols: dict) -> np.ndarray:
        return losses.each(self.settings.loss, self.target(cols), self.mean(cols), self.settings.quantile, self.settings.power)


def salted(seed: int, number: int, salt: int) -> tuple[int, int]:
    """Factor and shift of a round's linear draw."""
    x = (seed * 0x9E3779B97F4A7C15 + (number + 2) * 0xC2B2AE3D27D4EB4F + (salt + 1) * 0x165667B19E3779F9) % (1 << 64)
    out = []
    for _ in range(2):
        x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
        z = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % (1 << 64)
        out.append(1 + (z ^ (z >> 31)) % (PRIME - 1))
    return out[0], out[1]


def draw(h: np.ndarray, seed: int, number: int, salt: int) -> np.ndarray:
    """A number in [0, 1) for each row and (seed, number, salt)."""
    a, b = salted(seed, number, salt)
    return ((h.astype(np.int64) * a + b) % PRIME) / PRIME


_CDF = np.cumsum([np.exp(-1.0 - sum(np.log(range(1, k + 1)))) for k in range(12)])


def poisson(u: np.ndarray) -> np.ndarray:
    """Poisson numbers of mean 1 by inversion."""
    return np.searchsorted(_CDF, u, side="right").astype(float)


def isotonic(values: Sequence[float], weights: Sequence[float], direction: int = 1) -> np.ndarray:
    """Nearest monotone sequence by weighted least squares; points without weight are interpolated."""
    v, w = np.asarray(values, float) * direction, np.asarray(weights, float)
    used = np.nonzero(w > 0)[0]
    if not len(used):
        return np.asarray(values, float)
    blocks: list[list[float]] = []
    for i in used:
        blocks.append([v[i], w[i], 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            (a, wa, na), (b, wb, nb) = blocks[-2:]
            blocks[-2:] = [[(a * wa + b * wb) / (wa + wb), wa + wb, na + nb]]
    fitted = np.concatenate([np.full(int(n), x) for x, _, n in blocks])
    return np.interp(np.arange(len(v)), used, fitted) * direction


def convexed(values: np.ndarray, counts: np.ndarray, centers: Sequence[float], direction: int) -> np.ndarray:
    """The line through the zones with monotone slopes (rising: convex), its weighted mean kept."""
    gaps = np.diff(centers)
    if len(values) < 3 or (gaps <= 0).any() or counts.sum() <= 0:
        return values
    slopes = isotonic(np.diff(values) / gaps, (counts[1:] + counts[:-1]) / 2, direction)
    line = np.r_[0.0, np.cumsum(slopes * gaps)]
    return line + np.average(values - line, weights=counts)


def lasso(gram: np.ndarray, alpha: float, positive: np.ndarray | None = None, steps: int = 2000, spread: np.ndarray | None = None, n: float | None = None) -> tuple[float, np.ndarray]:
    """Intercept and weights from the raw moments of [1, terms, target]: L1 of ``alpha`` on terms and target in units of their deviations.

    ``spread``: deviations of terms and target to use instead of the moments' own; ``n``: rows that the
    moments are divided by instead of their weight.
    """
    mass = gram[0, 0]
    if mass <= 0:
        return 0.0, np.zeros(len(gram) - 2)
    mean = gram[0] / mass
    cov = (gram / mass - np.outer(mean, mean)) * (1.0 if n is None else mass / n)
    spread = np.sqrt(np.maximum(np.diag(cov)[1:], 0.0)) if spread is None else spread
    sy, terms = spread[-1], spread[:-1]
    weights = np.zeros(len(terms))
    live = np.nonzero(terms > 1e-12 * max(sy, terms.max(initial=0.0)))[0]
    if sy <= 0 or not len(live):
        return float(mean[-1]), weights
    c = cov[1:-1, 1:-1][np.ix_(live, live)] / np.outer(terms[live], terms[live])
    b = cov[1:-1, -1][live] / (terms[live] * sy)
    own = np.diag(c).copy()
    own[own <= 1e-12] = np.inf  # a term that varies in rows without weight only
    beta, rest = np.zeros(len(live)), b.copy()  # rest: b - c @ beta
    for _ in range(steps):
        moved = 0.0
        for j in range(len(live)):
            before = beta[j]
            pull = rest[j] + c[j, j] * before
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / own[j]
            if positive is not None and positive[live[j]]:
                new = max(new, 0.0)
            if new != before:
                rest -= c[j] * (new - before)
                beta[j], moved = new, max(moved, abs(new - before))
        if moved < 1e-9:
            break
    weights[live] = beta * sy / terms[live]
    return float(mean[-1] - weights @ mean[1:-1]), weights


# Rows


class Rows:
    """Coded rows of a fit: ``_y``, ``_o`` (offset), ``_w``, ``_h`` (hash), ``_part`` (0 fit, 1 validation, 2 calibration), ``_p`` (period),
    each feature's values and code, and a score ``_s<k>`` for each channel."""

    schema: frames.Schema
    edges: dict[str, list[float]]
    categories: dict[str, list[str]]

    def bins(self, c: str) -> int:
        return len(self.edges[c]) + 2 if c in self.edges else len(self.categories[c]) + 2

    def reduce(self, kernel: Callable, columns: Sequence[str], combine: Callable = np.add) -> np.ndarray | None:
        """``kernel`` of all batches, added (or combined)."""
        raise NotImplementedError

    def start(self, baselines: Sequence[float]) -> None:
        raise NotImplementedError

    def step(self, kernel: Callable, columns: Sequence[str], number: int) -> None:
        """New scores: ``kernel`` gives what is added to each channel's."""
        raise NotImplementedError

    def describe(self) -> None:
        """Least, greatest and mean value in each bin of each continuous column, over the rows to fit."""
        names = self.schema.continuous
        sizes = [self.bins(c) for c in names]

        def kernel(cols):
            parts, fit = [], cols["_part"] == 0
            for c, size in zip(names, sizes):
                x, code = cols[c][fit].astype(float), cols[CODE + c][fit]
                present = ~np.isnan(x)
                x, code = x[present], code[present]
                low, high = np.full(size, -np.inf), np.full(size, -np.inf)
                np.maximum.at(low, code, -x)
                np.maximum.at(high, code, x)
                parts += [low, high, np.bincount(code, weights=x, minlength=size), np.bincount(code, minlength=size).astype(float)]
            return np.concatenate(parts) if parts else np.zeros(0)

        marks = np.concatenate([np.r_[np.ones(2 * s, bool), np.zeros(2 * s, bool)] for s in sizes]) if sizes else np.zeros(0, bool)
        found = self.reduce(kernel, [*names, *(CODE + c for c in names), "_part"], lambda a, b: np.where(marks, np.maximum(a, b), a + b))
        self.low, self.high, self.mean, at = {}, {}, {}, 0
        for c, size in zip(names, sizes):
            own = found[at : at + 4 * size].reshape(4, size) if found is not None else np.zeros((4, size))
            with np.errstate(invalid="ignore", divide="ignore"):
                self.low[c], self.high[c], self.mean[c] = -own[0], own[1], own[2] / own[3]
            at += 4 * size

    def close(self) -> None:
        pass


class ArrayRows(Rows):
    """Rows in memory."""

    def __init__(self, frame: dict[str, np.ndarray], schema: frames.Schema, settings: Settings, edges: dict | None = None, categories: dict | None = None):
        self.schema, self.cols = schema, dict(frame)
        if edges is None:
            edges, categories = _edges_of(frame, schema, settings.bins)
        self.edges, self.categories, self.kept = edges, categories, {}
        for c in schema.names:
            self.cols[CODE + c] = _codes(self.cols[c], edges.get(c), categories.get(c))
        _with_categories(self.cols, schema)
        self.describe()

    def reduce(self, kernel, columns, combine=np.add):
        return kernel(self._given(columns)) if len(self.cols["_y"]) else None

    def _given(self, columns):
        return {c: self.cols[c] for c in columns} | {_KEPT: self.kept}

    def start(self, baselines):
        for k, b in enumerate(baselines):
            self.cols[f"_s{k}"] = self.cols["_o"] + b

    def step(self, kernel, columns, number):
        for k, more in enumerate(kernel(self._given(columns))):
            self.cols[f"_s{k}"] = self.cols[f"_s{k}"] + more
        self.kept.clear()


def _edges_of(frame: dict[str, np.ndarray], schema: frames.Schema, bins: int) -> tuple[dict, dict]:
    edges, categories = {}, {}
    for c in schema.continuous:
        x = frame[c].astype(float)
        present = x[~np.isnan(x)]
        values = np.unique(present)
        if len(values) <= bins:
            edges[c] = ((values[1:] + values[:-1]) / 2).tolist()
        else:
            edges[c] = np.unique(np.quantile(present, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf")).tolist()
    for c in schema.categorical:
        categories[c] = sorted({str(v) for v in frame[c] if v is not None and v == v})
    return edges, categories


def _codes(x: np.ndarray, edges: list[float] | None, categories: list[str] | None) -> np.ndarray:
    if edges is None:
        return category_codes(x, categories).astype(np.int32)
    x = x.astype(float)
    missing = np.isnan(x)
    return np.where(missing, len(edges) + 1, np.searchsorted(edges, np.where(missing, 0.0, x), side="right")).astype(np.int32)


def _numpy(batch) -> dict[str, np.ndarray]:
    """Columns of an Arrow batch: numbers with NaN for null, text as objects."""
    return {name: column.to_numpy(zero_copy_only=False) for name, column in zip(batch.schema.names, batch.columns)}


class SparkRows(Rows):
    """Rows of a DataFrame, cached with their codes."""

    def __init__(self, base: DataFrame, schema: frames.Schema, settings: Settings):
        self.schema = schema
        self.edges, self.categories = _spark_edges(base, schema, settings.bins)
        edges, categories, names = self.edges, self.categories, schema.names
        kept = [f for f in base.schema if f.name not in schema.categorical]
        coded = StructType([*kept, *(StructField(CODE + c, IntegerType()) for c in names)])

        def code(batches):
            import pyarrow as pa

            for batch in batches:
                cols = _numpy(batch)
                yield pa.record_batch([*(batch.column(f.name) for f in kept), *(pa.array(_codes(cols[c], edges.get(c), categories.get(c)), pa.int32()) for c in names)], names=coded.names)

        self.prepared = base.mapInArrow(code, coded).persist()
        self.current, self.held = self.prepared, []
        self.describe()

    def reduce(self, kernel, columns, combine=np.add):
        schema = self.schema

        def run(batches):
            import pyarrow as pa

            total = None
            for batch in batches:
                if batch.num_rows:
                    cols = _numpy(batch)
                    part = kernel(_with_categories(cols, schema))
                    total = part if total is None else combine(total, part)
            if total is not None:
                yield pa.record_batch([pa.array([np.ascontiguousarray(total, dtype=float).tobytes()], pa.binary())], names=["g"])

        wanted = [c for c in dict.fromkeys(columns) if c not in schema.categorical]
        parts = self.current.select(*(F.col(f"`{c}`") for c in wanted)).mapInArrow(run, "g binary")
        rdd = parts.rdd
        whole = lambda r: np.frombuffer(bytes(r[0]))
        if rdd.getNumPartitions() > TREE_FROM:  # the driver would hold one array for each partition
            found = rdd.map(whole).map(lambda a: (a,)).treeReduce(lambda a, b: (b[0] if a[0] is None else a[0] if b[0] is None else combine(a[0], b[0]),), depth=3)[0] if not rdd.isEmpty() else None
            return found
        arrays = [whole(r) for r in parts.collect()]
        return reduce(combine, arrays) if arrays else None

    def start(self, baselines):
        self.current = self.prepared.withColumns({f"_s{k}": F.col("_o") + F.lit(float(b)) for k, b in enumerate(baselines)})
        self.channels = len(baselines)

    def step(self, kernel, columns, number):
        schema, channels = self.schema, self.channels
        out = StructType([f if f.name not in {f"_s{k}" for k in range(channels)} else StructField(f.name, DoubleType()) for f in self.current.schema])

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                cols = _with_categories(_numpy(batch), schema)
                more = kernel(cols)
                yield pa.record_batch([pa.array(cols[f.name] + more[int(f.name[2:])]) if f.name.startswith("_s") and f.name[2:].isdigit() else batch.column(f.name) for f in out], names=out.names)

        new = self.current.mapInArrow(run, out)
        if (number + 1) % CHECKPOINT_ROUNDS == 0:
            new = frames.checkpointed(new)
        self.current = new.persist()
        self.held.append(self.current)
        for df in self.held[:-2]:  # the last but one is what the newest is made from
            df.unpersist()
        self.held = self.held[-2:]

    def close(self):
        for df in (*self.held, self.prepared):
            df.unpersist()


def _with_categories(cols: dict, schema: frames.Schema) -> dict:
    """Lookups take a category's code for its value."""
    for c in schema.categorical:
        if CODE + c in cols:
            cols[c] = cols[CODE + c]
    return cols


def _spark_edges(base: DataFrame, schema: frames.Schema, bins: int) -> tuple[dict, dict]:
    """Edges between all values of columns with few, quantile edges of the others; sorted categories. Two jobs for all columns."""
    shares = [i / bins for i in range(1, bins)]
    edges, categories = {}, {}
    found = base.agg(F.lit(1).alias("one"), *(F.percentile_approx(c, shares, 50 * bins).alias(f"q{i}") for i, c in enumerate(schema.continuous)), *(F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(schema.continuous))).first()
    few = [c for i, c in enumerate(schema.continuous) if found[f"d{i}"] <= 1.2 * bins]
    named = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x"), F.lit(None).cast("string").alias("v")) for c in few), *(F.struct(F.lit(c).alias("c"), F.lit(None).cast("double").alias("x"), F.col(c).alias("v")) for c in schema.categorical))
    values: dict[str, list] = {c: [] for c in (*few, *schema.categorical)}
    if values:
        distinct = base.select(F.explode(named).alias("k")).select("k.*").where("x is not null or v is not null").distinct()
        for r in distinct.limit(MAX_CATEGORIES + 1).toLocalIterator():
            values[r["c"]].append(r["x"] if r["v"] is None else r["v"])
        if sum(map(len, values.values())) > MAX_CATEGORIES:
            raise ValueError(f"over {MAX_CATEGORIES} categories")
    for i, c in enumerate(schema.continuous):
        if c in values and len(values[c]) <= bins:
            own = np.array(sorted(values[c]))
            edges[c] = ((own[1:] + own[:-1]) / 2).tolist()
        else:
            edges[c] = sorted(set(found[f"q{i}"] or []))
    for c in schema.categorical:
        categories[c] = sorted(values[c])
    return edges, categories


def rows_of(df: DataFrame, schema: frames.Schema, y: Column, settings: Settings, offset: str | None = None, key: str = "row_id", weight: str | None = None, parts: dict[str, float] | None = None, period: Column | None = None, local: int | None = None) -> Rows:
    """Coded rows with a target; in memory where rows times features are few."""
    place, part, low = frames.unit_hash(F.col(key), seed=settings.seed), F.lit(0), 0.0
    for number, name in enumerate(("val", "cal"), 1):
        share = (parts or {}).get(name, 0.0)
        part = F.when((place >= low) & (place < low + share), F.lit(number)).otherwise(part)
        low += share
    columns = {c: F.col(f"`{c}`").cast("double") for c in schema.continuous} | {c: F.col(f"`{c}`").cast("string") for c in schema.categorical}
    columns = {c: (F.when(~F.isnan(e), e) if c in schema.continuous else e).alias(c) for c, e in columns.items()}
    base = df.select(
        y.cast("double").alias("_y"), (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("_o"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
        frames.hash31(F.col(key)).alias("_h"), part.alias("_part"), (period if period is not None else F.lit(0)).cast("int").alias("_p"), *columns.values(),
    ).where("_y is not null and not isnan(_y) and _o is not null and _w is not null")
    width = max(1, len(schema.names))
    most = (LOCAL_VALUES if local is None else local) // width
    if base.limit(most + 1).count() <= most:
        return ArrayRows(_numpy(base.toArrow()), schema, settings)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if base.rdd.getNumPartitions() < 2 * cores:  # few input splits would leave cores idle in every round
        base = base.repartition(2 * cores, "_h")
    base = base.persist()
    try:
        return SparkRows(base, schema, settings)
    finally:
        base.unpersist()


# One round


def _shrink(n, total, prior, m):
    below = n + m
    return np.where(below > 0, (total + m * prior) / np.where(below > 0, below, 1.0), prior)


def _ratio(total, n):
    return np.divide(total, n, out=np.zeros(np.broadcast_shapes(np.shape(total), np.shape(n))), where=np.asarray(n) > 0)


def _deviations(n: np.ndarray, stat: np.ndarray, overall, m: float) -> np.ndarray:
    """Zones' statistics shrunk to the overall one, minus it."""
    return _shrink(n, n * stat, overall, m) - overall


def cell_deviations(n: np.ndarray, mean: np.ndarray, overall, m: float, marginal: Callable) -> np.ndarray:
    """Deviations of the cells of a 2-d or 3-d table (folds may follow): each shrunk to the sum of all lower deviations.

    ``marginal(axes)`` gives counts and statistics of the cells summed over all other axes.
    """
    dims = marginal.dims
    prior = np.zeros_like(n) + overall
    lower: dict[tuple, np.ndarray] = {}
    for size in range(1, dims):
        for axes in combinations(range(dims), size):
            count, stat = marginal(axes)
            base = overall + sum((_spread(lower[a], a, axes) for k in range(1, size) for a in combinations(axes, k)), 0.0)
            lower[axes] = _shrink(count, count * stat, base, m) - base
            prior = prior + _spread(lower[axes], axes, tuple(range(dims)))
    return _shrink(n, n * mean, prior, m) - overall


def _spread(values: np.ndarray, own: tuple, whole: tuple) -> np.ndarray:
    """``values`` over the axes ``own`` as an array that broadcasts over ``whole``; trailing axes stay."""
    index = tuple(slice(None) if a in own else None for a in whole)
    return values[index]


class _Marginal:
    """Counts and means of cells summed over axes."""

    def __init__(self, n: np.ndarray, total: np.ndarray, dims: int):
        self.n, self.total, self.dims = n, total, dims

    def __call__(self, axes: tuple) -> tuple[np.ndarray, np.ndarray]:
        rest = tuple(a for a in range(self.dims) if a not in axes)
        n = self.n.sum(axis=rest)
        return n, _ratio(self.total.sum(axis=rest), n)


class _OrderedMarginal:
    """Counts and order statistics of cells (last axis: bins of the residual) summed over axes."""

    def __init__(self, n: np.ndarray, stat: Callable, dims: int):
        self.n, self.stat, self.dims = n, stat, dims

    def __call__(self, axes: tuple) -> tuple[np.ndarray, np.ndarray]:
        rest = tuple(a for a in range(self.dims) if a not in axes)
        own = self.n.sum(axis=rest)
        return own.sum(axis=-1), self.stat(own)


def bin_quantile(counts: np.ndarray, edges: np.ndarray, q: float) -> np.ndarray:
    """Quantile of rows counted in bins between ``edges`` (last axis), linear within a bin; 0 for no rows."""
    total = counts.sum(axis=-1)
    upto = np.cumsum(counts, axis=-1)
    wanted = q * total
    at = np.minimum((upto < wanted[..., None]).sum(axis=-1), counts.shape[-1] - 1)
    inside = np.take_along_axis(counts, at[..., None], -1)[..., 0]
    before = np.take_along_axis(upto, at[..., None], -1)[..., 0] - inside
    share = np.clip(_ratio(wanted - before, inside), 0.0, 1.0)
    return np.where(total > 0, edges[at] + share * (edges[at + 1] - edges[at]), 0.0)


def bin_trimmed(counts: np.ndarray, edges: np.ndarray, trim: float) -> np.ndarray:
    """Mean without the floor(trim * n) least and greatest of rows counted in bins, each at its bin's middle; 0 for no rows."""
    total = counts.sum(axis=-1)
    k = np.floor(trim * total)
    k = np.where(2 * k >= total, 0.0, k)[..., None]
    upto = np.cumsum(counts, axis=-1)
    kept = np.maximum(np.minimum(upto, total[..., None] - k) - np.maximum(upto - counts, k), 0.0)
    return _ratio((kept * (edges[1:] + edges[:-1]) / 2).sum(axis=-1), kept.sum(axis=-1))


def _merge_levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two sets of levels (first entry: rows) the levels of both."""
    na, nb = a[0], b[0]
    values = np.concatenate([a[1:], b[1:]])
    mass = np.concatenate([np.full(len(a) - 1, na), np.full(len(b) - 1, nb)])
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(mass[order]) - mass[order] / 2
    shares = np.linspace(0.0, 1.0, len(a) - 1)
    inner = np.interp(shares * upto[-1] / 1.0, upto, values[order])
    inner[0], inner[-1] = values.min(), values.max()
    return np.r_[na + nb, inner]


def residual_levels(rows: Rows, columns: Sequence[str], residual: Callable, levels: int = LEVELS) -> np.ndarray | None:
    """Rising numbers that cut the residuals into about equal parts, from the least to the greatest."""

    def kernel(cols):
        r = residual(cols)
        return np.r_[float(len(r)), np.quantile(r, np.linspace(0.0, 1.0, levels + 1))] if len(r) else np.r_[0.0, np.zeros(levels + 1)]

    merge = lambda a, b: b if a[0] == 0 else a if b[0] == 0 else _merge_levels(a, b)
    found = rows.reduce(kernel, columns, merge)
    return None if found is None or found[0] == 0 else found[1:]


@dataclass
class _Plan:
    """What is known of one channel's round while it is made."""

    channel: Channel
    names: list[str]
    round: Round = field(default_factory=lambda: Round({}, {}, {}))
    fold_tables: dict = field(default_factory=dict)
    zone_of: dict[str, np.ndarray] = field(default_factory=dict)
    counts: dict[str, np.ndarray] = field(default_factory=dict)
    edges: np.ndarray | None = None
    overall: float = 0.0

    def size(self, c: str) -> int:
        return self.round.zonings[c].size


class _View:
    """A batch as one channel sees it in one round."""

    def __init__(self, cols: dict, ch: Channel, number: int):
        s = ch.settings
        self.w = ch.weights(cols)
        self.fit = (cols["_part"] == 0) & (self.w > 0)
        self.inside = self.fit & (draw(cols["_h"], s.seed, number, 0) < s.row_share)
        self.r = ch.residual(cols)
        self.fold = (draw(cols["_h"], s.seed, number, 1 + ch.index) * s.folds).astype(np.int64)


def _needed(plans: Sequence[_Plan], raw: bool, codes: bool) -> list[str]:
    names = dict.fromkeys(c for p in plans for c in p.names)
    channels = max([p.channel.index + 1 for p in plans] + [p.channel.classes for p in plans])
    return ["_y", "_w", "_h", "_part", "_p", *(f"_s{k}" for k in range(channels)), *(names if raw else ()), *(CODE + c for c in names if codes or raw)]


def _split(array: np.ndarray, shapes: Sequence[tuple]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(array[at : at + size].reshape(shape))
        at += size
    return out


def _count(at: np.ndarray, weights: np.ndarray | None, shape: tuple) -> np.ndarray:
    return np.bincount(at, weights=weights, minlength=int(np.prod(shape))).astype(float)


def _shaped(values: np.ndarray, counts: np.ndarray, z: Zoning, s: Settings) -> np.ndarray:
    """Deviations of a column's zones after its shape constraints."""
    c = z.column
    if z.categories is not None or c not in s.monotone and c not in s.convex and c not in s.bounded:
        return values
    real = values[: z.real]
    if c in s.monotone:
        real = isotonic(real, counts[: z.real], s.monotone[c])
    if c in s.convex:
        real = convexed(real, counts[: z.real], z.centers, s.convex[c])
    if c in s.bounded:
        real = np.clip(real, *s.bounded[c])
    return np.r_[real, values[z.real :]]


def _monotone_cells(table: np.ndarray, counts: np.ndarray, columns: Sequence[str], plan: _Plan) -> np.ndarray:
    """Cells made monotone along the axes of constrained columns."""
    for axis, c in enumerate(columns):
        z, direction = plan.round.zonings[c], plan.channel.settings.monotone.get(c)
        if direction and z.categories is None:
            moved, weight = np.moveaxis(table.copy(), axis, 0), np.moveaxis(counts, axis, 0)
            for at in np.ndindex(moved.shape[1:]):
                own = (slice(0, z.real), *at)
                moved[own] = isotonic(moved[own], weight[own], direction)
            table = np.moveaxis(moved, 0, axis)
    return table


def _spline_shape(coef: np.ndarray, knots: Sequence[float], counts: np.ndarray, c: str, s: Settings) -> np.ndarray:
    """A spline's slopes made monotone or convex, its levels at the knots bounded."""
    coef, knots = coef.copy(), np.asarray(knots)
    slopes = np.cumsum(coef[1:])
    if c in s.monotone:
        slopes = np.maximum(slopes * s.monotone[c], 0.0) * s.monotone[c]
    if c in s.convex:
        weight = np.where(counts[: len(slopes)] > 0, counts[: len(slopes)], 1.0)
        slopes = isotonic(slopes, weight, s.convex[c])
    if c in s.bounded:
        low, high = s.bounded[c]
        if not len(knots):
            coef[0] = np.clip(coef[0], low, high)
        else:
            level = coef[0] + slopes[0] * knots[0] + np.r_[0.0, np.cumsum(slopes[1:-1] * np.diff(knots))]
            held = np.clip(level, low, high)
            slopes[1:-1] = np.diff(held) / np.diff(knots)
            coef[0] = held[0] - slopes[0] * knots[0]
    coef[1:] = np.diff(slopes, prepend=0.0)
    return coef


def _zonings(rows: Rows, p: _Plan, sums: dict[str, np.ndarray]) -> None:
    """Cuts, centers and the zone of each bin, from histograms [stat, bin, fold] of each column."""
    s = p.channel.settings
    for c in p.names:
        n, r = sums[c][0].sum(axis=1), sums[c][1].sum(axis=1)
        bins = rows.bins(c)
        if c in rows.categories:
            p.round.zonings[c], p.zone_of[c] = Zoning(c, categories=rows.categories[c]), np.arange(bins)
            continue
        used = np.nonzero(n[:-1] > 0)[0]
        low, high, mean = rows.low[c][used], rows.high[c][used], rows.mean[c][used]
        empty = np.zeros(len(used))
        h = zones.Histogram(n[used], r[used], n[used] * mean, low, high, empty, empty)
        cuts = zones.greedy_cuts(h, min(s.max_zones, max(1, len(used))), s.min_zone_share)
        edges = rows.edges[c]
        middle = np.where(np.isfinite(rows.low[c][:-1]), rows.low[c][:-1], [edges[min(i, len(edges) - 1)] if edges else 0.0 for i in range(bins - 1)])
        zone = np.r_[np.searchsorted(cuts, middle, side="right"), len(cuts) + 1].astype(np.int64)  # cuts lie between bins
        bounds = [cuts[0] - 1, *cuts, cuts[-1] + 1] if cuts else [-1.0, 1.0]
        mass = np.bincount(zone[used], weights=n[used], minlength=len(cuts) + 1)
        moment = np.bincount(zone[used], weights=n[used] * mean, minlength=len(cuts) + 1)
        centers = [float(moment[k] / mass[k]) if mass[k] else (bounds[k] + bounds[k + 1]) / 2 for k in range(len(cuts) + 1)]
        p.round.zonings[c], p.zone_of[c] = Zoning(c, cuts, centers), zone


def _mains(p: _Plan, sums: dict[str, np.ndarray]) -> None:
    """Main effects and their out-of-fold versions from sums of weights, residuals and squares."""
    s = p.channel.settings
    for c in p.names:
        z = p.round.zonings[c]
        n, r, rr = (np.stack([np.bincount(p.zone_of[c], weights=part[:, k], minlength=z.size) for k in range(s.folds)], axis=1) for part in sums[c])
        count = n.sum(axis=1)
        p.counts[c] = count
        m = s.m
        if s.learn_m:
            mean = _ratio(r.sum(axis=1), count)
            m = dersimonian_laird(count, mean, np.maximum(_ratio(rr.sum(axis=1), count) - mean**2, 0), s.m)
        total = count.sum()
        p.overall = float(r.sum() / total) if total else 0.0
        dev = _deviations(count, _ratio(r.sum(axis=1), count), p.overall, m)
        rest_n, rest_r = count[:, None] - n, r.sum(axis=1, keepdims=True) - r
        overall = _ratio(rest_r.sum(axis=0), rest_n.sum(axis=0))
        folds = _deviations(rest_n, _ratio(rest_r, rest_n), overall, m).T
        p.round.tables[(c,)] = _shaped(dev, count, z, s)
        p.fold_tables[(c,)] = np.stack([_shaped(v, rest_n[:, k], z, s) for k, v in enumerate(folds)])


def _ordered_stat(p: _Plan) -> Callable:
    s, edges = p.channel.settings, p.edges
    return (lambda counts: bin_quantile(counts, edges, s.quantile)) if s.loss == "quantile" else (lambda counts: bin_trimmed(counts, edges, s.trim))


def _ordered_mains(p: _Plan, counts: dict[str, np.ndarray]) -> None:
    """The same from counts [zone, fold, bin of the residual], by quantiles or trimmed means."""
    s, stat = p.channel.settings, _ordered_stat(p)
    for c in p.names:
        z, own = p.round.zonings[c], counts[c]
        whole = own.sum(axis=1)
        p.counts[c] = whole.sum(axis=-1)
        p.overall = float(stat(whole.sum(axis=0)))
        p.round.tables[(c,)] = _shaped(_deviations(p.counts[c], stat(whole), p.overall, s.m), p.counts[c], z, s)
        rest = whole[:, None] - own
        overall = stat(rest.sum(axis=0))
        folds = _deviations(rest.sum(axis=-1), stat(rest), overall, s.m).T
        p.fold_tables[(c,)] = np.stack([_shaped(v, rest[:, k].sum(axis=-1), z, s) for k, v in enumerate(folds)])


def _fit_splines(rows: Rows, plans: Sequence[_Plan], number: int) -> None:
    """Splines instead of zone tables, by ridge on the moments of the hinge basis; each fold's from the others' moments."""
    wanted = [(p, c, Spline(p.round.zonings[c].cuts, [0.0] * (len(p.round.zonings[c].cuts) + 2))) for p in plans for c in p.channel.settings.splines if c in p.names]
    if not wanted:
        return
    shapes = [(p.channel.settings.folds, len(s.coef) + 1, len(s.coef) + 1) for p, _, s in wanted]

    def kernel(cols):
        out, views = [], {}
        for (p, c, spline), shape in zip(wanted, shapes):
            v = views.setdefault(p.channel.index, _View(cols, p.channel, number))
            x = cols[c].astype(float)
            z = np.c_[spline.design(x), v.r]
            for k in range(shape[0]):
                own = v.inside & (v.fold == k) & ~np.isnan(x)
                out.append((z[own] * v.w[own][:, None]).T @ z[own])
        return np.concatenate([a.ravel() for a in out])

    found = _split(rows.reduce(kernel, _needed([p for p, *_ in wanted], True, False)), shapes)
    for (p, c, spline), gram in zip(wanted, found):
        s, flat = p.channel.settings, p.round.tables[(c,)]
        folds = p.fold_tables[(c,)]

        def solved(g: np.ndarray, overall: float) -> np.ndarray:
            design, right = g[:-1, :-1], g[:-1, -1]
            ridge = np.r_[0.0, s.spline_m * np.diag(design)[1:] / max(design[0, 0], 1.0)]
            coef = np.linalg.pinv(design + np.diag(ridge)) @ right
            coef[0] -= overall
            return _spline_shape(coef, spline.knots, p.counts[c], c, s)  # noqa: B023

        whole = gram.sum(axis=0)
        p.round.tables[(c,)] = Spline(spline.knots, solved(whole, p.overall).tolist(), float(flat[p.round.zonings[c].real]))
        p.fold_tables[(c,)] = (np.stack([solved(whole - g, p.overall) for g in gram]), folds[:, p.round.zonings[c].real])


def _learn_smoothing(rows: Rows, plans: Sequence[_Plan], number: int) -> None:
    """How far each column's lookups are soft: by the out-of-fold squared errors of hard and soft ones, shrunk to soft."""
    wanted = [(p, c) for p in plans if p.channel.settings.smooth for c in p.names if p.round.zonings[c].categories is None and not isinstance(p.round.tables[(c,)], Spline)]
    if not wanted:
        return

    def kernel(cols):
        out, views = [], {}
        for p, c in wanted:
            v = views.setdefault(p.channel.index, _View(cols, p.channel, number))
            own, other, w = p.round.zonings[c].soft(cols[c])
            table = p.fold_tables[(c,)]
            hard, near = table[v.fold, own], table[v.fold, other]
            soft, inside = hard + w * (near - hard), v.inside
            out += [(v.w * (v.r - hard) ** 2)[inside].sum(), (v.w * (v.r - soft) ** 2)[inside].sum(), float(((w > 0) & inside).sum())]
        return np.array(out)

    for (p, c), (hard, soft, moved) in zip(wanted, rows.reduce(kernel, _needed([p for p, _ in wanted], True, False)).reshape(-1, 3)):
        raw, m = (1.0 if soft <= hard else 0.0), p.channel.settings.smooth_m
        p.round.zonings[c].lam = float((moved * raw + m) / (moved + m)) if moved + m > 0 else 1.0


def _main_values(p: _Plan, soft: dict) -> dict[str, np.ndarray]:
    return {c: p.round.values((c,), soft) for c in p.names}


def _cells(rows: Rows, plans: Sequence[_Plan], groups: dict[int, list[tuple]], number: int, ordered: bool) -> dict[tuple, np.ndarray]:
    """For each channel and group of two columns: [stat, cells, fold] of the residual without the mains; or counts [cells, fold, bin]."""
    shapes, keys = [], []
    for p in plans:
        for g in groups[p.channel.index]:
            cells = tuple(p.size(c) for c in g)
            keys.append((p.channel.index, g))
            shapes.append((*cells, p.channel.settings.folds, len(p.edges) - 1) if ordered else (2, *cells, p.channel.settings.folds))

    def kernel(cols):
        out = []
        for p in plans:
            own = groups[p.channel.index]
            if not own:
                continue
            v, folds = _View(cols, p.channel, number), p.channel.settings.folds
            inside = v.inside
            values = {c: x[inside] for c, x in _main_values(p, p.round.soft({c: cols[c] for c in p.names})).items()}
            zone = {c: p.zone_of[c][cols[CODE + c][inside]] for c in p.names}
            r, f, w = v.r[inside], v.fold[inside], v.w[inside]
            for g in own:
                at = 0
                for c in g:
                    at = at * p.size(c) + zone[c]
                at = at * folds + f
                left = r - sum(values[c] for c in g)
                shape = (*(p.size(c) for c in g), folds)
                if ordered:
                    level = np.clip(np.searchsorted(p.edges, left, side="right") - 1, 0, len(p.edges) - 2)
                    out.append(_count(at * (len(p.edges) - 1) + level, None, (*shape, len(p.edges) - 1)))
                else:
                    out += [_count(at, w, shape), _count(at, w * left, shape)]
        return np.concatenate(out)

    return dict(zip(keys, _split(rows.reduce(kernel, _needed(plans, True, True)), shapes))) if keys else {}


def _pairs(rows: Rows, plans: Sequence[_Plan], number: int) -> None:
    """Pair effects on what the mains leave: all pairs are scored by their interaction, the best (and the group's) are kept."""
    for ordered in (False, True):
        some = [p for p in plans if p.channel.settings.order >= 2 and p.channel.settings.ordered == ordered]
        groups = {p.channel.index: [g for g in combinations(p.names, 2) if frozenset(g) not in p.channel.settings.forbidden] for p in some}
        found = _cells(rows, some, groups, number, ordered) if some else {}
        for p in some:
            s, scored = p.channel.settings, []
            for g in groups[p.channel.index]:
                cells = found[p.channel.index, g]
                n = cells.sum(axis=-1) if ordered else cells[0]
                total = None if ordered else cells[1]
                count = n.sum(axis=-1)
                if ordered:
                    stat = _ordered_stat(p)
                    mean = stat(cells.sum(axis=2))
                else:
                    mean = _ratio(total.sum(axis=-1), count)
                mass = max(count.sum(), 1e-300)
                by_row, by_column = _ratio((count * mean).sum(1), count.sum(1)), _ratio((count * mean).sum(0), count.sum(0))
                gap = np.where(count > 0, mean - (by_row[:, None] + by_column[None, :] - (count * mean).sum() / mass), 0.0)
                scored.append(((count * gap**2).sum() / mass, g, cells))
            forced = [x for x in scored if s.group in x[1]] if s.group else []
            rest = sorted((x for x in scored if x not in forced), key=lambda x: -x[0]) if forced else sorted(scored, key=lambda x: -x[0])
            for _, g, cells in [*forced, *(rest if s.max_pairs is None else rest[: max(0, s.max_pairs - len(forced))])]:
                whole, folds = _cell_tables(p, cells, 2, ordered)
                p.round.tables[g], p.fold_tables[g] = _monotone_cells(whole[0], whole[1], g, p), np.stack([_monotone_cells(t, n, g, p) for t, n in folds])


def _cell_tables(p: _Plan, cells: np.ndarray, dims: int, ordered: bool) -> tuple[tuple, list[tuple]]:
    """(table, counts) of all folds, and of all but each fold."""
    s = p.channel.settings
    if ordered:
        stat = _ordered_stat(p)

        def table(counts):
            overall = float(stat(counts.sum(axis=tuple(range(dims)))))
            n = counts.sum(axis=-1)
            return cell_deviations(n, stat(counts), overall, s.m, _OrderedMarginal(counts, stat, dims)), n

        whole = cells.sum(axis=dims)
        return table(whole), [table(whole - np.take(cells, k, axis=dims)) for k in range(s.folds)]

    def table(n, total):
        overall = float(total.sum() / n.sum()) if n.sum() > 0 else 0.0
        return cell_deviations(n, _ratio(total, n), overall, s.m, _Marginal(n, total, dims)), n

    n, total = cells[0], cells[1]
    return table(n.sum(axis=-1), total.sum(axis=-1)), [table(n.sum(axis=-1) - n[..., k], total.sum(axis=-1) - total[..., k]) for k in range(s.folds)]


def seed_columns(importance: dict[tuple, float], most: int) -> list[str]:
    """Columns of the strongest pairs, strongest first, ten at most."""
    top = sorted(importance, key=lambda g: -importance[g])[: min(len(importance), max(2 * most, 6))]
    best: dict[str, float] = {}
    for g in top:
        for c in g:
            best[c] = max(best.get(c, 0.0), importance[g])
    return sorted(best, key=lambda c: -best[c])[:10]


def _triples(rows: Rows, plans: Sequence[_Plan], number: int) -> None:
    """Triple effects: of columns of strong pairs, those whose cells hold more than mains and pairs explain, by a line fitted through these."""
    groups: dict[int, list[tuple]] = {}
    some = [p for p in plans if p.channel.settings.order >= 3 and p.channel.settings.max_triples > 0 and not p.channel.settings.ordered]
    for p in some:
        s = p.channel.settings
        strong = {g: float(np.abs(t).mean()) for g, t in p.round.tables.items() if len(g) == 2}
        known = {frozenset(g) for g in strong}
        allowed = lambda g: all(frozenset(q) in known and frozenset(q) not in s.forbidden for q in combinations(g, 2))  # noqa: B023, E731
        names = sorted(seed_columns(strong, s.max_triples), key=p.names.index)
        groups[p.channel.index] = [g for g in combinations(names, 3) if allowed(g)]
    some = [p for p in some if groups[p.channel.index]]
    if not some:
        return
    shapes = [shape for p in some for g in groups[p.channel.index] for shape in ((5,), (4, *(p.size(c) for c in g), p.channel.settings.folds))]

    def kernel(cols):
        out = []
        for p in some:
            v, folds = _View(cols, p.channel, number), p.channel.settings.folds
            inside = v.inside
            values = {c: x[inside] for c, x in _main_values(p, p.round.soft({c: cols[c] for c in p.names})).items()}
            zone = {c: p.zone_of[c][cols[CODE + c][inside]] for c in p.names}
            r, f, w = v.r[inside], v.fold[inside], v.w[inside]
            for g in groups[p.channel.index]:
                mains = sum(values[c] for c in g)
                pairs = sum(p.round.tables[q][zone[q[0]], zone[q[1]]] for q in combinations(g, 2))
                lower = (mains + pairs) / 6
                at = 0
                for c in g:
                    at = at * p.size(c) + zone[c]
                at, shape = at * folds + f, (*(p.size(c) for c in g), folds)
                out.append(np.array([float(len(r)), lower.sum(), r.sum(), (lower * lower).sum(), (lower * r).sum()]))
                out += [_count(at, x, shape) for x in (w, w * r, w * lower, w * mains)]
        return np.concatenate(out)

    found = iter(_split(rows.reduce(kernel, _needed(some, True, True)), shapes))
    for p in some:
        s, scored = p.channel.settings, []
        for g in groups[p.channel.index]:
            moments, (n, r, lower, mains) = next(found), next(found)
            slope, intercept = line_fit(*moments)
            whole = lambda x: x.sum(axis=-1)
            left = whole(r) - intercept * whole(n) - slope * whole(lower)
            mass = max(whole(n).sum(), 1e-300)
            gain = float(np.abs(cell_deviations(whole(n), _ratio(left, whole(n)), float(left.sum() / mass), s.m, _Marginal(whole(n), left, 3))).mean())
            if gain >= s.triple_gain * max(float(np.abs(p.round.tables[q]).mean()) for q in combinations(g, 2)):
                scored.append((gain, g, np.stack([n, r - mains])))
        for _, g, cells in sorted(scored, key=lambda x: -x[0])[: s.max_triples]:
            whole, folds = _cell_tables(p, cells, 3, False)
            p.round.tables[g], p.fold_tables[g] = _monotone_cells(whole[0], whole[1], g, p), np.stack([_monotone_cells(t, n, g, p) for t, n in folds])


def line_fit(n: float, x: float, y: float, xx: float, xy: float) -> tuple[float, float]:
    """Slope and intercept of least squares from sums; slope 0 if x does not vary."""
    spread = xx / n - (x / n) ** 2 if n else 0.0
    slope = (xy / n - x * y / n / n) / spread if spread > 0 else 0.0
    return slope, (y / n - slope * x / n if n else 0.0)


def _term_values(p: _Plan, cols: dict, v: _View) -> np.ndarray:
    """[term, row]: rows of the sample by the other folds' tables, the others by the full ones."""
    r, n = p.round, len(v.r)
    if _KEPT in cols and (p.channel.index, id(p)) in cols[_KEPT]:
        return cols[_KEPT][p.channel.index, id(p)]
    soft = r.soft({c: cols[c] for c in p.names})
    out = np.empty((len(r.tables), n))
    parts = [(v.inside, True), (~v.inside, False)] if 0 < v.inside.sum() < n else [(None, bool(n and v.inside[0]))]
    for own, folded in parts:
        some = soft if own is None else {c: tuple(x[own] for x in parts_) for c, parts_ in soft.items()}
        fold = v.fold if own is None else v.fold[own]
        for i, t in enumerate(r.tables):
            found = r.values(t, some, p.fold_tables[t], fold) if folded else r.values(t, some)
            if own is None:
                out[i] = found
            else:
                out[i, own] = found
    if _KEPT in cols:
        cols[_KEPT][p.channel.index, id(p)] = out
    return out


def _stack(rows: Rows, plans: Sequence[_Plan], number: int, passes: int = 6) -> None:
    """Weights of the terms by lasso on their moments; a quantile's by reweighted moments, then the intercept that leaves its share below."""
    sizes = [len(p.round.tables) + 2 for p in plans]

    def moments(weigh: Callable):
        def kernel(cols):
            out = []
            for p in plans:
                v = _View(cols, p.channel, number)
                z = np.concatenate([np.ones((1, len(v.r))), _term_values(p, cols, v), v.r[None]])[:, v.fit]
                w = weigh(p, z, v.w[v.fit])
                out += [((z * w) @ z.T).ravel(), z.sum(axis=1), (z * z).sum(axis=1)]
            return np.concatenate(out)

        return iter(_split(rows.reduce(kernel, _needed(plans, True, False)), [shape for k in sizes for shape in ((k, k), (k,), (k,))]))

    found = moments(lambda p, z, w: w)
    spreads: dict[int, tuple] = {}
    for p in plans:
        gram, sums, squares = next(found), next(found), next(found)
        s, n = p.channel.settings, max(sums[0], 1.0)
        spread = np.sqrt(np.maximum(squares / n - (sums / n) ** 2, 0.0))[1:]  # of rows, not of weights
        spreads[p.channel.index] = spread, n
        shaped = {*s.monotone, *s.convex, *s.bounded}
        positive = np.array([s.strict and any(c in shaped for c in t) for t in p.round.tables], dtype=bool)
        p.round.intercept, weights = lasso(gram, s.alpha, positive, spread=spread)
        p.round.weights = {t: float(x) for t, x in zip(p.round.tables, weights)}
    quantiles = [p for p in plans if p.channel.settings.loss == "quantile"]
    if not quantiles:
        return
    for _ in range(passes):
        now = {p.channel.index: (p.round.intercept, np.array([p.round.weights[t] for t in p.round.tables])) for p in quantiles}

        def weigh(p, z, w):
            if p.channel.index not in now:  # noqa: B023
                return w
            b, x = now[p.channel.index]  # noqa: B023
            q, gap = p.channel.settings.quantile, z[-1] - b - x @ z[1:-1]
            return np.where(gap > 0, q, 1 - q) / np.maximum(np.abs(gap), 1e-3 * max(spreads[p.channel.index][0][-1], 1e-300))

        found, worst = moments(weigh), 0.0
        for p in plans:
            gram, *_ = next(found), next(found), next(found)
            if p.channel.index in now:
                spread, n = spreads[p.channel.index]
                unit = max(spread[-1], 1e-300)  # pinball over unit: moments of |gap| / unit
                p.round.intercept, weights = lasso(gram * unit, p.channel.settings.alpha, spread=spread, n=n)
                p.round.weights = {t: float(x) for t, x in zip(p.round.tables, weights)}
                worst = max(worst, float(np.abs(weights - now[p.channel.index][1]).max(initial=0.0)))
        if worst < 1e-3:
            break
    for p in quantiles:

        def gap(cols, p=p):
            v = _View(cols, p.channel, number)
            x = np.array([p.round.weights[t] for t in p.round.tables])
            return (v.r - x @ _term_values(p, cols, v))[v.fit]

        levels = residual_levels(rows, _needed([p], True, False), gap)
        if levels is not None:
            p.round.intercept = float(np.interp(p.channel.settings.quantile, np.linspace(0, 1, len(levels)), levels))


def _histograms(rows: Rows, plans: Sequence[_Plan], number: int) -> tuple[list[dict[str, np.ndarray]], np.ndarray]:
    """For each plan and column [stat, bin, fold] of weights, residuals and squares; and for each plan its loss and weight on the rows to fit and to validate."""
    shapes = [(3, rows.bins(c), p.channel.settings.folds) for p in plans for c in p.names]

    def kernel(cols):
        out, loss = [], []
        for p in plans:
            v, folds = _View(cols, p.channel, number), p.channel.settings.folds
            inside = v.inside
            r, w, f = v.r[inside], v.w[inside], v.fold[inside]
            wr, wrr = w * r, w * r * r
            for c in p.names:
                at, shape = cols[CODE + c][inside].astype(np.int64) * folds + f, (rows_bins[c], folds)
                out += [_count(at, x, shape) for x in (w, wr, wrr)]
            loss += _losses(p.channel, cols, v.w)
        return np.concatenate([*out, np.array(loss)])

    rows_bins = {c: rows.bins(c) for p in plans for c in p.names}
    *found, loss = _split(rows.reduce(kernel, _needed(plans, False, True)), [*shapes, (len(plans), 4)])
    at, out = iter(found), []
    for p in plans:
        out.append({c: next(at) for c in p.names})
    return out, loss


def _losses(ch: Channel, cols: dict, w: np.ndarray) -> list[float]:
    each, out = ch.loss(cols), []
    for part in (0, 1):
        own = cols["_part"] == part
        own_w = (w if part == 0 else cols["_w"] if ch.window is None else w)[own]
        out += [float((own_w * each[own]).sum()), float(own_w.sum())]
    return out


def _residual_counts(rows: Rows, plans: Sequence[_Plan], number: int) -> list[dict[str, np.ndarray]]:
    """For each plan and column counts [zone, fold, bin of the residual]."""
    shapes = [(p.size(c), p.channel.settings.folds, len(p.edges) - 1) for p in plans for c in p.names]

    def kernel(cols):
        out = []
        for p in plans:
            v, folds = _View(cols, p.channel, number), p.channel.settings.folds
            inside, levels = v.inside, len(p.edges) - 1
            level = np.clip(np.searchsorted(p.edges, v.r[inside], side="right") - 1, 0, levels - 1)
            for c in p.names:
                at = (p.zone_of[c][cols[CODE + c][inside]] * folds + v.fold[inside]) * levels + level
                out.append(_count(at, v.w[inside], (p.size(c), folds, levels)))
        return np.concatenate(out)

    found = iter(_split(rows.reduce(kernel, _needed(plans, False, True)), shapes))
    return [{c: next(found) for c in p.names} for p in plans]


def _chosen(ch: Channel, number: int) -> list[str]:
    s, names = ch.settings, list(ch.features)
    rng = np.random.default_rng([s.seed, number, 1, *([] if ch.replicate is None else [ch.replicate])])
    count = max(min(2, len(names)), int(round(s.column_share * len(names))))
    chosen = sorted(rng.permutation(names)[:count].tolist(), key=names.index)
    return [*chosen, s.group] if s.group and s.group in names and s.group not in chosen else chosen


def plan_round(rows: Rows, channels: Sequence[Channel], number: int) -> tuple[list[_Plan], np.ndarray]:
    """Zones, mains, splines, pairs, triples and weights of one round of all channels; and the losses before it."""
    plans = [_Plan(ch, _chosen(ch, number)) for ch in channels]
    sums, loss = _histograms(rows, plans, number)
    for p, own in zip(plans, sums):
        _zonings(rows, p, own)
    ordered = [p for p in plans if p.channel.settings.ordered]
    for p in ordered:

        def inside(cols, p=p):
            v = _View(cols, p.channel, number)
            return v.r[v.inside]

        p.edges = residual_levels(rows, _needed([p], False, False), inside)
    if ordered:
        for p, own in zip(ordered, _residual_counts(rows, ordered, number)):
            _ordered_mains(p, own)
    for p, own in zip(plans, sums):
        if not p.channel.settings.ordered:
            _mains(p, own)
    _fit_splines(rows, plans, number)
    _learn_smoothing(rows, plans, number)
    _pairs(rows, plans, number)
    _triples(rows, plans, number)
    _stack(rows, plans, number)
    return plans, loss


def _baselines(rows: Rows, channels: Sequence[Channel]) -> list[float]:
    def kernel(cols):
        out = []
        for ch in channels:
            w = ch.weights(cols) * (cols["_part"] == 0)
            y = ch.target(cols)
            out += [w.sum(), (w * y).sum(), (w * np.exp(cols["_o"])).sum(), float((w > 0).sum()), float(((y < 0) & (w > 0)).sum()), float(((y <= 0) & (w > 0)).sum())]
        return np.array(out)

    needed = ["_y", "_o", "_w", "_h", "_part", "_p"]
    found = rows.reduce(kernel, needed)
    out = []
    for ch, (w, wy, we, n, below, not_above) in zip(channels, (found if found is not None else np.zeros(6 * len(channels))).reshape(-1, 6)):
        s = ch.settings
        if not n or w <= 0:
            raise ValueError("no rows to fit")
        if s.loss == "gamma" and not_above or s.loss in ("poisson", "tweedie") and below:
            raise ValueError(f"targets do not suit {s.loss}")
        if s.loss in losses.LOG_LINK:
            out.append(float(np.log(max(wy, 1e-300) / we)))
        elif s.loss == "log_loss":
            share = min(max(wy / w, 1e-6), 1 - 1e-6)
            out.append(float(np.log(share / (1 - share))))
        elif s.loss == "softmax":
            out.append(float(np.log(min(max(wy / w, 1e-6), 1 - 1e-6))))
        elif s.ordered:

            def own(cols, ch=ch):
                return ch.target(cols)[(cols["_part"] == 0) & (ch.weights(cols) > 0)]

            levels = residual_levels(rows, needed, own, 4 * LEVELS)
            if s.loss == "quantile":
                out.append(float(np.interp(s.quantile, np.linspace(0, 1, len(levels)), levels)))
            else:
                middle = (levels[1:] + levels[:-1]) / 2
                k = int(s.trim * len(middle))
                out.append(float(middle[k : len(middle) - k].mean()))
        else:
            out.append(float(wy / w))
    return out


def boost(rows: Rows, channels: Sequence[Channel]) -> list[Model]:
    """A model for each channel, by rounds until their number or until validation has not improved for ``patience`` rounds; cut at the best round.

    Channels share rounds, so they share the end: the softmax's classes have one loss, others stop when all would.
    """
    s = channels[0].settings
    baselines = _baselines(rows, channels)
    rows.start(baselines)
    models = [Model(b, ch.settings.learning_rate, []) for b, ch in zip(baselines, channels)]
    rate = [ch.settings.learning_rate for ch in channels]
    centred = channels[0].classes > 0
    best, since = np.full(len(channels), np.inf), np.zeros(len(channels), dtype=int)

    def note(loss: np.ndarray) -> bool:
        """Losses after a round; whether to stop."""
        validated = loss[:, 3] > 0
        now = np.where(validated, _ratio(loss[:, 2], loss[:, 3]), _ratio(loss[:, 0], loss[:, 1]))
        if centred:
            now[:] = now.sum()
        for k, m in enumerate(models):
            m.history.append(float(now[k]))
        since[:] = np.where(now < best - 1e-12, 0, since + 1)
        best[:] = np.minimum(best, now)
        return s.patience is not None and bool(validated.all() and (since >= s.patience).all())

    stopped = False
    for number in range(s.rounds):
        plans, loss = plan_round(rows, channels, number)
        if number and note(loss):
            stopped = True
            break

        def kernel(cols, plans=plans):
            parts = []
            for p in plans:
                v = _View(cols, p.channel, number)
                x = np.array([p.round.weights[t] for t in p.round.tables])
                parts.append(p.round.intercept + x @ _term_values(p, cols, v))
            if centred:
                mean = sum(parts) / len(parts)
                parts = [x - mean for x in parts]
            return [k * x for k, x in zip(rate, parts)]

        rows.step(kernel, _needed(plans, True, False), number)
        for m, p in zip(models, plans):
            m.rounds.append(p.round)
    if not stopped:

        def final(cols):
            return np.array([x for ch in channels for x in _losses(ch, cols, ch.weights(cols))])

        note(rows.reduce(final, _needed([_Plan(ch, []) for ch in channels], False, False)).reshape(-1, 4))
        loss = rows.reduce(final, _needed([_Plan(ch, []) for ch in channels], False, False)).reshape(-1, 4)
    for m, row in zip(models, loss):
        m.rounds = m.rounds[: len(m.history)]
        if row[3] > 0:  # validated
            m.rounds = m.rounds[: int(np.argmin(m.history)) + 1]
    rows.close()
    return models


# Entry points


def checked(settings: Settings, schema: frames.Schema, weight: str | None = None) -> Settings:
    """Settings against the columns: constraints on categories are dropped, unknown columns refused."""
    known = set(schema.names)
    named = {*settings.monotone, *settings.convex, *settings.bounded, *settings.splines, *(c for p in settings.forbidden for c in p), *([settings.group] if settings.group else [])}
    if named - known:
        raise ValueError(f"unknown columns {sorted(named - known)}")
    if weight and settings.ordered:
        raise ValueError("weights need means: no quantile loss, no trim")
    if set(settings.splines) & set(schema.categorical):
        raise ValueError("splines need numbers")
    only = lambda d: {c: v for c, v in d.items() if c in schema.continuous}
    return replace(settings, monotone=only(settings.monotone), convex=only(settings.convex), bounded=only(settings.bounded), forbidden=frozenset(frozenset(p) for p in settings.forbidden))


def fit_frame(df: DataFrame, features: Sequence[str], y: str, settings: Settings, categorical: Sequence[str] = (), offset: str | None = None, key: str = "row_id", validation: float = 0.0, calibration: float = 0.0, weight: str | None = None, local: int | None = None) -> Model:
    return fit_channels(df, features, F.col(y), [settings], categorical, offset, key, validation, calibration, weight, local)[0]


def fit_channels(df: DataFrame, features: Sequence[str], y: Column, settings: Sequence[Settings], categorical: Sequence[str] = (), offset: str | None = None, key: str = "row_id", validation: float = 0.0, calibration: float = 0.0, weight: str | None = None, local: int | None = None, classes: int = 0, replicates: bool = False, windows: Sequence[tuple[int, int]] = (), period: Column | None = None, subsets: Sequence[Sequence[str]] = ()) -> list[Model]:
    """One model for each of ``settings``, fitted together over the same rows."""
    parts = {k: v for k, v in (("val", validation), ("cal", calibration)) if v}
    if sum(parts.values()) >= 1 or any(v < 0 for v in parts.values()):
        raise ValueError("validation and calibration must leave rows to fit")
    schema = frames.resolve(df, list(features), list(categorical))
    if weight is not None and df.where(F.col(weight) < 0).limit(1).count():
        raise ValueError("weights must not be negative")
    settings = [checked(s, schema, weight) for s in settings]
    channels = [
        Channel(k, s, tuple(subsets[k]) if subsets else schema.names, k if replicates else None, windows[k] if windows else None, classes)
        for k, s in enumerate(settings)
    ]
    return boost(rows_of(df, schema, y, settings[0], offset, key, weight, parts, period, local), channels)


def local_model(frame, features: frames.Schema, y: np.ndarray, settings: Settings, offset: np.ndarray | None = None, weight: np.ndarray | None = None) -> Model:
    """A fit over arrays (a dict or pandas frame of columns)."""
    n = len(y)
    arrays = {c: np.asarray(frame[c]) for c in features.names}
    rng = np.random.default_rng(settings.seed)
    arrays |= {"_y": np.asarray(y, float), "_o": np.zeros(n) if offset is None else np.asarray(offset, float), "_w": np.ones(n) if weight is None else np.asarray(weight, float), "_h": rng.integers(0, PRIME, n), "_part": np.zeros(n, dtype=np.int64), "_p": np.zeros(n, dtype=np.int64)}
    return boost(ArrayRows(arrays, features, settings), [Channel(0, checked(settings, features), features.names)])[0]


def cal_part(df: DataFrame, name: str, settings: Settings, validation: float, calibration: float, key: str = "row_id") -> DataFrame:
    """The rows that a fit put in part ``name``."""
    place = frames.unit_hash(F.col(key), seed=settings.seed)
    low = {"val": 0.0, "cal": validation, "fit": validation + calibration}[name]
    high = {"val": validation, "cal": validation + calibration, "fit": 1.0}[name]
    return df.where((place >= low) & (place < high))


def link(settings: Settings, score: Column) -> Column:
    if settings.loss == "log_loss":
        return scalar.sigmoid(score)
    return losses.mean_of(settings.loss, score)
