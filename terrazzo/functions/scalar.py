"""Scalar expressions of the engine: zones, links, distances, dates and labels.

All return Columns of built-in functions, so they stay in generated code.
Missing is NULL; `normalized` turns NaN into NULL on the way in.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the score at which links are clipped.
CLIP = 30.0


def normalized(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def array_literal(values: Sequence, kind: str = "array<double>") -> Column:
    """A constant array, folded once by the optimizer however long it is."""
    return F.from_json(F.lit(json.dumps(list(values))), kind)


def zone_index(x: Column, cuts: Sequence[float]) -> Column:
    """Number of cuts <= x; missing x: ``len(cuts) + 1``. Short lists become a CASE chain, long ones a search in two levels."""
    missing = F.lit(len(cuts) + 1)
    if len(cuts) <= 16:
        out = F.when(x.isNull(), missing)
        for i, cut in enumerate(sorted(cuts)):
            out = out.when(x < F.lit(float(cut)), F.lit(i))
        return out.otherwise(F.lit(len(cuts)))
    ordered = sorted(map(float, cuts))
    side = math.isqrt(len(ordered))
    blocks = [ordered[i : i + side] for i in range(0, len(ordered), side)]
    block = F.size(F.filter(array_literal([b[0] for b in blocks]), lambda c: c <= x))
    inner = F.size(F.filter(F.get(array_literal(blocks, "array<array<double>>"), block - 1), lambda c: c <= x))
    return F.when(x.isNull(), missing).when(block == 0, F.lit(0)).otherwise((block - 1) * side + inner)


def category_index(x: Column, categories: Sequence[str]) -> Column:
    """Place of x among the categories; missing: their number; unseen: one more."""
    out = F.when(x.isNull(), F.lit(len(categories)))
    for i, value in enumerate(categories):
        out = out.when(x.cast("string") == value, F.lit(i))
    return out.otherwise(F.lit(len(categories) + 1))


def interpolated(x: Column, centers: Sequence[float], values: Sequence[float], missing: float, lam: float = 1.0, cuts: Sequence[float] = ()) -> Column:
    """Soft lookup: values at the zone centers, linear between them, constant outside.

    ``lam`` below 1 blends toward the hard value of the own zone (``cuts`` are
    needed then): own + lam * (line - own).
    """
    line = F.when(x.isNull(), F.lit(float(missing)))
    if len(centers) > 1:
        line = line.when(x <= F.lit(float(centers[0])), F.lit(float(values[0])))
        for (a, va), (b, vb) in zip(zip(centers, values), zip(centers[1:], values[1:])):
            slope = (vb - va) / (b - a) if b > a else 0.0
            line = line.when(x <= F.lit(float(b)), F.lit(float(va)) + (x - F.lit(float(a))) * F.lit(float(slope)))
        line = line.otherwise(F.lit(float(values[-1])))
    else:
        line = line.otherwise(F.lit(float(values[0])))
    if lam >= 1.0 or not len(cuts):
        return line
    hard = F.get(array_literal([*values, missing]), zone_index(x, cuts))
    return F.when(x.isNull(), F.lit(float(missing))).otherwise(hard + F.lit(float(lam)) * (line - hard))


def soft_weights(x: Column, centers: Sequence[float], cuts: Sequence[float], lam: float = 1.0) -> tuple[Column, Column, Column]:
    """Own zone, neighbour zone and the neighbour's weight."""
    own = zone_index(x, cuts)
    last = len(cuts)
    center = F.get(array_literal(centers), own)
    neighbour = F.greatest(F.lit(0), F.least(F.lit(last), F.when(x >= center, own + 1).otherwise(own - 1)))
    other = F.get(array_literal(centers), neighbour)
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - center, other - center)))
    weight = F.when(x.isNull() | (own == neighbour), F.lit(0.0)).otherwise(F.coalesce(weight, F.lit(0.0)) * F.lit(float(lam)))
    return own, F.when(x.isNull(), own).otherwise(neighbour), weight


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-CLIP)), F.lit(CLIP))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clipped(x)))


def exp_link(x: Column) -> Column:
    return F.exp(clipped(x))


def softmax(scores: Sequence[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    weights = [F.exp(s - top) for s in scores]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def hinge(x: Column, knot: float) -> Column:
    """max(x - knot, 0); NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(x - F.lit(float(knot)), F.lit(0.0)))


def mahalanobis(columns: Sequence[Column], center: Sequence[float], inverse: Sequence[Sequence[float]]) -> Column:
    """Distance from the center; NULL counts as the center."""
    gap = [F.coalesce(c, F.lit(float(m))) - F.lit(float(m)) for c, m in zip(columns, center)]
    total = F.lit(0.0)
    for i, row in enumerate(inverse):
        for j, value in enumerate(row):
            total = total + gap[i] * gap[j] * F.lit(float(value))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def coreness(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def days(time: Column) -> Column:
    """Days since the epoch as a double."""
    return F.unix_micros(time.cast("timestamp")).cast("double") / 86_400e6


def period(time: Column, unit: str) -> Column:
    if unit not in ("year", "quarter", "month", "week", "day"):
        raise ValueError(f"unknown period {unit!r}")
    return F.date_trunc(unit, time)


def term_name(*columns: str) -> str:
    return " x ".join(sorted(columns))


def half_life_name(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else str(float(value))


def zone_labels(cuts: Sequence[float]) -> list[str]:
    """Labels of the real zones and of the missing one."""
    if not len(cuts):
        return ["all", "missing"]
    show = [f"{c:.3g}" for c in cuts]
    return [f"< {show[0]}", *(f"[{a}, {b})" for a, b in zip(show, show[1:])), f">= {show[-1]}", "missing"]
