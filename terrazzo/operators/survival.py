"""Survival: person-period tables, breakpoints, hazards and concordance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import array_literal, zone_index
from .cells import percentiles


def breakpoints(df: DataFrame, duration: str, event: str, intervals: int) -> list[float]:
    """Quantiles of event durations, the first 0 and the last infinite; without events those of all durations."""
    shares = [i / intervals for i in range(intervals + 1)]
    found: list[float] = []
    for rows in (df.where(F.col(event) == 1), df):
        found = found or sorted({v for v in percentiles(rows, [], duration, shares).first()["q"] if v is not None})
    return [0.0, *found[1:-1], float("inf")] if len(found) >= 2 else [0.0, float("inf")]


def _intervals(points: Sequence[float]) -> Column:
    bounds = [(float(a), float(b) if b != float("inf") else None) for a, b in zip(points, points[1:])]
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("lo"), F.lit(b).cast("double").alias("hi")) for i, (a, b) in enumerate(bounds)))


def person_period(df: DataFrame, duration: str, event: str, points: Sequence[float]) -> DataFrame:
    """``df`` once for each interval a subject reaches: interval, interval_start, exposure and y (1 in the interval of an event)."""
    dealt = df.withColumn("_i", F.explode(F.filter(_intervals(points), lambda p: p["lo"] < F.col(duration))))
    hi = F.coalesce(F.col("_i.hi"), F.col(duration).cast("double"))
    ends = F.col("_i.hi").isNull() | (F.col(duration) <= F.col("_i.hi"))
    return dealt.withColumns({"interval": F.col("_i.i"), "interval_start": F.col("_i.lo"), "exposure": F.least(F.col(duration).cast("double"), hi) - F.col("_i.lo"), "y": F.when(ends & (F.col(event) == 1), 1.0).otherwise(0.0)}).drop("_i")


def cumulative_hazard(hazards: Sequence[Column], points: Sequence[float], t: Column) -> Column:
    """Sum of each interval's hazard times its overlap with [0, t]; the last interval is open."""
    total = F.lit(0.0)
    for h, a, b in zip(hazards, points, points[1:]):
        end = t if b == float("inf") else F.least(t, F.lit(float(b)))
        total = total + h * F.greatest(end - F.lit(float(a)), F.lit(0.0))
    return total


def _later_and_lower(time: np.ndarray, risk: np.ndarray, n: np.ndarray, events: np.ndarray) -> tuple[float, float]:
    """Over pairs of an event and something strictly later: their number, and how many of the later ones have the lower risk (half for equal ones).

    Risks become ranks. At the highest binary digit in which two ranks differ
    the lower one has a 0, so each digit is one sort and one running sum.
    """
    if not len(time):
        return 0.0, 0.0

    def after(group: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each row the weight of its group's rows with a later time."""
        order = np.lexsort((time, group))
        total = np.cumsum(weight[order])
        new = np.r_[True, np.diff(group[order]) != 0]
        moved = new | np.r_[True, np.diff(time[order]) != 0]
        last = lambda starts: np.r_[np.flatnonzero(starts)[1:], len(order)] - 1  # noqa: E731  of each run
        end_of_group = total[last(new)][np.cumsum(new) - 1]
        end_of_time = total[last(moved)][np.cumsum(moved) - 1]
        out = np.empty(len(order))
        out[order] = end_of_group - end_of_time
        return out

    rank = np.unique(risk, return_inverse=True)[1].ravel()
    pairs = float((events * after(np.zeros(len(time), dtype=np.int64), n)).sum())
    won = 0.5 * float((events * after(rank, n)).sum())
    for digit in range(int(rank.max()).bit_length()):
        high = (rank >> digit) & 1
        won += float((events * high * after(rank >> (digit + 1), n * (1 - high))).sum())
    return pairs, won


def concordance(df: DataFrame, duration: str, event: str, risk: str, blocks: int = 256) -> DataFrame:
    """Harrell's C: of the pairs whose earlier one has the event, the share where that one has the greater risk; equal risks count half.

    Of two events at the same time each is once the earlier one. Rows without
    a duration or risk are left out; without pairs the result is null.

    Times and risks are cut into ``blocks`` quantile blocks, each edge a block
    of its own (so a value with many rows is one). Pairs that differ in both
    blocks follow from counts by block, pairs inside a block of times or of
    risks from a kernel over that block's distinct values: n log n work, and
    a task sees about one part in ``blocks`` of the distinct values.
    """
    rows = df.select(F.col(duration).cast("double").alias("d"), F.coalesce(F.col(event).cast("int"), F.lit(0)).alias("e"), F.col(risk).cast("double").alias("r")).where("d is not null and r is not null")
    shares = [i / blocks for i in range(1, blocks)]
    found = rows.agg(*(F.percentile_approx(c, shares, 100 * blocks).alias(c) for c in ("d", "r"))).first()
    edges = {c: sorted(set(found[c] or [])) for c in ("d", "r")}

    def block(c: str) -> Column:
        """Twice the number of edges up to the value, less one on an edge: odd numbers are edges, even ones lie between."""
        below = zone_index(F.col(c), edges[c])
        return 2 * below - F.when(F.get(array_literal(edges[c]), below - 1) == F.col(c), 1).otherwise(0) if edges[c] else F.lit(0)

    counts = F.sum(F.lit(1.0)).alias("n"), F.sum(F.col("e").cast("double")).alias("m")
    coded = rows.withColumns({"t": block("d"), "u": block("r")})

    def kernel(frame):
        import pyarrow as pa

        column = lambda c: frame.column(c).to_numpy().astype(float)
        pairs, won = _later_and_lower(column("time"), column("r"), column("n"), column("m"))
        # Pairs inside a block of risks are counted with those of different blocks of times.
        return pa.table({"pairs": [0.0 if column("risks")[0] else pairs], "won": [won]})

    inside = F.array(F.struct(F.lit(0).alias("risks"), F.col("t").alias("block"), F.col("d").alias("time")), F.struct(F.lit(1).alias("risks"), F.col("u").alias("block"), F.col("t").cast("double").alias("time")))
    near = coded.select(F.explode(F.filter(inside, lambda p: p["block"] % 2 == 0)).alias("p"), "r", "e").select("p.*", "r", "e")
    within = near.groupBy("risks", "block", "time", "r").agg(*counts).groupBy("risks", "block").applyInArrow(kernel, "pairs double, won double")
    ties = coded.where("e = 1").groupBy("d").agg(F.count(F.lit(1)).cast("double").alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1)), F.lit(0.0)).alias("pairs"))
    pairs, won = within.unionByName(ties.select("pairs", (F.col("pairs") / 2).alias("won"))).agg(F.sum("pairs"), F.sum("won")).first()
    side = {c: 2 * len(edges[c]) + 1 for c in ("d", "r")}
    n, m = np.zeros((side["d"], side["r"])), np.zeros((side["d"], side["r"]))
    cells = coded.groupBy("t", "u").agg(*counts).toArrow()  # (2 * blocks)^2 rows at most
    at = cells.column("t").to_numpy(), cells.column("u").to_numpy()
    n[at], m[at] = cells.column("n").to_numpy(), cells.column("m").to_numpy()
    later = np.vstack([n[::-1].cumsum(axis=0)[::-1][1:], np.zeros((1, side["r"]))])
    lower = np.hstack([np.zeros((side["d"], 1)), later.cumsum(axis=1)[:, :-1]])
    pairs += float((m * later.sum(axis=1, keepdims=True)).sum())
    # Equal risks on an edge; between edges the kernel has counted them.
    won += float((m * lower).sum()) + 0.5 * float((m * later)[:, 1::2].sum())
    return df.sparkSession.createDataFrame([(won / pairs if pairs else None,)], "c_index double")


def survival_curve(hazard: Column) -> Column:
    return F.exp(-hazard)
