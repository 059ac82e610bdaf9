"""Zone construction: from a column and a target to cut points.

A cut must separate two distinct values, so one aggregated row for each
distinct value carries all that a cut needs. Columns with more than
``MAX_BINS`` distinct values are first cut into that many quantile bins. The
driver sees at most that many rows; rows of the table are read by one
partially aggregated ``groupBy`` alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import array_literal, zone_index
from .joins import lookup

MAX_BINS = 1024
MAX_ZONES = 7
MIN_SHARE = 0.02
MIN_ROWS = 20


@dataclass
class Histogram:
    """Bins of one column in ascending order: weight, weighted target, weighted x, least and greatest x, weighted x*x and x*y."""

    w: np.ndarray
    wy: np.ndarray
    wx: np.ndarray
    low: np.ndarray
    high: np.ndarray
    wxx: np.ndarray
    wxy: np.ndarray


def bin_edges(df: DataFrame, x: str, bins: int = MAX_BINS) -> list[float] | None:
    """None if x has at most ``bins`` distinct values, else distinct quantile edges."""
    if df.select(x).where(F.col(x).isNotNull()).distinct().limit(bins + 1).count() <= bins:
        return None
    shares = [i / bins for i in range(1, bins)]
    return sorted(set(df.select(F.percentile_approx(x, shares, 100 * bins).alias("q")).first()["q"]))


def histogram_table(df: DataFrame, x: str, y: str, weight: str | None = None, edges: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row for each distinct x, each bin between the edges, or each combination of the columns ``by``: w, wy, wx, wxx, wxy, low, high."""
    value, target = F.col(x).cast("double"), F.col(y).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    key = value if edges is None else zone_index(value, edges).cast("double")
    sums = {"w": w, "wy": w * target, "wx": w * value, "wxx": w * value * value, "wxy": w * value * target}
    keys = [F.col(c) for c in by] or [key.alias("bin")]
    return df.where(value.isNotNull()).groupBy(*keys).agg(*(F.sum(e).alias(n) for n, e in sums.items()), F.min(value).alias("low"), F.max(value).alias("high"))


def histogram(df: DataFrame, x: str, y: str, weight: str | None = None, edges: Sequence[float] | None = None) -> Histogram:
    rows = sorted(histogram_table(df, x, y, weight, edges).collect(), key=lambda r: r["bin"])  # MAX_BINS at most
    column = lambda n: np.array([r[n] for r in rows], dtype=float)
    return Histogram(*(column(n) for n in ("w", "wy", "wx", "low", "high", "wxx", "wxy")))


def variance_cut(h: Histogram, a: int, b: int, least: float) -> tuple[float, int]:
    """Best (gain, first bin of the right part) within bins a..b-1; gain 0 if none is allowed."""
    if b - a < 2:
        return 0.0, -1
    w, s = np.cumsum(h.w[a:b]), np.cumsum(h.wy[a:b])
    total, mass = s[-1], w[-1]
    lw, ls = w[:-1], s[:-1]
    rw = mass - lw
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ls**2 / lw + (total - ls) ** 2 / rw - total**2 / mass
    gain = np.where((lw >= least) & (rw >= least) & np.isfinite(gain), gain, 0.0)
    best = int(np.argmax(gain))
    return (float(gain[best]), a + best + 1) if gain[best] > 0 else (0.0, -1)


def reversal_cut(h: Histogram, a: int, b: int, least: float) -> tuple[float, int]:
    """Best cut where the least-squares slope changes sign; the gain is the lesser of both slopes' sizes."""
    if b - a < 4:
        return 0.0, -1
    sums = [np.cumsum(v[a:b]) for v in (h.w, h.wx, h.wy, h.wxx, h.wxy)]
    slopes = []
    for part in ([v[:-1] for v in sums], [v[-1] - v[:-1] for v in sums]):
        w, x, y, xx, xy = part
        below = w * xx - x * x
        slopes.append(np.where(below > 1e-12, (w * xy - x * y) / np.where(below > 1e-12, below, 1.0), np.nan))
    left, right = slopes
    gain = np.where(left * right < 0, np.minimum(np.abs(left), np.abs(right)), 0.0)
    gain = np.where((sums[0][:-1] >= least) & (sums[0][-1] - sums[0][:-1] >= least) & np.isfinite(gain), gain, 0.0)
    best = int(np.argmax(gain))
    return (float(gain[best]), a + best + 1) if gain[best] > 0 else (0.0, -1)


def greedy_cuts(h: Histogram, max_zones: int = MAX_ZONES, min_share: float = MIN_SHARE, min_rows: float = MIN_ROWS, criterion: str = "variance") -> list[float]:
    """Best-first cuts: the segment with the greatest gain is cut until none gains or ``max_zones`` are reached; earlier segments win ties."""
    if criterion not in ("variance", "correlation"):
        raise ValueError(f"unknown criterion {criterion!r}")
    if not len(h.w):
        return []
    least = max(float(min_rows), float(int(h.w.sum() * min_share)))
    segments, cuts = [(0, len(h.w))], []
    while len(segments) < max_zones:
        chosen = (0.0, -1, -1)
        for rule in ((reversal_cut, variance_cut) if criterion == "correlation" else (variance_cut,)):
            for i, (a, b) in enumerate(segments):
                gain, at = rule(h, a, b, least)
                if gain > chosen[0]:
                    chosen = gain, i, at
            if chosen[1] >= 0:
                break
        gain, i, at = chosen
        if i < 0:
            break
        a, b = segments[i]
        segments[i : i + 1] = [(a, at), (at, b)]
        cuts.append((h.high[at - 1] + h.low[at]) / 2)
    return sorted(float(c) for c in cuts)


def adaptive_cuts(df: DataFrame, x: str, y: str, weight: str | None = None, max_zones: int = MAX_ZONES, min_share: float = MIN_SHARE, min_rows: float = MIN_ROWS, criterion: str = "variance") -> list[float]:
    """Data-driven cuts of x for the target y; rows without x do not count."""
    return greedy_cuts(histogram(df, x, y, weight, bin_edges(df, x)), max_zones, min_share, min_rows, criterion)


#: Rows of edges (8 KB each) up to which they are broadcast.
MAX_EDGE_ROWS = 4_000


def segment_cuts(df: DataFrame, segment: str, x: str, y: str, weight: str | None = None, max_zones: int = MAX_ZONES, min_share: float = MIN_SHARE, min_rows: float = MIN_ROWS, criterion: str = "variance") -> DataFrame:
    """segment, cuts: the cuts `adaptive_cuts` finds in each segment's own rows, for all segments at once.

    A segment's values are bins of their own, or, where they are more than
    ``MAX_BINS`` (by a distinct count within 2 %), fall into that many
    quantile bins of the segment. One task sees a segment's bins, never its
    rows. Segments without a value of x have no row.
    """
    value = F.col(x).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(segment).alias("_s"), value.alias("_x"), F.col(y).cast("double").alias("_y"), w.alias("_w")).where("_x is not null")
    shares, side = [i / MAX_BINS for i in range(1, MAX_BINS)], 32
    crowded = rows.groupBy(F.col("_s").alias("_e")).agg(F.approx_count_distinct("_x", 0.02).alias("_d"), F.percentile_approx("_x", shares, 100 * MAX_BINS).alias("_q")).where(F.col("_d") > MAX_BINS)
    edges = F.array_sort(F.array_distinct("_q"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / side).cast("int")), lambda i: F.slice(edges, i * side + 1, side))
    crowded = crowded.select("_e", blocks.alias("_blocks")).withColumn("_firsts", F.transform("_blocks", lambda b: b[0])).persist()  # few and small, used twice
    found = lookup(rows, crowded, F.expr("_s <=> _e"), MAX_EDGE_ROWS)
    block = F.size(F.filter("_firsts", lambda e: e <= F.col("_x")))
    inner = F.size(F.filter(F.get("_blocks", block - 1), lambda e: e <= F.col("_x")))
    place = F.when(F.col("_blocks").isNull(), F.col("_x")).when(block == 0, F.lit(0.0)).otherwise(((block - 1) * side + inner).cast("double"))
    binned = histogram_table(found.withColumn("_bin", place), "_x", "_y", "_w", by=["_s", "_bin"])

    def cuts(frame):
        import pyarrow as pa

        frame = frame.sort_by("low")
        h = Histogram(*(frame.column(n).to_numpy().astype(float) for n in ("w", "wy", "wx", "low", "high", "wxx", "wxy")))
        found = greedy_cuts(h, max_zones, min_share, min_rows, criterion)
        return pa.table({"segment": frame.column("_s").slice(0, 1), "cuts": pa.array([found], pa.list_(pa.float64()))})

    return binned.groupBy("_s").applyInArrow(cuts, f"segment {df.schema[segment].dataType.simpleString()}, cuts array<double>")


def quantile_blocks(df: DataFrame, blocks: int = 256) -> tuple[list[list[float]], list[list[int]], int]:
    """For all columns at once: edges of quantile blocks, the rows before each block, and the number of rows."""
    shares = [i / blocks for i in range(1, blocks)]
    found = df.agg(*(F.percentile_approx(c, shares, 100 * blocks).alias(c) for c in df.columns)).first()
    edges = [sorted({float(e) for e in found[c] or []}) for c in df.columns]
    counts = [np.zeros(len(own) + 2, dtype=np.int64) for own in edges]  # the last one is of missing values

    def kernel(batches):
        import pyarrow as pa

        n = [np.zeros(len(own) + 2, dtype=np.int64) for own in edges]
        for batch in batches:
            for own, total, x in zip(edges, n, batch.columns):
                total[:-1] += np.bincount(np.searchsorted(own, x.drop_null().to_numpy(), side="right"), minlength=len(own) + 1)
                total[-1] += x.null_count
        for i, total in enumerate(n):
            yield pa.RecordBatch.from_pydict({"column": np.full(len(total), i), "block": np.arange(len(total)), "n": total})

    counted = df.select(*(F.col(c).cast("double") for c in df.columns)).mapInArrow(kernel, "column bigint, block bigint, n bigint")
    for r in counted.groupBy("column", "block").agg(F.sum("n").alias("n")).collect():  # blocks + 1 numbers a column at most
        counts[r["column"]][r["block"]] = r["n"]
    return edges, [[0, *np.cumsum(n[:-2]).tolist()] for n in counts], int(counts[0].sum())


def shares_up_to(df: DataFrame, wanted: DataFrame, x: str, edges: Sequence[float], before: Sequence[int], rows: int) -> DataFrame:
    """x, x_share: for each distinct present x of ``wanted`` the share of the rows of ``df`` with an x up to it, by ``quantile_blocks`` of ``df``.

    Exact: values are counted, and a running sum over a block's distinct
    values (never its rows) goes on from the rows before that block.
    """
    both = df.select(x, F.lit(1).alias("_n"), F.lit(False).alias("_asked")).unionByName(wanted.select(x, F.lit(0).alias("_n"), F.lit(True).alias("_asked")))
    counted = both.where(F.col(x).isNotNull()).groupBy(x).agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    order = Window.partitionBy("_block").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_block", zone_index(F.col(x).cast("double"), edges)).withColumn("_n", F.sum("_n").over(order)).where("_asked")
    up_to = F.get(array_literal(before, "array<bigint>"), F.col("_block")) + F.col("_n")
    return placed.select(x, (up_to / F.lit(float(max(rows, 1)))).alias(f"{x}_share"))


def best_cut_table(df: DataFrame, x: str, y: str, min_share: float = MIN_SHARE, min_rows: int = MIN_ROWS) -> DataFrame:
    """The first cut as a plan of its own: cut and its share of the sum of squares."""
    table = histogram_table(df, x, y)
    ordered = Window.orderBy("bin")  # one row for each distinct value
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    total = df.where(F.col(x).isNotNull()).agg((F.var_pop(y) * F.count(y)).alias("ss"))
    scan = table.select("bin", F.sum("w").over(so_far).alias("lw"), F.sum("wy").over(so_far).alias("ls"), F.sum("w").over(whole).alias("n"), F.sum("wy").over(whole).alias("t"), F.lead("bin").over(ordered).alias("next"))
    least = F.greatest(F.lit(float(min_rows)), F.floor(F.col("n") * min_share))
    gain = F.col("ls") * F.col("ls") / F.col("lw") + (F.col("t") - F.col("ls")) * (F.col("t") - F.col("ls")) / (F.col("n") - F.col("lw")) - F.col("t") * F.col("t") / F.col("n")
    allowed = scan.where(F.col("next").isNotNull() & (F.col("lw") >= least) & (F.col("n") - F.col("lw") >= least))
    return allowed.crossJoin(F.broadcast(total)).select(((F.col("bin") + F.col("next")) / 2).alias("cut"), F.round(gain / F.col("ss"), 6).alias("gain_share")).orderBy(F.desc("gain_share"), "cut").limit(1)


def zone_centers(df: DataFrame, x: str, cuts: Sequence[float], weight: str | None = None) -> list[float]:
    """Weighted mean of x in each real zone; an empty zone has the middle of its edges (one beyond the outer cuts)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    value = F.col(x).cast("double")
    found = {r[0]: r[1] for r in df.where(value.isNotNull()).groupBy(zone_index(value, cuts).alias("z")).agg(F.try_divide(F.sum(w * value), F.sum(w))).collect()}
    edges = [cuts[0] - 1.0, *cuts, cuts[-1] + 1.0] if len(cuts) else [-1.0, 1.0]
    return [found[z] if found.get(z) is not None else (edges[z] + edges[z + 1]) / 2 for z in range(len(cuts) + 1)]


def categories(df: DataFrame, x: str, most: int = 10_000) -> list[str]:
    """Distinct present values as text, sorted."""
    found = df.where(F.col(x).isNotNull()).select(F.col(x).cast("string").alias("v")).distinct().orderBy("v").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{x} has over {most} categories")
    return [r["v"] for r in found]


def quantile_bins(df: DataFrame, x: str, bins: int) -> list[float]:
    """Inner edges of quantile bins, repeated ones dropped; for `zone_index`."""
    from .cells import percentiles

    edges = percentiles(df, [], x, [i / bins for i in range(bins + 1)]).first()["q"]
    return sorted({e for e in edges if e is not None})[1:-1]
