"""Intervals, drift, purification, reliability and exploratory tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import percentiles, ranked


def order_statistic(df: DataFrame, score: str, alpha: float, groups: Sequence[str] = ()) -> DataFrame:
    """groups, n, margin: the k-th least score, k = min(ceil((n + 1)(1 - alpha)), n).

    Only scores near that rank are ordered (`cells.ranked`), also in a hot group.
    """
    placed = ranked(df.where(F.col(score).isNotNull()), groups, score, [1.0 - alpha])
    k = F.least(F.ceil((F.col("_n") + 1) * F.lit(1.0 - alpha) - 1e-9), F.col("_n"))
    return placed.where((F.col("_end") >= k) & (F.col("_end") - F.col("_c") < k)).select(*groups, F.col("_n").alias("n"), F.col("_v").alias("margin"))


def mondrian_margins(df: DataFrame, score: str, group: str, alpha: float, least: int) -> DataFrame:
    """group, n, margin, own: each group's margin, or the global one where the group has under ``least`` rows."""
    own = order_statistic(df, score, alpha, [group])
    everything = order_statistic(df, score, alpha).select(F.col("margin").alias("all_margin"))
    enough = F.col("n") >= least
    return own.crossJoin(F.broadcast(everything)).select(group, "n", F.when(enough, F.col("margin")).otherwise(F.col("all_margin")).alias("margin"), enough.alias("own"))


def conformal_score(y: Column, low: Column, high: Column) -> Column:
    """How far y lies outside [low, high]; negative inside."""
    return F.greatest(F.least(low, high) - y, y - F.greatest(low, high))


def importance_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """term, old, new, change of two tables (term, importance); absent terms count 0."""
    joined = old.select(F.col("term"), F.col("importance").alias("old")).join(new.select(F.col("term"), F.col("importance").alias("new")), "term", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select("term", zero("old").alias("old"), zero("new").alias("new"), (zero("new") - zero("old")).alias("change"))


def term_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """term, status: new terms and those that are gone."""
    gone = old.select("term").join(new.select("term"), "term", "left_anti").withColumn("status", F.lit("disappeared"))
    return new.select("term").join(old.select("term"), "term", "left_anti").withColumn("status", F.lit("new")).unionByName(gone)


def migration(df: DataFrame, old_zone: Column, new_zone: Column) -> DataFrame:
    """Share of rows whose zone differs."""
    return df.agg(F.avg(F.when(old_zone != new_zone, 1.0).otherwise(0.0)).alias("migration"))


def drift_flags(df: DataFrame, old: Column, new: Column, margin: Column | float, groups: Sequence[str] = ()) -> DataFrame:
    """Mean shift for each group and whether its size exceeds the margin."""
    margin = F.lit(float(margin)) if isinstance(margin, (int, float)) else margin
    shift = df.groupBy(*groups).agg(F.avg(new - old).alias("shift"), F.max(margin).alias("margin"))
    return shift.withColumn("drift", F.abs("shift") > F.col("margin"))


def period_windows(df: DataFrame, period: str, y: str, window: str = "expanding", periods: int = 3) -> DataFrame:
    """For each period the rows and mean of the periods before it (all, or the last ``periods``)."""
    by = df.groupBy(period).agg(F.count(y).alias("c"), F.sum(F.col(y).cast("double")).alias("s"))
    order = Window.orderBy(period)  # one row for each period
    if window not in ("expanding", "rolling"):
        raise ValueError(f"unknown window {window!r}")
    frame = order.rowsBetween(Window.unboundedPreceding if window == "expanding" else -periods, -1)
    return by.select(period, F.coalesce(F.sum("c").over(frame), F.lit(0)).alias("train_rows"), (F.sum("s").over(frame) / F.sum("c").over(frame)).alias("train_mean"), F.lag(period).over(order).alias("previous"))


def purify_gains(table, a: str, b: str, n: str, value: str, sweeps: int = 50, tolerance: float = 1e-10) -> tuple[object, dict, dict]:
    """A pair's cells (a pandas frame, one row for each) without their margins, and what each zone of either side takes of them."""
    table, gains = table.copy(), {a: {}, b: {}}
    for _ in range(sweeps):
        worst = 0.0
        for side in (a, b):
            mean = table.groupby(side, dropna=False).apply(lambda g: (g[n] * g[value]).sum() / g[n].sum() if g[n].sum() else 0.0, include_groups=False)
            table[value] -= table[side].map(mean)
            for zone, gain in mean.items():
                gains[side][zone] = gains[side].get(zone, 0.0) + float(gain)
            worst = max(worst, float(mean.abs().max()) if len(mean) else 0.0)
        if worst < tolerance:
            break
    return table, gains[a], gains[b]


def purify(cells: DataFrame, a: str, b: str, sweeps: int = 50, n: str = "n", value: str = "value", tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves the margins of a pair's cell table into its mains: cells (a, b, value), and what a's and b's zones gain.

    Works on cells, one row for each (a, b); rows of data are not read.
    """
    table = cells.select(a, b, F.col(n).cast("double").alias(n), F.col(value).cast("double").alias(value)).toPandas()  # zones x zones
    back, of_a, of_b = purify_gains(table, a, b, n, value, sweeps, tolerance)
    spark = cells.sparkSession
    frame = lambda side, gains: spark.createDataFrame([(z, g) for z, g in gains.items()], f"{side} {cells.schema[side].dataType.simpleString()}, gain double")
    return spark.createDataFrame(back), frame(a, of_a), frame(b, of_b)


def purify_sweep(cells: DataFrame, side: str, n: str = "n", value: str = "value") -> DataFrame:
    """One half sweep as a plan: each zone of ``side`` loses its weighted mean."""
    w = Window.partitionBy(side)
    return cells.withColumn(value, F.col(value) - F.sum(F.col(n) * F.col(value)).over(w) / F.sum(n).over(w))


def evidence(df: DataFrame, supports: Sequence[Column], outside: Column, sparse: float = 30.0) -> DataFrame:
    """Per row: share of sparse terms, score, whether it extrapolates, and Low / Medium / High."""
    low = sum((F.when(s < sparse, 1.0).otherwise(0.0) for s in supports[1:]), F.when(supports[0] < sparse, 1.0).otherwise(0.0)) / len(supports)
    score = (1.0 - low) * F.when(outside, 0.5).otherwise(1.0)
    quality = F.when(score <= 0.5, "Low").when(score <= 0.8, "Medium").otherwise("High")
    return df.withColumns({"pct_sparse": low, "extrapolates": outside, "evidence_score": score, "evidence_quality": quality})


def outside_range(x: Column, centers: Sequence[float]) -> Column:
    if not len(centers):
        return F.lit(False)
    return F.coalesce((x < F.lit(float(min(centers)))) | (x > F.lit(float(max(centers)))), F.lit(False))


def boxplot(df: DataFrame, zone: str, x: str, valid: tuple[float, float] | None = None) -> DataFrame:
    """count, mean, median, quartiles, outliers (1.5 IQR) and invalid share of x in each zone."""
    value = F.col(x).cast("double")
    q = percentiles(df, [zone], x, [0.25, 0.5, 0.75])
    fences = q.select(F.col(zone).alias("_z"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")).withColumn("iqr", F.col("q3") - F.col("q1"))
    rows = df.join(F.broadcast(fences), F.col(zone).eqNullSafe(F.col("_z")))  # one row for each zone
    far = (value < F.col("q1") - 1.5 * F.col("iqr")) | (value > F.col("q3") + 1.5 * F.col("iqr"))
    invalid = ~value.between(*valid) if valid else F.lit(False)
    out = rows.groupBy(zone).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), *(F.first(c).alias(c) for c in ("median", "q1", "q3", "iqr")), F.sum(F.when(far, 1).otherwise(0)).alias("outlier_count"), F.avg(F.when(value.isNotNull(), F.when(invalid, 1.0).otherwise(0.0))).alias("pct_business_invalid"))
    return out.withColumn("outlier_frac", F.try_divide("outlier_count", "count"))


def signed_profile(df: DataFrame, zone: str, contribution: str) -> DataFrame:
    """Mean contribution of each zone and the shares above and below zero."""
    c = F.col(contribution)
    return df.groupBy(zone).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.avg(F.when(c > 0, 1.0).otherwise(0.0)).alias("share_positive"), F.avg(F.when(c < 0, 1.0).otherwise(0.0)).alias("share_negative"))


def waterfall(terms: DataFrame, key: str, most: int) -> DataFrame:
    """Steps from the baseline to each row's prediction: largest terms first, the rest as "other", with running totals.

    ``terms``: key, term, contribution; the term "baseline" comes first.
    """
    base = F.col("term") == "baseline"
    rank = F.row_number().over(Window.partitionBy(key).orderBy((~base).cast("int"), F.desc(F.abs("contribution")), "term"))
    named = terms.withColumn("_r", rank).withColumn("step", F.when(F.col("_r") <= most + 1, F.col("_r")).otherwise(most + 2))
    steps = named.groupBy(key, "step").agg(F.when(F.col("step") > most + 1, "other").otherwise(F.first("term")).alias("term"), F.sum("contribution").alias("contribution"))
    return steps.withColumn("total", F.sum("contribution").over(Window.partitionBy(key).orderBy("step")))


def percentile_intervals(df: DataFrame, keys: Sequence[str], value: str, alpha: float) -> DataFrame:
    """keys, low, high over replicates."""
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(alpha / 2)).alias("low"), F.percentile(value, F.lit(1 - alpha / 2)).alias("high"))


def inclusion_frequency(df: DataFrame, term: str, replicate: str, replicates: int) -> DataFrame:
    return df.groupBy(term).agg((F.count_distinct(replicate) / F.lit(float(replicates))).alias("frequency"))
