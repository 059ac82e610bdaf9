"""Cells: aggregates of a target by zone, zone pair and zone triple, with shrinkage.

All sums combine before the shuffle and cells are few, so a cell with most
rows costs one row of each task. Order statistics (quantile, trimmed mean) are
exact, but only values near the wanted rank are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALLBACK_M = 10.0


def zone_stats(df: DataFrame, zones: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """For each combination of zones: n (sum of weights), mean and population variance of y."""
    target = F.col(y).cast("double")
    rows = df.where(target.isNotNull())
    if weight is None:
        return rows.groupBy(*zones).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(target).alias("mean"), F.var_pop(target).alias("var"))
    # Squares are taken about the mean of all rows, so that a great mean does not swallow the variance.
    w = F.col(weight).cast("double")
    middle = rows.agg(F.coalesce(F.try_divide(F.sum(w * target), F.sum(w)), F.lit(0.0)).alias("_o"))
    gap = target - F.col("_o")
    sums = rows.crossJoin(F.broadcast(middle)).groupBy(*zones).agg(F.sum(w).alias("n"), F.first("_o").alias("_o"), F.try_divide(F.sum(w * gap), F.sum(w)).alias("_g"), F.try_divide(F.sum(w * gap * gap), F.sum(w)).alias("_gg"))
    spread = F.greatest(F.coalesce(F.col("_gg") - F.col("_g") * F.col("_g"), F.lit(0.0)), F.lit(0.0))
    return sums.select(*zones, "n", (F.col("_o") + F.col("_g")).alias("mean"), spread.alias("var"))


def shrunk(n: Column, value: Column, prior: Column, m: Column | float) -> Column:
    """Empirical Bayes: (n * value + m * prior) / (n + m); the prior where that has no weight."""
    m = F.lit(float(m)) if isinstance(m, (int, float)) else m
    return F.coalesce(F.try_divide(n * F.coalesce(value, F.lit(0.0)) + m * prior, n + m), prior)


def main_effect(df: DataFrame, zone: str, y: str, m: float = FALLBACK_M, weight: str | None = None) -> DataFrame:
    """zone, n, dev: the shrunk deviation of each zone from the overall mean."""
    cells = zone_stats(df, [zone], y, weight)
    overall = cells.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("overall"))
    return cells.crossJoin(F.broadcast(overall)).select(zone, "n", (shrunk(F.col("n"), F.col("mean"), F.col("overall"), m) - F.col("overall")).alias("dev"))


def _sets(df: DataFrame, zones: Sequence[str], y: str, keep: Sequence[Sequence[str]]) -> DataFrame:
    """n and mean for each of several sets of zones in one pass, from the finest cells."""
    fine = df.groupBy(*zones).agg(F.count(y).alias("c"), F.sum(F.col(y).cast("double")).alias("s"))
    return fine.groupingSets([[F.col(z) for z in own] for own in keep], *map(F.col, zones)).agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("mean"), F.grouping_id().alias("gid"))


def _deviations(sets: DataFrame, zones: Sequence[str], own: Sequence[str]) -> DataFrame:
    gid = sum(1 << (len(zones) - 1 - i) for i, z in enumerate(zones) if z not in own)
    return sets.where(F.col("gid") == gid)


def pair_effect(df: DataFrame, a: str, b: str, y: str, m: float = FALLBACK_M) -> DataFrame:
    """a, b, n, dev: each cell shrunk to overall + main(a) + main(b), as the deviation from overall."""
    zones = [a, b]
    sets = _sets(df, zones, y, [[a, b], [a], [b], []])
    overall = _deviations(sets, zones, []).select(F.col("mean").alias("o"))
    mains = [_deviations(sets, zones, [z]).crossJoin(F.broadcast(overall)).select(F.col(z).alias(f"_{z}"), (shrunk(F.col("n"), F.col("mean"), F.col("o"), m) - F.col("o")).alias(f"d_{z}")) for z in zones]
    cells = _deviations(sets, zones, zones).crossJoin(F.broadcast(overall))
    for z, main in zip(zones, mains):
        cells = cells.join(F.broadcast(main), F.col(z).eqNullSafe(F.col(f"_{z}")), "left")  # one row for each zone
    prior = F.col("o") + F.col(f"d_{a}") + F.col(f"d_{b}")
    return cells.select(a, b, "n", (shrunk(F.col("n"), F.col("mean"), prior, m) - F.col("o")).alias("dev"))


def triple_effect(df: DataFrame, zones: Sequence[str], y: str, m: float = FALLBACK_M) -> DataFrame:
    """Three-way cells shrunk to overall + three mains + three pair interactions."""
    a, b, c = zones
    pairs = [(a, b), (a, c), (b, c)]
    sets = _sets(df, zones, y, [list(zones), *map(list, pairs), [a], [b], [c], []])
    overall = _deviations(sets, zones, []).select(F.col("mean").alias("o"))
    mains = {z: _deviations(sets, zones, [z]).crossJoin(F.broadcast(overall)).select(F.col(z).alias(f"_{z}"), (shrunk(F.col("n"), F.col("mean"), F.col("o"), m) - F.col("o")).alias(f"d_{z}")) for z in zones}
    cells = _deviations(sets, zones, zones).crossJoin(F.broadcast(overall))
    prior = F.col("o")
    for z in zones:
        cells = cells.join(F.broadcast(mains[z]), F.col(z).eqNullSafe(F.col(f"_{z}")), "left")
        prior = prior + F.col(f"d_{z}")
    for p, q in pairs:
        own = _deviations(sets, zones, [p, q]).crossJoin(F.broadcast(overall)).select(F.col(p), F.col(q), "n", "mean", "o")
        for z in (p, q):
            own = own.join(F.broadcast(mains[z]), F.col(z).eqNullSafe(F.col(f"_{z}")), "left").drop(f"_{z}")
        base = F.col("o") + F.col(f"d_{p}") + F.col(f"d_{q}")
        own = own.select(F.col(p).alias(f"p_{p}"), F.col(q).alias(f"q_{q}"), (shrunk(F.col("n"), F.col("mean"), base, m) - base).alias(f"d_{p}_{q}"))
        cells = cells.join(F.broadcast(own), F.col(p).eqNullSafe(F.col(f"p_{p}")) & F.col(q).eqNullSafe(F.col(f"q_{q}")), "left").drop(f"p_{p}", f"q_{q}")
        prior = prior + F.col(f"d_{p}_{q}")
    return cells.select(*zones, "n", (shrunk(F.col("n"), F.col("mean"), prior, m) - F.col("o")).alias("dev"))


def learned_m(cells: DataFrame, fallback: float = FALLBACK_M) -> DataFrame:
    """Shrinkage by DerSimonian-Laird from cells (n, mean, var): pooled within variance over between variance."""
    used = cells.where("n > 0")
    s = used.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("var")) / F.sum("n")).alias("v"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q2"))
    q = (F.col("q2") - F.col("n") * F.col("mu") * F.col("mu")) / F.col("v")
    below = (F.col("n") - F.col("nn") / F.col("n")) / F.col("v")
    tau2 = F.greatest(F.lit(0.0), F.try_divide(q - (F.col("k") - 1), below))
    usable = (F.col("k") > 1) & (F.col("v") > 0) & (F.col("n") - F.col("nn") / F.col("n") > 0)
    return s.select(F.when(usable & (tau2 > 0), F.col("v") / tau2).otherwise(F.lit(float(fallback))).alias("m"))


def pair_score(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Two-way interaction sum of squares for each row: how far cells lie from row + column - mean."""
    cells = df.groupBy(a, b).agg(F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    over = lambda *keys: F.sum("s").over(Window.partitionBy(*keys)) / F.sum("n").over(Window.partitionBy(*keys))  # noqa: E731  cells, not rows
    gap = F.col("s") / F.col("n") - (over(a) + over(b) - over(F.lit(0)))
    return cells.select("n", gap.alias("g")).agg((F.sum(F.col("n") * F.col("g") * F.col("g")) / F.sum("n")).alias("score"))


def batched_pair_scores(df: DataFrame, zones: Sequence[str], y: str) -> DataFrame:
    """a, b, score for all pairs of zone columns in one pass over the rows."""
    pairs = [(p, q) for i, p in enumerate(zones) for q in zones[i + 1 :]]
    packed = F.array(*(F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(p).alias("za"), F.col(q).alias("zb")) for p, q in pairs))
    cells = df.select(F.explode(packed).alias("k"), F.col(y).cast("double").alias("y")).groupBy("k.a", "k.b", "k.za", "k.zb").agg(F.count("y").alias("n"), F.sum("y").alias("s"))
    over = lambda *keys: F.sum("s").over(Window.partitionBy("a", "b", *keys)) / F.sum("n").over(Window.partitionBy("a", "b", *keys))
    gap = F.col("s") / F.col("n") - (over("za") + over("zb") - over())
    return cells.select("a", "b", "n", gap.alias("g")).groupBy("a", "b").agg((F.sum(F.col("n") * F.col("g") * F.col("g")) / F.sum("n")).alias("score"))


#: Accuracy of the quantile sketch that brackets an order statistic, and half a bracket's width in units of its error.
SKETCH, BRACKET = 10_000, 5
#: Groups up to which the brackets are gathered and broadcast.
MAX_BRACKETS = 20_000


def ranked(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """groups, _v, _c, _s, _end, _n: exact ranks of the values around each share of each group; what lies between is one row without _v.

    A sketch gives for each share a bracket that holds it for certain (its
    error is 1 / ``SKETCH`` of the rows at most, a bracket reaches ``BRACKET``
    times as far). Only values inside brackets are ordered one by one, one row
    for each distinct value; groups of ``SKETCH`` rows at most are ordered
    whole. _c and _s are count and sum, _end the rank of the last of them.
    """
    rows = df.select(*groups, F.col(value).cast("double").alias("_x"))
    reach = BRACKET / SKETCH
    probes = [min(max(s + d, 0.0), 1.0) for s in sorted(shares) for d in (-reach, reach)]
    own = [f"_k{i}" for i in range(len(groups))]
    state = rows.groupBy(*(F.col(g).alias(k) for g, k in zip(groups, own))).agg(F.count("_x").alias("_n"), F.percentile_approx("_x", probes, SKETCH).alias("_q"))
    known = state.limit(MAX_BRACKETS + 1).collect()
    if len(known) <= MAX_BRACKETS:
        state = F.broadcast(df.sparkSession.createDataFrame(known, state.schema))
    same = F.lit(True)
    for g, k in zip(groups, own):
        same = same & F.col(g).eqNullSafe(F.col(k))
    found = rows.join(state, same) if groups else rows.crossJoin(state)
    x = F.col("_x")
    inside, run = F.col("_n") <= SKETCH, F.lit(0)
    for i in range(len(shares)):
        low, high = F.get("_q", F.lit(2 * i)), F.get("_q", F.lit(2 * i + 1))
        inside, run = inside | x.between(low, high), run + F.when(x > high, 1).otherwise(0)
    keys = [F.when(inside, x).alias("_v"), F.when(~F.coalesce(inside, F.lit(False)), run).alias("_run")]
    by = list(groups) or [F.lit(0)]
    counted = found.groupBy(*groups, *keys).agg(F.count("_x").alias("_c"), F.sum("_x").alias("_s"), F.min("_x").alias("_at"), F.max("_n").alias("_n"))
    order = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.select(*groups, "_v", "_c", "_s", F.sum("_c").over(order).alias("_end"), "_n")


def percentiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """groups, q: the exact interpolated quantiles of the values in each group, in an array; null where a group has none."""
    places = []
    for share in shares:
        at = (F.col("_n") - 1) * F.lit(float(share))
        part = at - F.floor(at)
        holds = lambda rank: (F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end"))
        below = F.sum(F.when(holds(F.floor(at)), F.col("_v") * (1 - part)))
        places.append(below + F.coalesce(F.sum(F.when((part > 0) & holds(F.ceil(at)), F.col("_v") * part)), F.lit(0.0)))
    return ranked(df, groups, value, shares).groupBy(*groups).agg(F.array(*places).alias("q"))


def zone_quantile(df: DataFrame, zone: str, y: str, q: float) -> DataFrame:
    """Exact interpolated quantile of y in each zone."""
    return percentiles(df, [zone], y, [q]).select(zone, F.get("q", F.lit(0)).alias("value"))


def zone_trimmed_mean(df: DataFrame, zone: str, y: str, trim: float) -> DataFrame:
    """Mean without the floor(trim * n) least and greatest values of each zone; without values there is no zone."""
    placed = ranked(df.where(F.col(y).isNotNull()), [zone], y, [trim, 1.0 - trim])
    k = F.floor(F.col("_n") * trim)
    k = F.when(2 * k >= F.col("_n"), F.lit(0)).otherwise(k)
    kept = F.greatest(F.lit(0), F.least(F.col("_end"), F.col("_n") - k) - F.greatest(F.col("_end") - F.col("_c"), k))
    # A run between brackets is kept or left out as a whole.
    return placed.withColumn("_kept", kept).groupBy(zone).agg((F.sum(F.col("_kept") * F.col("_s") / F.col("_c")) / F.sum("_kept")).alias("value"))


def out_of_fold(df: DataFrame, zone: str, y: str, fold: str, m: float = FALLBACK_M) -> DataFrame:
    """zone, fold, dev: the main effect from all rows of other folds, by subtracting each fold from the total."""
    cells = df.groupBy(zone, fold).agg(F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    by = lambda *keys: Window.partitionBy(*keys)  # noqa: E731  cells, not rows
    rest_n = F.sum("n").over(by(zone)) - F.col("n")
    rest_s = F.sum("s").over(by(zone)) - F.col("s")
    all_n = F.sum("n").over(by(F.lit(0))) - F.sum("n").over(by(fold))
    all_s = F.sum("s").over(by(F.lit(0))) - F.sum("s").over(by(fold))
    overall = all_s / all_n
    return cells.select(zone, fold, (shrunk(rest_n, F.try_divide(rest_s, rest_n), overall, m) - overall).alias("dev"))


def spline_moments(df: DataFrame, x: str, y: str, knots: Sequence[float]) -> DataFrame:
    """Sums of the normal equations of a hinge basis: term i, term j, xx; j = -1 holds the products with y."""
    from ..functions.scalar import hinge

    basis = [F.lit(1.0), F.col(x).cast("double"), *(hinge(F.col(x).cast("double"), k) for k in knots)]
    wanted = [(i, j, basis[i] * basis[j]) for i in range(len(basis)) for j in range(i, len(basis))]
    wanted += [(i, -1, basis[i] * F.col(y).cast("double")) for i in range(len(basis))]
    sums = df.where(F.col(x).isNotNull()).agg(*(F.avg(e).alias(f"v{n}") for n, (_, _, e) in enumerate(wanted)))
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{n}").alias("mean")) for n, (i, j, _) in enumerate(wanted)))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def boundary_lambda(df: DataFrame, y: str, hard: Column, soft: Column, m: float, moved: Column) -> DataFrame:
    """0, 1 or between: how far the soft lookup beats the hard one out of fold, shrunk to 1 by ``m`` against the rows it moves."""
    target = F.col(y).cast("double")
    sums = df.agg(F.sum((target - hard) ** 2).alias("h"), F.sum((target - soft) ** 2).alias("s"), F.sum(F.when(moved, 1.0).otherwise(0.0)).alias("n"))
    raw = F.when(F.col("s") <= F.col("h"), 1.0).otherwise(0.0)
    return sums.select(((F.col("n") * raw + m) / (F.col("n") + m)).alias("lam"))


def fit_spline(df: DataFrame, x: str, y: str, knots: Sequence[float], m: float = 1.0) -> tuple[float, float, list[float]]:
    """Intercept, slope and one bend for each knot by ridge on the hinge basis; each term's penalty is m times its own mean square, the intercept has none.

    Rows give their moments in one aggregate; the driver solves a system of knots + 2.
    """
    import numpy as np

    size = len(knots) + 2
    gram, right = np.zeros((size, size)), np.zeros(size)
    for r in spline_moments(df, x, y, knots).collect():  # (knots + 2)^2 numbers at most
        if r["j"] < 0:
            right[r["i"]] = r["mean"] or 0.0
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["mean"] or 0.0
    rows = max(df.where(F.col(x).isNotNull()).count(), 1)
    ridge = np.diag(np.r_[0.0, m / rows * np.diag(gram)[1:]])
    solved = np.linalg.pinv(gram + ridge) @ right
    return float(solved[0]), float(solved[1]), [float(v) for v in solved[2:]]
