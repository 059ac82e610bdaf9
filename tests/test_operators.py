"""Hand-computed values and invariants of the engine's operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.functions import losses, scalar
from terrazzo.operators import cells, diagnostics, survival, transformers, zones
from terrazzo.sources import frames


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_zone_index_is_closed_on_the_left(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 2.0, 3.0, 6.0, 9.0, None])], "i int, x double").orderBy("i")
    assert values(df.select(scalar.zone_index(F.col("x"), [2.0, 5.0, 8.0]).alias("z")), "z") == [0, 1, 1, 2, 3, 4]


def test_long_lists_of_cuts_agree_with_short_ones(spark):
    cuts = [i * 0.7 for i in range(60)]
    df = spark.range(500).select((F.col("id") * 0.1 - 3).alias("x"))
    got = values(df.select("x", scalar.zone_index(F.col("x"), cuts).alias("z")), "x", "z")
    assert all(z == int(np.searchsorted(cuts, x, side="right")) for x, z in got)


def test_nan_is_missing(spark):
    df = frames.normalized(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert sorted(values(df.select(scalar.zone_index(F.col("x"), [2.0]).alias("z")), "z")) == [0, 2]


def test_category_index(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "unseen"), (3, "b")], "i int, c string").orderBy("i")
    assert values(df.select(scalar.category_index(F.col("c"), ["a", "b"]).alias("z")), "z") == [0, 2, 3, 1]


def test_zone_centers_and_empty_zones(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 3.0, 10.0, 11.0, 12.0, None]], "x double")
    assert zones.zone_centers(df, "x", [5.0]) == [2.0, 11.0]
    assert zones.zone_centers(df, "x", [5.0, 7.0]) == [2.0, 6.0, 11.0]
    assert zones.zone_centers(df.limit(0), "x", []) == [0.0]


def test_shrunk_means(spark):
    rows = [(0, 10.0)] * 5 + [(1, 4.0)]
    stats = cells.zone_stats(spark.createDataFrame(rows, "z int, y double"), ["z"], "y")
    got = dict(values(stats.select("z", cells.shrunk(F.col("n"), F.col("mean"), F.lit(0.0), 5.0).alias("v")), "z", "v"))
    assert got == {0: 5.0, 1: pytest.approx(4 / 6)}
    assert values(spark.range(1).select(cells.shrunk(F.lit(0.0), F.lit(None).cast("double"), F.lit(3.0), 0.0).alias("v")), "v") == [3.0]


def test_singletons_get_nothing_out_of_fold(spark):
    df = spark.range(60).select(F.col("id").alias("z"), (F.col("id") * 1.5).alias("y"), (F.col("id") % 5).alias("f"))
    assert {round(v, 9) for v in values(cells.out_of_fold(df, "z", "y", "f"), "dev")} == {0.0}


def test_weights_equal_repetition(spark):
    rows = [(0, 1.0, 2), (0, 2.0, 1), (0, 3.0, 3), (1, 5.0, 1), (1, 7.0, 2)]
    df = spark.createDataFrame(rows, "z int, y double, w int")
    repeated = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w"))))
    a, b = (sorted(values(cells.zone_stats(d, ["z"], "y", w), "z", "n", "mean", "var")) for d, w in ((df, "w"), (repeated, None)))
    assert np.allclose(a, b)


def test_greedy_cuts_find_steps_and_prefer_reversals(spark):
    df = spark.range(2000).select((F.col("id") / 100.0).alias("x")).withColumn("y", F.when(F.col("x") < 5, 0.0).when(F.col("x") < 12, 3.0).otherwise(1.0))
    assert zones.adaptive_cuts(df, "x", "y", max_zones=3) == pytest.approx([5.0, 12.0], abs=0.03)
    peak = df.withColumn("y", -F.abs(F.col("x") - 8))
    assert abs(zones.adaptive_cuts(peak, "x", "y", max_zones=2, criterion="correlation")[0] - 8) < 4
    assert zones.adaptive_cuts(df.withColumn("y", F.lit(1.0)), "x", "y") == []
    assert zones.adaptive_cuts(df.limit(0), "x", "y") == []


def test_dersimonian_laird_falls_back():
    assert transformers.dersimonian_laird([5], [1.0], [1.0]) == 10.0
    assert transformers.dersimonian_laird([5, 5], [1.0, 2.0], [0.0, 0.0]) == 10.0
    assert transformers.dersimonian_laird([0, 0], [1.0, 2.0], [1.0, 1.0]) == 10.0
    assert transformers.dersimonian_laird([100, 100, 100], [0.0, 50.0, -50.0], [1.0, 1.0, 1.0]) < 1


def test_trimmed_mean_of_small_zones(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 7.0)], "z string, y double")
    assert dict(values(cells.zone_trimmed_mean(df, "z", "y", 0.2), "z", "value")) == {"a": 3.0, "b": 7.0}


def test_person_periods(spark):
    df = spark.createDataFrame([(0, 5.0, 1), (1, 2.0, 1), (2, 12.0, 0)], "id int, d double, e int")
    rows = survival.person_period(df, "d", "e", [0.0, 3.0, 6.0, math.inf]).orderBy("id", "interval")
    assert values(rows, "exposure", "y", "interval_start") == [(3, 0, 0), (2, 1, 3), (2, 1, 0), (3, 0, 0), (3, 0, 3), (6, 0, 6)]
    tail = survival.person_period(spark.createDataFrame([(100.0, 1)], "d double, e int"), "d", "e", [0.0, 1.0, 2.0, math.inf]).orderBy("interval")
    assert values(tail, "exposure") == [1, 1, 98]


def test_breakpoints_and_concordance(spark):
    df = spark.createDataFrame([(float(i + 1), 1, 4.0 - i) for i in range(4)], "d double, e int, r double")
    assert survival.breakpoints(df, "d", "e", 1) == [0.0, math.inf]
    assert survival.concordance(df, "d", "e", "r").first()[0] == 1.0
    assert survival.concordance(df.withColumn("r", F.lit(1.0)), "d", "e", "r").first()[0] == 0.5
    assert survival.concordance(df.limit(0), "d", "e", "r").first()[0] is None


def test_concordance_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(float(d), int(e), float(x)) for d, e, x in zip(rng.integers(1, 60, 500), rng.random(500) < 0.6, rng.normal(size=500).round(1))]
    rows += [(30.0, 1, float(x)) for x in rng.normal(size=300)] + [(float(d), 1, 0.5) for d in rng.random(300) * 60]  # a time and a risk with many rows
    d, e, x = (np.array(c) for c in zip(*rows))
    counts = (e[:, None] == 1) & ((d[None] > d[:, None]) | ((d[None] == d[:, None]) & (e[None] == 1))) & ~np.eye(len(d), dtype=bool)
    won = np.where(x[:, None] > x[None], 1.0, np.where(x[:, None] == x[None], 0.5, 0.0))
    df = spark.createDataFrame([*rows, (None, 1, 0.1), (3.0, 1, None)], "d double, e int, r double").repartition(4)
    for blocks in (2, 8, 256):
        assert survival.concordance(df, "d", "e", "r", blocks).first()[0] == pytest.approx((won * counts).sum() / counts.sum(), abs=1e-12)
    assert survival.concordance(df.where("e = 0"), "d", "e", "r").first()[0] is None


def brute_history(events, at, h):
    own = [(t, v) for t, v in events if t <= at]
    return sum((v or 0.0) * 0.5 ** ((at - t) / h) for t, v in own), sum(0.5 ** ((at - t) / h) for t, v in own)


def test_decayed_history_is_that_of_brute_force(spark):
    rng, start = np.random.default_rng(0), dt.datetime(2024, 1, 1)
    events = [(int(rng.integers(0, 4)), start + dt.timedelta(days=float(rng.uniform(0, 90))), None if rng.random() < 0.1 else float(rng.normal())) for _ in range(300)]
    events += [(1, start + dt.timedelta(days=5), 1000.0)] * 2
    asked = [(c, start + dt.timedelta(days=float(d))) for c in (0, 1, 2, 3, 99, None) for d in (-1, 0, 5, 17.3, 60, 400)]
    history = transformers.DecayedHistory("c", "t", ["v"], [30, 0.5], "h").fit(spark.createDataFrame(events, "c int, t timestamp, v double"))
    out = history.transform(spark.createDataFrame(asked, "c int, at timestamp"), "at").collect()
    assert len(out) == len(asked)
    day = lambda t: (t - start).total_seconds() / 86400
    for r in out:
        own = [(day(t), v) for c, t, v in events if c == r["c"] and c is not None]
        for h, tag in ((30, "30"), (0.5, "0.5")):
            total, count = brute_history(own, day(r["at"]), h)
            assert r[f"h__v__laplace_{tag}d"] == pytest.approx(total, abs=1e-9) and r[f"h__event_decay_count_{tag}d"] == pytest.approx(count, abs=1e-9)
        assert r["h__had_history"] == int(any(t <= day(r["at"]) for t, _ in own))
    with pytest.raises(ValueError):
        transformers.DecayedHistory("c", "t", ["v"], [])


def test_categorical_depth_counts_missing_as_a_level(spark):
    df = spark.createDataFrame([("A",)] * 4 + [("B",), ("C",), (None,)], "t string")
    fitted = transformers.CategoricalDepth("g", ["t"]).fit(df)
    out = dict(values(fitted.transform(spark.createDataFrame([("A",), (None,), ("Z",)], "t string")), "t", "g__count"))
    assert out == {"A": 4, None: 1, "Z": 0}


def test_depth_is_mahalanobis(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) @ np.array([[1, 0.5], [0, 2]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    out = transformers.Depth("g", ["a", "b"], ridge=0.0).fit(df).transform(df).collect()
    gap = x - x.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", gap, np.linalg.pinv(np.cov(x.T, bias=True)), gap))
    assert np.allclose([r["g__depth_distance"] for r in out], want)


def test_crowd_ties_go_to_the_first_expert(spark):
    df = spark.createDataFrame([([0.5, 0.01, 0.01],)], "r array<double>")
    r = transformers.crowd_columns(df, "r", ["x", "y", "z"], 0.05).first()
    assert (r["crowd__most_atypical_expert"], r["crowd__vote_count"], r["crowd__median"]) == ("y", 2, 0.01)


def test_crowd_ranks_are_exact_and_the_driver_holds_few_numbers(spark, monkeypatch):
    """Ranks as numpy counts them, with more values than blocks, one score in half the rows, missing scores (last), large keys and unseen rows."""
    rng = np.random.default_rng(11)
    n, big = 6000, 2**60
    a = np.where(rng.random(n) < 0.5, 0.25, rng.normal(size=n))
    a[:3], a[3:200] = (np.inf, -np.inf, -0.0), np.nan
    k = rng.permutation(n)
    b = rng.integers(0, 3, n)
    rows = [(int(i), None if np.isnan(u) else float(u), big + int(j), int(v)) for i, (u, j, v) in enumerate(zip(a, k, b))]
    df = spark.createDataFrame(rows, "id int, a double, k bigint, b int").repartition(5)
    up_to = lambda known, x: np.searchsorted(np.sort(known), x, side="right") / len(known)
    crowd = transformers.DepthCrowd(["a", "k", "b"], 0.2).fit(df)
    assert all(len(e) < 256 for e in crowd.edges) and all(len(e) <= 256 for e in crowd.before)
    unseen = [(0, 0.1, big - 5, -1), (1, 1e9, big + n + 5, 9), (2, None, None, None)]
    for most in (transformers.MAX_BROADCAST_ROWS, 3, 0):
        monkeypatch.setattr(transformers, "MAX_BROADCAST_ROWS", most)
        out = crowd.transform(df).orderBy("id").collect()
        want = np.stack([up_to(a, a), up_to(k, k), up_to(b, b)])
        assert [r["id"] for r in out] == list(range(n)) and [r["k"] for r in out] == [r[2] for r in rows]
        for name, value in (("mean", want.mean(axis=0)), ("median", np.median(want, axis=0)), ("std", want.std(axis=0)), ("min", want.min(axis=0)), ("vote_count", (want <= 0.2).sum(axis=0))):
            assert np.allclose([r[f"crowd__{name}"] for r in out], value, rtol=0, atol=1e-12), (most, name)
        new = crowd.transform(spark.createDataFrame(unseen, df.schema)).orderBy("id").collect()
        want = np.stack([up_to(a, np.array([0.1, 1e9, np.nan])), [0.0, 1.0, 1.0], [0.0, 1.0, 1.0]])
        assert np.allclose([[r["crowd__mean"], r["crowd__min"]] for r in new], np.stack([want.mean(axis=0), want.min(axis=0)], axis=1), rtol=0, atol=1e-12)
        assert [r["crowd__most_atypical_expert"] for r in new] == ["k", "a", "a"]


def test_order_statistic(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 4, 5, 6, 7, 8, 9)], "s double")
    assert diagnostics.order_statistic(df, "s", 0.1).first()["margin"] == 9.0
    assert diagnostics.order_statistic(df, "s", 0.5).first()["margin"] == 5.0


def test_purify_moves_margins_and_keeps_sums(spark):
    rows = [(a, b, float(1 + a + b), float(a * b + 2 * a - b)) for a in range(3) for b in range(4)]
    cells_, own_a, own_b = diagnostics.purify(spark.createDataFrame(rows, "a int, b int, n double, value double"), "a", "b")
    left, ga, gb = {(r["a"], r["b"]): r["value"] for r in cells_.collect()}, dict(values(own_a, "a", "gain")), dict(values(own_b, "b", "gain"))
    assert all(left[a, b] + ga[a] + gb[b] == pytest.approx(v) for a, b, _, v in rows)
    assert all(abs(sum(n * left[a, b] for a, b, n, _ in rows if a == k)) < 1e-6 for k in range(3))


def test_losses(spark):
    r = spark.range(1).select(losses.poisson_deviance(F.lit(0.0), F.lit(2.0)).alias("p"), losses.pinball(F.lit(3.0), F.lit(1.0), 0.9).alias("q"), losses.log_loss(F.lit(1.0), F.lit(0.0)).alias("l")).first()
    assert r["p"] == 4.0 and r["q"] == pytest.approx(1.8) and r["l"] == pytest.approx(-math.log(1e-15))


def test_samples_do_not_depend_on_partitions(spark):
    df = frames.row_id(spark.range(2000).select("id"))
    parts = frames.split(df, {"val": 0.2, "cal": 0.1})
    assert sum(p.count() for p in parts.values()) == 2000
    a, b = (sorted(values(frames.subsample(d, 0.3), "id")) for d in (df.repartition(3), df.repartition(7)))
    assert a == b and 500 < len(a) < 700
    assert abs(frames.bootstrap(df, 3).count() / 6000 - 1) < 0.1
    with pytest.raises(ValueError):
        frames.split(df, {"val": 0.6, "cal": 0.4})


def test_splines_find_a_kink(spark):
    df = spark.range(2000).select(((F.col("id") - 1000) / 100.0).alias("x")).withColumn("y", F.when(F.col("x") < 0, -2 * F.col("x")).otherwise(3 * F.col("x")))
    intercept, slope, bends = cells.fit_spline(df, "x", "y", [0.0])
    assert (intercept, slope, bends[0]) == pytest.approx((0.0, -2.0, 5.0), abs=0.1)


def test_order_statistics_are_exact_beyond_the_sketch(spark, monkeypatch):
    monkeypatch.setattr(cells, "SKETCH", 200)
    rng = np.random.default_rng(5)
    data = {"hot": rng.normal(size=20_000), "tied": np.floor(rng.exponential(size=3_000) * 4), "few": rng.normal(size=7), "one": np.array([2.5])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("hot", None), ("empty", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    data[None] = np.array([4.0])
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = dict(values(cells.percentiles(df, ["g"], "v", shares), "g", "q"))
    assert got.pop("empty") == [None] * 5 and set(got) == set(data)
    for g, vs in data.items():
        assert got[g] == pytest.approx(np.quantile(vs, shares).tolist(), abs=1e-12), g
    whole = np.concatenate(list(data.values()))
    assert values(cells.percentiles(df, [], "v", shares), "q")[0] == pytest.approx(np.quantile(whole, shares).tolist(), abs=1e-12)
    assert values(cells.percentiles(df.limit(0), [], "v", [0.5]), "q") == [[None]]
    for alpha in (0.0, 0.1, 0.999):
        for r in diagnostics.order_statistic(df, "v", alpha, ["g"]).collect():
            vs = np.sort(data[r["g"]])
            k = min(int(np.ceil((len(vs) + 1) * (1 - alpha) - 1e-9)), len(vs))
            assert (r["n"], r["margin"]) == (len(vs), vs[k - 1]), (alpha, r["g"])
    for trim in (0.0, 0.3):
        for g, v in values(cells.zone_trimmed_mean(df, "g", "v", trim), "g", "value"):
            vs = np.sort(data[g])
            k = int(np.floor(len(vs) * trim))
            assert v == pytest.approx(vs[k : len(vs) - k].mean()), (trim, g)
    # Only values near the ranks are ordered.
    assert cells.ranked(df, ["g"], "v", [0.5]).where("g = 'hot'").count() < 20_000 * 0.06


def test_variance_of_cells_with_a_great_mean(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("z"), (F.lit(1e9) + (F.col("id") % 4)).alias("y"), F.lit(2.0).alias("w"))
    for weight in (None, "w"):
        assert {round(v, 6) for v in values(cells.zone_stats(df, ["z"], "y", weight), "var")} == {1.0}
    assert cells.zone_stats(df.limit(0), ["z"], "y", "w").count() == 0


def test_segments_have_their_own_cuts(spark):
    """Each segment's cuts, counts and means are those of a grid fitted on its rows alone."""
    rng = np.random.default_rng(9)
    rows = []
    for s, step, n in (("p", 0.3, 3000), ("q", 0.8, 1500), (None, 0.5, 400), ("light", 0.5, 20)):
        a, b = rng.random(n), rng.integers(0, 4, n) / 4
        rows += [(s, float(u) if i % 11 else None, float(v), float((u > step) * 5 + v)) for i, (u, v) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "s string, a double, b double, y double").repartition(6)
    cuts = dict(values(zones.segment_cuts(df, "s", "a", "y", max_zones=2), "segment", "cuts"))
    assert cuts["light"] == [] and cuts["p"][0] == pytest.approx(0.3, abs=0.01) and cuts["q"][0] == pytest.approx(0.8, abs=0.01) and cuts[None][0] == pytest.approx(0.5, abs=0.02)
    grid = transformers.ConditionalGrid("a", "b", "y", ["s"], max_zones=3).fit(df)
    out = grid.transform(df.withColumn("extra", F.lit(1))).cache()
    assert out.count() == len(rows) and out.columns[:5] == ["s", "a", "b", "y", "extra"]
    for s in ("p", "q", None):
        own = df.where(F.col("s").eqNullSafe(F.lit(s)))
        alone = transformers.ConditionalGrid("a", "b", "y", "s", max_zones=3, least=1e9).fit(own).transform(own)
        names = ("a", "b", "a_b__cell_mean", "a_b__cell_count", "a_b__cell_var")
        key = lambda r: tuple((x is None, x or 0.0) for x in r)
        got, want = (sorted(values(d.where(F.col("s").eqNullSafe(F.lit(s))), *names), key=key) for d in (out, alone))
        assert np.allclose(np.array(got, dtype=float), np.array(want, dtype=float), equal_nan=True), s
        assert set(values(out.where(F.col("s").eqNullSafe(F.lit(s))), "a_b__used_segment_grid")) == {True}
    assert set(values(out.where("s = 'light'"), "a_b__used_segment_grid")) == {False}
    pooled = transformers.ConditionalGrid("a", "b", "y", "s", max_zones=3, least=1e9).fit(df).transform(df.where("s = 'light'"))
    assert np.allclose(*(sorted(values(d, "y", "a_b__cell_mean")) for d in (pooled, out.where("s = 'light'"))))
    with pytest.raises(ValueError):
        transformers.ConditionalGrid("a", "a", "y", "s")
