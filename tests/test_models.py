"""Models: exact explanations, equal back ends, SQL form, constraints, coverage."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrazzo.functions import scalar
from terrazzo.plans import boost
from terrazzo.plans.estimators import BootstrapStability, ConformalQuantiles, ZoneClassifier, ZoneForest, ZoneRegressor, ZoneSurvival, ZoneTimeSeries, compare_models
from terrazzo.plans.model import Model, Spline
from terrazzo.sources import frames

FAST = {"learning_rate": 0.5, "row_share": 1.0, "column_share": 1.0}


def data(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    a, b, c = rng.uniform(-3, 3, n), rng.uniform(-3, 3, n), rng.choice(list("abc"), n)
    y = a * b + 5 * (c == "b") + rng.normal(0, 0.3, n)
    a[::19] = np.nan
    return pd.DataFrame({"a": a, "b": b, "c": c, "y": y, "row_id": np.arange(n)})


@pytest.fixture(scope="module")
def table(spark):
    return frames.normalized(spark.createDataFrame(data())).cache()


@pytest.fixture(scope="module")
def fitted(table):
    return ZoneRegressor(["a", "b", "c"], "y", rounds=4, validation=0.0, **FAST).fit(table)


def test_explanations_sum_to_predictions(table, fitted):
    out = fitted.explain(fitted.predict(table), ["row_id", "y", "prediction"]).toPandas()
    terms = ["baseline", *(scalar.term_name(*t) for t in fitted.model.terms())]
    assert np.abs(out[terms].sum(axis=1) - out["prediction"]).max() < 1e-9
    assert ((out["prediction"] - out["y"]) ** 2).mean() < 0.3 * out["y"].var()


def test_columns_arrays_and_sql_agree(table, fitted):
    kernel = {r["row_id"]: r["prediction"] for r in fitted.predict(table).collect()}
    columns = {r["row_id"]: r["p"] for r in table.select("row_id", fitted.score().alias("p")).collect()}
    frame = data()
    arrays = dict(zip(frame["row_id"], fitted.model.score({c: frame[c].to_numpy() for c in "abc"})))
    connection = duckdb.connect()
    connection.register("t", frame.astype({"a": object}).assign(a=[None if x != x else x for x in frame["a"]]).astype({"a": "Float64"}))
    sql = dict(connection.execute(fitted.to_sql("t", ["row_id"])).fetchall())
    for i in kernel:
        assert columns[i] == pytest.approx(kernel[i], abs=1e-9) and arrays[i] == pytest.approx(kernel[i], abs=1e-9) and sql[i] == pytest.approx(kernel[i], abs=1e-9)


def test_models_survive_json(fitted):
    again = Model.from_json(fitted.model.to_json())
    frame = data(50)
    assert np.array_equal(again.score({c: frame[c].to_numpy() for c in "abc"}), fitted.model.score({c: frame[c].to_numpy() for c in "abc"}))


EVERY = [
    {}, {"order": 3, "learn_m": True, "smooth": True}, {"splines": ("a", "b"), "max_pairs": 1}, {"trim": 0.1}, {"loss": "quantile", "quantile": 0.8},
    {"monotone": {"b": 1}, "convex": {"a": -1}, "bounded": {"b": (-1.0, 1.0)}, "strict": True}, {"row_share": 0.6, "column_share": 0.7, "group": "c", "max_pairs": 1},
]


@pytest.mark.parametrize("options", EVERY)
def test_back_ends_fit_the_same_model(table, options):
    """Partitions of a cluster and one batch in memory: the same cuts and predictions; explanations sum to them."""
    found = []
    for local in (0, None):
        model = ZoneRegressor(["a", "b", "c"], "y", rounds=2, validation=0.2, local=local, **{**FAST, **options}).fit(table)
        wide = model.explain(model.predict(table), ["row_id", "prediction"]).toPandas().sort_values("row_id")
        terms = [c for c in wide.columns if c not in ("row_id", "prediction")]
        assert np.abs(wide[terms].sum(axis=1) - wide["prediction"]).max() < 1e-9
        found.append(wide["prediction"].to_numpy())
    tolerance = 0.05 if model.settings.ordered else 1e-8  # levels of partitions are merged
    assert np.abs(found[0] - found[1]).mean() < tolerance * max(1.0, found[1].std())


def fitted_locally(y, frame=None, weight=None, **options):
    frame = data(3000) if frame is None else frame
    frame = {c: frame[c].to_numpy() for c in "abc"}
    schema = frames.Schema(("a", "b"), ("c",))
    model = boost.local_model(frame, schema, np.asarray(y, float), boost.Settings(**{**FAST, "rounds": 5, **options}), weight=weight)
    return model, model.score(frame)


@pytest.mark.parametrize("loss", ["squared_error", "quantile"])
def test_predictions_scale_with_the_target(loss):
    frame = data(3000)
    rng = np.random.default_rng(1)
    y = 2 * frame["b"] + 5 * (frame["c"] == "b") + rng.normal(0, 1, 3000)
    options = {"loss": loss, "quantile": 0.9, "rounds": 40, "learning_rate": 0.1}
    base = fitted_locally(y, frame, **options)[1]
    assert loss == "squared_error" or abs((y <= base).mean() - 0.9) < 0.02
    for c in (0.01, 1e3, 5e4):
        other = fitted_locally(c * y, frame, **options)[1] / c
        assert np.abs(other - base).max() < (1e-6 if loss == "squared_error" else 0.25 * y.std())
        assert loss == "squared_error" or abs((y <= other).mean() - 0.9) < 0.02


def test_weights_count_rows():
    frame = data(1200)
    doubled = pd.concat([frame, frame[frame["b"] > 0]], ignore_index=True)
    weight = np.where(frame["b"] > 0, 2.0, 1.0)
    options = {"alpha": 0.0, "order": 1, "min_zone_share": 0.05}
    weighted, plain = fitted_locally(frame["y"], frame, weight, **options)[0], fitted_locally(doubled["y"], doubled, **options)[0]
    assert weighted.baseline == pytest.approx(plain.baseline)
    one, two = weighted.rounds[0], plain.rounds[0]
    assert one.zonings["c"] == two.zonings["c"] and one.tables[("c",)] == pytest.approx(two.tables[("c",)])
    for bad in ({"weight": "row_id", "trim": 0.1}, {"weight": "row_id", "loss": "quantile"}):
        with pytest.raises(ValueError):
            boost.checked(boost.Settings(**{k: v for k, v in bad.items() if k != "weight"}), frames.Schema(("a",), ()), "row_id")


def test_triples_splines_trims_and_smoothing():
    frame = data(4000, 3)
    product = (frame["a"].fillna(0) > 0) * (frame["b"] > 0) * (frame["c"] == "a") * 8.0 + np.random.default_rng(0).normal(0, 0.2, 4000)
    pairs, three = fitted_locally(product, frame), fitted_locally(product, frame, order=3)
    assert any(len(t) == 3 for t in three[0].terms()) and ((three[1] - product) ** 2).mean() < ((pairs[1] - product) ** 2).mean()
    line = 3 * frame["b"] + np.random.default_rng(1).normal(0, 0.1, 4000)
    bent = fitted_locally(line, frame, splines=("b",), order=1)
    assert isinstance(bent[0].rounds[0].tables[("b",)], Spline) and ((bent[1] - line) ** 2).mean() < 0.05
    outliers = np.where(np.arange(4000) % 50 == 0, 1e4, line)
    tables = [fitted_locally(outliers, frame, trim=trim, order=1, rounds=1, min_zone_share=0.1)[0].rounds[0].tables[("c",)] for trim in (0.0, 0.05)]
    assert np.abs(tables[1]).max() < 2 < 10 < np.abs(tables[0]).max()
    step = 5.0 * (frame["b"] > 0.37) + np.random.default_rng(2).normal(0, 0.1, 4000)
    assert all(r.zonings["b"].lam < 0.1 for r in fitted_locally(step, frame, smooth=True, order=1, max_zones=2, rounds=1)[0].rounds)
    again = Model.from_json(three[0].to_json())
    assert np.allclose(again.score({c: frame[c].to_numpy() for c in "abc"}), three[1])
    with pytest.raises(ValueError):
        three[0].to_sql("t")


def test_shapes_hold_in_every_round():
    frame = data(3000)
    model, _ = fitted_locally(frame["y"], frame, monotone={"b": -1}, convex={"a": 1}, bounded={"b": (-0.5, 0.5)}, strict=True)
    for r in model.rounds:
        b, a = r.tables[("b",)][: r.zonings["b"].real], r.tables[("a",)][: r.zonings["a"].real]
        assert (np.diff(b) <= 1e-12).all() and np.abs(b).max() <= 0.5
        slopes = np.diff(a) / np.diff(r.zonings["a"].centers)
        assert (np.diff(slopes) >= -1e-9).all()
        assert all(w >= 0 for t, w in r.weights.items() if {"a", "b"} & {*t})
    bent = boost._spline_shape(np.array([0.0, -1.0, 3.0, -1.0]), [0.0, 1.0], np.ones(4), "x", boost.Settings(monotone={"x": 1}))
    assert (np.cumsum(bent[1:]) >= 0).all()


def test_order_statistics_from_bins():
    rng = np.random.default_rng(0)
    r = rng.normal(size=20_000)
    edges = np.quantile(r, np.linspace(0, 1, 513))
    counts = np.histogram(r, edges)[0].astype(float)
    for q in (0.05, 0.5, 0.9):
        assert boost.bin_quantile(counts, edges, q) == pytest.approx(np.quantile(r, q), abs=0.02)
    kept = np.sort(r)[2000:-2000].mean()
    assert boost.bin_trimmed(counts, edges, 0.1) == pytest.approx(kept, abs=0.01)
    assert boost.bin_quantile(np.zeros(512), edges, 0.5) == 0


def test_lasso_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = 2 * x[:, 0] - x[:, 2] + 1
    z = np.c_[np.ones(500), x, y]
    intercept, w = boost.lasso(z.T @ z, 1e-6)
    assert intercept == pytest.approx(1, abs=1e-3) and w == pytest.approx([2, 0, -1], abs=1e-3)
    assert boost.lasso(z.T @ z, 1e-6, np.array([False, False, True]))[1][2] == 0
    assert boost.lasso(z.T @ z, 10.0)[1].tolist() == [0, 0, 0]
    assert boost.isotonic([1, 3, 2, 4], [1, 1, 1, 1]).tolist() == [1, 2.5, 2.5, 4]
    assert boost.isotonic([1, 2], [1, 1], -1).tolist() == [1.5, 1.5]


def test_constraints(table):
    model = ZoneRegressor(["a", "b"], "y", rounds=2, validation=0.0, monotone={"b": 1}, forbidden=frozenset({frozenset({"a", "b"})}), **FAST).fit(table).model
    assert all(len(t) == 1 for t in model.terms())
    for r in model.rounds:
        assert (np.diff(r.tables[("b",)][: r.zonings["b"].real]) >= -1e-12).all() and True
    for bad in ({"loss": "none"}, {"quantile": 1.0}, {"monotone": {"a": 2}}, {"row_share": 0.0}, {"order": 4}, {"trim": 0.5}, {"trim": 0.1, "loss": "quantile"}, {"splines": ("a",), "trim": 0.1}, {"strict": True, "monotone": {"a": 1}, "loss": "quantile"}, {"bounded": {"a": (1, 0)}}, {"convex": {"a": 0}}):
        with pytest.raises(ValueError):
            boost.Settings(**bad)


def test_intervals_cover(table):
    model = ZoneRegressor(["a", "b", "c"], "y", rounds=2, validation=0.0, calibration=0.3, mondrian="c", **FAST).fit(table)
    out = model.predict_interval(table, 0.1).agg(F.avg(F.when(F.col("y").between(F.col("lower"), F.col("upper")), 1.0).otherwise(0.0))).first()[0]
    assert 0.85 < out < 0.99


def test_edits_and_counterfactuals(table, fitted):
    report = fitted.edit_report(table, "b", -1.0, 1.0, 100.0).first()
    assert report["rows_touched"] == table.where(F.col("b").between(-1, 1)).count() and report["max_change"] > 50
    assert fitted.overrides == []
    fitted.override("b", -1.0, 1.0, 100.0)
    assert fitted.predict(table.where(F.col("b").between(-1, 1))).agg(F.min("prediction")).first()[0] > 80
    fitted.reset_overrides()
    nearest = fitted.counterfactual(table.limit(20), "b", 3.0, 30)
    assert nearest.count() == 20


def test_exposure_doubles_the_rate(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"x": rng.uniform(0, 3, 800), "e": rng.uniform(0.5, 2, 800)})
    frame["y"], frame["row_id"] = rng.poisson(np.exp(frame.x - 1) * frame.e).astype(float), np.arange(800)
    df = spark.createDataFrame(frame).withColumn("offset", F.log("e"))
    model = ZoneRegressor(["x"], "y", offset="offset", loss="poisson", rounds=3, validation=0.0, **FAST).fit(df)
    one = model.predict(df).agg(F.sum("prediction")).first()[0]
    two = model.predict(df.withColumn("offset", F.log(F.col("e") * 2))).agg(F.sum("prediction")).first()[0]
    assert two == pytest.approx(2 * one) and one == pytest.approx(frame.y.sum(), rel=0.25)
    with pytest.raises(ValueError):
        ZoneRegressor(["x"], "y", offset="offset")


def test_classifiers(table):
    binary = table.withColumn("label", F.when(F.col("y") > 2, "yes").otherwise("no"))
    out = ZoneClassifier(["a", "b", "c"], "label", rounds=3, **FAST).fit(binary).predict(binary)
    assert out.agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0] > 0.8
    three = table.withColumn("label", F.when(F.col("y") > 4, 2).when(F.col("y") > 0, 1).otherwise(0))
    out = ZoneClassifier(["a", "b", "c"], "label", rounds=2, **FAST).fit(three).predict(three)
    assert out.agg(F.max(F.abs(F.col("p_0") + F.col("p_1") + F.col("p_2") - 1))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        ZoneClassifier(["a"], "label").fit(three.where("label = 1"))


def test_softmax_explanations_importance_and_calibration(table):
    three = table.withColumn("label", F.when(F.col("y") > 4, "z").when(F.col("y") > 0, "m").otherwise("a"))
    model = ZoneClassifier(["a", "b", "c"], "label", rounds=4, validation=0.2, **FAST).fit(three)
    out = model.predict(three)
    assert out.agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0] > 0.7
    scores = []
    for value in model.classes:
        wide = model.explain(three, value).toPandas().sort_values("row_id")
        scores.append(wide.drop(columns="row_id").sum(axis=1).to_numpy())
    e = np.exp(np.stack(scores))
    got = out.select("row_id", *(f"p_{c}" for c in model.classes)).toPandas().sort_values("row_id")
    assert np.abs((e / e.sum(axis=0)).T - got[[f"p_{c}" for c in model.classes]].to_numpy()).max() < 1e-9
    steps = np.stack([m.shift() + sum(m.arrays({c: data()[c].to_numpy() for c in "abc"}).values()) for m in model.models])
    assert np.abs(np.stack(scores) - np.array([m.baseline for m in model.models])[:, None] - (steps - steps.mean(axis=0))).max() < 1e-9
    names = [r["term"] for r in model.importance(three).collect()]
    assert "a x b" in names and names == sorted(names, key=names.index)
    assert "classes" in model.card(three)
    sure = ZoneClassifier(["a", "b", "c"], "label", rounds=4, calibration=0.3, calibrate=True, **FAST).fit(three)
    shares = sure.predict(three).agg(*(F.avg(f"p_{c}") for c in sure.classes), F.max(F.abs(F.col("p_a") + F.col("p_m") + F.col("p_z") - 1))).first()
    true = three.agg(*(F.avg((F.col("label") == c).cast("int")) for c in sure.classes)).first()
    assert shares[3] < 1e-9 and all(abs(shares[i] - true[i]) < 0.05 for i in range(3))
    for bad in ({"loss": "quantile"}, {"calibrate": True}):
        with pytest.raises(ValueError):
            ZoneClassifier(["a"], "label", **bad)


def test_comparison_purifying_and_several_columns(table, fitted):
    other = ZoneRegressor(["a", "b"], "y", rounds=2, validation=0.0, **FAST).fit(table)
    found = compare_models(fitted, other, table, 1e9)
    assert {r["term"] for r in found["terms"].collect()} >= {"c"} and not found["prediction"].first()["drift"]
    assert {r["feature"] for r in found["boundaries"].collect()} == {"a", "b"} == {r["feature"] for r in found["migration"].collect()}
    loss = found["performance"].first()
    assert loss["old_loss"] < loss["new_loss"]
    pure = fitted.explain(table, ["row_id"], purify=True).toPandas().sort_values("row_id")
    plain = fitted.explain(table, ["row_id"]).toPandas().sort_values("row_id")
    assert np.abs(pure.drop(columns="row_id").sum(axis=1).to_numpy() - plain.drop(columns="row_id").sum(axis=1).to_numpy()).max() < 1e-9
    zone = data().sort_values("row_id")["c"].to_numpy()
    assert all(abs(pure["b x c"].to_numpy()[zone == c].mean()) < 1e-8 for c in "abc")
    few = table.where("a is not null and b is not null").limit(30)
    one, two = fitted.counterfactual(few, "b", 6.0, 30), fitted.counterfactual(few, ["a", "b"], 6.0, 30)
    assert two.agg(F.sum("gap")).first()[0] <= one.agg(F.sum("gap")).first()[0] + 1e-9
    quality = fitted.reliability(table).groupBy("evidence_quality").count().collect()
    assert sum(r["count"] for r in quality) == table.count()


def test_ensembles(table):
    forest = ZoneForest(["a", "b", "c"], "y", estimators=3, rounds=4, **FAST).fit(table)
    wide = forest.explain(forest.predict(table), ["row_id", "prediction"]).toPandas()
    names = [c for c in wide.columns if c not in ("row_id", "prediction")]
    assert np.abs(wide[names].sum(axis=1) - wide["prediction"]).max() < 1e-9
    stable = BootstrapStability(["a", "b", "c"], "y", estimators=3, rounds=2, **FAST).fit(table)
    assert 0 < stable.inclusion()["a x b"] <= 1.0
    low, high = stable.importance_interval()["a x b"]
    assert 0 <= low <= high > 0
    assert stable.prediction_interval(table).where("low > high").count() == 0
    assert stable.contribution_interval(table).where("low > high + 1e-12 or mean < low - 1e-9 or mean > high + 1e-9").count() == 0
    assert stable.difference_interval(table, table, "row_id").where("low <> 0 or high <> 0").count() == 0


def test_survival_curves_fall(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"x": rng.uniform(0, 1, 600)})
    d, c = rng.exponential(1 / (0.1 + 0.4 * frame.x)), rng.uniform(1, 12, 600)
    frame["d"], frame["e"], frame["row_id"] = np.minimum(d, c), (d <= c).astype(int), np.arange(600)
    df = spark.createDataFrame(frame)
    model = ZoneSurvival(["x"], "d", "e", intervals=3, rounds=2, validation=0.0, **FAST).fit(df)
    early, late = (model.predict_hazard(df, F.lit(t)).agg(F.avg("survival")).first()[0] for t in (1.0, 6.0))
    assert 0 < late < early < 1
    with pytest.raises(ValueError):
        ZoneSurvival(["x"], "d", "e").fit(df.withColumn("d", F.lit(0.0)))


def test_time_series_learn_from_the_past_only(spark):
    rows = [(i, f"2024-{1 + i % 4:02d}-10", float(i % 7), float(i % 7) * (1 + i % 4)) for i in range(800)]
    df = spark.createDataFrame(rows, "row_id int, d string, x double, y double").withColumn("d", F.to_timestamp("d"))
    out = ZoneTimeSeries(["x"], "y", "d", rounds=5, **FAST).fit(df)
    got = out.predict(df)
    assert got.where("prediction is null").select(F.month("d")).distinct().collect() == [(1,)]
    second = got.where("month(d) = 2").agg(F.avg(F.abs(F.col("prediction") - F.col("x")))).first()[0]
    assert second < 0.5
    assert {s["term"] for s in out.stability()} == {"x"}
    assert len(out.flags(df, 1e9)) == 3 and not any(f["drift"] for f in out.flags(df, 1e9)) and out.shifts(df)[0]["feature"] == "x"


def test_quantile_intervals(table):
    out = ConformalQuantiles(["a", "b"], "y", rounds=2, validation=0.0, **FAST).fit(table).predict_interval(table)
    assert out.agg(F.avg(F.when(F.col("y").between(F.col("lower"), F.col("upper")), 1.0).otherwise(0.0))).first()[0] > 0.8


def test_streams(spark, tmp_path, fitted):
    from terrazzo.streaming import streams

    source = f"{tmp_path}/in"
    rows = spark.range(40).select((F.col("id") % 2).alias("u"), F.timestamp_seconds(F.col("id") * 86400).alias("t"), F.lit(1.0).alias("v"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    query = streams.decayed(stream, "u", "t", "v", 10.0).writeStream.format("memory").queryName("decayed").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    query.awaitTermination()
    got = {r["entity"]: r["decayed_sum"] for r in spark.sql("select * from decayed").collect()}
    assert got["1"] == pytest.approx(sum(0.5 ** (2 * k / 10) for k in range(20)))
    query = streams.zone_windows(stream, "t", "v", [0.5], "10 days", "1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    query.awaitTermination()
    assert spark.sql("select sum(n) from windows where zone = 1").first()[0] == 40
