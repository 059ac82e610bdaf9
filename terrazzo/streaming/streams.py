"""Structured Streaming forms of batch operators: an extension, with the same names and results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import zone_index
from ..plans.estimators import ZoneRegressor


def zone_windows(events: DataFrame, time: str, value: str, cuts: Sequence[float], window: str, late: str, slide: str | None = None) -> DataFrame:
    """Count and mean of a value by zone in tumbling or sliding windows; events later than ``late`` are dropped by the watermark."""
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(frame.alias("w"), zone_index(F.col(value), cuts).alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "zone", "n", "mean")


def scored(rows: DataFrame, model: ZoneRegressor, name: str = "prediction") -> DataFrame:
    """A stream with a frozen model's prediction: stateless."""
    return model.predict(rows, name)


def decayed(events: DataFrame, entity: str, time: str, value: str, half_life_days: float) -> DataFrame:
    """entity, time, decayed_sum after each batch's events of an entity.

    State is two numbers for each entity, the sum and its time: the sum halves
    with each half-life and takes on each new event. Late events count with
    the decay they would have had.
    """

    def update(key, frames, state):
        total, at = state.get if state.exists else (0.0, None)
        for frame in frames:
            for t, v in zip(frame["t"], frame["v"].fillna(0.0)):
                if at is None or t >= at:
                    total, at = total * (0.5 ** ((t - at) / half_life_days) if at is not None else 1.0) + v, t
                else:
                    total += v * 0.5 ** ((at - t) / half_life_days)
        if at is not None:
            state.update((total, at))
            yield pd.DataFrame({"entity": [key[0]], "day": [at], "decayed_sum": [total]})

    rows = events.select(F.col(entity).cast("string").alias("entity"), (F.unix_micros(F.col(time).cast("timestamp")) / 86_400e6).alias("t"), F.col(value).cast("double").alias("v")).where("entity is not null and t is not null")
    return rows.groupBy("entity").applyInPandasWithState(update, "entity string, day double, decayed_sum double", "total double, day double", "update", "NoTimeout")


def on_drift(rows: DataFrame, old: ZoneRegressor, new: ZoneRegressor, margin: float, alert: Callable[[int, float], None]):
    """A writer that calls ``alert(batch, shift)`` for each batch whose mean shift between two models exceeds the margin."""

    def check(batch: DataFrame, number: int) -> None:
        shift = batch.agg(F.avg(new.score() - old.score()).alias("s")).first()["s"]
        if shift is not None and abs(shift) > margin:
            alert(number, shift)

    return rows.writeStream.foreachBatch(check)
