"""Losses, deviances and residuals as Columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import exp_link, sigmoid

LOSSES = ("squared_error", "quantile", "poisson", "gamma", "tweedie")
LOG_LINK = ("poisson", "gamma", "tweedie")


def mean_of(loss: str, score: Column) -> Column:
    """Prediction on the scale of the target."""
    return exp_link(score) if loss in LOG_LINK else score


def residual(loss: str, y: Column, score: Column, quantile: float = 0.5, power: float = 1.5) -> Column:
    """Negative gradient at the score."""
    mu = mean_of(loss, score)
    if loss == "squared_error":
        return y - score
    if loss == "quantile":
        return y - score
    if loss == "poisson":
        return y - mu
    if loss == "gamma":
        return y / mu - 1.0
    if loss == "tweedie":
        return F.pow(mu, F.lit(1.0 - power)) * (y - mu)
    raise ValueError(f"unknown loss {loss!r}")


def poisson_deviance(y: Column, mu: Column) -> Column:
    return 2.0 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))


def gamma_deviance(y: Column, mu: Column) -> Column:
    return 2.0 * (y / mu - 1.0 - F.log(y / mu))


def tweedie_deviance(y: Column, mu: Column, power: float) -> Column:
    p = float(power)
    return 2.0 * (F.pow(y, F.lit(2.0 - p)) / ((1.0 - p) * (2.0 - p)) - y * F.pow(mu, F.lit(1.0 - p)) / (1.0 - p) + F.pow(mu, F.lit(2.0 - p)) / (2.0 - p))


def pinball(y: Column, prediction: Column, quantile: float) -> Column:
    gap = y - prediction
    return F.greatest(quantile * gap, (quantile - 1.0) * gap)


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0 - 1e-15))
    return -(y * F.log(q) + (1.0 - y) * F.log(1.0 - q))


def loss_of(loss: str, y: Column, score: Column, quantile: float = 0.5, power: float = 1.5) -> Column:
    """Per-row loss that is averaged for early stopping."""
    mu = mean_of(loss, score)
    if loss == "squared_error":
        return (y - score) * (y - score)
    if loss == "quantile":
        return pinball(y, score, quantile)
    if loss == "poisson":
        return poisson_deviance(y, mu)
    if loss == "gamma":
        return gamma_deviance(y, mu)
    if loss == "tweedie":
        return tweedie_deviance(y, mu, power)
    if loss == "log_loss":
        return log_loss(y, sigmoid(score))
    raise ValueError(f"unknown loss {loss!r}")


def each(loss: str, y: np.ndarray, mu: np.ndarray, quantile: float = 0.5, power: float = 1.5) -> np.ndarray:
    """`loss_of` over arrays, from the prediction on the scale of the target; softmax: a class's share of the log loss."""
    if loss == "squared_error":
        return (y - mu) ** 2
    if loss == "quantile":
        return np.maximum(quantile * (y - mu), (quantile - 1.0) * (y - mu))
    if loss == "softmax":
        return -y * np.log(np.clip(mu, 1e-15, 1.0))
    if loss == "log_loss":
        p = np.clip(mu, 1e-15, 1 - 1e-15)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p))
    if loss == "poisson":
        return 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0) - (y - mu))
    if loss == "gamma":
        return 2 * (y / mu - 1 - np.log(y / mu))
    if loss == "tweedie":
        return 2 * (y ** (2 - power) / ((1 - power) * (2 - power)) - y * mu ** (1 - power) / (1 - power) + mu ** (2 - power) / (2 - power))
    raise ValueError(f"unknown loss {loss!r}")
