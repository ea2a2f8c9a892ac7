"""Iterative fits per series: count regression and an additive model.

A series is a handful of months, so it travels as one row of arrays and is fitted in
NumPy inside a task; many series share a batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspan.operators.forecast import holdout_rows, score, training, trend_fit, trend_value
from shockspan.operators.series import KEYS

Fit = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray] | None]
Z95 = 1.959963984540054


def month_design(first: int, n: int) -> np.ndarray:
    """Intercept, t / 100, and a dummy per month but the first."""
    t = np.arange(first, first + n)
    return np.column_stack([np.ones(n), t / 100.0, *[(t % 12 == m).astype(float) for m in range(1, 12)]])


def negbin(y: np.ndarray, ahead: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Log-link regression of counts with variance mu + mu^2, by reweighted least
    squares; gives the mean and its 95 % interval for the next ``ahead`` months."""
    if not y.sum():
        return None
    x = month_design(0, len(y))
    mu = (y + y.mean()) / 2
    last = np.inf
    for _ in range(rounds):
        eta = np.clip(np.log(mu), -30, 30)
        w = mu / (1 + mu)
        information = x.T @ (x * w[:, None])
        beta = np.linalg.pinv(information) @ (x.T @ (w * (eta + (y - mu) / mu)))
        mu = np.exp(np.clip(x @ beta, -30, 30))
        part = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0.0)
        deviance = 2 * np.sum(part - (y + 1) * np.log((1 + y) / (1 + mu)))
        if abs(last - deviance) <= 1e-8 * (abs(deviance) + 1e-8):
            break
        last = deviance
    w = mu / (1 + mu)
    cov = np.linalg.pinv(x.T @ (x * w[:, None]))
    new = month_design(len(y), ahead)
    eta = new @ beta
    half = Z95 * np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", new, cov, new)))
    mean, low, high = (np.exp(np.clip(v, -30, 30)) for v in (eta, eta - half, eta + half))
    return mean, low, high


def sparse_changes(gram: np.ndarray, slope: np.ndarray, penalty: float, start: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """Coordinate descent for ``min d'Gd/2 - s'd + penalty |d|``."""
    d = start.copy()
    rest = slope - gram @ d
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(d)):
            if gram[j, j] <= 1e-12:
                continue
            pull = rest[j] + gram[j, j] * d[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / gram[j, j]
            if new != d[j]:
                rest -= gram[:, j] * (new - d[j])
                moved, d[j] = max(moved, abs(new - d[j]) * np.sqrt(gram[j, j])), new
        if moved < 1e-9:
            break
    return d


def future_trends(rng: np.random.Generator, ahead: int, step: float, rate: float, size: float, draws: int) -> np.ndarray:
    """Departures of the trend in ``draws`` futures: changes come at the past rate, Laplace of the past mean size.

    The sum of a month's changes is drawn as the difference of two gamma variables.
    """
    changes = rng.poisson(rate * step, (draws, ahead))
    slope = (rng.gamma(changes, 1.0) - rng.gamma(changes, 1.0)) * size
    return np.cumsum(np.cumsum(slope, axis=1) * step, axis=1)


def additive(
    y: np.ndarray, ahead: int, changepoints: int = 25, order: int = 10, spread: float = 0.05, draws: int = 1000
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Piecewise-linear trend plus yearly Fourier terms; most changes of slope are zero.

    Counts are scaled to 1. Level and slope have Gaussian priors of deviation 5,
    seasonal terms of 10, changes of slope a Laplace prior of scale ``spread``. For a
    given noise level the Gaussian part is eliminated exactly and the changes follow by
    coordinate descent; the noise is re-estimated a few times. The 95 % band holds the
    middle of simulated futures in which the slope goes on changing as often and as much
    as it did, so it widens with the horizon. The simulation's seed comes from the
    counts, so a series has one band however it is dealt out.
    """
    n = len(y)
    if n < 2 or not y.sum():
        return None
    scale = np.abs(y).max()
    t = np.arange(n + ahead) / max(n - 1, 1)
    knots = np.linspace(0, 0.8, min(changepoints, n - 1) + 1)[1:]
    year = 2 * np.pi * (np.arange(n + ahead) % 12) / 12
    waves = [f(k * year) for k in range(1, order + 1) for f in (np.sin, np.cos)]
    smooth = np.column_stack([np.ones_like(t), t, *waves])
    bent = np.column_stack([np.maximum(0, t - k) for k in knots])
    hold = np.concatenate([[5.0, 5.0], np.full(len(waves), 10.0)]) ** -2
    z, d, target = smooth[:n], bent[:n], y / scale
    sigma, delta = max(target.std(), 1e-3), np.zeros(len(knots))
    for _ in range(5):
        inner = np.linalg.solve(z.T @ z + np.diag(sigma**2 * hold), z.T)
        left = lambda v: v - z @ (inner @ v)  # noqa: E731, B023
        delta = sparse_changes(d.T @ left(d), d.T @ left(target), sigma**2 / spread, delta)
        beta = inner @ (target - d @ delta)
        sigma = max(np.sqrt(np.mean((target - z @ beta - d @ delta) ** 2)), 1e-3)
    value = (smooth[n:] @ beta + bent[n:] @ delta) * scale
    rng = np.random.default_rng(zlib.crc32(np.ascontiguousarray(y, "<f8").tobytes()))
    futures = future_trends(rng, ahead, t[1] - t[0], len(knots), np.abs(delta).mean() + 1e-8, draws)
    futures += rng.normal(0, sigma, futures.shape)
    low, high = np.quantile(futures, [0.025, 0.975], axis=0) * scale
    return np.maximum(0, value), np.maximum(0, value + np.minimum(low, 0)), np.maximum(0, value) + np.maximum(high, 0)


MODELS: dict[str, Fit] = {"negbin": negbin, "additive": additive}


def fitted(series: DataFrame, models: list[str], holdout: int = 12, horizon: int = 72, refit: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Hold-out predictions (part 'test') and forecasts (part 'ahead') of the models.

    Without ``refit`` the forecasts come from the training months too, as in a model
    comparison; with it, from the whole series. All-zero series give no rows.
    """
    wide = series.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda r: r["n"].cast("double")).alias("y"),
        F.max("month").alias("last_month"),
    )
    names = {c: series.schema[c].dataType.simpleString() for c in keys}
    schema = ", ".join(f"{c} {t}" for c, t in names.items()) + ", model string, part string, t int, month date, n double, predicted double, lower double, upper double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row_of, labels, values = [], [], []  # per part: its series, its names, its arrays
            for i, row in enumerate(pdf.itertuples(index=False)):
                y = np.asarray(row.y, dtype=float)
                n, train = len(y), len(y) - holdout
                for model in models:
                    got = MODELS[model](y[:train], holdout + horizon) if train >= 24 else None
                    if got is None:
                        continue
                    test = [v[:holdout] for v in got]
                    ahead = MODELS[model](y, horizon) if refit else [v[holdout:] for v in got]
                    for part, v, first, seen in (("test", test, train, y[train:]), ("ahead", ahead, n, np.full(horizon, np.nan))):
                        row_of.append(np.full(len(v[0]), i))
                        labels += [(model, part)] * len(v[0])
                        values.append(np.stack([np.arange(first, first + len(v[0])), np.full(len(v[0]), n), seen, *v]))
            if not values:
                continue
            at, (t, n, seen, predicted, lower, upper) = np.concatenate(row_of), np.concatenate(values, axis=1)
            last = pdf["last_month"].to_numpy("datetime64[M]")[at]
            yield pd.DataFrame(
                {
                    **{c: pdf[c].to_numpy()[at] for c in keys}, "model": [m for m, _ in labels], "part": [p for _, p in labels], "t": t.astype(int),
                    "month": (last + (t - n + 1).astype(int)).astype("datetime64[D]").astype(object),
                    "n": seen, "predicted": predicted, "lower": lower, "upper": upper,
                }
            )

    return wide.mapInPandas(run, schema)


def fitted_forecast(series: DataFrame, model: str, horizon: int = 72, refit: bool = False, keys: list[str] = KEYS) -> DataFrame:
    rows = fitted(series, [model], horizon=horizon, refit=refit, keys=keys).filter(F.col("part") == "ahead")
    first = series.groupBy(*keys).agg(F.max("months").alias("months"))
    return rows.join(first, keys).select(
        *keys, (F.col("t") - F.col("months")).alias("step"), "month", *[F.round(c, 6).alias(c) for c in ("predicted", "lower", "upper")]
    )


def compare_models(series: DataFrame, holdout: int = 12, horizon: int = 72, keys: list[str] = KEYS) -> DataFrame:
    """One row per series: errors of the three models, the winner, and its forecast with its band.

    The fits run once; their rows feed both the errors and the winner's forecast.
    """
    def band(step, *values):
        names = ("predicted", "lower", "upper")
        return F.struct(step.cast("int").alias("step"), *[F.round(v, 2).alias(n) for v, n in zip(values, names, strict=True)])

    half = Z95 * F.col("sigma")
    train = training(series, holdout)
    line = trend_fit(train, keys)
    tests = holdout_rows(series, holdout)
    base = tests.select(*keys, "t", "n").join(line, keys).withColumn("predicted", trend_value(F.col("t") - F.col("months")))
    base = score(base, keys).withColumn("model", F.lit("baseline"))
    steps = F.explode(F.sequence(F.lit(holdout), F.lit(holdout + horizon - 1)))
    base_ahead = line.withColumn("step", steps).groupBy(*keys).agg(
        F.array_sort(F.collect_list(band(F.col("step") - holdout, trend_value(F.col("step")), F.greatest(F.lit(0.0), trend_value(F.col("step")) - half), trend_value(F.col("step")) + half))).alias("ahead")
    )
    rows = fitted(series, ["negbin", "additive"], holdout, horizon, keys=keys)
    gap = F.when(F.col("part") == "test", F.col("n") - F.col("predicted"))
    fits = rows.groupBy(*keys, "model").agg(
        F.round(F.avg(F.abs(gap)), 3).alias("mae"),
        F.round(F.sqrt(F.avg(gap * gap)), 3).alias("rmse"),
        F.array_sort(F.collect_list(F.when(F.col("part") == "ahead", band(F.col("t"), F.col("predicted"), F.col("lower"), F.col("upper"))))).alias("ahead"),
    )
    fits = fits.withColumn("ahead", F.transform("ahead", lambda r, i: F.struct(i.alias("step"), r["predicted"].alias("predicted"), r["lower"].alias("lower"), r["upper"].alias("upper"))))
    every = base.join(base_ahead, keys).select(*keys, "model", "mae", "rmse", "ahead").unionByName(fits)
    order = F.when(F.col("model") == "baseline", 0).when(F.col("model") == "negbin", 1).otherwise(2)
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}")
    won = F.min(F.when(F.col("mae").isNotNull(), F.struct("mae", order.alias("o"), "model", "ahead"))).alias("won")
    out = every.groupBy(*keys).agg(*[pick(m, c) for m in ("baseline", "negbin", "additive") for c in ("mae", "rmse")], won)
    zeros = tests.groupBy(*keys).agg((F.sum("n") == 0).cast("int").alias("test_zeros"))
    total = series.groupBy(*keys).agg(F.sum("n").alias("total_historical"))
    return out.join(zeros, keys).join(total, keys).select(
        *keys, "total_historical", "test_zeros",
        *[f"{m}_{c}" for m in ("baseline", "negbin", "additive") for c in ("mae", "rmse")],
        F.col("won.model").alias("best_model"), F.col("won.mae").alias("best_mae"), F.col("won.ahead").alias("forecast"),
    )
