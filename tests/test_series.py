"""Series, forecasts and fits on hand-made series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockspan.operators import fitted as G
from shockspan.operators import forecast as P
from shockspan.operators import series as S

D = dt.date


def months(n, first=D(2000, 1, 1)):
    return [D(first.year + (first.month - 1 + i) // 12, (first.month - 1 + i) % 12 + 1, 1) for i in range(n)]


def series(spark, named):
    rows = [(s, "flood", len(y), t, m, int(v)) for s, y in named.items() for t, (m, v) in enumerate(zip(months(len(y)), y))]
    return spark.createDataFrame(rows, "state string, event_type string, months int, t int, month date, n long")


def stats(spark, rows):
    return spark.createDataFrame(rows, "state string, event_type string, total long, avg_active_month double, max_month long, months_with_data long")


def test_select_top_combos_thresholds_and_ties(spark):
    df = stats(spark, [
        ("A", "flood", 9, 1.0, 1, 20), ("A", "fire", 10, 1.0, 1, 11), ("A", "storm", 10, 1.0, 1, 12),
        ("B", "d", 20, 1.0, 1, 12), ("B", "c", 20, 1.0, 1, 12), ("B", "b", 30, 0.4, 1, 12), ("B", "a", 20, 1.0, 1, 12), ("C", "x", 5, 1.0, 1, 1),
    ])
    chosen = S.select_top_combos(df)
    got = [(r.state, r.event_type, r.state_rank) for r in chosen.orderBy("state", "state_rank").collect()]
    assert got == [("A", "storm", 1), ("B", "b", 1), ("B", "a", 2), ("B", "c", 3)]
    assert [r.state for r in S.unmatched_states(df, chosen).collect()] == ["C"]
    assert [r.event_type for r in S.sparse_flag(chosen).collect()] == ["b"]


def test_calendar_fill(spark):
    df = spark.createDataFrame([("A", "x", D(2000, 2, 1), 3), ("A", "x", D(2000, 4, 1), 1)], "state string, event_type string, month date, n long")
    assert [r.n for r in S.calendar_fill(df).orderBy("t").collect()] == [3, 0, 1]
    assert [r.n for r in S.calendar_fill(df, "2000-01-01", "2000-03-01").orderBy("t").collect()] == [0, 3, 0]


def naive_trend_seasonal(y, horizon):
    n = len(y)
    if n < 24:
        return np.full(horizon, np.mean(y)), 0.0
    slope, intercept = np.polyfit(np.arange(n), y, 1)
    whole = y[: n // 12 * 12]
    season = whole.reshape(-1, 12).mean(axis=0) / whole.mean() if whole.mean() > 0 else np.ones(12)
    line = slope * np.arange(n, n + horizon) + intercept
    out = np.where(line > 0, line * season[np.arange(n, n + horizon) % 12], 0.0)
    return np.maximum(0, out), float(np.std(y - (slope * np.arange(n) + intercept)))


def test_trend_seasonal_equals_loops(spark):
    rng = np.random.default_rng(1)
    named = {
        "long": rng.poisson(3, 79), "short": rng.poisson(2, 20), "zero": np.zeros(40, int),
        "falling": np.maximum(0, 30 - np.arange(40)), "season": np.tile(np.arange(12), 4),
    }
    got = P.trend_seasonal_forecast(series(spark, named), 30).collect()
    for name, y in named.items():
        want, sigma = naive_trend_seasonal(np.asarray(y, float), 30)
        rows = sorted((r for r in got if r.state == name), key=lambda r: r.step)
        assert np.allclose([r.predicted for r in rows], want, atol=1e-5), name
        assert np.allclose([r.upper for r in rows], want + 1.96 * sigma, atol=1e-5), name
        assert all(0 <= r.lower <= r.predicted <= r.upper for r in rows)


def test_smoothing_equals_loop(spark):
    y = [4, 0, 3, 9, 2]
    s = y[0]
    for v in y:
        s = 0.3 * v + 0.7 * s
    rows = P.exp_smoothing(series(spark, {"a": y}), 0.3, 3).collect()
    assert len(rows) == 3 and all(abs(r.predicted - s) < 1e-6 for r in rows)


@pytest.mark.parametrize("t,df,p", [(2.570582, 5, 0.05), (2.776445, 4, 0.05), (12.706205, 1, 0.05), (4.302653, 2, 0.05), (2.042272, 30, 0.05), (3.169273, 10, 0.01), (1.0, 7, 0.350617)])
def test_student_p(spark, t, df, p):
    got = spark.range(1).select(S.student_p(F.lit(t), F.lit(df).cast("long"))).collect()[0][0]
    assert abs(got - p) < 2e-6


def test_trend_labels(spark):
    rows = []
    for name, slope in (("up", 3), ("down", -3), ("flat", 0)):
        for year in range(2000, 2008):
            rows.append((name, D(year, 5, 1), 40 + slope * (year - 2000) + (year % 2)))
    rows += [("few", D(2000, 1, 1), 1), ("few", D(2001, 1, 1), 2)]
    df = spark.createDataFrame(rows, "state string, month date, n long")
    got = {r.state: r.trend for r in S.trend_test(df, ["state"], "month", F.col("n")).collect()}
    assert got == {"up": "increasing", "down": "decreasing", "flat": "stable", "few": "insufficient_data"}


def test_peak_months_tie_goes_to_the_earlier(spark):
    y = [1, 5, 1, 5, 0, 0, 0, 0, 0, 0, 9, 0] * 2
    assert S.peak_months(series(spark, {"a": y})).collect()[0].peak_months == ["November", "February", "April"]


def newton_negbin(y, rounds=100):
    """Fisher scoring written out per coefficient vector, as an independent fit."""
    x = G.month_design(0, len(y))
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(y.mean())
    for _ in range(rounds):
        mu = np.exp(x @ beta)
        score = x.T @ ((y - mu) / (1 + mu))
        info = (x * (mu / (1 + mu))[:, None]).T @ x
        beta = beta + np.linalg.solve(info, score)
    return beta


def test_negbin_reaches_the_likelihood_maximum():
    y = np.random.default_rng(3).poisson(np.tile(np.arange(2, 14), 6)).astype(float)
    mean, low, high = G.negbin(y, 12)
    assert np.allclose(mean, np.exp(G.month_design(72, 12) @ newton_negbin(y)), rtol=1e-5)
    assert (low <= mean).all() and (mean <= high).all()
    assert G.negbin(np.zeros(30), 5) is None


def test_additive_beats_the_mean_on_seasonal_data():
    t = np.arange(96)
    y = np.round(10 + 0.05 * t + 6 * np.sin(2 * np.pi * t / 12))
    value, low, high = G.additive(y[:84], 12)
    assert np.mean(np.abs(value - y[84:])) < 0.3 * np.mean(np.abs(y[:84].mean() - y[84:]))
    assert (0 <= low).all() and (low <= value).all() and (value <= high).all()


def test_changes_of_slope_meet_the_optimality_conditions():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 12))
    y = x[:, 2] * 3 - x[:, 7] + rng.normal(size=60) * 0.1
    gram, slope, penalty = x.T @ x, x.T @ y, 9.0
    d = G.sparse_changes(gram, slope, penalty, np.zeros(12))
    rest = slope - gram @ d
    assert np.abs(rest).max() <= penalty + 1e-6 and (d == 0).any() and d[2] > 2
    assert rest[d != 0] == pytest.approx(penalty * np.sign(d[d != 0]), abs=1e-6)


def test_straight_series_bend_nowhere_and_bands_widen():
    t = np.arange(120)
    rng = np.random.default_rng(1)
    straight = 50 + 0.3 * t + rng.normal(size=120)
    value, low, high = G.additive(straight, 72)
    assert np.abs(value - (50 + 0.3 * np.arange(120, 192))).max() < 4
    bent = np.where(t < 60, 20 + t, 80 - 0.5 * (t - 60)) + rng.normal(size=120)
    value, low, high = G.additive(bent, 72)
    width = high - low
    assert width[60:].mean() > 1.5 * width[:6].mean() and (low <= value).all() and (value <= high).all()
    assert all(np.array_equal(a, b) for a, b in zip(G.additive(bent, 72), (value, low, high), strict=True))


def test_bands_cover_what_comes():
    """Near 95 % of the later months of steady series lie in the band; of series that go on bending, more than noise alone explains."""
    rng = np.random.default_rng(3)
    steady, bending, noise_only = [], [], []
    for _ in range(30):
        t = np.arange(150)
        y = 100 + 0.2 * t + 8 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 3, 150)
        _, low, high = G.additive(y[:120], 30)
        steady.append(((low <= y[120:]) & (y[120:] <= high)).mean())
        slope = np.cumsum(np.where(rng.random(150) < 0.1, rng.laplace(0, 0.4, 150), 0))
        y = 200 + np.cumsum(slope) + rng.normal(0, 3, 150)
        y = y - min(y.min(), 0)
        value, low, high = G.additive(y[:120], 30)
        bending.append(((low <= y[120:]) & (y[120:] <= high)).mean())
        half = (high - low)[:1] / 2
        noise_only.append((np.abs(y[120:] - value) <= half).mean())
    assert 0.9 < np.mean(steady) <= 1
    assert np.mean(bending) > np.mean(noise_only) + 0.1


def test_compare_models(spark):
    rng = np.random.default_rng(5)
    named = {"season": rng.poisson(np.tile(np.arange(1, 13), 7)), "zero end": np.r_[rng.poisson(3, 72), np.zeros(12, int)], "zero": np.zeros(84, int)}
    rows = {r.state: r for r in G.compare_models(series(spark, named)).collect()}
    assert rows["zero"].negbin_mae is None and rows["zero"].best_model == "baseline" and rows["zero"].test_zeros == 1
    assert rows["zero end"].test_zeros == 1 and rows["season"].test_zeros == 0
    best = rows["season"]
    errors = {m: best[f"{m}_mae"] for m in ("baseline", "negbin", "additive")}
    assert best.best_mae == min(errors.values()) == errors[best.best_model] and len(best.forecast) == 72
