"""Registered queries: monthly series, selections and deterministic forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockspan.operators import forecast as P
from shockspan.operators import series as S
from shockspan.operators import sketches as K
from shockspan.plans.registry import query, view
from shockspan.session import stored

view("monthly", """
  SELECT state, event_type, date_trunc('month', begin_on)::DATE AS month, count(*) AS n
  FROM shocks WHERE begin_on IS NOT NULL GROUP BY ALL""", "shocks")
view("stats", """
  SELECT state, event_type, sum(n)::BIGINT AS total, round(avg(n), 6) AS avg_active_month, max(n) AS max_month,
         count(*) AS months_with_data
  FROM monthly GROUP BY ALL""", "monthly")
view("chosen", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY total DESC, event_type)::INT AS state_rank
                 FROM stats WHERE total >= 110 AND months_with_data >= 60) WHERE state_rank <= 3""", "stats")
view("calendar", "SELECT min(month) AS first, max(month) AS last, date_diff('month', min(month), max(month)) // 12 AS years FROM monthly", "monthly")
view("filled", """
  SELECT k.state, k.event_type, c.t, c.month, coalesce(m.n, 0) AS n, c.months
  FROM (SELECT DISTINCT state, event_type FROM monthly) k
  CROSS JOIN (SELECT m::DATE AS month, (row_number() OVER (ORDER BY m) - 1)::INT AS t, (count(*) OVER ())::INT AS months
              FROM (SELECT unnest(generate_series(first, last, INTERVAL 1 MONTH)) AS m FROM calendar)) c
  LEFT JOIN monthly m ON m.state = k.state AND m.event_type = k.event_type AND m.month = c.month""", "monthly", "calendar")
view("spanned", """
  SELECT k.state, k.event_type, k.month, coalesce(m.n, 0) AS n
  FROM (SELECT state, event_type, unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS month
        FROM (SELECT state, event_type, min(month) AS lo, max(month) AS hi FROM monthly GROUP BY ALL)) k
  LEFT JOIN monthly m ON m.state = k.state AND m.event_type = k.event_type AND m.month = k.month""", "monthly")


def fit_views(prefix: str, source: str, where: str) -> None:
    """Line, season and residual deviation in plain two-pass SQL."""
    view(f"{prefix}_src", f"SELECT * FROM {source} WHERE {where}", source)
    view(f"{prefix}_line", f"""
      SELECT state, event_type, count(*) AS len, regr_slope(n, t) AS slope, regr_intercept(n, t) AS intercept,
             max(month) AS last_month
      FROM {prefix}_src GROUP BY ALL""", f"{prefix}_src")
    view(f"{prefix}_sigma", f"""
      SELECT state, event_type, stddev_pop(n - (slope * t + intercept)) AS sigma
      FROM {prefix}_src JOIN {prefix}_line USING (state, event_type) GROUP BY ALL""", f"{prefix}_src", f"{prefix}_line")
    view(f"{prefix}_season", f"""
      SELECT state, event_type, t % 12 AS position, avg(n) / any_value(whole) AS idx
      FROM {prefix}_src JOIN {prefix}_line USING (state, event_type)
      JOIN (SELECT state, event_type, avg(n) AS whole FROM {prefix}_src JOIN {prefix}_line USING (state, event_type)
            WHERE t < (len // 12) * 12 GROUP BY ALL) USING (state, event_type)
      WHERE t < (len // 12) * 12 GROUP BY state, event_type, t % 12""", f"{prefix}_src", f"{prefix}_line")


fit_views("full", "filled", "true")
fit_views("train", "filled", "t < months - 12")
view("ahead", """
  SELECT state, event_type, step::INT AS step, (last_month + to_months((step + 1)::INT))::DATE AS month,
         CASE WHEN slope * (len + step) + intercept > 0 THEN (slope * (len + step) + intercept) * idx ELSE 0.0 END AS value,
         sigma
  FROM full_line JOIN full_sigma USING (state, event_type)
  CROSS JOIN (SELECT unnest(range(72)) AS step)
  JOIN full_season USING (state, event_type) WHERE position = (len + step) % 12""",
     "full_line", "full_sigma", "full_season")
view("ahead_out", """
  SELECT state, event_type, step, month, round(greatest(value, 0), 6) AS predicted,
         round(greatest(0, greatest(value, 0) - 1.96 * sigma), 6) AS lower, round(greatest(value, 0) + 1.96 * sigma, 6) AS upper
  FROM ahead""", "ahead")
view("held", """
  SELECT f.state, f.event_type, f.t, f.month, f.n,
         CASE WHEN slope * f.t + intercept > 0 THEN (slope * f.t + intercept) * idx ELSE 0.0 END AS predicted
  FROM filled f JOIN train_line l USING (state, event_type)
  JOIN train_season s ON s.state = f.state AND s.event_type = f.event_type AND s.position = f.t % 12
  WHERE f.t >= f.months - 12""", "filled", "train_line", "train_season")
view("held_score", """
  SELECT state, event_type, round(avg(abs(n - predicted)), 3) AS mae, round(sqrt(avg((n - predicted) ** 2)), 3) AS rmse
  FROM held GROUP BY ALL""", "held")
view("peaks", """
  SELECT state, event_type, list(monthname(make_date(2000, m, 1)) ORDER BY a DESC, m)[1:3] AS peak_months
  FROM (SELECT state, event_type, month(month) AS m, avg(n) AS a FROM filled GROUP BY ALL) GROUP BY ALL""", "filled")
view("scores", """
  SELECT state, event_type, 'trend_seasonal' AS model, 0 AS priority, mae, rmse FROM held_score
  UNION ALL
  SELECT f.state, f.event_type, 'smoothing', 1, round(avg(abs(n - level)), 3), round(sqrt(avg((n - level) ** 2)), 3)
  FROM filled f JOIN (SELECT state, event_type, list_reduce(list(n::DOUBLE ORDER BY t), lambda s, y: 0.3 * y + 0.7 * s,
                             max(CASE WHEN t = 0 THEN n::DOUBLE END)) AS level
                      FROM train_src GROUP BY ALL) l USING (state, event_type)
  WHERE f.t >= f.months - 12 GROUP BY ALL
  UNION ALL
  SELECT f.state, f.event_type, 'seasonal_mean', 2, round(avg(abs(n - a)), 3), round(sqrt(avg((n - a) ** 2)), 3)
  FROM filled f JOIN (SELECT state, event_type, month(month) AS m, avg(n) AS a FROM train_src GROUP BY ALL) l
    ON l.state = f.state AND l.event_type = f.event_type AND l.m = month(f.month)
  WHERE f.t >= f.months - 12 GROUP BY ALL""", "held_score", "filled", "train_src")
view("best", """
  SELECT state, event_type, arg_min(model, mae * 10 + priority * 0.001) AS best_model, min(mae) AS best_mae
  FROM scores GROUP BY ALL""", "scores")
view("outlooks", """
  SELECT state, event_type, 'trend_seasonal' AS model, step, month, round(value, 6) AS predicted FROM ahead WHERE step < 12
  UNION ALL
  SELECT state, event_type, 'smoothing', step::INT, (last + to_months((step + 1)::INT))::DATE, round(level, 6)
  FROM (SELECT state, event_type, max(month) AS last,
               list_reduce(list(n::DOUBLE ORDER BY t), lambda s, y: 0.3 * y + 0.7 * s, max(CASE WHEN t = 0 THEN n::DOUBLE END)) AS level
        FROM filled GROUP BY ALL) CROSS JOIN (SELECT unnest(range(12)) AS step)
  UNION ALL
  SELECT a.state, a.event_type, 'seasonal_mean', a.step, a.month, round(s.mean, 6)
  FROM (SELECT DISTINCT state, event_type, step, month FROM ahead WHERE step < 12) a
  JOIN (SELECT state, event_type, month(month) AS m, avg(n) AS mean FROM filled GROUP BY ALL) s
    ON s.state = a.state AND s.event_type = a.event_type AND s.m = month(a.month)""", "ahead", "filled")
view("winning", """
  SELECT o.* FROM outlooks o JOIN best b ON o.state = b.state AND o.event_type = b.event_type AND o.model = b.best_model""", "outlooks", "best")
view("forecast_table", """
  SELECT state, event_type, total_historical, peak_months, avg_next_12, mae AS cv_mae, rmse AS cv_rmse,
         train_months, 72 AS forecast_horizon
  FROM (SELECT state, event_type, sum(n)::BIGINT AS total_historical, max(months) AS train_months FROM filled GROUP BY ALL)
  JOIN peaks USING (state, event_type)
  JOIN (SELECT state, event_type, round(avg(predicted), 3) AS avg_next_12 FROM ahead_out WHERE step < 12 GROUP BY ALL)
    USING (state, event_type)
  JOIN held_score USING (state, event_type)""", "filled", "peaks", "ahead_out", "held_score")


def monthly(t):
    return S.monthly_counts(t.shocks)


def stats(t):
    return S.combo_stats(monthly(t))


def chosen(t):
    return S.select_top_combos(stats(t), 110, 60, 3)


def filled(t):
    counts = t.stage("monthly", lambda: monthly(t))
    return t.stage("filled", lambda: S.calendar_fill(counts, *S.calendar_span(counts)))


def spanned(t):
    return S.calendar_fill(monthly(t))


def ahead(t):
    return P.trend_seasonal_forecast(filled(t), 72)


@query("monthly_counts", "SELECT * FROM monthly", "monthly")
def _(t):
    return monthly(t)


@query("combo_stats", "SELECT * FROM stats", "stats")
def _(t):
    return stats(t)


@query("threshold_filter", """
  SELECT * FROM stats WHERE total >= 115 AND months_with_data >= 60 AND event_type IN ('1-URGENT', '2-HIGH', '5-LOW')""", "stats")
def _(t):
    return S.threshold_filter(stats(t), 115, 60, ["1-URGENT", "2-HIGH", "5-LOW"])


@query("select_top_combos", "SELECT * FROM chosen", "chosen")
def _(t):
    return chosen(t)


@query("unmatched_states", """
  SELECT DISTINCT state FROM stats
  WHERE state NOT IN (SELECT state FROM stats WHERE total >= 135 AND months_with_data >= 60)""", "stats")
def _(t):
    return S.unmatched_states(stats(t), S.select_top_combos(stats(t), 135, 60, 3))


@query("sparse_flag", "SELECT * FROM chosen WHERE avg_active_month < 2", "chosen")
def _(t):
    return S.sparse_flag(chosen(t), 2.0)


@query("coverage_by_type", "SELECT event_type, count(*) AS n_states FROM chosen GROUP BY ALL", "chosen")
def _(t):
    return S.coverage_by_type(chosen(t))


@query("state_summary", """
  SELECT state, string_agg(event_type || ' (' || total || ')', ', ' ORDER BY state_rank) AS summary
  FROM chosen GROUP BY ALL""", "chosen")
def _(t):
    return S.state_summary(chosen(t))


@query("top1_per_state", """
  SELECT state, event_type, total
  FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY total DESC, event_type) AS r FROM stats) WHERE r = 1""", "stats")
def _(t):
    return S.top1_per_state(stats(t))


@query("global_top", "SELECT * FROM stats ORDER BY total DESC, state, event_type LIMIT 50", "stats")
def _(t):
    return S.global_top(stats(t), "total", 50, "state", "event_type")


@query("share_of_total", """
  SELECT event_type, sum(total)::BIGINT AS total, round(sum(total) * 100.0::DOUBLE / (SELECT sum(total) FROM stats), 6) AS pct
  FROM stats GROUP BY ALL""", "stats")
def _(t):
    return S.share_of_total(stats(t))


@query("value_counts_top", """
  SELECT area, state, count(*) AS n FROM exits GROUP BY ALL ORDER BY n DESC, area, state LIMIT 10""", "exits")
def _(t):
    return S.value_counts_top(t.exits, ["area", "state"], 10)


@query("calendar_profile", """
  SELECT 'year' AS kind, year(begin_on)::INT AS value, count(*) AS n FROM shocks GROUP BY ALL
  UNION ALL SELECT 'month', month(begin_on)::INT, count(*) FROM shocks GROUP BY ALL""", "shocks")
def _(t):
    return S.calendar_profile(t.shocks)


@query("dataset_summary", """
  SELECT count(*) AS n_rows, min(begin_on) AS first_time, max(begin_on) AS last_time,
         (max(year(begin_on)) - min(year(begin_on)) + 1)::INT AS n_years,
         count(DISTINCT state) AS n_state, count(DISTINCT county_id) AS n_county_id,
         count(DISTINCT event_type) AS n_event_type, count(DISTINCT event_id) AS n_event_id,
         count(*) FILTER (WHERE state IS NULL) AS nulls_state, count(*) FILTER (WHERE county_id IS NULL) AS nulls_county_id,
         count(*) FILTER (WHERE event_type IS NULL) AS nulls_event_type, count(*) FILTER (WHERE event_id IS NULL) AS nulls_event_id,
         count(*) FILTER (WHERE begin_on IS NULL) AS nulls_begin_on, count(*) FILTER (WHERE end_on IS NULL) AS nulls_end_on
  FROM shocks""", "shocks")
def _(t):
    keep = ["state", "county_id", "event_type", "event_id"]
    return S.dataset_summary(t.shocks.select(*keep, "begin_on", "end_on"), "begin_on", keep)


@query("dataset_summary_days", """
  SELECT count(*) AS n_rows, min(begin_on) AS first_time, max(begin_on) AS last_time,
         (max(year(begin_on)) - min(year(begin_on)) + 1)::INT AS n_years,
         count(*) FILTER (WHERE end_on IS NULL) AS nulls_end_on,
         true AS state_within, true AS county_id_within, true AS event_type_within, true AS event_id_within
  FROM shocks WHERE begin_on BETWEEN DATE '1993-01-01' AND DATE '1997-06-30'""", "shocks")
def _(t):
    """Sketches of all days, then a span of them; estimates lie within four errors of the exact counts."""
    keep, span = ["state", "county_id", "event_type", "event_id"], ("1993-01-01", "1997-06-30")
    shocks = t.shocks.select(*keep, "begin_on", "end_on")
    near = K.summary_of_days(stored(K.daily_sketches(shocks, "begin_on", keep), "days"), *span)
    own = shocks.filter(F.col("begin_on").between(*[F.lit(x).cast("date") for x in span]))
    exact = {c: own.select(c).distinct().select(F.count(c)).scalar() for c in keep}
    within = [(F.abs(F.col(f"n_{c}") - n) <= 4 * K.relative_error() * n).alias(f"{c}_within") for c, n in exact.items()]
    return near.select("n_rows", "first_time", "last_time", "n_years", "nulls_end_on", *within)


@query("calendar_fill", "SELECT * FROM filled", "filled")
def _(t):
    return filled(t)


@query("calendar_fill_own_span", "SELECT * FROM spanned", "spanned")
def _(t):
    return spanned(t).drop("t", "months")


@query("combo_series", "SELECT m.* FROM monthly m SEMI JOIN chosen c USING (state, event_type)", "monthly", "chosen")
def _(t):
    return S.combo_series(monthly(t), chosen(t))


@query("series_summary", """
  SELECT state, event_type, sum(n)::BIGINT AS total, round(avg(n), 6) AS avg_per_month, max(n) AS max_in_month,
         count(*) AS span_months, round(sum(n) / (count(*) / 12), 6) AS avg_per_year,
         any_value(array_to_string(peak_months, ', ')) AS peak_months
  FROM filled JOIN peaks USING (state, event_type) GROUP BY state, event_type""", "filled", "peaks")
def _(t):
    return S.series_summary(filled(t))


@query("peak_months", "SELECT state, event_type, array_to_string(peak_months, ', ') AS peak_months FROM peaks", "peaks")
def _(t):
    return S.peak_months(filled(t)).withColumn("peak_months", F.array_join("peak_months", ", "))


view("yearly", "SELECT state, event_type, year(month) AS year, sum(n) AS total FROM spanned GROUP BY ALL", "spanned")
view("combo_trend", """
  SELECT state, event_type, slope, p, r2,
         CASE WHEN slope IS NULL THEN 'insufficient_data' WHEN p < 0.05 AND slope > 0 THEN 'increasing' WHEN p < 0.05 THEN 'decreasing'
              ELSE 'stable' END AS trend
  FROM (SELECT *, CASE WHEN r2 >= 1 THEN 0 ELSE 1 - CASE n - 2 WHEN 1 THEN 2 / pi() * th WHEN 2 THEN sin(th) WHEN 3 THEN 2 / pi() * (th + sin(th) * cos(th))
                         WHEN 4 THEN sin(th) * (1 + cos(th) ** 2 / 2)
                         WHEN 5 THEN 2 / pi() * (th + sin(th) * (cos(th) + 2.0::DOUBLE / 3 * cos(th) ** 3)) END END AS p
        FROM (SELECT *, CASE WHEN r2 < 1 THEN atan(sqrt(r2 * (n - 2) / (1 - r2)) / sqrt((n - 2)::DOUBLE)) END AS th
              FROM (SELECT state, event_type, count(*) AS n, CASE WHEN count(*) >= 3 THEN regr_slope(total, year) END AS slope,
                           CASE WHEN count(*) >= 3 THEN CASE WHEN var_pop(total) = 0 THEN 0 ELSE regr_r2(total, year) END END AS r2
                    FROM yearly GROUP BY ALL)))""", "yearly")


@query("trend_test", """
  SELECT state, event_type, round(slope, 6) AS slope, round(r2, 8) AS r_squared, round(p, 4) AS p_value, trend
  FROM combo_trend""", "combo_trend")
def _(t):
    out = S.trend_test(spanned(t), S.KEYS, "month", F.col("n"))
    return out.select(*S.KEYS, F.round("slope", 6).alias("slope"), F.round("r_squared", 8).alias("r_squared"), F.round("p_value", 4).alias("p_value"), "trend")


@query("linear_trend", """
  SELECT state, event_type, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM full_line""", "full_line")
def _(t):
    return P.linear_trend(filled(t))


@query("seasonal_index", """
  SELECT state, event_type, position, round(idx, 6) AS seasonal_index FROM full_season""", "full_season")
def _(t):
    return P.seasonal_index(filled(t))


@query("trend_seasonal_forecast", "SELECT * FROM ahead_out", "ahead_out")
def _(t):
    return ahead(t)


@query("trend_direction", """
  SELECT state, event_type, round(slope, 4) AS slope,
         CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction
  FROM full_line""", "full_line")
def _(t):
    return P.trend_direction(filled(t))


@query("direction_counts", """
  SELECT CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction,
         count(*) AS n FROM full_line GROUP BY ALL""", "full_line")
def _(t):
    return P.direction_counts(P.trend_direction(filled(t)))


@query("exp_smoothing", """
  SELECT state, event_type, step::INT AS step, (last + to_months((step + 1)::INT))::DATE AS month, round(level, 6) AS predicted
  FROM (SELECT state, event_type, max(month) AS last,
               list_reduce(list(n::DOUBLE ORDER BY t), lambda s, y: 0.3 * y + 0.7 * s, max(CASE WHEN t = 0 THEN n::DOUBLE END)) AS level
        FROM filled GROUP BY ALL) CROSS JOIN (SELECT unnest(range(72)) AS step)""", "filled")
def _(t):
    return P.exp_smoothing(filled(t))


@query("seasonal_mean_forecast", """
  SELECT state, event_type, step, month, trend, round(value, 6) AS predicted,
         round(coalesce(greatest(0, value - 1.96 * dev), 0), 6) AS lower, round(value + 1.96 * dev, 6) AS upper
  FROM (SELECT state, event_type, step, a.month, trend, dev,
               mean + CASE WHEN trend IN ('increasing', 'decreasing') THEN round_even(slope, 2) * step / 12 ELSE 0 END AS value
        FROM (SELECT state, event_type, step::INT AS step, (max(month) + to_months(step::INT))::DATE AS month
              FROM spanned CROSS JOIN (SELECT unnest(range(1, 13)) AS step) GROUP BY state, event_type, step HAVING count(*) >= 12) a
        JOIN (SELECT state, event_type, month(month) AS m, round_even(avg(n), 2) AS mean, round_even(stddev_samp(n), 2) AS dev
              FROM spanned GROUP BY ALL) s USING (state, event_type)
        JOIN combo_trend USING (state, event_type) WHERE s.m = month(a.month))""", "spanned", "combo_trend")
def _(t):
    return P.seasonal_mean_forecast(spanned(t))


@query("holdout_score", "SELECT * FROM held_score", "held_score")
def _(t):
    return P.holdout_score(filled(t))


@query("best_worst_combo", """
  (SELECT 'best' AS kind, mae, state, event_type FROM held_score ORDER BY mae, state, event_type LIMIT 1)
  UNION ALL (SELECT 'worst', mae, state, event_type FROM held_score ORDER BY mae DESC, state DESC, event_type DESC LIMIT 1)""",
       "held_score")
def _(t):
    return P.best_worst_combo(P.holdout_score(filled(t)))


@query("model_scores", "SELECT state, event_type, model, mae, rmse FROM scores", "scores")
def _(t):
    return P.model_scores(filled(t)).drop("priority")


@query("best_model", "SELECT * FROM best", "best")
def _(t):
    return P.best_model(P.model_scores(filled(t)))


@query("leaderboard", """
  SELECT model, round(avg(mae), 6) AS mean_mae, count(*) AS n_series, count(*) FILTER (WHERE model = best_model) AS wins,
         round(count(*) FILTER (WHERE model = best_model) * 100.0::DOUBLE / count(*), 6) AS win_pct
  FROM scores JOIN best USING (state, event_type)
  JOIN (SELECT state, event_type FROM filled WHERE t >= months - 12 GROUP BY ALL HAVING sum(n) > 0) USING (state, event_type)
  GROUP BY model""", "scores", "best", "filled")
def _(t):
    f = filled(t)
    scores = P.model_scores(f)
    return P.leaderboard(scores, P.best_model(scores), P.zero_holdouts(f))


@query("model_forecasts", "SELECT * FROM outlooks", "outlooks")
def _(t):
    return P.model_forecasts(filled(t))


@query("winning_forecast", "SELECT * FROM winning", "winning")
def _(t):
    f = filled(t)
    return P.winning_forecast(f, P.best_model(P.model_scores(f)))


@query("annual_forecast", """
  SELECT state, event_type, round(avg(predicted) * 12, 6) AS annual_forecast FROM ahead_out WHERE step < 12 GROUP BY ALL""",
       "ahead_out")
def _(t):
    return P.annual_forecast(ahead(t))


@query("next12_peak", """
  SELECT state, event_type, avg_next_12, month AS peak_month, predicted AS peak_predicted, upper AS peak_upper
  FROM (SELECT *, round(avg(predicted) OVER (PARTITION BY state, event_type), 3) AS avg_next_12,
               row_number() OVER (PARTITION BY state, event_type ORDER BY predicted DESC, month) AS r
        FROM ahead_out WHERE step < 12) WHERE r = 1""", "ahead_out")
def _(t):
    return P.next12_peak(ahead(t))


@query("month_risk_profile", """
  SELECT state, event_type, m AS month, monthname(make_date(2000, m, 1)) AS month_name, a AS avg_count,
         CASE WHEN a >= 2 THEN 'high' WHEN a >= 1 THEN 'moderate' WHEN a >= 0.5 THEN 'low' ELSE 'minimal' END AS risk_level
  FROM (SELECT state, event_type, month(month)::INT AS m, round_even(avg(n), 2)::DOUBLE AS a FROM filled GROUP BY ALL)""", "filled")
def _(t):
    return P.month_risk_profile(filled(t))


@query("season_split", """
  SELECT state, event_type, round(coalesce(avg(predicted) FILTER (WHERE list_contains(peak_months, monthname(month))), 0), 4) AS avg_peak,
         round(coalesce(avg(predicted) FILTER (WHERE NOT list_contains(peak_months, monthname(month))), 0), 4) AS avg_off
  FROM ahead_out JOIN peaks USING (state, event_type) GROUP BY state, event_type""", "ahead_out", "peaks")
def _(t):
    return P.season_split(filled(t), ahead(t))


@query("forecast_table", """
  SELECT * REPLACE (array_to_string(peak_months, ', ') AS peak_months) FROM forecast_table""", "forecast_table")
def _(t):
    return P.forecast_table(filled(t)).withColumn("peak_months", F.array_join("peak_months", ", "))
