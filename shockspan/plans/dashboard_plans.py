"""Registered queries: chart shapes and generated texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from shockspan.functions import phrases as T
from shockspan.operators import dashboard as D
from shockspan.operators import export as E
from shockspan.operators import forecast as P
from shockspan.operators import narrative as N
from shockspan.operators import series as S
from shockspan.operators import serving as V
from shockspan.operators.series import KEYS
from shockspan.plans import series_plans as SP
from shockspan.plans.registry import query, view
from shockspan.plans.serving_plans import asia, outlook, regions, scenarios

CURVE = ", ".join(f"({m})" for m in D.CURVE_MONTHS)
RULES = {"prom": ["Events", "Sponsoring"], "stand": ["Norms", "Audits", "Testing"], "o": ["Retail", "Outlet"]}


def sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("displacement_curve", f"""
  SELECT event_type, county_id, sector, m AS month,
         CASE WHEN m < 0 THEN 0
              WHEN job_loss_pct IS NOT NULL THEN CASE WHEN m = 0 THEN -job_loss_pct
                WHEN m >= coalesce(recovery_months, 12) THEN 0
                ELSE round(-job_loss_pct * (1 - m / coalesce(recovery_months, 12)), 1) END
              WHEN m <= peak_month THEN round(job_change_pct * (m / peak_month::DOUBLE), 1)
              WHEN m >= peak_month * 2 + 6 THEN 0
              ELSE round(job_change_pct * (1 - (m - peak_month::DOUBLE) / (peak_month::DOUBLE * 2 + 6 - peak_month::DOUBLE)), 1)
         END::DOUBLE AS value
  FROM scenarios CROSS JOIN (VALUES {CURVE}) v(m)""", "scenarios")
def _(t):
    return D.displacement_curve(scenarios(t))


@query("risk_band", """
  SELECT event_type, county_id, sector, coalesce(job_loss_pct, 0) AS job_loss_pct, coalesce(job_change_pct, 0) AS demand_increase_pct,
         CASE WHEN job_loss_pct > 25 THEN 'High' WHEN job_loss_pct > 10 THEN 'Medium' ELSE 'Low' END AS risk_score,
         CASE WHEN recovery_months > 0 THEN '~' || recovery_months::INT || ' months' WHEN peak_month > 0 THEN 'Peaks month ' || peak_month
              ELSE 'Unknown' END AS recovery_time FROM scenarios""", "scenarios")
def _(t):
    return D.risk_band(scenarios(t))


@query("pivot_suggestions", f"""
  SELECT event_type, county_id, sector, unnest(s) AS suggestion, (unnest(range(len(s))))::INT AS position
  FROM (SELECT event_type, county_id, sector, CASE {" ".join(f"WHEN contains(lower(sector), '{k}') THEN {sql_list(v)}" for k, v in RULES.items())}
               ELSE {sql_list(D.DEFAULT_PIVOTS)} END AS s FROM scenarios)""", "scenarios")
def _(t):
    rows = scenarios(t).select("event_type", "county_id", "sector")
    return D.pivot_suggestions(rows, "sector", RULES)


@query("ranked_sectors", """
  SELECT * FROM (SELECT event_type, county_id, sector, greatest(l, g) AS magnitude,
           row_number() OVER (PARTITION BY event_type, county_id ORDER BY greatest(l, g) DESC, sector)::INT AS rank,
           row_number() OVER (PARTITION BY event_type, county_id ORDER BY l DESC, sector) = 1 AND l > 0 AS biggest_loss,
           row_number() OVER (PARTITION BY event_type, county_id ORDER BY g DESC, sector) = 1 AND g > 0 AS biggest_surge
    FROM (SELECT *, coalesce(job_loss_pct, 0) AS l, coalesce(job_change_pct, 0) AS g FROM scenarios)) WHERE rank <= 5""", "scenarios")
def _(t):
    return D.ranked_sectors(scenarios(t))


view("chart", """
  SELECT state, event_type, month, 0 AS part, n::DOUBLE AS historical, NULL::DOUBLE AS forecast, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper
  FROM filled
  UNION ALL SELECT state, event_type, month, 1, n, n, n, n FROM filled WHERE t = months - 1
  UNION ALL SELECT state, event_type, month, 2, NULL, round(predicted, 2), round(lower, 2), round(upper, 2) FROM ahead_out""",
     "filled", "ahead_out")


@query("chart_series", "SELECT * FROM chart", "chart")
def _(t):
    return D.chart_series(SP.filled(t), SP.ahead(t))


@query("chart_meta", """
  SELECT h.state, h.event_type, data_start, data_end, forecast_start, forecast_end, horizon, total_historical, cv_mae, cv_rmse, train_months
  FROM (SELECT state, event_type, min(month) AS data_start, max(month) AS data_end FROM filled GROUP BY ALL) h
  JOIN (SELECT state, event_type, min(month) AS forecast_start, max(month) AS forecast_end, count(*) AS horizon FROM ahead_out GROUP BY ALL) f
    USING (state, event_type) JOIN forecast_table USING (state, event_type)""", "filled", "ahead_out", "forecast_table")
def _(t):
    return D.chart_meta(SP.filled(t), SP.ahead(t), P.forecast_table(SP.filled(t)))


@query("slider_table", """
  SELECT event_type, month, state, count, kind FROM (
    SELECT event_type, month, state, n::DOUBLE AS count, 'historical' AS kind FROM filled
    UNION ALL SELECT event_type, month, state, predicted, 'forecast' FROM ahead_out)""", "filled", "ahead_out")
def _(t):
    wide = D.slider_table(SP.filled(t), SP.ahead(t))
    return wide.select("event_type", "month", F.explode("states").alias("state", "v")).select("event_type", "month", "state", "v.count", "v.kind")


@query("log_floor", """
  SELECT state, event_type, month, part, CASE WHEN historical IS NOT NULL THEN greatest(historical, 0.1) END AS historical,
         CASE WHEN forecast IS NOT NULL THEN greatest(forecast, 0.1) END AS forecast,
         CASE WHEN lower IS NOT NULL THEN greatest(lower, 0.1) END AS lower,
         CASE WHEN upper IS NOT NULL THEN greatest(upper, 0.1) END AS upper FROM chart""", "chart")
def _(t):
    return D.log_floor(D.chart_series(SP.filled(t), SP.ahead(t)), ["historical", "forecast", "lower", "upper"])


@query("map_extent", """
  WITH pts AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'major' ELSE 'other' END AS severity_class,
                      c_acctbal / 250 AS lat, o_totalprice / 4000 - 60 AS lng FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT severity_class, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east, count(*) AS n FROM pts GROUP BY ALL
  UNION ALL SELECT 'all', min(lat), max(lat), min(lng), max(lng), count(*) FROM pts""")
def _(t):
    points = t.table("orders").join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.when(F.col("o_orderstatus") == "F", "major").otherwise("minor").alias("severity"),
        (F.col("c_acctbal") / 250).alias("lat"), (F.col("o_totalprice") / 4000 - 60).alias("lng"),
    )
    return D.map_extent(points)


# ---- texts ----------------------------------------------------------------

def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RECORD = "(SELECT year(first) || '–' || year(last) FROM calendar)"
AHEAD_YEARS = "(SELECT year(min(month)) || '–' || year(max(month)) FROM ahead_out)"
LAST_MONTH = "(SELECT strftime(max(month), '%B %Y') FROM ahead_out)"
LABEL = "array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def label(c):
    return LABEL.format(c=c)


def num(c, d):
    return f"printf('%.{d}f', round_even({c}, {d}))"


view("impact_texts", f"""
  SELECT event_type || '_' || county_id AS id, event_type, county_id, any_value(region) AS region,
         printf({quoted(T.IMPACT_OPENING)}, replace(event_type, '_', ' '), any_value(region), county_id) || string_agg(line, ' ' ORDER BY sector_rank) AS text
  FROM (SELECT event_type, county_id, sector_rank,
               CASE WHEN job_loss_pct IS NOT NULL
                    THEN printf({quoted(T.IMPACT_LOSS)}, sector, job_loss_pct::INT, round_even(abs(window_1_pct), 0)::INT,
                                round_even(abs(window_2_pct), 0)::INT, round_even(abs(window_3_pct), 0)::INT)
                    ELSE printf({quoted(T.IMPACT_GAIN)}, sector, job_change_pct::INT, peak_month) END AS line
        FROM scenarios WHERE sector_rank <= 6) JOIN regions_of USING (county_id) GROUP BY event_type, county_id""", "scenarios", "regions_of")


@query("impact_text", "SELECT * FROM impact_texts", "impact_texts")
def _(t):
    return N.impact_text(scenarios(t), regions(t))


view("prediction_texts", f"""
  SELECT state, event_type,
         printf({quoted(T.PREDICTION_TITLE)}, {label('event_type')}, printf({quoted(T.STATE_REGION)}, state, any_value(n_counties))) || chr(10)
         || printf({quoted(T.PREDICTION_SUMMARY)}, printf({quoted(T.STATE_SUMMARY)}, {label('event_type')}, any_value(n_counties), state)) || chr(10)
         || {quoted(T.PREDICTION_HEADING)} || chr(10)
         || string_agg(CASE WHEN job_loss_pct IS NOT NULL THEN printf({quoted(T.PREDICTION_LOSS)}, sector, job_loss_pct::VARCHAR, recovery_months::INT::VARCHAR)
                            ELSE printf({quoted(T.PREDICTION_GAIN)}, sector, job_change_pct::VARCHAR, peak_month::VARCHAR) END, chr(10) ORDER BY sector) AS prediction_text
  FROM by_state GROUP BY state, event_type""", "by_state")


@query("prediction_text", "SELECT * FROM prediction_texts", "prediction_texts")
def _(t):
    return N.state_prediction_text(E.rollup_state(scenarios(t)))


view("forecast_texts", f"""
  SELECT state, event_type,
         printf({quoted(T.FORECAST_TITLE)}, {label('event_type')}, state) || chr(10)
         || printf({quoted(T.FORECAST_HISTORY)}, total_historical, state, {RECORD}, (train_months // 12)::INT) || chr(10)
         || printf({quoted(T.FORECAST_PEAKS)}, array_to_string(peak_months, ', ')) || chr(10)
         || printf({quoted(T.FORECAST_WINDOW)}, peak_months[1] || '–' || peak_months[3]) || chr(10)
         || printf({quoted(T.FORECAST_AHEAD)}, {AHEAD_YEARS}, {num('avg_next_12', 1)}) || chr(10)
         || printf({quoted(T.FORECAST_TOP)}, strftime(month, '%Y-%m'), {num('predicted', 1)}, {num('upper', 1)}) || chr(10)
         || printf({quoted(T.FORECAST_ACCURACY)}, {num('cv_mae', 2)}, {RECORD}) AS forecast_text
  FROM forecast_table JOIN (SELECT state, event_type, month, predicted, upper,
                                   row_number() OVER (PARTITION BY state, event_type ORDER BY predicted DESC, month) AS r
                            FROM ahead_out WHERE step < 12) USING (state, event_type) WHERE r = 1""", "forecast_table", "ahead_out", "calendar")


def forecast_blocks(t):
    f = SP.filled(t)
    return N.forecast_text(f, SP.ahead(t), P.forecast_table(f))


@query("forecast_text", "SELECT * FROM forecast_texts", "forecast_texts")
def _(t):
    return forecast_blocks(t)


WINDOW = "monthname(make_date(2000, list_min(ms)::INT, 1)) || '–' || monthname(make_date(2000, list_max(ms)::INT, 1))"
view("seasonal_texts", f"""
  SELECT 'forecast_' || state || '_' || replace(event_type, ' ', '_') AS id, state, event_type,
         array_to_string([
           printf({quoted(T.PROFILE_TITLE)}, state, event_type),
           printf({quoted(T.PROFILE_PAST)}, state, format('{{:,}}', total_historical), lower(event_type), {RECORD},
                  round_even(train_months / 12, 0)::INT, {num('active', 1)},
                  'Activity peaks in ' || peak_months[1] || ', ' || peak_months[2] || ', and ' || peak_months[3], {WINDOW}),
           printf({quoted(T.PROFILE_FORECAST_HEADING)}, {num('cv_mae', 2)}) || chr(10)
             || printf({quoted(T.PROFILE_FORECAST)}, lower(event_type), state, {LAST_MONTH}, array_to_string(peak_months, ', '),
                       {num('avg_peak', 1)}, {num('avg_off', 1)}),
           {quoted(T.PROFILE_WORKFORCE_HEADING)} || chr(10)
             || printf({quoted(T.PROFILE_WORKFORCE)}, lower(event_type), state, {quoted(T.INDUSTRIES_DEFAULT)}, state, {WINDOW}),
           {quoted(T.PROFILE_NOTE)}], chr(10) || chr(10)) AS text
  FROM (SELECT *, list_transform(peak_months, lambda p: list_position(
                 ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'], p)) AS ms
        FROM forecast_table)
  JOIN (SELECT state, event_type, avg(n) FILTER (WHERE n > 0) AS active FROM filled GROUP BY ALL) USING (state, event_type)
  JOIN (SELECT state, event_type, round(coalesce(avg(predicted) FILTER (WHERE list_contains(peak_months, monthname(month))), 0), 4) AS avg_peak,
               round(coalesce(avg(predicted) FILTER (WHERE NOT list_contains(peak_months, monthname(month))), 0), 4) AS avg_off
        FROM ahead_out JOIN peaks USING (state, event_type) GROUP BY state, event_type) USING (state, event_type)""",
     "forecast_table", "filled", "ahead_out", "peaks", "calendar")


def seasonal_profiles(t):
    f, a = SP.filled(t), SP.ahead(t)
    return N.seasonal_text(f, a, P.forecast_table(f), P.season_split(f, a))


@query("seasonal_text", "SELECT * FROM seasonal_texts", "seasonal_texts")
def _(t):
    return seasonal_profiles(t)


@query("circular_season", """
  SELECT state, event_type, CASE WHEN len = 0 THEN monthname(make_date(2000, start, 1))
         ELSE monthname(make_date(2000, start, 1)) || '–' || monthname(make_date(2000, (start + len - 1) % 12 + 1, 1)) END AS season
  FROM (SELECT state, event_type, min(len) AS len, arg_min(start, len * 100 + start) AS start FROM (
    SELECT a.state, a.event_type, a.m AS start, max((b.m - a.m + 12) % 12)::INT AS len
    FROM (SELECT state, event_type, month(strptime(unnest(peak_months) || ' 2000', '%B %Y'))::INT AS m FROM peaks) a
    JOIN (SELECT state, event_type, month(strptime(unnest(peak_months) || ' 2000', '%B %Y'))::INT AS m FROM peaks) b
      ON a.state = b.state AND a.event_type = b.event_type GROUP BY ALL) GROUP BY state, event_type)""", "peaks")
def _(t):
    return S.peak_months(SP.filled(t)).select(*KEYS, N.circular_window(F.col("peak_months")).alias("season"))


@query("comparison_text", f"""
  SELECT b.state, b.event_type, array_to_string([
      printf({quoted(T.COMPARISON_TITLE)}, b.state, b.event_type, {RECORD}) || chr(10)
        || printf({quoted(T.COMPARISON_KEYS)}, b.state, b.event_type) || chr(10)
        || printf({quoted(T.COMPARISON_TOTAL)}, total, (SELECT years FROM calendar)::INT, {num('total / (SELECT years FROM calendar)', 1)},
                  CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END) || chr(10)
        || printf({quoted(T.COMPARISON_PEAKS)}, peaks),
      {quoted(T.COMPARISON_PATTERN)} || chr(10) || pattern,
      printf({quoted(T.COMPARISON_OUTLOOK)}, upper(best_model[1]) || best_model[2:], {num('best_mae', 2)}, {num('base_mae', 2)}) || chr(10) || outlook,
      {quoted(T.COMPARISON_NOTE)}], chr(10) || chr(10)) AS text
  FROM best b
  JOIN (SELECT state, event_type, mae AS base_mae FROM scores WHERE model = 'trend_seasonal') USING (state, event_type)
  JOIN (SELECT state, event_type, slope FROM full_line) USING (state, event_type)
  JOIN (SELECT state, event_type, sum(n)::BIGINT AS total FROM filled GROUP BY ALL) USING (state, event_type)
  JOIN (SELECT state, event_type, string_agg(strftime(month, '%b %Y') || '=' || {num('predicted', 1)}, ', ' ORDER BY step) AS outlook
        FROM winning GROUP BY ALL) USING (state, event_type)
  JOIN (SELECT state, event_type, array_to_string(list(monthname(make_date(2000, m, 1)) ORDER BY idx DESC, position DESC)[1:3], ', ') AS peaks,
               string_agg(printf({quoted(T.COMPARISON_MONTH)}, monthname(make_date(2000, m, 1)),
                 CASE WHEN idx >= 2 THEN 'HIGH' WHEN idx >= 1 THEN 'moderate' WHEN idx >= 0.5 THEN 'low' ELSE 'minimal' END, {num('idx', 2)}),
                 chr(10) ORDER BY position) AS pattern
        FROM (SELECT state, event_type, position::INT AS position, ((position + month(first) - 1) % 12 + 1)::INT AS m, idx FROM train_season, calendar)
        GROUP BY ALL) USING (state, event_type)""",
       "best", "scores", "full_line", "filled", "winning", "train_season", "calendar")
def _(t):
    f = SP.filled(t)
    scores = P.model_scores(f)
    totals = f.groupBy(*KEYS).agg(F.sum("n").alias("total"), F.min("month").alias("first"), F.max("month").alias("last"))
    return N.comparison_text(P.trend_fit(P.training(f)), P.best_model(scores), scores, P.trend_direction(f), P.winning_forecast(f, P.best_model(scores)), totals, "trend_seasonal")


view("ranked", """
  SELECT kind, sector, pct, months, row_number() OVER (PARTITION BY kind ORDER BY pct DESC, sector) AS i FROM (
    SELECT 'loss' AS kind, sector, avg(job_loss_pct) AS pct, avg(recovery_months) AS months FROM scenarios
    WHERE job_loss_pct IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'surge', sector, avg(job_change_pct), avg(peak_month) FROM scenarios WHERE job_change_pct IS NOT NULL GROUP BY ALL)""",
     "scenarios")


def q(pattern):
    return quoted(pattern)
view("text_sectors", f"""
  SELECT {q(T.RANKING_TITLE % '')} || chr(10) || chr(10) || {q(T.RANKING_LOSS_HEADING)} || chr(10)
         || (SELECT string_agg(printf({q(T.RANKING_LOSS)}, i, sector, {num('pct', 0)}, {num('months', 0)} || ' months'), chr(10) ORDER BY i) FROM ranked WHERE kind = 'loss')
         || chr(10) || chr(10) || {q(T.RANKING_SURGE_HEADING)} || chr(10)
         || (SELECT string_agg(printf({q(T.RANKING_SURGE)}, i, sector, {num('pct', 0)}, 'month ' || {num('months', 0)}), chr(10) ORDER BY i) FROM ranked WHERE kind = 'surge')
         AS text""", "ranked")
view("text_risk", f"""
  SELECT {q(T.RISK_TITLE % 10)} || chr(10) || {q(T.RISK_SUBTITLE)} || chr(10) || chr(10)
         || string_agg(printf({q(T.RISK_LINE)}, i, state, sector, {label('event_type')}) || chr(10)
            || printf({q(T.RISK_DETAIL)}, avg_loss_pct::VARCHAR, avg_recovery::VARCHAR, freq_per_month::VARCHAR, risk_score::VARCHAR), chr(10) ORDER BY i) AS text
  FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, state, sector, event_type) AS i FROM risks)""", "risks")
view("text_portfolio", f"""
  SELECT printf({q(T.PORTFOLIO_TITLE)}, {label("'3-medium'")}, (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'))
         || chr(10) || chr(10)
         || string_agg(printf({q(T.PORTFOLIO_LINE)}, sector, avg_loss::VARCHAR, worst_loss::VARCHAR, avg_recovery::VARCHAR, states_covered, 5), chr(10)
                       ORDER BY avg_loss DESC, sector) AS text FROM holdings""", "holdings")
view("text_variance", f"""
  SELECT {q(T.VARIANCE_TITLE)} || chr(10) || chr(10)
         || string_agg(printf({q(T.VARIANCE_LINE)}, i, sector, avg_recovery::VARCHAR, range_months::VARCHAR, band, n_data_points), chr(10) ORDER BY i) AS text
  FROM (SELECT *, row_number() OVER (ORDER BY range_months DESC, sector) AS i FROM spreads)""", "spreads")
view("text_surge", f"""
  SELECT {q(T.SURGE_TITLE % '')} || chr(10) || chr(10)
         || string_agg(printf({q(T.SURGE_LINE)}, sector, avg_surge::VARCHAR, ' (' || {label('event_type')} || ')', {num('avg_peak', 0)}, n_states), chr(10) ORDER BY i) AS text
  FROM (SELECT *, row_number() OVER (ORDER BY avg_surge DESC, sector, event_type) AS i FROM surges)""", "surges")
view("text_preposition", f"""
  SELECT {q(T.PREPOSITION_TITLE % 10)} || chr(10) || {q(T.PREPOSITION_SUBTITLE)} || chr(10) || chr(10)
         || string_agg(printf({q(T.PREPOSITION_LINE)}, i, state, {label('event_type')}, ', peak: ' || peaks) || chr(10)
            || printf({q(T.PREPOSITION_DETAIL)}, freq::VARCHAR, avg_loss::VARCHAR, priority_score::VARCHAR), chr(10) ORDER BY i) AS text
  FROM (SELECT *, row_number() OVER (ORDER BY priority_score DESC, state, event_type) AS i FROM positions)""", "positions")


RANKINGS = ["sectors", "risk", "portfolio", "variance", "surge", "preposition"]


@query("ranking_text", " UNION ALL ".join(f"SELECT '{k}' AS kind, text FROM (SELECT * FROM text_{k})" for k in RANKINGS),
       *[f"text_{k}" for k in RANKINGS])
def _(t):
    rows, ahead = scenarios(t), outlook(t)
    texts = [
        N.sector_ranking_text(V.sector_ranking(rows)),
        N.top_risk_text(V.top_risk(rows, ahead)),
        N.portfolio_text(V.portfolio(rows, asia(t), "3-medium"), asia(t), "3-medium"),
        N.variance_text(V.recovery_variance(rows)),
        N.surge_text(V.demand_surge(rows)),
        N.preposition_text(V.preposition(rows, ahead)),
    ]
    parts = [df.select(F.lit(k).alias("kind"), "text") for k, df in zip(RANKINGS, texts)]
    return reduce(lambda a, b: a.unionByName(b), parts)
