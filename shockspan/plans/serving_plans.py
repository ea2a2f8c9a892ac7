"""Registered queries: scenario impacts, roll-ups, ranked answers, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockspan.functions.columns import type_key
from shockspan.operators import export as E
from shockspan.operators import forecast as P
from shockspan.operators import impact as I
from shockspan.operators import serving as V
from shockspan.plans import series_plans as SP
from shockspan.plans.feature_plans import sector_exits
from shockspan.plans.registry import query, view
from shockspan.session import scratch_path

TYPE = "replace(lower(event_type), ' ', '_')"

view("scen_means", """
  SELECT event_type, county_id, sector, min(state) AS state, avg(baseline_exits) AS base,
         avg(excess_exits) FILTER (WHERE window_num = 1) AS w1, avg(excess_exits) FILTER (WHERE window_num = 2) AS w2,
         avg(excess_exits) FILTER (WHERE window_num = 3) AS w3
  FROM sector_impact GROUP BY ALL""", "sector_impact")
view("scenarios", f"""
  SELECT event_type, county_id, state, sector,
         CASE WHEN ex > 0 THEN size END AS job_loss_pct, CASE WHEN ex <= 0 THEN size END AS job_change_pct,
         CASE WHEN ex > 0 THEN CASE WHEN w1 <= 0 THEN 6.0 WHEN p2 <= p1 * 0.1 THEN 12.0 ELSE 18.0 END END::DOUBLE AS recovery_months,
         CASE WHEN ex <= 0 THEN CASE WHEN w1 < w2 AND w1 < w3 THEN 3 WHEN w2 < w3 THEN 9 ELSE 15 END END AS peak_month,
         round_even(p1, 1) AS window_1_pct, round_even(p2, 1) AS window_2_pct, round_even(p3, 1) AS window_3_pct, sector_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type, county_id ORDER BY size DESC, sector)::INT AS sector_rank
        FROM (SELECT {TYPE} AS event_type, county_id, state, sector, w1, w2, w3, (w1 + w2 + w3) / 3 AS ex,
                     round_even(abs(greatest(-95, least(95, (w1 + w2 + w3) / 3 / base * 100))), 0) AS size,
                     greatest(-95, least(95, w1 / base * 100)) AS p1, greatest(-95, least(95, w2 / base * 100)) AS p2,
                     greatest(-95, least(95, w3 / base * 100)) AS p3
              FROM scen_means WHERE w1 IS NOT NULL AND w2 IS NOT NULL AND w3 IS NOT NULL AND base >= 1
                AND abs((w1 + w2 + w3) / 3 / base * 100) >= 1)) WHERE sector_rank <= 8""", "scen_means")
view("regions_of", """
  SELECT c.county_id, coalesce(f.region, 'FIPS ' || c.county_id) AS region
  FROM (SELECT DISTINCT county_id FROM shocks) c
  LEFT JOIN (SELECT county_id, arg_min(replace(replace(area, ' (County)', ' County'), ' (City)', '') || ', ' || state, event_id) AS region
             FROM sector_impact GROUP BY ALL) f USING (county_id)""", "shocks", "sector_impact")
view("outlook", f"SELECT * REPLACE ({TYPE} AS event_type) FROM forecast_table", "forecast_table")


def rollup_sql(keys: str) -> str:
    return f"""
  SELECT {keys}, CASE WHEN n_loss >= n_gain AND n_loss > 0 THEN round_even(loss, 1) END AS job_loss_pct,
         CASE WHEN n_loss >= n_gain AND n_loss > 0 THEN coalesce(round_even(rec, 0), 12) END AS recovery_months,
         CASE WHEN NOT (n_loss >= n_gain AND n_loss > 0) THEN round_even(gain, 1) END AS job_change_pct,
         CASE WHEN NOT (n_loss >= n_gain AND n_loss > 0) THEN coalesce(round_even(peak, 0), 3) END::INT AS peak_month, n_loss, n_gain
  FROM (SELECT {keys}, count(job_loss_pct) AS n_loss, count(job_change_pct) AS n_gain, avg(job_loss_pct) AS loss,
               avg(job_change_pct) AS gain, avg(recovery_months) AS rec, avg(peak_month) AS peak
        FROM scenarios GROUP BY ALL)"""


view("by_state", f"""
  SELECT * FROM ({rollup_sql('state, event_type, sector')})
  JOIN (SELECT state, event_type, count(DISTINCT county_id) AS n_counties FROM scenarios GROUP BY ALL) USING (state, event_type)""", "scenarios")
view("by_type", f"""
  SELECT * FROM ({rollup_sql('event_type, sector')})
  JOIN (SELECT event_type, count(DISTINCT county_id) AS n_counties, count(DISTINCT state) AS n_states FROM scenarios GROUP BY ALL)
    USING (event_type)""", "scenarios")
view("by_state_all", f"""
  SELECT * FROM ({rollup_sql('state, event_type')})
  JOIN (SELECT state, count(DISTINCT (event_type, county_id)) AS n_counties, count(DISTINCT event_type) AS n_types
        FROM scenarios GROUP BY ALL) USING (state)""", "scenarios")


def sector_facts(t):
    """Impact by sector: exits take their sector first, which gives the same sums as
    rolling up industry facts, over far fewer rows."""

    def build():
        facts = I.window_impact(t.majors, sector_exits(t), industry="sector")
        return facts.withColumnRenamed("industry", "sector")

    return t.stage("sector-impact", build)


def scenarios(t):
    return t.stage("scenarios", lambda: E.scenario_impact(sector_facts(t)))


def regions(t):
    return E.scenario_region(t.shocks.select("county_id").distinct(), sector_facts(t))


def outlook(t):
    table = lambda: P.forecast_table(SP.filled(t)).withColumn("event_type", type_key(F.col("event_type")))
    return t.stage("outlook", table)


@query("scenario_impact", "SELECT * FROM scenarios", "scenarios")
def _(t):
    return scenarios(t)


@query("scenario_region", "SELECT * FROM regions_of", "regions_of")
def _(t):
    return regions(t)


@query("regional_series", f"""
  SELECT county_id, state, sector, {TYPE} AS event_type, month_offset, round(sum(round_even(round(chg, 9), 1)::DECIMAL(24, 2))::DOUBLE / count(*), 8) AS job_change_count,
         round(sum(round_even(round(chg / (base / 6) * 100, 9), 1)::DECIMAL(24, 2))::DOUBLE / count(*), 8) AS job_change_pct,
         round(sum(round_even(round(CASE WHEN peak > 0 THEN greatest(0, least(1, 1 - abs(chg) / (peak / 6))) ELSE 1 END, 9), 2)::DECIMAL(24, 2))::DOUBLE / count(*), 8) AS recovery_rate
  FROM (SELECT f.*, base, peak, coalesce(x.n, 0) - base / 6 AS chg
        FROM (SELECT event_type, county_id, state, sector, ((window_num - 1) * 6 + k)::INT AS month_offset,
                     (date_trunc('month', begin_on) + to_months(((window_num - 1) * 6 + k)::INT))::DATE AS month
              FROM sector_impact CROSS JOIN (SELECT unnest(range(6)) AS k)) f
        JOIN (SELECT event_type, county_id, sector, avg(baseline_exits) AS base, max(abs(excess_exits)) AS peak
              FROM sector_impact GROUP BY ALL HAVING avg(baseline_exits) >= 1) USING (event_type, county_id, sector)
        LEFT JOIN (SELECT county_id, sector, date_trunc('month', ended_on)::DATE AS month, count(*) AS n
                   FROM sector_exits GROUP BY ALL) x
          ON x.county_id = f.county_id AND x.sector = f.sector AND x.month = f.month)
  GROUP BY ALL""", "sector_impact", "sector_exits")
def _(t):
    return E.regional_series(sector_facts(t), sector_exits(t))


@query("rollup_state", "SELECT * FROM by_state", "by_state")
def _(t):
    return E.rollup_state(scenarios(t))


@query("rollup_national", "SELECT * FROM by_type", "by_type")
def _(t):
    return E.rollup_national(scenarios(t))


@query("rollup_state_all", "SELECT * FROM by_state_all", "by_state_all")
def _(t):
    return E.rollup_state_all(scenarios(t))


@query("choose_rollup", "SELECT * FROM by_state WHERE state = 'NATION_3' AND event_type = '2-high'", "by_state")
def _(t):
    return E.choose_rollup(scenarios(t), event_type="2-high", state="NATION_3")


@query("choose_rollup_county", """
  SELECT s.* FROM scenarios s WHERE s.event_type = '3-medium' AND s.county_id = '07002'""", "scenarios")
def _(t):
    return E.choose_rollup(scenarios(t), event_type="3-medium", county_id="07002")


@query("choose_rollup_national", "SELECT * FROM by_type WHERE event_type = '5-low'", "by_type")
def _(t):
    return E.choose_rollup(scenarios(t), event_type="5-low")


@query("choose_rollup_state_all", "SELECT * FROM by_state_all WHERE state = 'NATION_4'", "by_state_all")
def _(t):
    return E.choose_rollup(scenarios(t), state="NATION_4")


view("requests", f"SELECT DISTINCT {TYPE} AS event_type, county_id, state FROM shocks", "shocks")


@query("resolve_prediction", """
  SELECT r.*, s.sector, s.job_loss_pct, s.job_change_pct, s.recovery_months, s.peak_month, 'county' AS source
  FROM requests r JOIN scenarios s ON s.event_type = r.event_type AND s.county_id = r.county_id
  UNION ALL
  SELECT r.*, s.sector, s.job_loss_pct, s.job_change_pct, s.recovery_months, s.peak_month,
         CASE WHEN s.sector IS NOT NULL THEN 'state' END
  FROM requests r LEFT JOIN by_state s ON s.event_type = r.event_type AND s.state = r.state
  WHERE NOT EXISTS (SELECT 1 FROM scenarios k WHERE k.event_type = r.event_type AND k.county_id = r.county_id)""", "scenarios", "by_state", "requests")
def _(t):
    requests = t.canonical_shocks.select("event_type", "county_id", "state").distinct()
    return E.resolve_prediction(requests, scenarios(t))


@query("risk_join", """
  SELECT s.state, s.event_type, s.county_id, s.sector, job_loss_pct, recovery_months, avg_next_12
  FROM scenarios s JOIN outlook o ON s.state = o.state AND s.event_type = o.event_type WHERE job_loss_pct IS NOT NULL""",
       "scenarios", "outlook")
def _(t):
    cols = ["state", "event_type", "county_id", "sector", "job_loss_pct", "recovery_months", "avg_next_12"]
    return V.risk_join(scenarios(t), outlook(t)).select(*cols)


def ranking_sql(where: str) -> str:
    return f"""
  SELECT 'loss' AS kind, sector, avg(job_loss_pct) AS pct, avg(recovery_months) AS months FROM scenarios
  WHERE job_loss_pct IS NOT NULL {where} GROUP BY ALL
  UNION ALL SELECT 'surge', sector, avg(job_change_pct), avg(peak_month) FROM scenarios
  WHERE job_change_pct IS NOT NULL {where} GROUP BY ALL"""


def rounded_sql(body: str) -> str:
    return f"SELECT kind, sector, round(pct, 6) AS pct, round(months, 6) AS months FROM ({body})"


def rounded(df):
    return df.select("kind", "sector", F.round("pct", 6).alias("pct"), F.round("months", 6).alias("months"))


@query("sector_ranking", rounded_sql(ranking_sql("")), "scenarios")
def _(t):
    return rounded(V.sector_ranking(scenarios(t)))


@query("sector_ranking_of_state", rounded_sql(ranking_sql("AND state = 'NATION_3' AND event_type = '1-urgent'")), "scenarios")
def _(t):
    return rounded(V.sector_ranking(scenarios(t), "NATION_3", "1-URGENT"))


view("risks", """
  SELECT s.state, s.sector, s.event_type, round(avg(job_loss_pct), 1) AS avg_loss_pct, round(avg(recovery_months), 0) AS avg_recovery,
         round(avg_next_12, 2) AS freq_per_month, round(avg(job_loss_pct) * avg_next_12, 1) AS risk_score
  FROM scenarios s JOIN outlook o ON s.state = o.state AND s.event_type = o.event_type WHERE job_loss_pct IS NOT NULL
  GROUP BY s.state, s.sector, s.event_type, avg_next_12
  ORDER BY risk_score DESC, state, sector, event_type LIMIT 10""", "scenarios", "outlook")
view("holdings", """
  SELECT sector, round(avg(job_loss_pct), 1) AS avg_loss, round(max(job_loss_pct), 1) AS worst_loss,
         round(avg(recovery_months), 0) AS avg_recovery, count(DISTINCT state) AS states_covered
  FROM scenarios WHERE event_type = '3-medium' AND job_loss_pct IS NOT NULL
    AND state IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
  GROUP BY sector""", "scenarios")
view("spreads", """
  SELECT *, CASE WHEN range_months > 9 THEN 'HIGH' WHEN range_months > 4 THEN 'MEDIUM' ELSE 'LOW' END AS band
  FROM (SELECT sector, round(avg(recovery_months), 1) AS avg_recovery,
               round(max(recovery_months) - min(recovery_months), 1) AS range_months,
               round(avg(job_loss_pct), 1) AS avg_loss, count(*) AS n_data_points
        FROM scenarios WHERE recovery_months IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)""", "scenarios")
view("surges", """
  SELECT sector, event_type, round(avg(job_change_pct), 1) AS avg_surge, round(avg(peak_month), 0) AS avg_peak,
         count(DISTINCT state) AS n_states
  FROM scenarios WHERE job_change_pct IS NOT NULL GROUP BY ALL""", "scenarios")
view("positions", """
  SELECT s.state, s.event_type, round(avg_next_12, 2) AS freq, array_to_string(peak_months[1:2], ', ') AS peaks,
         round(avg(job_loss_pct), 1) AS avg_loss, round(avg_next_12 * avg(job_loss_pct), 1) AS priority_score
  FROM outlook o JOIN scenarios s ON s.state = o.state AND s.event_type = o.event_type
  WHERE avg_next_12 > 0 AND job_loss_pct IS NOT NULL
  GROUP BY s.state, s.event_type, avg_next_12, peak_months
  ORDER BY priority_score DESC, state, event_type LIMIT 10""", "scenarios", "outlook")


@query("top_risk", "SELECT * FROM risks", "risks")
def _(t):
    return V.top_risk(scenarios(t), outlook(t))


def asia(t):
    return t.regions.filter(F.col("region_name") == "asia")


@query("portfolio", "SELECT * FROM holdings", "holdings")
def _(t):
    return V.portfolio(scenarios(t), asia(t), "3-medium")


@query("recovery_variance", "SELECT * FROM spreads", "spreads")
def _(t):
    return V.recovery_variance(scenarios(t))


@query("demand_surge", "SELECT * FROM surges", "surges")
def _(t):
    return V.demand_surge(scenarios(t))


@query("preposition", "SELECT * FROM positions", "positions")
def _(t):
    return V.preposition(scenarios(t), outlook(t))


@query("coverage_summary", """
  SELECT count(DISTINCT event_type) AS total_events, count(DISTINCT county_id) AS regions_analyzed,
         count(DISTINCT sector) AS industries_tracked FROM scenarios""", "scenarios")
def _(t):
    return V.coverage_summary(scenarios(t))


@query("list_scenarios", """
  SELECT DISTINCT event_type || '_' || county_id AS scenario, event_type, county_id, state, region
  FROM scenarios JOIN regions_of USING (county_id)""", "scenarios", "regions_of")
def _(t):
    return V.list_scenarios(scenarios(t), regions(t))


@query("filter_optional", """
  SELECT * FROM scenarios WHERE upper(state) = 'NATION_3' AND lower(sector) LIKE '%o%'""", "scenarios")
def _(t):
    return V.filter_optional(scenarios(t), {"state": "nation_3", "event_type": None}, {"sector": "O"})


@query("point_lookup", "SELECT * FROM shocks WHERE event_id = 77", "shocks")
def _(t):
    return V.point_lookup(t.shocks, "event_id", "77")


def for_lookups(df, keys):
    path = scratch_path(df.sparkSession, "lookups")
    V.write_for_lookups(df, path, keys)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("point_lookup_sorted", "SELECT * FROM shocks WHERE event_id = 77", "shocks")
def _(t):
    return V.lookup(for_lookups(t.shocks, ["event_id"]), {"event_id": "77"})


ASKED = ("5-low", "003", "NATION_3")


view("asked", f"""
  SELECT '{ASKED[0]}' AS event_type, max(county_id) AS county_id, max(state) AS state FROM scenarios WHERE event_type = '{ASKED[0]}'
  UNION ALL SELECT '{ASKED[0]}', '{ASKED[1]}', '{ASKED[2]}' UNION ALL SELECT '{ASKED[0]}', '{ASKED[1]}', 'nowhere'""", "scenarios")


@query("resolve_one", """
  SELECT a.*, s.sector, s.job_loss_pct, s.job_change_pct, s.recovery_months, s.peak_month, 'county' AS source
  FROM asked a JOIN scenarios s ON s.event_type = a.event_type AND s.county_id = a.county_id
  UNION ALL
  SELECT a.*, s.sector, s.job_loss_pct, s.job_change_pct, s.recovery_months, s.peak_month, CASE WHEN s.sector IS NOT NULL THEN 'state' END
  FROM asked a LEFT JOIN by_state s ON s.event_type = a.event_type AND s.state = a.state
  WHERE NOT EXISTS (SELECT 1 FROM scenarios k WHERE k.event_type = a.event_type AND k.county_id = a.county_id)""", "scenarios", "by_state", "asked")
def _(t):
    """A county that has its own prediction, one that has none, and one in no known state."""
    rows = scenarios(t)
    exact = for_lookups(rows, ["county_id", "event_type"])
    wider = for_lookups(E.rollup_state(rows), ["state", "event_type"])
    last = exact.filter(F.col("event_type") == ASKED[0]).agg(F.max("county_id"), F.max("state")).first()
    answers = [E.resolve_one(exact, wider, *request) for request in ((ASKED[0], *last), ASKED, (*ASKED[:2], "nowhere"))]
    return answers[0].unionByName(answers[1]).unionByName(answers[2])


@query("list_limit", "SELECT * FROM shocks ORDER BY event_id LIMIT 200", "shocks")
def _(t):
    return V.list_limit(t.shocks, "event_id")


@query("fill_defaults", """
  SELECT event_type, county_id, state, sector, coalesce(job_loss_pct, 0) AS job_loss_pct, coalesce(job_change_pct, 0) AS job_change_pct,
         coalesce(recovery_months, 0) AS recovery_months, coalesce(peak_month, 0) AS peak_month,
         window_1_pct, window_2_pct, window_3_pct, sector_rank FROM scenarios""", "scenarios")
def _(t):
    return V.fill_defaults(scenarios(t))


@query("facet_values", """
  SELECT DISTINCT 'event_type' AS facet, event_type AS value FROM scenarios
  UNION ALL SELECT DISTINCT 'state', state FROM scenarios WHERE event_type = '5-low'
  UNION ALL SELECT DISTINCT 'scenario', event_type || '_' || county_id FROM scenarios WHERE event_type = '5-low' AND state = 'NATION_7'""",
       "scenarios")
def _(t):
    return V.facet_values(scenarios(t), "5-low", "NATION_7")
