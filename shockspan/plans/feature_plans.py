"""Registered queries: filters and joins around shocks, and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockspan.functions import phrases, places
from shockspan.functions.columns import half_even
from shockspan.operators import features as X
from shockspan.operators import impact as I
from shockspan.plans.impact_plans import counts_stage, impact_of, impact_stage
from shockspan.plans.registry import query, view
from shockspan.sources.tables import MAJOR


def rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


def sectored(t):
    return X.map_lookup(impact_stage(t), t.industry_map, "industry", "sector", "Other")


def sector_exits(t):
    return X.map_lookup(t.exits.select("county_id", "state", "industry", "ended_on"), t.industry_map, "industry", "sector", "Other")


view("sector_exits", """
  SELECT exits.*, coalesce(sector, 'Other') AS sector FROM exits LEFT JOIN industry_map USING (industry)""", "exits", "industry_map")
view("sector_impact", """
  SELECT *, (baseline_yr2_exits + baseline_yr3_exits)::DOUBLE / 2 AS baseline_exits,
         post_exits - (baseline_yr2_exits + baseline_yr3_exits)::DOUBLE / 2 AS excess_exits
  FROM (SELECT event_id, county_id, begin_on, event_type, title, area, state, sector, window_num,
               sum(post_exits)::BIGINT AS post_exits, sum(baseline_yr2_exits)::BIGINT AS baseline_yr2_exits,
               sum(baseline_yr3_exits)::BIGINT AS baseline_yr3_exits FROM sectored GROUP BY ALL)""", "sectored")


@query("county_key", """
  SELECT c_custkey, lpad(c_nationkey::VARCHAR, 2, '0') || CASE WHEN length(c_custkey::VARCHAR) >= 3 THEN c_custkey::VARCHAR
         ELSE lpad(c_custkey::VARCHAR, 3, '0') END AS county_id FROM customer""")
def _(t):
    return t.table("customer").select("c_custkey", I.county_key(F.col("c_nationkey"), F.col("c_custkey")).alias("county_id"))


@query("major_only", "SELECT * FROM majors", "majors")
def _(t):
    return I.major_only(t.shocks, MAJOR)


@query("flatten_exits", """
  SELECT county_id, industry, company, title, started_on, ended_on, locality, region, date_trunc('month', ended_on)::DATE AS end_month
  FROM person_jobs WHERE ended_at <> '' AND county_id IS NOT NULL AND company IS NOT NULL AND industry IS NOT NULL""", "person_jobs")
def _(t):
    return I.flatten_exits(t.persons)


@query("dedup_shocks", """
  SELECT event_type, county_id, min(begin_on) AS begin_on,
         arg_min(event_id, (begin_on, event_id)) AS event_id FROM shocks GROUP BY ALL""", "shocks")
def _(t):
    return I.dedup_shocks(t.shocks.select("event_type", "county_id", "begin_on", "event_id"), ("event_type", "county_id"))


@query("overlap_filter", """
  SELECT * FROM majors WHERE county_id IN (SELECT county_id FROM exits)""", "majors", "exits")
def _(t):
    return I.overlap_filter(t.majors, t.exit_places)


@query("prior_shocks", """
  SELECT a.event_id, a.county_id, a.begin_on, count(DISTINCT b.event_id) AS prior_shocks,
         (count(DISTINCT b.event_id) > 0)::INT AS recently_hit
  FROM majors a LEFT JOIN majors b ON a.county_id = b.county_id AND a.event_id <> b.event_id
       AND b.begin_on < a.begin_on AND b.begin_on >= a.begin_on - INTERVAL 2 YEAR
  GROUP BY a.event_id, a.county_id, a.begin_on""", "majors")
def _(t):
    return X.prior_shocks(t.majors)


@query("decayed_exposure", """
  SELECT a.event_id, a.county_id, a.begin_on,
         round(coalesce(sum(exp(-datediff('day', b.begin_on, a.begin_on) / 365.0::DOUBLE)), 0), 6) AS exposure_weighted
  FROM majors a LEFT JOIN majors b ON a.county_id = b.county_id AND a.event_id <> b.event_id
       AND b.begin_on < a.begin_on AND b.begin_on >= a.begin_on - INTERVAL 2 YEAR
  GROUP BY a.event_id, a.county_id, a.begin_on""", "majors")
def _(t):
    return rounded(X.decayed_exposure(t.majors), "exposure_weighted")


view("offsets", """
  SELECT k.event_id, k.county_id, k.begin_on, k.industry,
         (year(x.ended_on) - year(k.begin_on)) * 12 + month(x.ended_on) - month(k.begin_on) AS m
  FROM (SELECT DISTINCT event_id, county_id, begin_on, industry FROM impact) k
  LEFT JOIN exits x ON x.county_id = k.county_id AND x.industry = k.industry
       AND x.ended_on >= date_trunc('month', k.begin_on) AND x.ended_on < date_trunc('month', k.begin_on) + INTERVAL 6 MONTH""",
     "impact", "exits")
MONTH_COUNTS = ", ".join(f"count(*) FILTER (WHERE m = {i}) AS exits_month_{i + 1}" for i in range(6))
view("month_offsets", f"SELECT event_id, county_id, begin_on, industry, {MONTH_COUNTS} FROM offsets GROUP BY ALL", "offsets")


@query("exits_by_month_offset", "SELECT * FROM month_offsets", "month_offsets")
def _(t):
    return I.exits_by_month_offset(I.impact_keys(t.majors, t.exits), t.exits)


PEAK = """
  SELECT event_id, county_id, begin_on, industry, {months},
         CASE WHEN top = 0 THEN 0 ELSE list_position(all6, top) END::INT AS peak_exit_month, top AS peak_exits,
         (top > 0 AND list_position(all6, top) <= 2)::INT AS immediate_impact
  FROM (SELECT *, [{months}] AS all6, greatest({months}) AS top FROM month_offsets)""".format(
    months=", ".join(f"exits_month_{i}" for i in range(1, 7)))


@query("peak_features", PEAK, "month_offsets")
def _(t):
    return X.peak_features(I.exits_by_month_offset(I.impact_keys(t.majors, t.exits), t.exits))


@query("duration_join", """
  SELECT event_id, county_id, begin_on, end_on, duration_days, round(ln(1 + duration_days), 6) AS log_duration
  FROM (SELECT m.*, greatest(0, coalesce(end_on - begin_on, (SELECT median(end_on - begin_on) FROM majors)))::DOUBLE AS duration_days
        FROM majors m)""", "majors")
def _(t):
    return rounded(X.duration_days(t.majors.select("event_id", "county_id", "begin_on"), t.majors), "log_duration")


@query("map_lookup", """
  SELECT p_partkey, p_brand AS industry, coalesce(sector, 'Other') AS sector FROM part LEFT JOIN industry_map ON p_brand = industry""",
       "industry_map")
def _(t):
    parts = t.table("part").select("p_partkey", F.col("p_brand").alias("industry"))
    return X.map_lookup(parts, t.industry_map, "industry", "sector", "Other").select("p_partkey", "industry", "sector")


def case_sql(table, of, default):
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


@query("map_lookup_prefix_to_state", f"""
  SELECT c_custkey, county_id, {case_sql(places.STATE_PREFIXES, "county_id[1:2]", "''")} AS state FROM places""", "places")
def _(t):
    rows = t.places.select("c_custkey", "county_id", F.substring("county_id", 1, 2).alias("prefix"))
    return X.map_lookup(rows, places.state_dimension(t.spark), "prefix", "state", "").select("c_custkey", "county_id", "state")


@query("map_lookup_state_to_name", f"""
  SELECT o_orderkey, code, {case_sql(places.STATE_NAMES, "code", "code")} AS state_name
  FROM (SELECT o_orderkey, {case_sql(places.STATE_PREFIXES, "lpad((o_custkey % 60)::VARCHAR, 2, '0')", "'??'")} AS code FROM orders)""")
def _(t):
    prefix = F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0")
    rows = t.table("orders").select("o_orderkey", prefix.alias("prefix"))
    rows = X.map_lookup(rows, places.state_dimension(t.spark).withColumnRenamed("state", "code"), "prefix", "code", "??").drop("prefix")
    names = t.spark.createDataFrame(list(places.STATE_NAMES.items()), "code string, state_name string")
    found = X.map_lookup(rows, names, "code", "state_name", "")
    return found.withColumn("state_name", F.when(F.col("state_name") == "", F.col("code")).otherwise(F.col("state_name")))


@query("map_lookup_type_to_industries", f"""
  SELECT event_id, event_type, {case_sql(phrases.INDUSTRIES, "event_type", f"'{phrases.INDUSTRIES_DEFAULT}'")} AS industries
  FROM (SELECT event_id, (['hurricane', 'severe_storm', 'flood', 'fire', 'tornado', 'snowstorm', 'severe_ice_storm', 'other'])[user_id % 8 + 1] AS event_type
        FROM events)""")
def _(t):
    kinds = F.array(*[F.lit(k) for k in ("hurricane", "severe_storm", "flood", "fire", "tornado", "snowstorm", "severe_ice_storm", "other")])
    rows = t.table("events").select("event_id", F.element_at(kinds, (F.col("user_id") % 8 + 1).cast("int")).alias("event_type"))
    words = t.spark.createDataFrame(list(phrases.INDUSTRIES.items()), "event_type string, industries string")
    return X.map_lookup(rows, words, "event_type", "industries", phrases.INDUSTRIES_DEFAULT).select("event_id", "event_type", "industries")


@query("map_lookup_industry_to_sector", f"""
  SELECT p_partkey, industry, {case_sql(places.INDUSTRY_SECTORS, "industry", "'Other'")} AS sector
  FROM (SELECT p_partkey, ({list(places.INDUSTRY_SECTORS) + ["Unknown Trade"]})[p_partkey % {len(places.INDUSTRY_SECTORS) + 1} + 1] AS industry FROM part)""")
def _(t):
    names = F.array(*[F.lit(k) for k in [*places.INDUSTRY_SECTORS, "Unknown Trade"]])
    rows = t.table("part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % (len(places.INDUSTRY_SECTORS) + 1) + 1).cast("int")).alias("industry"))
    return X.map_lookup(rows, places.sector_dimension(t.spark), "industry", "sector", places.OTHER_SECTOR).select("p_partkey", "industry", "sector")


TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ONEHOT = ", ".join(f"(event_type = '{v}')::INT AS \"type_{v}\"" for v in TYPES)


@query("onehot", f"SELECT event_id, event_type, {ONEHOT} FROM shocks", "shocks")
def _(t):
    shocks = t.shocks.select("event_id", "event_type")
    return X.onehot(shocks, "event_type", TYPES, "type")


@query("category_code", """
  SELECT industry, (dense_rank() OVER (ORDER BY industry) - 1)::INT AS industry_code FROM (SELECT DISTINCT industry FROM exits)""", "exits")
def _(t):
    return X.category_code(t.exits, "industry", "industry_code")


@query("temporal_features", """
  SELECT event_id, begin_on, month(begin_on)::INT AS shock_month, quarter(begin_on)::INT AS shock_quarter,
         year(begin_on)::INT AS shock_year, round(sin(2 * pi() * month(begin_on) / 12), 6) AS month_sin,
         round(cos(2 * pi() * month(begin_on) / 12), 6) AS month_cos FROM shocks""", "shocks")
def _(t):
    return rounded(X.temporal_features(t.shocks.select("event_id", "begin_on")), "month_sin", "month_cos")


FACT = ["event_id", "county_id", "industry", "window_num"]


@query("scale_features", """
  SELECT event_id, county_id, industry, window_num,
         round(CASE WHEN baseline_exits > 0 THEN post_exits / baseline_exits ELSE post_exits END, 6) AS exit_ratio,
         round(ln(1 + baseline_exits), 6) AS log_baseline,
         (baseline_exits > (SELECT median(baseline_exits) FROM impact))::INT AS high_turnover FROM impact""", "impact")
def _(t):
    out = X.scale_features(impact_stage(t)).select(*FACT, "exit_ratio", "log_baseline", "high_turnover")
    return rounded(out, "exit_ratio", "log_baseline")


@query("target_mean", """
  SELECT event_id, county_id, industry, window_num, sector,
         round(avg(excess_exits) OVER (PARTITION BY industry), 6) AS industry_vulnerability,
         round(avg(excess_exits) OVER (PARTITION BY sector), 6) AS sector_vulnerability FROM sectored""", "sectored")
def _(t):
    out = X.target_mean(X.target_mean(sectored(t), "industry", "industry_vulnerability"), "sector", "sector_vulnerability")
    out = out.select(*FACT, "sector", "industry_vulnerability", "sector_vulnerability")
    return rounded(out, "industry_vulnerability", "sector_vulnerability")


@query("target_mean_out_of_fold", """
  SELECT a.event_id, a.county_id, a.industry, a.window_num, a.fold, round(o.m, 6) AS industry_vulnerability
  FROM (SELECT *, event_id % 5 AS fold FROM impact) a
  JOIN (SELECT k.industry, f.fold, avg(i.excess_exits) AS m
        FROM (SELECT DISTINCT industry FROM impact) k CROSS JOIN (SELECT unnest(range(5)) AS fold) f
        JOIN impact i ON i.industry = k.industry AND i.event_id % 5 <> f.fold GROUP BY ALL) o
    ON o.industry = a.industry AND o.fold = a.fold""", "impact")
def _(t):
    facts = impact_stage(t).withColumn("fold", F.col("event_id") % 5)
    out = X.target_mean(facts, "industry", "industry_vulnerability", fold="fold")
    return rounded(out.select(*FACT, "fold", "industry_vulnerability"), "industry_vulnerability")


@query("frequency_encode", """
  SELECT event_id, county_id, industry, window_num, count(*) OVER (PARTITION BY industry) AS industry_frequency, state_shock_frequency
  FROM impact JOIN (SELECT state, count(DISTINCT event_id) AS state_shock_frequency FROM impact GROUP BY ALL) USING (state)""", "impact")
def _(t):
    return X.frequency_encode(impact_stage(t)).select(*FACT, "industry_frequency", "state_shock_frequency")


@query("interaction_features", """
  SELECT i.event_id, i.county_id, i.industry, i.window_num, round(ln(1 + baseline_exits), 6) AS shock_x_baseline,
         round(v * ln(1 + baseline_exits), 6) AS vuln_x_baseline,
         round(ln(1 + days) * ln(1 + baseline_exits), 6) AS duration_x_baseline, round(p * v, 6) AS prior_x_vulnerability
  FROM impact i JOIN (SELECT industry, avg(excess_exits) AS v FROM impact GROUP BY ALL) USING (industry)
  JOIN (SELECT DISTINCT m.event_id, greatest(0, coalesce(end_on - begin_on,
                 (SELECT median(end_on - begin_on) FROM majors JOIN impact USING (event_id, county_id, begin_on)))) AS days
        FROM majors m) USING (event_id)
  JOIN (SELECT a.event_id, count(b.event_id) AS p FROM majors a LEFT JOIN majors b ON a.county_id = b.county_id
        AND a.event_id <> b.event_id AND b.begin_on < a.begin_on AND b.begin_on >= a.begin_on - INTERVAL 2 YEAR
        GROUP BY ALL) USING (event_id)""", "impact", "majors")
def _(t):
    facts = impact_stage(t)
    rows = X.duration_days(facts, t.majors).join(X.prior_shocks(t.majors).drop("begin_on"), X.EVENT)
    rows = X.target_mean(rows.withColumn("log_baseline", F.log1p("baseline_exits")), "industry", "industry_vulnerability")
    names = ["shock_x_baseline", "vuln_x_baseline", "duration_x_baseline", "prior_x_vulnerability"]
    return rounded(rows.select("*", *X.interaction_columns()).select(*FACT, *names), *names)


@query("concentration_features", """
  SELECT county_id, sector, n AS sector_size, round(ln(1 + n), 6) AS log_sector_size,
         round(n / sum(n) OVER (PARTITION BY county_id), 6) AS sector_concentration,
         round(sum(n * n) OVER (PARTITION BY county_id) / (sum(n) OVER (PARTITION BY county_id)) ** 2, 6) AS herfindahl_index
  FROM (SELECT county_id, sector, count(*)::DOUBLE AS n FROM sector_exits GROUP BY ALL)""", "sector_exits")
def _(t):
    out = X.concentration_features(sector_exits(t)).withColumn("sector_size", F.col("sector_size").cast("double"))
    return rounded(out, "log_sector_size", "sector_concentration", "herfindahl_index")


@query("sector_growth", """
  SELECT county_id, sector, round(CASE WHEN count(*) > 1 THEN regr_slope(n, y) ELSE 0 END, 6) AS sector_growth_trend
  FROM (SELECT county_id, sector, year(ended_on) AS y, count(*) AS n FROM sector_exits GROUP BY ALL) GROUP BY ALL""", "sector_exits")
def _(t):
    return rounded(X.sector_growth(sector_exits(t)), "sector_growth_trend")


@query("type_sector_displacement", """
  SELECT event_id, county_id, industry, window_num, sector,
         round(avg(excess_exits) OVER (PARTITION BY event_type, sector), 6) AS type_sector_avg_displacement,
         count(*) OVER (PARTITION BY sector) AS sector_frequency, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS type_code
  FROM sectored""", "sectored")
def _(t):
    names = ["sector", "type_sector_avg_displacement", "sector_frequency", "type_code"]
    return rounded(X.type_sector_displacement(sectored(t)).select(*FACT, *names), "type_sector_avg_displacement")


@query("to_sector_level", "SELECT * FROM sector_impact", "sector_impact")
def _(t):
    return I.to_sector_level(sectored(t))


@query("nlargest_facts", """
  SELECT title, industry, window_num, post_exits, baseline_exits, excess_exits, event_id FROM impact
  ORDER BY excess_exits DESC, event_id, industry, window_num LIMIT 10""", "impact")
def _(t):
    return (
        impact_of(t).orderBy(F.desc("excess_exits"), "event_id", "industry", "window_num").limit(10)
        .select("title", "industry", "window_num", "post_exits", "baseline_exits", "excess_exits", "event_id")
    )


PROFILED = ["window_num", "baseline_exits", "post_exits", "exit_ratio", "log_baseline"]
TYPED = {"window_num": "int", "post_exits": "bigint"}
PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{TYPED.get(c, 'double')}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(avg({c}), 6) AS mean, "
    + (f"round(stddev_samp({c}), 6) AS std, min({c}) AS low, max({c}) AS high FROM profiled" if c == "excess_exits"
       else "NULL::DOUBLE AS std, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM profiled")
    for c in [*PROFILED, "excess_exits"])
view("profiled", """
  SELECT *, CASE WHEN baseline_exits > 0 THEN post_exits / baseline_exits ELSE post_exits END AS exit_ratio,
         ln(1 + baseline_exits) AS log_baseline FROM impact""", "impact")


@query("feature_profile", PROFILE, "profiled")
def _(t):
    return rounded(X.feature_profile(X.scale_features(impact_stage(t)), PROFILED, "excess_exits"), "mean", "std")


@query("distinct_keys", "SELECT DISTINCT event_type, county_id, begin_on FROM shocks", "shocks")
def _(t):
    return t.shocks.select("event_type", "county_id", "begin_on").dropDuplicates()


@query("key_union", "SELECT county_id FROM majors UNION SELECT county_id FROM exits", "majors", "exits")
def _(t):
    return t.majors.select("county_id").union(t.exits.select("county_id")).distinct()


@query("key_intersect", "SELECT county_id FROM majors INTERSECT SELECT county_id FROM exits", "majors", "exits")
def _(t):
    return t.majors.select("county_id").intersect(t.exits.select("county_id"))


@query("key_except", "SELECT county_id FROM exits EXCEPT SELECT county_id FROM majors", "majors", "exits")
def _(t):
    return t.exits.select("county_id").subtract(t.majors.select("county_id"))


def r6(*exprs):
    return ", ".join(f"round_even({e}, 6) AS {n}" for n, e in (x.split("=", 1) for x in exprs))


view("shock_history", """
  SELECT a.event_id, a.county_id, count(b.event_id) AS prior_shocks, (count(b.event_id) > 0)::INT AS recently_hit,
         coalesce(sum(exp(-datediff('day', b.begin_on, a.begin_on) / 365.0::DOUBLE)), 0) AS exposure_weighted
  FROM majors a LEFT JOIN majors b ON a.county_id = b.county_id AND a.event_id <> b.event_id
       AND b.begin_on < a.begin_on AND b.begin_on >= a.begin_on - INTERVAL 2 YEAR
  GROUP BY a.event_id, a.county_id""", "majors")
view("shock_durations", """
  SELECT event_id, county_id, end_on, greatest(0, coalesce(end_on - begin_on,
           (SELECT median(end_on - begin_on) FROM majors JOIN impact USING (event_id, county_id, begin_on))))::DOUBLE AS duration_days
  FROM majors""", "majors", "impact")
view("place_stats", """
  SELECT county_id, sector, sum(n)::BIGINT AS sector_size, ln(1 + sum(n)) AS log_sector_size,
         sum(n) / any_value(whole) AS sector_concentration, any_value(sq) / any_value(whole) ** 2 AS herfindahl_index,
         CASE WHEN count(*) > 1 THEN regr_slope(n, y) ELSE 0 END AS sector_growth_trend
  FROM (SELECT county_id, sector, year(ended_on) AS y, count(*) AS n FROM sector_exits GROUP BY ALL)
  JOIN (SELECT county_id, sum(c) AS whole, sum(c * c) AS sq FROM (SELECT county_id, sector, count(*) AS c FROM sector_exits GROUP BY ALL)
        GROUP BY county_id) USING (county_id)
  GROUP BY county_id, sector""", "sector_exits")
view("peaked", PEAK, "month_offsets")
CODES = ", ".join(f"(dense_rank() OVER (ORDER BY s.{c}) - 1)::INT AS {n}" for c, n in (
    ("industry", "industry_code"), ("sector", "sector_code"), ("event_type", "type_code"), ("state", "state_code")))
view("matrix_groups", f"""
  SELECT s.*, {CODES}, state_shock_frequency,
         avg(excess_exits) OVER (PARTITION BY industry) AS industry_vulnerability, count(*) OVER (PARTITION BY industry) AS industry_frequency,
         avg(excess_exits) OVER (PARTITION BY sector) AS sector_vulnerability, count(*) OVER (PARTITION BY sector) AS sector_frequency,
         avg(excess_exits) OVER (PARTITION BY event_type, sector) AS type_sector_avg_displacement
  FROM sectored s JOIN (SELECT state, count(DISTINCT event_id) AS state_shock_frequency FROM impact GROUP BY ALL) USING (state)""",
     "sectored", "impact")
# The sectors that brands lead to, and the one of all others.
SECTORS = ["Economy", "Large", "Medium", "Promo", "Small", "Standard", "Other"]
INDICATORS = ", ".join([f"(m.event_type = '{v}')::INT AS \"type_{v}\"" for v in TYPES] + [f"(m.sector = '{v}')::INT AS \"sector_{v}\"" for v in SECTORS])
MATRIX = f"""
  SELECT m.event_id, m.county_id, m.begin_on, m.event_type, m.title, m.area, m.state, m.industry, m.sector, m.window_num,
         post_exits, baseline_yr2_exits, baseline_yr3_exits, baseline_exits, excess_exits, end_on, duration_days, prior_shocks, recently_hit,
         {INDICATORS},
         month(m.begin_on)::INT AS shock_month, quarter(m.begin_on)::INT AS shock_quarter, year(m.begin_on)::INT AS shock_year,
         sector_size, {", ".join(f"exits_month_{i}" for i in range(1, 7))}, peak_exit_month, peak_exits, immediate_impact,
         (baseline_exits > (SELECT median(baseline_exits) FROM impact))::INT AS high_turnover,
         industry_code, sector_code, type_code, state_code, industry_frequency, sector_frequency, state_shock_frequency,
         {r6("log_duration=ln(1 + duration_days)", "exposure_weighted=exposure_weighted", "month_sin=sin(2 * pi() * month(m.begin_on) / 12)",
             "month_cos=cos(2 * pi() * month(m.begin_on) / 12)", "log_sector_size=log_sector_size", "sector_concentration=sector_concentration",
             "herfindahl_index=herfindahl_index", "sector_growth_trend=sector_growth_trend", "log_baseline=ln(1 + baseline_exits)",
             "exit_ratio=CASE WHEN baseline_exits > 0 THEN post_exits / baseline_exits ELSE post_exits END",
             "industry_vulnerability=industry_vulnerability", "sector_vulnerability=sector_vulnerability",
             "type_sector_avg_displacement=type_sector_avg_displacement", "shock_x_baseline=ln(1 + baseline_exits)",
             "vuln_x_baseline=industry_vulnerability * ln(1 + baseline_exits)",
             "duration_x_baseline=ln(1 + duration_days) * ln(1 + baseline_exits)", "prior_x_vulnerability=prior_shocks * industry_vulnerability")}
  FROM matrix_groups m JOIN shock_durations d USING (event_id, county_id) JOIN shock_history h USING (event_id, county_id)
  JOIN place_stats p USING (county_id, sector)
  JOIN peaked k ON k.event_id = m.event_id AND k.county_id = m.county_id AND k.industry = m.industry"""


def matrix(t):
    return X.feature_matrix(impact_stage(t), t.majors, t.exits, t.industry_map, types=TYPES, sectors=SECTORS, counts=counts_stage(t))


@query("feature_matrix", MATRIX, "matrix_groups", "shock_durations", "shock_history", "place_stats", "peaked", "impact")
def _(t):
    out = matrix(t)
    exact = {"baseline_exits", "excess_exits", "duration_days"}
    return out.withColumns({c: half_even(F.col(c), 6) for c, kind in out.dtypes if kind == "double" and c not in exact})
