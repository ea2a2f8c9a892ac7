"""Registered queries: cleaning, joins around shocks and the window impact."""

from __future__ import annotations

from shockspan.operators import impact as I
from shockspan.plans.registry import query, view

view("places", """
  SELECT c_custkey, lpad(i, 3, '0') AS county_code, lpad(c_nationkey::VARCHAR, 2, '0') || lpad(i, 3, '0') AS county_id,
         upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' (County)' AS area, n_name AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN (VALUES ('AUTOMOBILE', '0'), ('BUILDING', '1'), ('FURNITURE', '2'), ('HOUSEHOLD', '3'), ('MACHINERY', '4')) s(seg, i)
    ON c_mktsegment = seg""")
view("shocks", """
  SELECT o_orderkey AS event_id, o_orderstatus AS level, o_orderpriority AS event_type,
         o_orderpriority || ' ' || year(o_orderdate) AS title, county_id, county_code, area, state,
         o_orderdate::DATE AS begin_on,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + (o_orderkey % 30)::INT END AS end_on
  FROM orders JOIN places ON o_custkey = c_custkey""", "places")
view("majors", "SELECT * FROM shocks WHERE level = 'F' AND county_code <> '000'", "shocks")
view("jobs", """
  SELECT o_custkey AS person_id, l_orderkey, l_linenumber, county_id, area, state, p_brand AS industry, p_name AS title, s_name AS company,
         o_orderdate::DATE AS started_on, CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE END AS ended_on
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN places ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""", "places")
view("person_jobs", """
  SELECT title, started_on, ended_on, coalesce(ended_on::VARCHAR, CASE WHEN l_linenumber % 2 = 0 THEN '' END) AS ended_at,
         CASE WHEN (l_orderkey + l_linenumber) % 13 <> 0 THEN county_id END AS county_id,
         CASE WHEN (l_orderkey + l_linenumber) % 13 <> 0 THEN area END AS locality,
         CASE WHEN (l_orderkey + l_linenumber) % 13 <> 0 THEN state END AS region,
         CASE WHEN (l_orderkey + l_linenumber) % 17 <> 0 THEN company END AS company,
         CASE WHEN (l_orderkey + l_linenumber) % 17 <> 0 AND (l_orderkey + l_linenumber) % 19 <> 0 THEN industry END AS industry
  FROM jobs""", "jobs")
view("exits", "SELECT * FROM jobs WHERE ended_on IS NOT NULL", "jobs")
view("edges", """
  SELECT DISTINCT county_id, begin_on, w AS window_num, p1::DATE AS p1, p2::DATE AS p2,
         (p1 - INTERVAL 2 YEAR)::DATE AS b1, (p2 - INTERVAL 2 YEAR)::DATE AS b2,
         (p1 - INTERVAL 3 YEAR)::DATE AS c1, (p2 - INTERVAL 3 YEAR)::DATE AS c2
  FROM (SELECT county_id, begin_on, w, begin_on + to_months(m1) AS p1, begin_on + to_months(m2) AS p2
        FROM majors, (VALUES (1, 0, 6), (2, 6, 12), (3, 12, 18)) v(w, m1, m2))""", "majors")
view("hits", """
  SELECT e.county_id, e.begin_on, e.window_num, x.industry,
         count(*) FILTER (WHERE ended_on >= p1 AND ended_on < p2) AS post_exits,
         count(*) FILTER (WHERE ended_on >= b1 AND ended_on < b2) AS baseline_yr2_exits,
         count(*) FILTER (WHERE ended_on >= c1 AND ended_on < c2) AS baseline_yr3_exits
  FROM edges e JOIN exits x ON e.county_id = x.county_id AND x.ended_on >= c1 AND x.ended_on < p2
  GROUP BY ALL""", "edges", "exits")
view("impact", """
  SELECT event_id, county_id, begin_on, event_type, title, area, state, industry, window_num,
         post_exits, baseline_yr2_exits, baseline_yr3_exits,
         (baseline_yr2_exits + baseline_yr3_exits)::DOUBLE / 2 AS baseline_exits,
         post_exits - (baseline_yr2_exits + baseline_yr3_exits)::DOUBLE / 2 AS excess_exits
  FROM majors JOIN hits USING (county_id, begin_on)
  WHERE post_exits + baseline_yr2_exits + baseline_yr3_exits > 0""", "majors", "hits")
view("industry_map", """
  SELECT p_brand AS industry, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS sector
  FROM (SELECT p_brand, p_type, n, sum(n) OVER (PARTITION BY p_brand) AS total,
               row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r
        FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL))
  WHERE r = 1 AND n * 9 >= total * 2""")
view("sectored", """
  SELECT impact.*, coalesce(sector, 'Other') AS sector FROM impact LEFT JOIN industry_map USING (industry)""",
     "impact", "industry_map")


def impact_of(t):
    return I.window_impact(t.majors, t.exits)


def counts_stage(t):
    """The counts of all windows side by side: a third of the rows, for queries that read them more than once."""
    return t.stage("impact", lambda: I.impact_counts(t.majors, t.exits, carry=I.CARRY))


def impact_stage(t):
    """The impact facts for queries that read them more than once, spread as they are read."""
    return I.spread_windows(counts_stage(t))


@query("window_impact", "SELECT * FROM impact", "impact")
def _(t):
    return impact_of(t)


@query("excess_by", """
  SELECT window_num, event_type, round(avg(excess_exits), 6) AS mean_excess, count(*) AS n_rows
  FROM impact GROUP BY ALL""", "impact")
def _(t):
    return I.excess_by(impact_of(t), "window_num", "event_type")
