"""Views that give the star-schema tables the roles the operators expect.

Orders play the shocks (state = nation, county = nation x market segment, level
and type from status and priority); line items play the jobs (industry = brand,
ended on the ship date once the line is finished).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockspan.functions.columns import first_match, type_key
from shockspan.operators.impact import county_key, major_only
from shockspan.session import stored

# Segment codes in alphabetical order; 000 plays the statewide row.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
MAJOR = "F"


class Tables:
    """Lazy access to one folder of tables and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._stages: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that a query reads more than once: computed and written once."""
        if name not in self._stages:
            self._stages[name] = stored(build(), name)
        return self._stages[name]

    @cached_property
    def places(self) -> DataFrame:
        """Customer -> place columns."""
        code = first_match([(F.col("c_mktsegment") == s, F.lit(str(i))) for i, s in enumerate(SEGMENTS)], F.lit("999"))
        return (
            self.table("customer")
            .select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                "c_custkey",
                F.lpad(code, 3, "0").alias("county_code"),
                county_key(F.col("c_nationkey"), code).alias("county_id"),
                F.concat(F.initcap("c_mktsegment"), F.lit(" (County)")).alias("area"),
                F.col("n_name").alias("state"),
                "n_regionkey",
            )
        )

    @cached_property
    def shocks(self) -> DataFrame:
        begin = F.col("o_orderdate").cast("date")
        return (
            self.table("orders")
            .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
            .join(self.places, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_orderkey").alias("event_id"),
                F.col("o_orderstatus").alias("level"),
                F.col("o_orderpriority").alias("event_type"),
                F.concat_ws(" ", "o_orderpriority", F.year("o_orderdate")).alias("title"),
                "county_id", "county_code", "area", "state",
                begin.alias("begin_on"),
                F.when(
                    F.col("o_orderkey") % 7 != 0, F.date_add(begin, (F.col("o_orderkey") % 30).cast("int"))
                ).alias("end_on"),
            )
        )

    @cached_property
    def majors(self) -> DataFrame:
        return major_only(self.shocks, MAJOR)

    @cached_property
    def homes(self) -> DataFrame:
        """Order -> begin and place columns."""
        return (
            self.table("orders")
            .select("o_orderkey", "o_custkey", "o_orderdate")
            .join(self.places, F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "o_custkey", "o_orderdate", "county_id", "area", "state")
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with their part."""
        return (
            self.table("lineitem")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate")
            .join(self.table("part").select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        )

    def jobs_of(self, lines: DataFrame, *more: str) -> DataFrame:
        """Lines as jobs. Orders get their places first, so lines meet them once, by order, and stay dealt by it."""
        return lines.join(self.homes, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("person_id"),
            "county_id", "area", "state",
            F.col("p_brand").alias("industry"),
            F.col("p_name").alias("title"),
            "l_orderkey", "l_linenumber", "l_suppkey",
            F.col("o_orderdate").cast("date").alias("started_on"),
            F.when(F.col("l_linestatus") == MAJOR, F.col("l_shipdate").cast("date")).alias("ended_on"),
            *more,
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """Every line as a job; still active ones have no end."""
        return self.jobs_of(self.lines)

    @cached_property
    def exits(self) -> DataFrame:
        """Finished jobs; the two-column filter reaches the line item scan."""
        return self.jobs.filter(F.col("ended_on").isNotNull())

    @cached_property
    def exit_places(self) -> DataFrame:
        """Places of finished jobs, without the joins that only their other columns need."""
        return (
            self.table("lineitem")
            .filter((F.col("l_linestatus") == MAJOR) & F.col("l_shipdate").isNotNull())
            .select("l_orderkey")
            .join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select("o_custkey")
            .distinct()
            .join(self.places, F.col("o_custkey") == F.col("c_custkey"))
            .select("county_id")
        )

    @cached_property
    def persons(self) -> DataFrame:
        """Jobs nested per person, the shape of a raw employment history.

        An order is a person with its few lines as jobs. Running jobs have no end or
        an empty one; some jobs lack the place, the company or the industry.
        """
        suppliers = self.table("supplier").select("s_suppkey", "s_name")
        rows = self.jobs_of(self.lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")), "s_name")
        turn = F.col("l_orderkey") + F.col("l_linenumber")
        place = F.struct("county_id", F.col("area").alias("locality"), F.col("state").alias("region"))
        company = F.struct(F.col("s_name").alias("name"), F.when(turn % 19 != 0, F.col("industry")).alias("industry"))
        job = F.struct(
            F.col("title"),
            F.col("started_on").cast("string").alias("started_at"),
            F.coalesce(F.col("ended_on").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(""))).alias("ended_at"),
            F.when(turn % 13 != 0, place).alias("location_details"),
            F.when(turn % 17 != 0, company).alias("company"),
        )
        return rows.groupBy(F.col("l_orderkey").alias("person_id")).agg(F.collect_list(job).alias("jobs"))

    @cached_property
    def industry_map(self) -> DataFrame:
        """Industry -> sector: the brand's leading part type where it leads clearly."""
        n = self.table("part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
        lead = n.groupBy("p_brand").agg(
            F.min(F.struct((-F.col("n")).alias("m"), "p_type")).alias("lead"), F.sum("n").alias("total")
        )
        clear = lead.filter(-F.col("lead.m") * 9 >= F.col("total") * 2)
        return self.stage(
            "industry-map",
            lambda: clear.select(F.col("p_brand").alias("industry"), F.initcap(F.col("lead.p_type")).alias("sector")),
        )

    @cached_property
    def regions(self) -> DataFrame:
        """Region -> its states."""
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.lower("r_name").alias("region_name"), F.col("n_name").alias("state"))
        )

    @cached_property
    def canonical_shocks(self) -> DataFrame:
        return self.shocks.withColumn("event_type", type_key(F.col("event_type")))
