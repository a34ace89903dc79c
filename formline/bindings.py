"""The driver's tables seen as the tables of the entity-form schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import POSITION_CODES

SEGMENT_POSITIONS = {"AUTOMOBILE": "PG", "BUILDING": "SG", "FURNITURE": "SF", "HOUSEHOLD": "PF", "MACHINERY": "C"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def game_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity and event from ``events``."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    codes = list(POSITION_CODES)
    position = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("user_id") % 5 + 1).cast("int"))
    sides = F.array(*[F.lit(s) for s in ("view", "error", "click", "purchase", "signup")])
    return rows.select(
        F.col("user_id").alias("player_id"),
        F.concat(F.lit("Player "), F.col("user_id").cast("string")).alias("player_name"),
        position.alias("position"),
        F.col("event_id").alias("game_id"),
        F.col("ts").alias("game_date"),
        F.to_date("ts").alias("game_day"),
        F.weekofyear("ts").cast("int").alias("season"),
        F.element_at(sides, (F.col("user_id") % 5 + 1).cast("int")).alias("team_abbrev"),
        F.col("event_type").alias("opponent_abbrev"),
        (F.col("event_id") % 2).cast("int").alias("home_game"),
        F.when(F.col("event_id") % 3 == 0, "W").when(F.col("event_id") % 3 == 1, "L").alias("result"),
        F.col("value").alias("pts"),
        *[(F.col("k") % m).cast("double").alias(c) for c, m in (("reb", 15), ("ast", 11), ("stl", 4), ("blk", 3))],
        F.when(F.col("k") % 17 != 0, F.col("k") % 50).cast("double").alias("minutes"),
        *[(F.col("k") % m).cast("double").alias(c) for c, m in (("tov", 7), ("fga", 20), ("fta", 9))],
        *[
            ((F.col("k") % m).cast("double") / F.lit(float(m))).alias(c)
            for c, m in (("fg_pct", 8), ("fg3_pct", 5), ("ft_pct", 10))
        ],
        F.when(F.col("event_id") % 4 == 0, 0).otherwise(1).cast("int").alias("gs"),
    )


GAME_LOGS_SQL = """
game_logs as (
  select user_id as player_id, 'Player ' || user_id::varchar as player_name,
    ['PG','SG','SF','PF','C'][(user_id % 5 + 1)::int] as position,
    event_id as game_id, ts as game_date, ts::date as game_day, week(ts)::int as season,
    ['view','error','click','purchase','signup'][(user_id % 5 + 1)::int] as team_abbrev,
    event_type as opponent_abbrev, (event_id % 2)::int as home_game,
    case when event_id % 3 = 0 then 'W' when event_id % 3 = 1 then 'L' end as result,
    value as pts, (k % 15)::double as reb, (k % 11)::double as ast, (k % 4)::double as stl, (k % 3)::double as blk,
    case when k % 17 <> 0 then (k % 50)::double end as minutes,
    (k % 7)::double as tov, (k % 20)::double as fga, (k % 9)::double as fta,
    (k % 8)::double / 8 as fg_pct, (k % 5)::double / 5 as fg3_pct, (k % 10)::double / 10 as ft_pct,
    (case when event_id % 4 = 0 then 0 else 1 end)::int as gs
  from (select *, json_extract_string(props, '$.k')::int as k from events))"""


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per side and event from ``orders``; dates have ties."""
    result = F.when(F.col("o_orderstatus") == "F", "W").when(F.col("o_orderstatus") == "O", "L")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        F.col("o_orderdate").alias("game_date"),
        F.year("o_orderdate").cast("int").alias("season"),
        F.col("o_custkey").alias("team_id"),
        F.col("o_orderpriority").alias("opponent_abbrev"),
        (F.col("o_orderkey") % 2).cast("int").alias("home_game"),
        result.alias("result"),
        F.col("o_totalprice").alias("value"),
    )


SCHEDULE_SQL = """
schedule as (
  select o_orderkey as game_id, o_orderdate as game_date, year(o_orderdate)::int as season, o_custkey as team_id,
    o_orderpriority as opponent_abbrev, (o_orderkey % 2)::int as home_game,
    case o_orderstatus when 'F' then 'W' when 'O' then 'L' end as result, o_totalprice as value
  from orders)"""


def team_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings per (side, week) from ``events``."""
    rows = table(spark, sf_dir, "events").withColumn("season", F.weekofyear("ts").cast("int"))
    return rows.groupBy(F.col("event_type").alias("team_abbrev"), "season").agg(
        F.round(F.avg("value"), 6).alias("team_def_rating"),
        F.round(F.max("value"), 6).alias("team_pace"),
        F.round(F.min("value"), 6).alias("team_off_rating"),
    )


TEAM_STATS_SQL = """
team_stats as (
  select event_type as team_abbrev, week(ts)::int as season, round(avg(value), 6) as team_def_rating,
    round(max(value), 6) as team_pace, round(min(value), 6) as team_off_rating
  from events group by 1, 2)"""


def side_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule rows with a matchup text from ``events``."""
    sides = F.array(*[F.lit(s) for s in ("view", "error", "click", "purchase", "signup")])
    mine = F.element_at(sides, (F.col("user_id") % 5 + 1).cast("int"))
    mark = F.when(F.col("event_id") % 2 == 1, " vs. ").otherwise(" @ ")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("game_id"),
        F.col("ts").alias("game_date"),
        F.to_date("ts").alias("game_day"),
        F.weekofyear("ts").cast("int").alias("season"),
        F.col("user_id").alias("team_id"),
        mine.alias("team_abbrev"),
        F.concat(mine, mark, F.col("event_type")).alias("matchup"),
    )


SIDE_SCHEDULE_SQL = """
side_schedule as (
  select event_id as game_id, ts as game_date, ts::date as game_day, week(ts)::int as season, user_id as team_id,
    ['view','error','click','purchase','signup'][(user_id % 5 + 1)::int] as team_abbrev,
    ['view','error','click','purchase','signup'][(user_id % 5 + 1)::int]
      || (case when event_id % 2 = 1 then ' vs. ' else ' @ ' end) || event_type as matchup
  from events)"""


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with name and position from ``customer``."""
    position = F.col("c_mktsegment")
    chain = None
    for segment, code in SEGMENT_POSITIONS.items():
        chain = F.when(position == segment, code) if chain is None else chain.when(position == segment, code)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), chain.alias("pos"), F.col("c_nationkey").alias("nation")
    )


ROSTER_SQL = """
roster as (
  select c_custkey as id, c_name as name,
    case c_mktsegment when 'AUTOMOBILE' then 'PG' when 'BUILDING' then 'SG' when 'FURNITURE' then 'SF'
      when 'HOUSEHOLD' then 'PF' when 'MACHINERY' then 'C' end as pos, c_nationkey as nation
  from customer)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text names from ``part``: many people share a last name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("person_name"))


def tied_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings with many ties from ``supplier``."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("side"),
        F.col("s_nationkey").alias("period"),
        F.when(F.col("s_suppkey") % 11 != 0, F.floor(F.col("s_acctbal") / F.lit(2500.0))).cast("double").alias("rating"),
    )


TIED_RATINGS_SQL = """
tied as (
  select s_suppkey as side, s_nationkey as period,
    case when s_suppkey % 11 <> 0 then floor(s_acctbal / 2500.0)::double end as rating
  from supplier)"""
