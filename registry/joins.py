"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline import bindings as B
from formline.operators import joins as J
from formline.operators.windows import average_rank
from formline.plans.dataset import positional_defense

from . import EVENTS, query, rounded, sql

ON = ["team_abbrev", "opponent_abbrev", "game_day"]

DAYS_SQL = """
days as (select team_abbrev, split_part(split_part(matchup, ' vs. ', 2) || split_part(matchup, ' @ ', 2), ' ', 1)
    as opponent_abbrev, case when season = 3 then game_day + 20000 else game_day end as game_day, game_id,
    game_id % 4 as rest_days from side_schedule),
slim as (select * exclude (i) from (select *, row_number() over (partition by team_abbrev, opponent_abbrev, game_day
  order by game_id) as i from days) where i = 1)"""


def moved_days(rows):
    """The rows of period 3 moved far ahead."""
    moved = F.date_add(F.col("game_day"), 20_000)
    return rows.withColumn("game_day", F.when(F.col("season") == 3, moved).otherwise(F.col("game_day")))


def days(spark, sf):
    """Schedule rows by calendar day; several per key, one period moved to days that no log has."""
    from formline.functions.columns import rival_from_matchup

    rows = moved_days(B.side_schedule(spark, sf)).withColumn("opponent_abbrev", rival_from_matchup("matchup"))
    return rows.select(*ON, "game_id", (F.col("game_id") % 4).alias("rest_days"))


def joined(spark, sf):
    return J.left_context(B.game_logs(spark, sf), days(spark, sf), on=ON, context=["rest_days"], order=["game_id"])


@query(
    "jn_left_context",
    sql(
        "select l.game_id, s.rest_days from game_logs l left join slim s on l.team_abbrev = s.team_abbrev "
        "and l.opponent_abbrev = s.opponent_abbrev and l.game_day = s.game_day",
        "game_logs", "side_schedule", ctes=DAYS_SQL,
    ),
)
def left_context(spark, sf):
    return joined(spark, sf).select("game_id", "rest_days")


@query(
    "jn_left_context_null_keys",
    sql(
        """
select l.game_id, r.games from (select *, case when game_id % 3 = 0 then null else result end as res from game_logs) l
left join (select res, count(*) as games from (select case when game_id % 3 = 0 then null else result end as res
  from game_logs) group by res) r on l.res is not distinct from r.res""",
        "game_logs",
    ),
)
def null_keys(spark, sf):
    rows = B.game_logs(spark, sf).select("game_id", F.when(F.col("game_id") % 3 != 0, F.col("result")).alias("res"))
    counts = rows.groupBy("res").agg(F.count("*").alias("games"))
    return J.lookup_join(rows, counts, ["res"], null_safe=True).select("game_id", "games")


@query(
    "jn_assert_many_to_one",
    sql("select team_id, game_date, count(*) as n from schedule group by 1, 2 having count(*) > 1", "schedule"),
)
def violations(spark, sf):
    return J.key_violations(B.schedule(spark, sf), ["team_id", "game_date"])


@query(
    "jn_rival_dimension",
    sql(
        "select game_id, t.team_pace as opp_pace, team_def_rating as opp_def_rating, team_off_rating as opp_off_rating "
        "from game_logs l left join team_stats t on l.opponent_abbrev = t.team_abbrev and l.season = t.season + 1",
        "game_logs", "team_stats",
    ),
)
def rival_dim(spark, sf):
    stats = B.team_stats(spark, sf).withColumn("season", F.col("season") + 1)
    logs = B.game_logs(spark, sf).select("game_id", "opponent_abbrev", "season")
    out = J.rival_dimension(logs, stats, rival="opponent_abbrev", period="season", side="team_abbrev")
    return out.drop("opponent_abbrev", "season")


@query(
    "jn_side_dimension",
    sql(
        "select game_id, team_pace from game_logs l left join team_stats t on l.team_abbrev = t.team_abbrev "
        "and l.season = t.season + 1",
        "game_logs", "team_stats",
    ),
)
def side_dim(spark, sf):
    stats = B.team_stats(spark, sf).withColumn("season", F.col("season") + 1)
    logs = B.game_logs(spark, sf).select("game_id", "team_abbrev", "season")
    return J.side_dimension(logs, stats, period="season", side="team_abbrev").select("game_id", "team_pace")


@query(
    "jn_id_to_code",
    "select c_custkey, n_name from customer left join nation on c_nationkey = case when n_nationkey < 20 then n_nationkey "
    "else n_nationkey + 100 end",
)
def id_to_code(spark, sf):
    key = F.col("n_nationkey")
    codes = B.table(spark, sf, "nation").select("n_name", F.when(key < 20, key).otherwise(key + 100).alias("c_nationkey"))
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return J.id_to_code(rows, codes, id_column="c_nationkey", code_column="n_name").drop("c_nationkey")


RATED_SQL = """
rated as (select l.*, case when l.game_id % 5 <> 0 then round(t.team_def_rating) end as opp_def_rating
  from game_logs l left join team_stats t on l.opponent_abbrev = t.team_abbrev and l.season = t.season),
firsts as (select opponent_abbrev, season, arg_min(opp_def_rating, (player_id, game_date, game_id)) as opp_def_rating
  from rated where opp_def_rating is not null group by 1, 2),
ranks as (select opponent_abbrev, season, rank() over (partition by season order by opp_def_rating)
  + (count(*) over (partition by season, opp_def_rating) - 1) / 2.0::double as opp_def_rank from firsts)"""


def rated(spark, sf):
    """Log rows with a rounded (so tied) rating of the rival, a fifth of them without."""
    stats = B.team_stats(spark, sf).select(
        F.col("team_abbrev").alias("opponent_abbrev"), "season", F.round("team_def_rating").alias("opp_def_rating")
    )
    rows = J.lookup_join(B.game_logs(spark, sf), stats, ["opponent_abbrev", "season"])
    return rows.withColumn("opp_def_rating", F.when(F.col("game_id") % 5 != 0, F.col("opp_def_rating")))


RANKED = {"rival": "opponent_abbrev", "period": "season", "rating": "opp_def_rating"}


@query(
    "jn_rank_backfill",
    sql(
        "select game_id, opp_def_rank from rated left join ranks using (opponent_abbrev, season)",
        "game_logs", "team_stats", ctes=RATED_SQL,
    ),
)
def rank_backfill(spark, sf):
    return J.rank_backfill(rated(spark, sf), **RANKED, **EVENTS).select("game_id", "opp_def_rank")


@query(
    "agg_first_non_null",
    sql("select opponent_abbrev, season, opp_def_rating from firsts", "game_logs", "team_stats", ctes=RATED_SQL),
)
def first_non_null(spark, sf):
    return J.first_rating(rated(spark, sf), **RANKED, **EVENTS)


POINTS_SQL = """
known as (select team_abbrev as opponent_abbrev, season, team_def_rating,
  avg(team_def_rating) over (partition by season) as m from team_stats),
allowed as (select season, opponent_abbrev, p.position, round_even(p.pts * (team_def_rating / m), 2)
    as pts_allowed_per_game
  from known, (values ('Point Guard', 14.8::double), ('Shooting Guard', 13.2), ('Small Forward', 12.1),
    ('Power Forward', 10.9), ('Center', 9.4)) p(position, pts)),
defense as (select *, floor(rank() over (partition by season, position order by pts_allowed_per_game)
  + (count(*) over (partition by season, position, pts_allowed_per_game) - 1) / 2.0)::int as rank from allowed)"""
DEFENSE_SQL = (
    POINTS_SQL
    + """,
holes as (select * replace (case when season = 3 and opponent_abbrev = 'click' then 'nobody' else opponent_abbrev end as
    opponent_abbrev) from defense union all
  select * from defense where season = 4 and opponent_abbrev = 'view'),
singles as (select opponent_abbrev, season, position, any_value(pts_allowed_per_game) as opp_pts_allowed_pos,
  any_value(rank)::double as rank from holes group by 1, 2, 3 having count(*) = 1),
looked as (select l.*, s.opp_pts_allowed_pos, coalesce(s.rank, 15.0::double) as opp_pos_defense_rank
  from game_logs l left join singles s on l.opponent_abbrev = s.opponent_abbrev and l.season = s.season
  and case l.position when 'PG' then 'Point Guard' when 'SG' then 'Shooting Guard' when 'SF' then 'Small Forward'
    when 'PF' then 'Power Forward' when 'C' then 'Center' else 'Small Forward' end = s.position)"""
)


def defense_with_holes(spark, sf):
    """Positional defence with some keys missing and some repeated."""
    rows = positional_defense(
        B.team_stats(spark, sf).withColumnRenamed("team_abbrev", "opponent_abbrev"), rival="opponent_abbrev"
    )
    doubled = rows.where("season = 4 and opponent_abbrev = 'view'")
    hole = (F.col("season") == 3) & (F.col("opponent_abbrev") == "click")
    return rows.withColumn("opponent_abbrev", F.when(hole, "nobody").otherwise(F.col("opponent_abbrev"))).unionByName(doubled)


def looked_up(spark, sf):
    return J.triple_lookup(
        B.game_logs(spark, sf), defense_with_holes(spark, sf), rival="opponent_abbrev", period="season", position="position"
    )


@query(
    "jn_triple_lookup_defaults",
    sql(
        "select game_id, opp_pts_allowed_pos, opp_pos_defense_rank from looked",
        "game_logs", "team_stats", ctes=DEFENSE_SQL,
    ),
)
def triple_lookup(spark, sf):
    return looked_up(spark, sf).select("game_id", "opp_pts_allowed_pos", "opp_pos_defense_rank")


@query(
    "jn_unmatched_report",
    sql(
        """
select l.team_abbrev, season, count(*) as n_unmatched from game_logs l left join slim s on
  l.team_abbrev = s.team_abbrev and l.opponent_abbrev = s.opponent_abbrev and l.game_day = s.game_day
where s.rest_days is null group by 1, 2 order by 3 desc, 1, 2 limit 10""",
        "game_logs", "side_schedule", ctes=DAYS_SQL,
    ),
)
def unmatched(spark, sf):
    return J.unmatched_report(joined(spark, sf), missing="rest_days", keys=["team_abbrev", "season"])


NAMES_SQL = """
asked as (select p_partkey as request_id, case p_partkey % 4 when 0 then upper(p_name) when 1 then 'x ' ||
    split_part(p_name, ' ', 2) when 2 then '''' || p_name else 'the ' || p_name end as request_name from part),
folk as (select p_partkey as person_id, p_name as person_name, lower(string_split(p_name, ' ')[-1]) as token,
    row_number() over (partition by lower(string_split(p_name, ' ')[-1]) order by p_partkey) as pos from part),
pairs as (select request_id, request_name, person_id, person_name, pos,
    trim(translate(lower(request_name), '''.', '')) as a, trim(translate(lower(person_name), '''.', '')) as b
  from asked join folk on lower(string_split(request_name, ' ')[-1]) = token)"""


@query(
    "jn_name_resolution",
    sql(
        """
select request_id, request_name, person_id, person_name, matched from asked left join (
  select *, a = b or contains(b, a) or contains(a, b) as matched, row_number() over (partition by request_id
    order by (a = b or contains(b, a) or contains(a, b)) desc, pos) as i from pairs) p
  using (request_id, request_name) where coalesce(i, 1) = 1""",
        ctes=NAMES_SQL,
    ),
)
def name_resolution(spark, sf):
    name, key = F.col("person_name"), F.col("person_id") % 4
    asked = B.people(spark, sf).select(
        F.col("person_id").alias("request_id"),
        F.when(key == 0, F.upper(name))
        .when(key == 1, F.concat(F.lit("x "), F.element_at(F.split(name, " "), 2)))
        .when(key == 2, F.concat(F.lit("'"), name))
        .otherwise(F.concat(F.lit("the "), name))
        .alias("request_name"),
    )
    return J.name_resolution(
        asked, B.people(spark, sf), request_id="request_id", request_name="request_name", name="person_name",
        ordinal="person_id",
    )


AS_OF = "1999-01-01"
CODES = ("GSW", "SAS", "NYK", "NOP", "LAL", "BOS")
RAW_CODES = ("gs", "SA", "ny", "NO", "LAL", "BOS")

EVENTS_SQL = """
plan as (select o_orderkey as event_id, o_custkey as team_id,
    ['GSW','SAS','NYK','NOP','LAL','BOS'][(o_custkey % 6 + 1)::int] as side,
    ['gs','SA','ny','NO','LAL','BOS'][(o_custkey % 6 + 1)::int] as raw_side, upper(o_orderpriority) as raw_rival,
    case when o_orderkey % 31 = 0 then 'TBD' else strftime(o_orderdate, '%Y-%m-%dT00:00:00') end as date from orders),
coded as (select *, case when event_id % 7 = 0 then 'MIA' when event_id % 2 = 0 then raw_side else raw_rival end as home,
    case when event_id % 7 = 0 then raw_rival when event_id % 2 = 0 then raw_rival else raw_side end as visitor,
    case when date = 'TBD' then date '2099-01-01' else date[1:10]::date end as game_date from plan),
fixed as (select *, case upper(home) when 'GS' then 'GSW' when 'SA' then 'SAS' when 'NY' then 'NYK' when 'NO' then 'NOP'
      else upper(home) end as home_code, case upper(visitor) when 'GS' then 'GSW' when 'SA' then 'SAS' when 'NY' then
      'NYK' when 'NO' then 'NOP' else upper(visitor) end as visitor_code from coded),
upcoming as (select team_id, side, event_id, game_date, case when visitor_code = side and home_code <> side then 0 else 1 end
    as home_game, case when visitor_code = side and home_code <> side then home_code else visitor_code end
    as opponent_abbrev
  from (select *, row_number() over (partition by team_id order by game_date, event_id) as i from fixed
    where game_date >= date '1999-01-01') where i = 1)"""


def raw_schedule(spark, sf):
    """Scheduled events with raw codes and text dates, some of them unreadable."""
    at, key = (F.col("o_custkey") % 6 + 1).cast("int"), F.col("o_orderkey")
    mine = F.element_at(F.array(*[F.lit(c) for c in RAW_CODES]), at)
    other = F.upper("o_orderpriority")
    return B.table(spark, sf, "orders").select(
        key.alias("event_id"),
        F.col("o_custkey").alias("team_id"),
        F.element_at(F.array(*[F.lit(c) for c in CODES]), at).alias("side"),
        F.when(key % 7 == 0, "MIA").when(key % 2 == 0, mine).otherwise(other).alias("home"),
        F.when(key % 7 == 0, other).when(key % 2 == 0, other).otherwise(mine).alias("visitor"),
        F.when(key % 31 == 0, "TBD")
        .otherwise(F.concat(F.to_date("o_orderdate").cast("string"), F.lit("T00:00:00")))
        .alias("date"),
    )


def upcoming(spark, sf):
    return J.next_event(
        raw_schedule(spark, sf), by="team_id", side="side", home="home", visitor="visitor", date_text="date",
        tiebreak="event_id", as_of=AS_OF,
    ).select("team_id", "side", "event_id", "game_date", "home_game", "opponent_abbrev")


@query(
    "jn_next_event",
    sql("select team_id, side, event_id, game_date, home_game, opponent_abbrev from upcoming", ctes=EVENTS_SQL),
)
def next_event(spark, sf):
    return upcoming(spark, sf)


REST_SQL = """
history as (select case when o_custkey % 9 = 0 or (o_custkey % 5 = 0 and o_orderdate < timestamp '1999-06-01')
    then -o_custkey else o_custkey end as team_id, o_orderdate as past_date from orders),
lasts as (select u.team_id, max(past_date) as last from upcoming u join history h on u.team_id = h.team_id
  and past_date < u.game_date group by 1),
rested as (select u.*, case when u.team_id not in (select team_id from history) then 1 when last is null then -1
    else greatest(0, date_sub('day', last, u.game_date::timestamp) - 1) end::int as rest_days, last
  from upcoming u left join lasts using (team_id))"""


def history(spark, sf):
    """Past events: some sides have none at all, some only late ones."""
    other = "o_custkey % 9 = 0 or (o_custkey % 5 = 0 and o_orderdate < timestamp_ntz '1999-06-01 00:00:00')"
    side = F.when(F.expr(other), -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return B.table(spark, sf, "orders").select(side.alias("team_id"), F.col("o_orderdate").alias("past_date"))


def rested(spark, sf):
    return J.prev_event_rest(
        upcoming(spark, sf), history(spark, sf), side="team_id", next_time="game_date", event_time="past_date"
    )


@query(
    "jn_prev_event_rest",
    sql(
        "select team_id, rest_days, last is not null and rest_days = 0 as back_to_back from rested",
        ctes=f"{EVENTS_SQL}, {REST_SQL}",
    ),
)
def prev_rest(spark, sf):
    return rested(spark, sf).select("team_id", "rest_days", "back_to_back")


YEARS = tuple(range(1995, 2002))


@query(
    "jn_missing_pairs",
    sql(
        "select team_id, y::int as season from (select distinct team_id from schedule), unnest(range(1995, 2002)) as t(y) "
        "where (team_id, y) not in (select (team_id, season) from schedule)",
        "schedule",
    ),
)
def missing_pairs(spark, sf):
    rows = B.schedule(spark, sf)
    return J.missing_pairs(rows, rows, YEARS, entity="team_id", period="season")


@query("jn_task_grid", sql("select id, y::int as season from roster, unnest(range(1995, 2002)) as t(y)", "roster"))
def task_grid(spark, sf):
    return J.task_grid(B.roster(spark, sf).select("id"), YEARS, period="season")


def stranged(rows):
    """Two thirds of the players as players that nothing else knows."""
    player = F.col("player_id")
    return rows.withColumn("player_id", F.when(player % 3 == 0, player).otherwise(-player))


LIVE_SQL = """
base as (select player_id, max(pts) as pts, max(minutes) as minutes, max(season) as season, count(*) as rows_seen
  from game_logs group by 1),
live as (select case when player_id % 3 = 0 then player_id else -player_id end as player_id, avg(pts) as pts,
    min(case when player_id % 4 <> 0 then minutes end) as minutes from game_logs group by 1)"""


@query(
    "jn_live_overlay",
    sql(
        """
select player_id, round(coalesce(live.pts, base.pts), 6) as pts, coalesce(live.minutes, base.minutes) as minutes,
  case when live.player_id is not null then 2026 else season end::int as season, rows_seen
from base left join live using (player_id)""",
        "game_logs", ctes=LIVE_SQL,
    ),
)
def live_overlay(spark, sf):
    by_player = B.game_logs(spark, sf).groupBy("player_id")
    base = by_player.agg(
        F.max("pts").alias("pts"), F.max("minutes").alias("minutes"), F.max("season").alias("season"),
        F.count("*").alias("rows_seen"),
    )
    live = stranged(B.game_logs(spark, sf).withColumn("_own", F.col("player_id"))).groupBy("player_id").agg(
        F.avg("pts").alias("pts"),
        F.min(F.when(F.col("_own") % 4 != 0, F.col("minutes"))).alias("minutes"),
        F.lit(1).alias("unknown_column"),
    )
    return rounded(J.live_overlay(base, live, entity="player_id", period="season", period_value=2026))


RATED_SQL = """
rated as (select season, team_abbrev, team_def_rating as def_rating, team_pace as pace, floor(rank() over (partition by season
    order by team_def_rating) + (count(*) over (partition by season, team_def_rating) - 1) / 2.0)::int as def_rank
  from (select * replace (case team_abbrev when 'signup' then 'nobody' else team_abbrev end as team_abbrev) from team_stats))"""
NOW_SQL = f"""{RATED_SQL},
now as (select * from rated where season = (select max(season) from rated))"""


def rated_sides(spark, sf):
    """Every period's ratings with ranks; one side has an unknown code."""
    code = F.when(F.col("team_abbrev") == "signup", "nobody").otherwise(F.col("team_abbrev"))
    rows = B.team_stats(spark, sf).withColumn("team_abbrev", code)
    ranked = average_rank(rows, partition=["season"], value="team_def_rating", name="def_rank", truncate=True)
    return ranked.select(
        "season", "team_abbrev", F.col("team_def_rating").alias("def_rating"), F.col("team_pace").alias("pace"), "def_rank"
    )


def current_stats(spark, sf):
    """The ratings of the newest period."""
    rows = rated_sides(spark, sf)
    return rows.where(F.col("season") == rows.agg(F.max("season")).scalar()).drop("season")


@query(
    "jn_context_with_fallback",
    sql(
        """
select game_id, round_even(coalesce(r.def_rating, 113.5), 1) as opp_def_rating, coalesce(r.def_rank, 15)::int
  as opp_def_rank, round_even(coalesce(s.pace, 99.5), 1) as team_pace
from game_logs l left join rated r on l.opponent_abbrev = r.team_abbrev and l.season = r.season
left join rated s on upper(l.team_abbrev) = upper(s.team_abbrev) and l.season = s.season""",
        "game_logs", "team_stats", ctes=RATED_SQL,
    ),
)
def context_fallback(spark, sf):
    upper = rated_sides(spark, sf).withColumn("team_abbrev", F.upper("team_abbrev"))
    logs = B.game_logs(spark, sf).select("game_id", "season", F.upper("opponent_abbrev").alias("opponent_abbrev"), "team_abbrev")
    out = J.context_with_fallback(logs, upper, rival="opponent_abbrev", side="team_abbrev", code="team_abbrev", period="season")
    return out.select("game_id", "opp_def_rating", "opp_def_rank", "team_pace")
