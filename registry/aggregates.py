"""Grouped statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline import bindings as B
from formline.functions.columns import flag
from formline.operators import aggregates as A
from formline.operators import windows as W
from formline.plans.dataset import positional_defense

from . import EVENTS, query, rounded, sql
from .joins import DEFENSE_SQL, POINTS_SQL, looked_up
from .rows import RAW_SQL, raw_log


@query(
    "agg_entity_counts",
    sql("select player_name, count(game_date) as games, max(game_date)::date as last_game from game_logs group by 1",
        "game_logs"),
)
def entity_counts(spark, sf):
    rows = A.entity_counts(B.game_logs(spark, sf), name="player_name", event_time="game_date")
    return rows.withColumn("last_game", F.to_date("last_game"))


@query(
    "agg_home_win_rate",
    sql(
        """
select s.game_id, round_even(coalesce(r.rate, 0.575), 3) as home_court_factor from schedule s left join (
  select team_id, avg((coalesce(result, '') like 'W%')::int) as rate from schedule where home_game = 1 group by 1) r
  using (team_id)""",
        "schedule",
    ),
)
def home_win_rate(spark, sf):
    rows = A.home_win_rate(B.schedule(spark, sf), side="team_id", home="home_game", result="result")
    return rows.select("game_id", "home_court_factor")


@query(
    "agg_home_win_rate_as_of",
    sql(
        """
select s.game_id, round_even(coalesce(r.wins / r.games, 0.575), 3) as home_court_factor from schedule s left join (
  select team_id, day, sum(won) over w as wins, sum(n) over w as games from (
    select team_id, game_date::date as day, sum(case when home_game = 1 then (coalesce(result, '') like 'W%')::int end)::double as won,
      sum(case when home_game = 1 then 1 end)::double as n from schedule group by 1, 2)
  window w as (partition by team_id order by day rows between unbounded preceding and 1 preceding)) r
  on s.team_id = r.team_id and s.game_date::date = r.day""",
        "schedule",
    ),
)
def home_win_rate_as_of(spark, sf):
    rows = B.schedule(spark, sf)
    rows = A.home_win_rate(rows, side="team_id", home="home_game", result="result", as_of="game_date")
    return rows.select("game_id", "home_court_factor")


@query(
    "agg_group_median_fill",
    sql(
        "select game_id, round(coalesce(opp_pts_allowed_pos, median(opp_pts_allowed_pos) over (partition by season, "
        "position)), 6) as opp_pts_allowed_pos from looked",
        "game_logs", "team_stats", ctes=DEFENSE_SQL,
    ),
)
def median_fill(spark, sf):
    out = A.group_median_fill(looked_up(spark, sf), group=["season", "position"], value="opp_pts_allowed_pos")
    return rounded(out, "game_id", "opp_pts_allowed_pos")


@query(
    "agg_group_median_wide",
    sql("select season, home_game, round(median(minutes), 6) as median from game_logs group by 1, 2", "game_logs"),
)
def median_wide(spark, sf):
    return rounded(A.group_medians(B.game_logs(spark, sf), group=["season", "home_game"], value="minutes"))


@query(
    "agg_league_mean_scale",
    sql("select season, opponent_abbrev, position, pts_allowed_per_game from allowed", "team_stats", ctes=POINTS_SQL),
)
def mean_scale(spark, sf):
    stats = B.team_stats(spark, sf).withColumnRenamed("team_abbrev", "opponent_abbrev")
    return A.league_mean_scale(stats, period="season", rival="opponent_abbrev", rating="team_def_rating")


@query(
    "agg_profile",
    sql(
        "select count(*) as n_rows, 24::int as n_columns, count(distinct player_id) as n_entities, "
        "(select string_agg(season::varchar, ',' order by season) from (select distinct season from game_logs)) "
        "as periods, min(game_date)::date as first_event, max(game_date)::date as last_event, "
        + ", ".join(
            f"round({f}({m}), 6)::double as {m}_{t}"
            for m in ("pts", "reb", "minutes")
            for t, f in (("mean", "avg"), ("min", "min"), ("max", "max"))
        )
        + " from game_logs",
        "game_logs",
    ),
)
def profile(spark, sf):
    out = A.profile(
        B.game_logs(spark, sf), entity="player_id", period="season", event_time="game_date",
        measures=["pts", "reb", "minutes"],
    )
    out = out.withColumns({c: F.to_date(c) for c in ("first_event", "last_event")})
    return rounded(out)


@query(
    "agg_null_rates",
    sql(
        "select * from (select 'minutes' as column, round(avg((minutes is null)::int), 6) as null_rate from game_logs "
        "union all select 'result', round(avg((result is null)::int), 6) from game_logs) where null_rate > 0 "
        "order by 2 desc, 1 limit 10",
        "game_logs",
    ),
)
def null_rates(spark, sf):
    return rounded(A.null_rates(B.game_logs(spark, sf)))


@query(
    "agg_value_counts",
    sql(
        """
select * from (select rest_days, count(*) as n from (select coalesce(date_sub('day', lag(game_date) over
    (partition by team_id, season order by game_date, game_id), game_date) - 1, -1)::int as rest_days from schedule)
  where rest_days >= 0 group by 1 order by 1 limit 6)""",
        "schedule",
    ),
)
def value_counts(spark, sf):
    rows = W.rest_days(
        B.schedule(spark, sf), side="team_id", period="season", event_time="game_date", tiebreak="game_id"
    )
    return A.value_counts(rows, "rest_days", least=0, n=6)


@query(
    "agg_low_count_flag",
    sql("select player_name, count(game_date) as games, (count(game_date) < 60)::int as is_low from game_logs group by 1",
        "game_logs"),
)
def low_counts(spark, sf):
    return A.low_counts(B.game_logs(spark, sf), name="player_name", event_time="game_date", least=60)


@query(
    "agg_mean_by_group",
    sql("select position, round(avg(minutes), 6) as mean from game_logs group by 1", "game_logs"),
)
def mean_by_group(spark, sf):
    return rounded(A.mean_by_group(B.game_logs(spark, sf), group="position", value="minutes"))


@query(
    "agg_best_per_period",
    sql("select period, side, rating from (select *, row_number() over (partition by period order by rating, side) as i "
        "from tied where rating is not null) where i = 1", "tied"),
)
def best_per_period(spark, sf):
    return A.best_per_period(B.tied_ratings(spark, sf), period="period", side="side", rating="rating")


@query(
    "agg_flag_sum_share",
    sql(
        "select season, sum(home_game)::bigint as n_flagged, round(avg(home_game), 6) as share from schedule group by 1 "
        "union all select null, sum(home_game)::bigint, round(avg(home_game), 6) from schedule",
        "schedule",
    ),
)
def flag_share(spark, sf):
    rows = B.schedule(spark, sf)
    by_period = A.flag_share(rows, flag_column="home_game", by=["season"])
    return rounded(by_period.unionByName(A.flag_share(rows, flag_column="home_game"), allowMissingColumns=True))


AVAILABLE_SQL = """
avail as (select player_id, sum((coalesce(minutes, 0) < 1)::int) as dnp_count,
    date_sub('day', max(game_date), timestamp '2024-02-01') as days_since_last
  from (select *, row_number() over (partition by player_id order by game_date desc, game_id desc) as i from game_logs)
  where i <= 5 group by 1)"""


@query(
    "agg_availability",
    sql("select player_id, dnp_count::bigint as dnp_count, days_since_last from avail", "game_logs", ctes=AVAILABLE_SQL),
)
def availability(spark, sf):
    return A.availability_inputs(B.game_logs(spark, sf), minutes="minutes", as_of="2024-02-01", **EVENTS)


@query(
    "agg_recent_mean_std",
    sql(
        "select player_id, count(*) as n_rows, "
        + ", ".join(
            f"round(avg({v}), 6) as {v}_mean, round(stddev_samp({v}), 6) as {v}_std, count({v}) as {v}_n"
            for v in ("pts", "minutes")
        )
        + " from (select *, row_number() over (partition by player_id order by game_date desc, game_id desc) as i "
        "from game_logs) where i <= 20 group by 1",
        "game_logs",
    ),
)
def recent_stats(spark, sf):
    return rounded(A.recent_stats(B.game_logs(spark, sf), values=["pts", "minutes"], window=20, **EVENTS))


@query(
    "agg_recent_mean_std_nulls_first",
    sql(
        "select player_id, count(*) as n_rows, round(avg(minutes), 6) as minutes_mean, "
        "round(stddev_samp(minutes), 6) as minutes_std, count(minutes) as minutes_n from (select *, row_number() over "
        "(partition by player_id order by game_date desc, game_id desc) as i from game_logs where minutes is not null) "
        "where i <= 20 group by 1",
        "game_logs",
    ),
)
def recent_stats_nulls_first(spark, sf):
    return rounded(
        A.recent_stats(B.game_logs(spark, sf), values=["minutes"], window=20, drop_nulls_first=True, **EVENTS)
    )


@query(
    "agg_hit_rate",
    sql(
        """
select player_id, round(avg((minutes > 25)::int), 6) as over_rate, round(avg((minutes < 25)::int), 6) as under_rate
from (select *, row_number() over (partition by player_id order by game_date desc, game_id desc) as i from game_logs)
where i <= 20 group by 1""",
        "game_logs",
    ),
)
def hit_rates(spark, sf):
    rows = W.last_n(B.game_logs(spark, sf), n=20, **EVENTS)
    rate = {d: A.hit_rate("minutes", F.lit(25.0), F.lit(d)).alias(f"{d}_rate") for d in ("over", "under")}
    return rounded(rows.groupBy("player_id").agg(*rate.values()))


METRICS_SQL = """
folds as (select season as fold, avg(abs(pts - 2 * reb)) as mae, sqrt(avg((pts - 2 * reb) ** 2)) as rmse,
  1 - sum((pts - 2 * reb) ** 2) / (var_pop(pts) * count(*)) as r2 from game_logs group by 1)"""


@query(
    "agg_error_metrics",
    sql(
        "select round(avg(mae), 6) as cv_mae, round(stddev_pop(mae), 6) as cv_mae_std, round(avg(rmse), 6) as cv_rmse, "
        "round(avg(r2), 6) as cv_r2 from folds",
        "game_logs", ctes=METRICS_SQL,
    ),
)
def error_metrics(spark, sf):
    rows = B.game_logs(spark, sf).withColumn("guess", F.lit(2.0) * F.col("reb"))
    folds = A.fold_metrics(rows, fold="season", actual="pts", predicted="guess")
    return rounded(A.error_metrics(folds))


@query(
    "agg_entity_mean_all",
    sql("select player_id, round(avg(minutes), 6) as avg_minutes, count(*) as n_rows from game_logs group by 1", "game_logs"),
)
def entity_means(spark, sf):
    return rounded(A.entity_means(B.game_logs(spark, sf), entity="player_id", value="minutes"))


@query(
    "agg_min_max_range",
    sql(
        "select min(pts) as pts_min, max(pts) as pts_max, count_if(pts is null)::bigint as pts_missing, "
        "min(minutes) as minutes_min, max(minutes) as minutes_max, count_if(minutes is null)::bigint as minutes_missing "
        "from game_logs",
        "game_logs",
    ),
)
def value_range(spark, sf):
    return A.value_range(B.game_logs(spark, sf), ["pts", "minutes"])


@query(
    "agg_detect_marker_column",
    sql(
        """
select u.column, bool_and(u.only) as is_marker from (
  select unnest([{'column': 'Rk', 'only': coalesce(trim("Rk"), '') in ('@', '', 'nan')},
    {'column': 'Date', 'only': coalesce(trim("Date"), '') in ('@', '', 'nan')},
    {'column': 'Tm', 'only': coalesce(trim("Tm"), '') in ('@', '', 'nan')},
    {'column': 'Team', 'only': coalesce(trim("Team"), '') in ('@', '', 'nan')},
    {'column': 'MP', 'only': coalesce(trim("MP"), '') in ('@', '', 'nan')},
    {'column': 'PTS', 'only': coalesce(trim("PTS"), '') in ('@', '', 'nan')},
    {'column': 'where', 'only': coalesce(trim(case when row_id % 3 = 0 then ' @' when row_id % 3 = 1 then '' end), '')
      in ('@', '', 'nan')}]) as u from raw) group by 1""",
        "game_logs", ctes=RAW_SQL,
    ),
)
def marker_columns(spark, sf):
    where = F.when(F.col("row_id") % 3 == 0, " @").when(F.col("row_id") % 3 == 1, "")
    return A.marker_columns(raw_log(spark, sf).withColumn("where", where))


@query(
    "agg_feature_log_stats",
    sql(
        "select round(avg(pts), 6) as mean_value, max(pts) as max_value, round(avg((minutes >= 20)::int), 6) as "
        "flag_share, count(result) as n_filled from (select pts, coalesce(minutes, 0) as minutes, result from game_logs)",
        "game_logs",
    ),
)
def feature_stats(spark, sf):
    rows = B.game_logs(spark, sf).withColumn("busy", flag(F.col("minutes") >= 20))
    return rounded(A.feature_stats(rows, value="pts", flag_column="busy", filled="result"))


@query(
    "pip_positional_defense",
    sql("select season, opponent_abbrev, position, pts_allowed_per_game, rank from defense", "team_stats",
        ctes=DEFENSE_SQL.split(",\nholes")[0]),
)
def defense(spark, sf):
    stats = B.team_stats(spark, sf).withColumnRenamed("team_abbrev", "opponent_abbrev")
    return positional_defense(stats, rival="opponent_abbrev")
