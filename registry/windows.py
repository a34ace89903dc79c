"""Window operators over the event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline import bindings as B
from formline.operators import windows as W

from . import EVENTS, query, rounded, sql

MEASURES = ("pts", "reb", "ast", "stl", "blk", "minutes", "fg_pct", "fg3_pct", "ft_pct", "tov", "fga", "fta")
PREV = "partition by player_id order by game_date, game_id rows between {n} preceding and 1 preceding"


def prev(n: int) -> str:
    return PREV.format(n=n)


ROLLING_SQL = ",\n".join(
    f"round(avg({m}) over ({prev(n)}), 6) as rolling_last{n}_{m}" for m in MEASURES for n in (3, 5, 10)
)


@query("win_lagged_rolling_mean", sql(f"select game_id, {ROLLING_SQL} from game_logs", "game_logs"))
def rolling_mean(spark, sf):
    out = W.lagged_rolling_mean(B.game_logs(spark, sf), measures=MEASURES, **EVENTS)
    return rounded(out, "game_id", *[f"rolling_last{n}_{m}" for m in MEASURES for n in (3, 5, 10)])


@query(
    "win_lagged_rolling_std",
    sql(
        f"select game_id, round(coalesce(stddev_samp(minutes) over ({prev(5)}), 3.5), 6) as rolling_last5_minutes_std "
        "from game_logs",
        "game_logs",
    ),
)
def rolling_std(spark, sf):
    out = W.lagged_rolling_std(B.game_logs(spark, sf), measure="minutes", **EVENTS)
    return rounded(out, "game_id", "rolling_last5_minutes_std")


PERIOD_MEASURES = ("pts", "reb", "ast", "stl", "blk", "minutes", "tov")


@query(
    "win_period_expanding_mean",
    sql(
        "select game_id, "
        + ", ".join(
            f"round(avg({m}) over (partition by player_id, season order by game_date, game_id "
            f"rows between unbounded preceding and 1 preceding), 6) as season_avg_{m}"
            for m in PERIOD_MEASURES
        )
        + " from game_logs",
        "game_logs",
    ),
)
def expanding_mean(spark, sf):
    out = W.period_expanding_mean(B.game_logs(spark, sf), measures=PERIOD_MEASURES, period="season", **EVENTS)
    return rounded(out, "game_id", *[f"season_avg_{m}" for m in PERIOD_MEASURES])


@query(
    "win_rival_rolling_mean",
    sql(
        "select game_id, "
        + ", ".join(
            f"round(avg({m}) over (partition by player_id, opponent_abbrev order by game_date, game_id "
            f"rows between 3 preceding and 1 preceding), 6) as vs_opp_rolling3_{m}"
            for m in ("pts", "reb", "ast")
        )
        + " from game_logs",
        "game_logs",
    ),
)
def rival_mean(spark, sf):
    out = W.rival_rolling_mean(
        B.game_logs(spark, sf), rival="opponent_abbrev", measures=("pts", "reb", "ast"), **EVENTS
    )
    return rounded(out, "game_id", *[f"vs_opp_rolling3_{m}" for m in ("pts", "reb", "ast")])


@query(
    "win_lagged_rate_min3",
    sql(
        f"select game_id, round(coalesce(case when count(gs) over ({prev(10)}) >= 3 "
        f"then avg(gs) over ({prev(10)}) end, 0.8), 6) as start_rate_last10 from game_logs",
        "game_logs",
    ),
)
def start_rate(spark, sf):
    return rounded(W.lagged_start_rate(B.game_logs(spark, sf), start="gs", **EVENTS), "game_id", "start_rate_last10")


@query(
    "win_cumcount",
    sql(
        "select game_id, row_number() over (partition by player_id, season order by game_date, game_id) - 1 "
        "as games_played_season from game_logs",
        "game_logs",
    ),
)
def cumcount(spark, sf):
    out = W.cumulative_index(B.game_logs(spark, sf), period="season", **EVENTS)
    return out.select("game_id", "games_played_season")


@query(
    "win_period_start_offset",
    sql(
        "select game_id, date_sub('day', min(game_date) over (partition by season), game_date) as days_into_season "
        "from game_logs",
        "game_logs",
    ),
)
def start_offset(spark, sf):
    out = W.period_start_offset(B.game_logs(spark, sf), period="season", event_time="game_date")
    return out.select("game_id", "days_into_season")


TRAILING_SQL = """
select game_id, count(*) over (partition by {e} order by game_date range between interval 7 day preceding
    and current row)
  - count(*) over (partition by {e} order by game_date range between current row and current row)
  + row_number() over (partition by {e} order by game_date, game_id)
  - rank() over (partition by {e} order by game_date) as games_in_last_7_days
from {t}"""


@query("win_trailing_days_count", sql(TRAILING_SQL.format(e="player_id", t="game_logs"), "game_logs"))
def trailing_count(spark, sf):
    return W.trailing_days_count(B.game_logs(spark, sf), **EVENTS).select("game_id", "games_in_last_7_days")


@query(
    "win_trailing_days_count_ties",
    sql(TRAILING_SQL.format(e="team_id", t="schedule").replace("7 day", "60 day"), "schedule"),
)
def trailing_count_ties(spark, sf):
    out = W.trailing_days_count(
        B.schedule(spark, sf), entity="team_id", event_time="game_date", tiebreak="game_id", days=60
    )
    return out.select("game_id", "games_in_last_7_days")


@query(
    "win_rest_days",
    sql(
        """
select game_id, rest_days, (rest_days = 0)::int as back_to_back from (
  select game_id, coalesce(date_sub('day', lag(game_date) over (partition by team_id, season
    order by game_date, game_id), game_date) - 1, -1)::int as rest_days from schedule)""",
        "schedule",
    ),
)
def rest(spark, sf):
    out = W.rest_days(
        B.schedule(spark, sf), side="team_id", period="season", event_time="game_date", tiebreak="game_id"
    )
    return out.select("game_id", "rest_days", "back_to_back")


RANK_SQL = """
select side, case when rating is not null then {cast} end as rating_rank from (
  select *, rank() over (partition by period order by rating nulls last) + (count(*) over (partition by period, rating)
    - 1) / 2.0::double as r from tied)"""


@query("win_average_rank", sql(RANK_SQL.format(cast="r"), "tied"))
def avg_rank(spark, sf):
    out = W.average_rank(B.tied_ratings(spark, sf), partition=["period"], value="rating", name="rating_rank")
    return out.select("side", "rating_rank")


@query("win_average_rank_truncated", sql(RANK_SQL.format(cast="floor(r)::int"), "tied"))
def avg_rank_int(spark, sf):
    out = W.average_rank(
        B.tied_ratings(spark, sf), partition=["period"], value="rating", name="rating_rank", truncate=True
    )
    return out.select("side", "rating_rank")


@query(
    "win_latest_row",
    sql(
        "select player_id, game_id, pts, minutes from (select *, row_number() over (partition by player_id "
        "order by game_date desc, game_id desc) as i from game_logs) where i = 1",
        "game_logs",
    ),
)
def latest(spark, sf):
    return W.latest_row(B.game_logs(spark, sf), **EVENTS).select("player_id", "game_id", "pts", "minutes")


TRENDS = ("pts", "reb", "ast", "tov", "fga")


def trend_sql(m: str) -> str:
    ratio = f"(avg({m}) over ({prev(3)}) / nullif(avg({m}) over ({prev(10)}), 0))"
    return f"round(case when {ratio} is not null then greatest(0.3, least(3.0, {ratio})) end, 6) as trend_{m}"


@query("win_trend_ratio", sql(f"select game_id, {', '.join(trend_sql(m) for m in TRENDS)} from game_logs", "game_logs"))
def trend(spark, sf):
    rows = W.lagged_rolling_mean(B.game_logs(spark, sf), measures=TRENDS, sizes=(3, 10), **EVENTS)
    return rounded(W.trend_ratios(rows, TRENDS), "game_id", *[f"trend_{m}" for m in TRENDS])


@query(
    "win_rolling_ratio_features",
    sql(
        f"""
select game_id, round(avg(ts_pct) over ({prev(3)}), 9) as rolling_last3_ts_pct,
  round(avg(ts_pct) over ({prev(5)}), 9) as rolling_last5_ts_pct,
  round(avg(ppm) over ({prev(5)}), 9) as rolling_last5_pts_per_min
from (select *, case when t <> 0 then greatest(0.0, least(1.0, pts / t)) end as ts_pct,
    case when minutes is not null then pts / greatest(minutes, 1.0) end as ppm
  from (select *, 2.0::double * (fga + 0.44::double * fta) as t from game_logs))""",
        "game_logs",
    ),
)
def rolling_ratio(spark, sf):
    out = W.rolling_ratios(B.game_logs(spark, sf), **EVENTS)
    names = ("rolling_last3_ts_pct", "rolling_last5_ts_pct", "rolling_last5_pts_per_min")
    return rounded(out, "game_id", *names, digits=9)


@query(
    "win_as_of_next",
    sql(
        """
select player_id, max(game_id) filter (i = 1) as game_id,
  """
        + ", ".join(
            f"round(avg({m}) filter (i between {1 + skip} and {n + skip}), 6) as {tag}_last{n}_{m}"
            for skip, tag in ((1, "past"), (0, "next"))
            for m in ("pts", "minutes")
            for n in (3, 10)
        )
        + """
from (select *, row_number() over (partition by player_id order by game_date desc, game_id desc) as i from game_logs)
group by player_id""",
        "game_logs",
    ),
)
def next_values(spark, sf):
    logs, measures = B.game_logs(spark, sf), ("pts", "minutes")
    past = W.as_of_next(logs, measures=measures, sizes=(3, 10), **EVENTS)
    after = W.as_of_next(logs, measures=measures, sizes=(3, 10), inclusive=True, **EVENTS)
    names = [f"last{n}_{m}" for m in measures for n in (3, 10)]
    past = past.select("player_id", "game_id", *[F.col(f"rolling_{c}").alias(f"past_{c}") for c in names])
    after = after.select("player_id", *[F.col(f"rolling_{c}").alias(f"next_{c}") for c in names])
    return rounded(past.join(after, "player_id"))
