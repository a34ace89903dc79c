"""Projections, filters, duplicates, top-k, sets and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline import bindings as B
from formline.functions.columns import date_of
from formline.operators import joins as J
from formline.operators import ranking as K
from formline.operators import rows as R
from formline.operators import splits as S
from formline.sources.tables import union_tables

from . import EVENTS, query, sql

def raw_log(spark, sf):
    """Text rows with repeated headers, totals and rows that were not played."""
    logs = B.game_logs(spark, sf).withColumn("MP", F.concat(F.col("minutes").cast("int").cast("string"), F.lit(":30")))
    gid = F.col("game_id")
    return logs.select(
        gid.alias("row_id"),
        F.when(gid % 20 == 0, "Rk").when(gid % 21 == 0, "TOT").when(gid % 23 != 0, gid.cast("string")).alias("Rk"),
        F.when(gid % 22 == 0, "Date").when(gid % 19 != 0, F.col("game_day").cast("string")).alias("Date"),
        F.when(gid % 2 == 0, F.col("team_abbrev")).alias("Tm"),
        F.when(gid % 2 == 1, F.col("team_abbrev")).alias("Team"),
        F.when(gid % 13 == 0, "did not play").when(gid % 17 == 0, "Inactive").otherwise(F.col("MP")).alias("MP"),
        F.col("pts").cast("string").alias("PTS"),
        gid.alias("Extra"),
    )


RAW_SQL = """
raw as (select game_id as row_id,
  case when game_id % 20 = 0 then 'Rk' when game_id % 21 = 0 then 'TOT' when game_id % 23 <> 0 then game_id::varchar end as "Rk",
  case when game_id % 22 = 0 then 'Date' when game_id % 19 <> 0 then game_day::varchar end as "Date",
  case when game_id % 2 = 0 then team_abbrev end as "Tm", case when game_id % 2 = 1 then team_abbrev end as "Team",
  case when game_id % 13 = 0 then 'did not play' when game_id % 17 = 0 then 'Inactive'
    else (minutes::int)::varchar || ':30' end as "MP",
  pts::varchar as "PTS", game_id as "Extra" from game_logs)"""


def raw_sql(body: str) -> str:
    return sql(body, "game_logs", ctes=RAW_SQL)


@query(
    "prj_rename_map",
    raw_sql('select row_id, "Rk" as rank, "Date" as game_date, coalesce("Tm", "Team") as team, "MP" as mp, '
            'pts, "Extra" from (select * rename ("PTS" as pts) from raw)'),
)
def rename_map(spark, sf):
    return R.rename_map(raw_log(spark, sf))


@query("prj_keep_existing", sql("select player_id, season, pts, minutes from game_logs", "game_logs"))
def keep_existing(spark, sf):
    return R.keep_existing(B.game_logs(spark, sf), ["player_id", "no_such_column", "season", "pts", "minutes"])


@query("prj_select_by_prefix", sql("select game_id, fg_pct, fga, fg3_pct, ft_pct, fta from game_logs", "game_logs"))
def by_prefix(spark, sf):
    return R.select_by_prefix(
        B.game_logs(spark, sf), lead=["game_id", "fg_pct"], prefixes=["fg", "ft"], names=["fg_pct"]
    )


@query("prj_drop_private", sql("select game_id, pts from game_logs", "game_logs"))
def drop_private(spark, sf):
    rows = B.game_logs(spark, sf).select("game_id", "pts", F.col("result").alias("_result"), F.col("gs").alias("_gs"))
    return R.drop_private(rows)


@query(
    "prj_default_columns",
    sql("select game_id, pts, 3.5::double as rolling_last5_minutes_std, fga as usage_rate from game_logs", "game_logs"),
)
def defaults(spark, sf):
    rows = B.game_logs(spark, sf).select("game_id", "pts", "fga")
    filled = R.default_columns(rows, {"pts": 0.0, "rolling_last5_minutes_std": 3.5, "usage_rate": F.col("fga")})
    return filled.drop("fga")


@query(
    "prj_literal_metadata",
    sql("select game_id, 'events' as source, 2024::int as period, 'SF' as position from game_logs", "game_logs"),
)
def metadata(spark, sf):
    rows = B.game_logs(spark, sf).select("game_id")
    return R.literal_metadata(rows, {"source": "events", "period": 2024, "position": "SF"})


REQUESTS_SQL = """
requests as (
  select distinct player_id, player_id % 2 = 0 as home_game, player_id % 3 = 0 as back_to_back,
    (player_id % 12)::int as rest_days, 100.0::double + player_id % 20 as opp_def_rating,
    (player_id % 30)::double as opp_def_rank, 95.0::double + player_id % 10 as team_pace,
    ['view','error','click','purchase','signup'][(player_id % 5 + 1)::int] as opponent_abbrev,
    [' pg', 'Sg ', 'sf', 'XX', 'c'][(player_id % 5 + 1)::int] as position
  from game_logs)"""


def requests(spark, sf):
    """One request per player; the row number of a player decides its fields."""
    p = F.col("player_id")
    pick = (p % 5 + 1).cast("int")
    sides = F.array(*[F.lit(s) for s in ("view", "error", "click", "purchase", "signup")])
    positions = F.array(*[F.lit(s) for s in (" pg", "Sg ", "sf", "XX", "c")])
    return B.game_logs(spark, sf).select("player_id").distinct().select(
        "player_id",
        (p % 2 == 0).alias("home_game"),
        (p % 3 == 0).alias("back_to_back"),
        (p % 12).cast("int").alias("rest_days"),
        (F.lit(100.0) + p % 20).alias("opp_def_rating"),
        (p % 30).cast("double").alias("opp_def_rank"),
        (F.lit(95.0) + p % 10).alias("team_pace"),
        F.element_at(sides, pick).alias("opponent_abbrev"),
        F.element_at(positions, pick).alias("position"),
    )


LATEST_SQL = """
latest as (select * exclude (i) from (select *, row_number() over (partition by player_id
  order by game_date desc, game_id desc) as i from game_logs) where i = 1)"""


@query(
    "prj_request_overrides",
    sql(
        """
select player_id, r.home_game::int as home_game, r.back_to_back::int as back_to_back,
  least(r.rest_days, 7)::int as rest_days_capped, r.opp_def_rating, r.opp_def_rank, r.team_pace, r.opponent_abbrev,
  upper(trim(r.position)) as position,
  case upper(trim(r.position)) when 'PG' then 1 when 'SG' then 2 when 'SF' then 3 when 'PF' then 4 when 'C' then 5
    else 3 end::int as position_enc, pts, game_id
from latest join requests r using (player_id)""",
        "game_logs",
        ctes=f"{REQUESTS_SQL}, {LATEST_SQL}",
    ),
)
def overrides(spark, sf):
    from formline.operators.windows import latest_row

    rows = latest_row(B.game_logs(spark, sf), **EVENTS).select("player_id", "game_id", "pts", "position", "home_game")
    return R.request_overrides(rows, requests(spark, sf), entity="player_id")


@query("flt_repeated_header", raw_sql('select row_id from raw where "Rk" is null or "Rk" <> \'Rk\''))
def repeated_header(spark, sf):
    return R.not_repeated_header(raw_log(spark, sf), "Rk").select("row_id")


@query(
    "flt_summary_rows",
    raw_sql('select row_id from raw where try_cast("Date" as date) is not null and '
            "not coalesce(trim(\"Rk\") in ('TOT', 'Total', ''), false)"),
)
def summary_rows(spark, sf):
    return R.not_summary(raw_log(spark, sf), date=date_of("Date"), rank="Rk").select("row_id")


@query(
    "flt_dnp_rows",
    raw_sql("select row_id, \"MP\" from raw where not coalesce(regexp_matches(\"MP\", "
            "'Did Not|Inactive|Not With|Suspended', 'i'), false)"),
)
def dnp_rows(spark, sf):
    return R.not_dnp(raw_log(spark, sf), "MP").select("row_id", "MP")


@query("flt_missing_targets", sql("select game_id from game_logs where minutes is not null", "game_logs"))
def missing_targets(spark, sf):
    return R.with_targets(B.game_logs(spark, sf)).select("game_id")


@query("flt_min_exposure", sql("select game_id, minutes from game_logs where minutes >= 5", "game_logs"))
def min_exposure(spark, sf):
    return R.min_exposure(B.game_logs(spark, sf)).select("game_id", "minutes")


@query("flt_entity_ci", sql("select game_id from game_logs where lower(player_name) = 'player 7'", "game_logs"))
def entity_ci(spark, sf):
    return R.entity_named(B.game_logs(spark, sf), "player_name", "PLAYER 7").select("game_id")


@query(
    "flt_complete_rows",
    sql(
        "select player_id, game_id from (select *, row_number() over (partition by player_id order by game_date desc, "
        "game_id desc) as i from game_logs where minutes is not null and result is not null) where i = 1",
        "game_logs",
    ),
)
def complete_rows(spark, sf):
    rows = R.last_complete_row(B.game_logs(spark, sf), ["pts", "minutes", "result"], **EVENTS)
    return rows.select("player_id", "game_id")


@query(
    "flt_alert_status",
    "select o_orderkey from orders where (case o_orderstatus when 'F' then 'Active' when 'O' then 'Questionable' "
    "when 'P' then case when o_orderkey % 2 = 0 then 'Unknown' end end) not in ('Active', 'Unknown')",
)
def alert_status(spark, sf):
    status = (
        F.when(F.col("o_orderstatus") == "F", "Active")
        .when(F.col("o_orderstatus") == "O", "Questionable")
        .when(F.col("o_orderkey") % 2 == 0, "Unknown")
    )
    return R.alerts(B.table(spark, sf, "orders").withColumn("status", status), "status").select("o_orderkey")


@query(
    "flt_target_present",
    sql(
        "select 'minutes' as target, count(*) as n_rows from game_logs where minutes is not null union all "
        "select 'pts', count(*) from game_logs where pts is not null",
        "game_logs",
    ),
)
def target_present(spark, sf):
    logs = B.game_logs(spark, sf)
    counts = [
        R.with_targets(logs, [t]).agg(F.lit(t).alias("target"), F.count("*").alias("n_rows")) for t in ("minutes", "pts")
    ]
    return union_tables(counts)


@query(
    "flt_time_before_after",
    sql(
        "select count(*) filter (game_date < '1998-01-01') as n_before, count(*) filter (game_date >= '1998-01-01') "
        "as n_after, max(game_id) filter (game_date < '1998-01-01') as last_before from schedule",
        "schedule",
    ),
)
def before_after(spark, sf):
    rows = B.schedule(spark, sf)
    early = R.before(rows, "game_date", "1998-01-01").select("game_id", F.lit(1).alias("early"))
    late = R.on_or_after(rows, "game_date", "1998-01-01").select("game_id", F.lit(0).alias("early"))
    return early.unionByName(late).agg(
        F.count_if(F.col("early") == 1).alias("n_before"),
        F.count_if(F.col("early") == 0).alias("n_after"),
        F.max(F.when(F.col("early") == 1, F.col("game_id"))).alias("last_before"),
    )


@query(
    "ded_first_by_key",
    sql(
        "select team_id, season, game_id from (select *, row_number() over (partition by team_id, season "
        "order by game_date, game_id) as i from schedule) where i = 1",
        "schedule",
    ),
)
def first_by_key(spark, sf):
    rows = J.first_by_key(B.schedule(spark, sf), ["team_id", "season"], ["game_date", "game_id"])
    return rows.select("team_id", "season", "game_id")


@query(
    "ded_roster_by_id",
    sql("select nation, id, name from (select *, row_number() over (partition by nation order by id) as i "
        "from roster) where i = 1", "roster"),
)
def roster_unique(spark, sf):
    return R.roster_unique(B.roster(spark, sf), key="nation", ordinal="id").select("nation", "id", "name")


@query("ded_duplicate_report", "select p_name as person_name, count(*) as n from part group by 1 having count(*) > 1")
def duplicates(spark, sf):
    return R.duplicate_report(B.people(spark, sf), "person_name")


@query(
    "top_recent_n",
    sql(
        "select player_id, game_id, pts, minutes, opponent_abbrev from (select *, row_number() over (partition by "
        "player_id order by game_date desc, game_id desc) as i from game_logs) where i <= 5",
        "game_logs",
    ),
)
def recent_n(spark, sf):
    return K.recent_events(
        B.game_logs(spark, sf), columns=["pts", "minutes", "opponent_abbrev", "not_there"], n=5, **EVENTS
    )


@query(
    "top_n_desc",
    sql("select team_id, season, count(*) as n_rows from schedule group by 1, 2 order by 3 desc, 1, 2 limit 10", "schedule"),
)
def n_desc(spark, sf):
    return K.largest_groups(B.schedule(spark, sf), keys=["team_id", "season"])


@query(
    "top_search_prefix",
    "select p_partkey as person_id, p_name as person_name from part where contains(lower(p_name), 'wid') "
    "order by p_partkey limit 8",
)
def search(spark, sf):
    return K.search_names(B.people(spark, sf), name="person_name", ordinal="person_id", text="WiD")


@query(
    "srt_event_order",
    sql("select team_id, game_id, row_number() over (order by team_id, game_date, game_id) - 1 as place from schedule",
        "schedule"),
)
def event_order(spark, sf):
    rows = S.time_index(B.schedule(spark, sf), ["team_id", "game_date", "game_id"], name="place")
    return K.event_order(rows, ["team_id", "game_date", "game_id"]).select("team_id", "game_id", "place")


@query(
    "set_union_by_name",
    "select c_custkey as id, c_name as name, c_acctbal as balance, null::varchar as nation from customer union all "
    "select n_nationkey::bigint, null, null, n_name from nation",
)
def union_by_name(spark, sf):
    left = B.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    right = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("nation"))
    return union_tables([left, right])


@query(
    "set_except_expected",
    raw_sql("select 'Extra' as column, count(\"Extra\") as n_values from raw union all select 'row_id', count(row_id) from raw"),
)
def except_expected(spark, sf):
    from formline.sources.tables import unmapped_columns

    return unmapped_columns(R.rename_map(raw_log(spark, sf)), {*R.HEADERS.values(), *R.LEAD_COLUMNS})


SPLIT_SQL = """
select game_id, i as row_index, case when i < n - 5 * s then 0 else (i - (n - 5 * s)) // s + 1 end::int as test_fold
from (select game_id, row_number() over (order by game_date, game_id) - 1 as i, count(*) over () as n,
  count(*) over () // 6 as s from schedule)"""


@query("spl_time_series_split", sql(SPLIT_SQL, "schedule"))
def ts_split(spark, sf):
    rows = S.time_series_split(B.schedule(spark, sf), ["game_date", "game_id"], k=5)
    return rows.select("game_id", "row_index", "test_fold")


@query(
    "spl_holdout_tail",
    sql(
        "select game_id, row_number() over (order by game_date, game_id) - 1 >= floor(0.85 * count(*) over ()) "
        "as is_validation from schedule",
        "schedule",
    ),
)
def holdout(spark, sf):
    return S.holdout_tail(B.schedule(spark, sf), ["game_date", "game_id"]).select("game_id", "is_validation")


BY_DATE_SQL = """
days as (select game_date::date as day, count(*) as c from schedule group by 1),
placed as (select *, coalesce(sum(c) over (order by day rows between unbounded preceding and 1 preceding), 0)::bigint as date_start,
  (sum(c) over ())::bigint as n, (sum(c) over () // 6)::bigint as s from days)"""


@query(
    "spl_time_series_split_by_date",
    sql(
        "select game_id, date_start, case when date_start < n - 5 * s then 0 else (date_start - (n - 5 * s)) // s + 1 end::int as "
        "test_fold from schedule join placed on game_date::date = day",
        "schedule", ctes=BY_DATE_SQL,
    ),
)
def ts_split_by_date(spark, sf):
    return S.time_series_split_by_date(B.schedule(spark, sf), "game_date", k=5).select("game_id", "date_start", "test_fold")


@query(
    "spl_holdout_tail_by_date",
    sql(
        "select game_id, date_start >= floor(0.85 * n) as is_validation from schedule join placed on game_date::date = day",
        "schedule", ctes=BY_DATE_SQL,
    ),
)
def holdout_by_date(spark, sf):
    return S.holdout_tail_by_date(B.schedule(spark, sf), "game_date").select("game_id", "is_validation")
