"""Scalar functions, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline import bindings as B
from formline.functions import columns as C
from formline.functions.labels import label_table, reason_label, warning_messages
from formline.operators.aggregates import availability_inputs, fold_metrics

from . import EVENTS, query, rounded, sql
from .aggregates import AVAILABLE_SQL

CODE_LIST = (" brk", "CHO", "pho ", "NOP", "NJN", "SEA", "NOH", "lal", "GS", "sa")
CODES_SQL = "['" + "','".join(CODE_LIST) + "']"


def code_sql(column: str, table: dict[str, str]) -> str:
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in table.items())
    return f"case upper(trim({column})) {cases} else upper(trim({column})) end"


@query(
    "scl_code_normalise",
    f"select event_id, {code_sql('c', C.CODE_ALIASES)} as code, {code_sql('c', C.SHORT_CODES)} as short_code from "
    f"(select event_id, case when event_id % 23 <> 0 then {CODES_SQL}[(event_id % 10 + 1)::int] end as c from events)",
)
def codes(spark, sf):
    code = F.when(
        F.col("event_id") % 23 != 0,
        F.element_at(F.array(*[F.lit(c) for c in CODE_LIST]), (F.col("event_id") % 10 + 1).cast("int")),
    )
    return B.table(spark, sf, "events").select(
        "event_id", C.code_normalise(code).alias("code"), C.code_normalise(code, C.SHORT_CODES).alias("short_code")
    )


@query(
    "scl_parse_minutes",
    """
select event_id, round(a, 6) as minutes, round(coalesce(a, 0), 6) as minutes_or_zero from (
  select event_id, case len(string_split(t, ':'))
      when 2 then try_cast(string_split(t, ':')[1] as int) + try_cast(string_split(t, ':')[2] as int) / 60.0::double
      when 1 then try_cast(t as double) end as a
  from (select event_id, trim(case event_id % 5 when 0 then (event_id % 48)::varchar || ':' || (event_id % 60)::varchar
    when 1 then ' ' || value::varchar when 2 then 'n/a' when 3 then '12:xx' end) as t from events))""",
)
def minutes(spark, sf):
    i = F.col("event_id")
    clock = F.concat((i % 48).cast("string"), F.lit(":"), (i % 60).cast("string"))
    text = (
        F.when(i % 5 == 0, clock)
        .when(i % 5 == 1, F.concat(F.lit(" "), F.col("value").cast("string")))
        .when(i % 5 == 2, "n/a")
        .when(i % 5 == 3, "12:xx")
    )
    return rounded(
        B.table(spark, sf, "events").select(
            "event_id", C.parse_minutes(text).alias("minutes"), C.parse_minutes(text, 0.0).alias("minutes_or_zero")
        )
    )


@query(
    "scl_home_from_matchup",
    sql(
        "select game_id, (contains(matchup, ' vs. '))::int as home_game, split_part(split_part(matchup, ' vs. ', 2) || "
        "split_part(matchup, ' @ ', 2), ' ', 1) as opponent_abbrev, coalesce((trim(case when game_id % 3 = 0 then ' @ ' "
        "when game_id % 3 = 1 then '' end) <> '@')::int, 1) as home_marker from side_schedule",
        "side_schedule",
    ),
)
def matchup(spark, sf):
    marker = F.when(F.col("game_id") % 3 == 0, " @ ").when(F.col("game_id") % 3 == 1, "")
    return B.side_schedule(spark, sf).select(
        "game_id",
        C.home_from_matchup("matchup").alias("home_game"),
        C.rival_from_matchup("matchup").alias("opponent_abbrev"),
        C.home_from_marker(marker).alias("home_marker"),
    )


FROM_LOGS = "from game_logs"


@query(
    "scl_composite_score",
    sql(
        f"select game_id, round(pts + 1.2 * reb + 1.5 * ast + 3 * stl + 3 * blk, 6) as score_without_tov, round(pts + "
        f"1.2 * reb + 1.5 * ast + 3 * stl + 3 * blk - case when minutes is not null then tov end, 6) as score {FROM_LOGS}",
        "game_logs",
    ),
)
def composite(spark, sf):
    parts = {c: F.col(c) for c in ("pts", "reb", "ast", "stl", "blk")}
    tov = F.when(F.col("minutes").isNotNull(), F.col("tov"))
    return rounded(
        B.game_logs(spark, sf).select(
            "game_id",
            C.composite_score(parts).alias("score_without_tov"),
            C.composite_score(parts | {"tov": tov}).alias("score"),
        )
    )


USAGE_SQL = """
select game_id, round(case when minutes is not null then least(1.0, greatest(0.0, (fga + 0.44 * coalesce(f, 0) +
    coalesce(tov, 0)) / greatest(0.1, greatest(minutes, 1) / 48.0::double * 100.0::double))) end, 6) as with_pace,
  round(case when minutes is not null then least(1.0, greatest(0.0, (fga + 0.44 * coalesce(f, 0) + coalesce(tov, 0)) /
    greatest(minutes, 1))) end, 6) as without_pace,
  round(case when minutes is not null then (fga + 0.44 * f + tov) / greatest(minutes, 1) end, 6) as proxy,
  round(least(1.0, (fga + 0.44 * coalesce(f, 0) + coalesce(tov, 0)) / greatest(0.1, greatest(coalesce(minutes, 30), 1)
    / 48.0::double * 100.0::double)), 6) as serving
from (select *, case when game_id % 6 <> 0 then fta end as f from game_logs)"""


@query("scl_usage_rate", sql(USAGE_SQL, "game_logs"))
def usage(spark, sf):
    rows = B.game_logs(spark, sf).withColumn("fta", F.when(F.col("game_id") % 6 != 0, F.col("fta")))
    args = ("fga", "fta", "tov", "minutes")
    return rounded(
        rows.select(
            "game_id",
            C.usage_rate(*args, F.lit(100.0)).alias("with_pace"),
            C.usage_rate(*args).alias("without_pace"),
            C.usage_proxy(*args).alias("proxy"),
            C.usage_rate_serving(*args, F.lit(100.0)).alias("serving"),
        )
    )


@query(
    "scl_true_shooting",
    sql(
        f"select game_id, round(case when fga + fta > 0 then least(1.0, greatest(0.0, pts / (2 * (fga + 0.44 * fta)))) "
        f"end, 6) as ts_pct {FROM_LOGS}",
        "game_logs",
    ),
)
def true_shooting(spark, sf):
    return rounded(B.game_logs(spark, sf).select("game_id", C.true_shooting("pts", "fga", "fta").alias("ts_pct")))


@query(
    "scl_rate_per_exposure",
    sql(f"select game_id, round(case when minutes is not null then pts / greatest(minutes, 1) end, 8) as pts_per_min {FROM_LOGS}",
        "game_logs"),
)
def per_exposure(spark, sf):
    rows = B.game_logs(spark, sf).select("game_id", C.rate_per_exposure("pts", "minutes").alias("pts_per_min"))
    return rounded(rows, digits=8)


@query(
    "scl_won_flag",
    sql("select game_id, (coalesce(result, '') like 'W%')::int as won from schedule", "schedule"),
)
def won(spark, sf):
    return B.schedule(spark, sf).select("game_id", C.won_flag("result").alias("won"))


@query(
    "scl_clip",
    sql(
        f"select game_id, case when minutes is not null then least(40.0, greatest(2.0, minutes)) end as both_ends, "
        f"case when minutes is not null then least(30.0, minutes) end as upper_end {FROM_LOGS}",
        "game_logs",
    ),
)
def clip(spark, sf):
    return B.game_logs(spark, sf).select(
        "game_id", C.clip("minutes", 2.0, 40.0).alias("both_ends"), C.clip("minutes", high=30.0).alias("upper_end")
    )


@query(
    "scl_sentinel_replace",
    "select event_id, case when r is null or r = -1 then 3.0::double else r end as rest_days, coalesce(case when "
    "event_id % 4 = 0 then 1 end, 0)::int as back_to_back from (select event_id, case when event_id % 3 <> 0 then "
    "(event_id % 6 - 1)::double end as r from events)",
)
def sentinel(spark, sf):
    i = F.col("event_id")
    rest = F.when(i % 3 != 0, (i % 6 - 1).cast("double"))
    return B.table(spark, sf, "events").select(
        "event_id", C.rest_or_default(rest).alias("rest_days"),
        F.coalesce(F.when(i % 4 == 0, 1), F.lit(0)).alias("back_to_back"),
    )


@query(
    "scl_category_encode",
    sql(
        """
select id, case upper(trim(p)) when 'PG' then 1 when 'SG' then 2 when 'SF' then 3 when 'PF' then 4 when 'C' then 5
  else 3 end::int as position_enc from (select id, case id % 4 when 0 then lower(pos) when 1 then ' ' || pos when 2
  then pos end as p from roster)""",
        "roster",
    ),
)
def encode(spark, sf):
    key, pos = F.col("id") % 4, F.col("pos")
    text = F.when(key == 0, F.lower(pos)).when(key == 1, F.concat(F.lit(" "), pos)).when(key == 2, pos)
    return B.roster(spark, sf).select("id", C.position_code(text).alias("position_enc"))


PHASE_SQL = "case when {i} <= 20 then 1 when {i} <= 55 then 2 when {i} <= 72 then 3 else 4 end::int"


@query(
    "scl_phase_bucket",
    f"select event_id, {PHASE_SQL.format(i='i')} as season_phase, coalesce((i >= 56)::int, 0) as is_late_season, "
    f"{PHASE_SQL.format(i='(d // 2)')} as serving_phase from (select event_id, case when event_id % 9 <> 0 then "
    "event_id % 90 end as i, event_id % 200 as d from events)",
)
def phase(spark, sf):
    i = F.col("event_id")
    index = F.when(i % 9 != 0, i % 90)
    return B.table(spark, sf, "events").select(
        "event_id",
        C.phase_bucket(index).alias("season_phase"),
        C.late_flag(index).alias("is_late_season"),
        C.phase_bucket(F.floor((i % 200) / 2)).alias("serving_phase"),
    )


STATUS_SQL = """
status as (select player_id, case when player_id % 10 = 3 then 'inactive' when player_id % 10 = 4 then null
    else 'Active' end as roster_status, player_id % 10 <> 5 as has_log,
    (dnp_count % 4)::int as dnp, (player_id % 9)::bigint as gap, 'Player ' || player_id::varchar as name from avail),
judged as (select *, roster_status = 'inactive' as inactive, dnp >= 2 or gap >= 7 as gone,
    dnp = 1 or (gap >= 4 and gap < 7) as doubtful,
    'Has not played in ' || gap::varchar || ' days' as idle from status),
reasons as (select *, case when dnp >= 2 then 'Did not play in ' || dnp::varchar || ' of last 5 games' else idle end
    as gone_reason, case when dnp = 1 then 'Missed 1 of last 5 games' else idle end as doubt_reason from judged)"""


@query(
    "scl_availability_status",
    sql(
        """
select player_id, case when coalesce(inactive, false) then 'Inactive' when not has_log then 'Unknown'
    when gone then 'Injured / Out' when doubtful then 'Questionable' else 'Active' end as status,
  case when coalesce(inactive, false) then 'Listed as inactive on NBA roster' when not has_log then null
    when gone then gone_reason when doubtful then doubt_reason end as reason,
  coalesce(inactive, false) or (has_log and gone) as is_injured,
  case when coalesce(inactive, false) then name || ' is currently INACTIVE on the NBA roster. Verify availability before using this prediction.'
    when not has_log then 'Could not verify injury status — check injury reports before wagering.'
    when gone then name || ' appears to be injured or resting (' || gone_reason || '). Check the latest injury report before using this prediction.'
    when doubtful then name || ' may be injured or resting (' || doubt_reason || '). Verify they are confirmed active tonight.'
  end as warning
from reasons""",
        "game_logs", ctes=f"{AVAILABLE_SQL}, {STATUS_SQL}",
    ),
)
def availability(spark, sf):
    rows = availability_inputs(B.game_logs(spark, sf), minutes="minutes", as_of="2024-02-01", **EVENTS)
    p = F.col("player_id")
    status = F.when(p % 10 == 3, "inactive").when(p % 10 != 4, "Active")
    result = C.availability(
        status, (F.col("dnp_count") % 4).cast("int"), p % 9, p % 10 != 5, F.concat(F.lit("Player "), p.cast("string"))
    )
    return rows.select("player_id", result.alias("a")).select("player_id", "a.*")


@query(
    "scl_season_label",
    sql("select distinct season, (season - 1)::varchar || '-' || substr(season::varchar, 3) as label from schedule", "schedule"),
)
def season_label(spark, sf):
    return B.schedule(spark, sf).select("season", C.season_label("season").alias("label")).distinct()


@query(
    "scl_starter_flag",
    "select event_id, least(1.0, greatest(0.0, coalesce(try_cast(t as double), 0.0))) as gs_binary, "
    "coalesce((r >= 0.6)::int, 0) as is_likely_starter from (select event_id, case event_id % 4 when 0 then '1' when 1 "
    "then 'x' when 2 then '3' end as t, case when event_id % 5 <> 0 then (event_id % 10) / 10.0::double end as r from events)",
)
def starter(spark, sf):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, "1").when(i % 4 == 1, "x").when(i % 4 == 2, "3")
    rate = F.when(i % 5 != 0, (i % 10) / F.lit(10.0))
    return B.table(spark, sf, "events").select(
        "event_id", C.starter_input(C.number(text)).alias("gs_binary"), C.starter_flag(rate).alias("is_likely_starter")
    )


def cdf_sql(z: str) -> str:
    x, a = f"(abs({z}) / sqrt(2.0::double))", C.ERF_TERMS
    t = f"(1 / (1 + {C.ERF_SCALE}::double * {x}))"
    series = "0.0::double"
    for term in reversed(a):
        series = f"({series} + {term}::double) * {t}"
    erf = f"(1 - ({series}) * exp(-{x} * {x}))"
    return f"(0.5 * (1 + case when {z} < 0 then -{erf} else {erf} end))"


@query(
    "scl_normal_cdf",
    f"select event_id, round({cdf_sql('z')}, 6) as cdf from (select event_id, (value - 20) / 10.0::double as z from events)",
)
def normal_cdf(spark, sf):
    z = (F.col("value") - 20) / F.lit(10.0)
    return rounded(B.table(spark, sf, "events").select("event_id", C.normal_cdf(z).alias("cdf")))


NORMAL_SQL = (
    "case when std > 0 and direction = 'under' then {cdf} when std > 0 then 1 - {cdf} when direction = 'over' and "
    "mean > threshold then 1.0::double else 0.0::double end"
).format(cdf=cdf_sql("((threshold - mean) / nullif(std, 0))"))
BLEND_SQL = (
    "least(0.98, greatest(0.02, (hit * least(n / 20.0::double, 1.0) + normal * (1 - least(n / 20.0::double, 1.0) * 0.5)) "
    "/ (least(n / 20.0::double, 1.0) + 1 - least(n / 20.0::double, 1.0) * 0.5)))"
)


@query(
    "scl_probability_blend",
    f"""
select event_id, round(normal, 6) as normal_prob, round({BLEND_SQL}, 6) as probability from (
  select *, {NORMAL_SQL} as normal from (select event_id, value as mean, (event_id % 7)::double as std,
    25.0::double as threshold, case when event_id % 2 = 0 then 'over' else 'under' end as direction,
    (event_id % 11) / 10.0::double as hit, event_id % 30 + 3 as n from events))""",
)
def blend(spark, sf):
    i = F.col("event_id")
    rows = B.table(spark, sf, "events").select(
        "event_id", F.col("value").alias("mean"), (i % 7).cast("double").alias("std"), F.lit(25.0).alias("threshold"),
        F.when(i % 2 == 0, "over").otherwise("under").alias("direction"), ((i % 11) / F.lit(10.0)).alias("hit"),
        (i % 30 + 3).alias("n"),
    )
    rows = rows.withColumn("normal_prob", C.normal_probability("mean", "std", "threshold", "direction"))
    rows = rows.withColumn("probability", C.probability_blend("hit", "normal_prob", "n"))
    return rounded(rows, "event_id", "normal_prob", "probability")


@query(
    "scl_prediction_range",
    """
select event_id, round_even(greatest(0.0, v - s), 1) as lo, round_even(v + s, 1) as hi from (
  select event_id, value + 0.003::double as v, case when event_id % 6 >= 3 then greatest(coalesce(d, 4.0), 4.0) else 4.0 end::double as s
  from (select *, case when event_id % 8 <> 0 then (event_id % 9)::double end as d from events))""",
)
def prediction_range(spark, sf):
    i = F.col("event_id")
    std = F.when(i % 8 != 0, (i % 9).cast("double"))
    rows = B.table(spark, sf, "events").select(
        "event_id", C.prediction_range(F.col("value") + F.lit(0.003), std, i % 6, C.MIN_SPREAD["pts"]).alias("r")
    )
    return rows.select("event_id", "r.lo", "r.hi")


@query(
    "scl_warnings_array",
    """
select event_id, len(w) as n_warnings, array_to_string(w, ' | ') as warnings from (
  select event_id, list_filter([case when event_id % 5 = 0 then 'Check status' when event_id % 5 = 1 then null
        else nullif('', '') end,
    case when abs(value - a) > 8 then 'Predicted minutes (' || round_even(value, 0)::int::varchar || ') differs from '
      || 'season average (' || round_even(a, 0)::int::varchar || '). Check for load management or injury news.' end,
    case when event_id % 40 < 20 then 'Limited data (' || (event_id % 40)::varchar || ' games). Prediction may be less reliable.' end,
    case when event_id % 3 = 0 then 'Back-to-back game. Verify the player is confirmed in the starting lineup before using this prediction.' end
    ], lambda x: x is not null) as w
  from (select *, (event_id % 50)::double as a from events))""",
)
def warnings(spark, sf):
    i = F.col("event_id")
    given = F.when(i % 5 == 0, "Check status").when(i % 5 == 1, None).otherwise("")
    texts = warning_messages(
        availability_warning=given, predicted="value", average=(i % 50).cast("double"), rows=i % 40, back_to_back=i % 3 == 0
    )
    return B.table(spark, sf, "events").select("event_id", texts.alias("w")).select(
        "event_id", F.size("w").cast("bigint").alias("n_warnings"), F.array_join("w", " | ").alias("warnings")
    )


FEATURES = (
    "rolling_last5_pts", "rolling_last5_pts_per_min", "rolling_last10_reb", "rolling_last5_minutes",
    "rolling_last5_minutes_std", "season_avg_usage_rate", "season_avg_usage_proxy", "opp_def_rank", "home_game",
    "back_to_back", "team_pace", "trend_pts", "position_enc", "vs_opp_rolling3_ast", "rest_days_capped",
)
FEATURES_SQL = "['" + "','".join(FEATURES) + "']"


def label_sql(feature: str, contribution: str, value: str, first_match: bool) -> str:
    def text(template: str, digits) -> str:
        if digits is None:
            return f"'{template}'"
        head, tail = template.split("%s")
        return f"'{head}' || printf('%.{digits}f', round_even({value}, {digits})) || '{tail}'"

    negative = f"case when {feature} in ('back_to_back', 'home_game') then {value} > 0.5 else not {contribution} > 0 end"
    whens = " ".join(
        f"when contains({feature}, '{p}') then case when {negative} then {text(down, d)} else {text(up, d)} end"
        for p, up, down, d in label_table(first_match)
    )
    return f"case {whens} end"


@query(
    "scl_reason_label",
    f"""
select event_id, feature, {label_sql('feature', 'c', 'v', False)} as label,
  {label_sql('feature', 'c', 'v', True)} as label_first_match
from (select event_id, {FEATURES_SQL}[(event_id % {len(FEATURES)} + 1)::int] as feature, value - 20 as c,
  case when event_id % {len(FEATURES)} in (8, 9) then event_id // 100 % 2 else value end as v from events)""",
)
def labels(spark, sf):
    i, n = F.col("event_id"), len(FEATURES)
    feature = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), (i % n + 1).cast("int"))
    binary = F.floor(i / 100) % 2
    rows = B.table(spark, sf, "events").select(
        "event_id", feature.alias("feature"), (F.col("value") - 20).alias("c"),
        F.when((i % n).isin(8, 9), binary.cast("double")).otherwise(F.col("value")).alias("v"),
    )
    return rows.select(
        "event_id", "feature", reason_label("feature", "c", "v").alias("label"),
        reason_label("feature", "c", "v", first_match=True).alias("label_first_match"),
    )


def limit_sql(i: int) -> str:
    return "case target " + " ".join(f"when '{t}' then {v[i]}" for t, v in C.ERROR_LIMITS.items()) + " end"


@query(
    "scl_verdict",
    sql(
        f"""
select target, season, case when {limit_sql(0)} is null then '' when mae <= {limit_sql(1)} then 'great'
  when mae <= {limit_sql(0)} then 'good' else 'needs data' end as verdict
from (select unnest(['pts', 'reb', 'minutes', 'other']) as target, season, avg(abs(reb - ast)) / 2 as mae from game_logs
  group by season)""",
        "game_logs",
    ),
)
def verdicts(spark, sf):
    folds = fold_metrics(B.game_logs(spark, sf), fold="season", actual="reb", predicted="ast")
    targets = F.explode(F.array(*[F.lit(t) for t in ("pts", "reb", "minutes", "other")]))
    rows = folds.select(targets.alias("target"), "season", (F.col("mae") / 2).alias("mae"))
    return rows.select("target", "season", C.verdict("target", "mae").alias("verdict"))


@query(
    "scl_nonneg_round",
    "select event_id, greatest(0.0, round_even(value - 20.003::double, 1)) as shown from events",
)
def nonneg(spark, sf):
    return B.table(spark, sf, "events").select("event_id", C.nonneg_round(F.col("value") - F.lit(20.003)).alias("shown"))


@query(
    "scl_gauge_band",
    """
select event_id, case when p >= 65 then 'high' when p >= 35 then 'middle' else 'low' end as band,
  round(least(value / 55.0::double * 100, 100.0), 6) as share
from (select *, floor((event_id % 101) / 101.0::double * 100 + 0.5) as p from events)""",
)
def gauge(spark, sf):
    probability = (F.col("event_id") % 101) / F.lit(101.0)
    return rounded(
        B.table(spark, sf, "events").select(
            "event_id", C.gauge_band(probability).alias("band"), C.bar_share("value", 55).alias("share")
        )
    )


@query(
    "scl_numeric_coerce",
    "select event_id, try_cast(trim(case event_id % 4 when 0 then value::varchar when 1 then '' when 2 then ' 12 ' else "
    "'1,5' end) as double) as number from events",
)
def coerce(spark, sf):
    key = F.col("event_id") % 4
    text = F.when(key == 0, F.col("value").cast("string")).when(key == 1, "").when(key == 2, " 12 ").otherwise("1,5")
    return B.table(spark, sf, "events").select("event_id", C.number(text).alias("number"))


START_SQL = "case season " + " ".join(f"when {p} then date '{d}'" for p, d in C.PERIOD_STARTS.items()) + (
    f" else date '{C.DEFAULT_PERIOD_START}' end"
)


@query(
    "scl_date_coerce",
    f"""
select event_id, try_cast(case when event_id % 4 = 0 then 'unknown' when event_id % 4 = 1 then '2024-02-30'
    else (ts::date)::varchar end as date) as day,
  greatest(0, date_diff('day', {START_SQL}, date '2026-01-15'))::int as days_into_season
from (select *, (2020 + event_id % 8)::int as season from events)""",
)
def dates(spark, sf):
    key = F.col("event_id") % 4
    text = F.when(key == 0, "unknown").when(key == 1, "2024-02-30").otherwise(F.to_date("ts").cast("string"))
    season = (2020 + F.col("event_id") % 8).cast("int")
    return B.table(spark, sf, "events").select(
        "event_id", C.date_of(text).alias("day"), C.days_into_period(season, "2026-01-15").alias("days_into_season")
    )


@query(
    "scl_missing_feature_fill",
    sql(
        "select game_id, coalesce(minutes, (select median(minutes) from game_logs)) as minutes, "
        "coalesce(case when game_id % 7 <> 0 then pts end, 0.0) as pts from game_logs",
        "game_logs",
    ),
)
def missing_fill(spark, sf):
    from formline.operators.models import fill_missing

    rows = B.game_logs(spark, sf).select("game_id", "minutes", F.when(F.col("game_id") % 7 != 0, F.col("pts")).alias("pts"))
    return fill_missing(fill_missing(rows, ["minutes"], strategy="median"), ["pts"], strategy="zero")


@query(
    "scl_pct_display",
    "select event_id, round_even(p * 100, 0)::int::varchar || '%' as pct_display, round_even(p, 3) as probability "
    "from (select event_id, (event_id % 997) / 997.0::double as p from events)",
)
def percent(spark, sf):
    p = (F.col("event_id") % 997) / F.lit(997.0)
    return B.table(spark, sf, "events").select(
        "event_id", C.percent_text(p).alias("pct_display"), F.bround(p, 3).alias("probability")
    )


@query("scl_date_display", "select o_orderkey, strftime(o_orderdate, '%b %d, %Y') as shown from orders")
def date_display(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", C.date_text("o_orderdate").alias("shown"))
