"""Tables of requests in, tables of answers out: context, features, probability, cards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    MIN_SPREAD,
    TARGETS,
    availability,
    date_text,
    days_into_period,
    late_flag,
    normal_probability,
    numeric,
    phase_bucket,
    prediction_range,
    probability_blend,
    usage_rate,
    usage_rate_serving,
)
from ..functions.labels import warning_messages
from ..operators.aggregates import availability_inputs, entity_means, recent_stats
from ..operators.attribution import row_contributions
from ..operators.joins import (
    context_with_fallback,
    live_overlay,
    lookup_join,
    name_resolution,
    next_event,
    prev_event_rest,
    triple_lookup,
)
from ..operators.models import ModelSet, batch_score
from ..operators.ranking import reason_arrays, signed_summary
from ..operators.rows import request_overrides
from ..operators.series import over_series
from ..operators.windows import last_n, latest_row, rolling_names, running_means, running_sums, trend_ratios

# Measures and trends of a fresh log.
LIVE_MEASURES = ("pts", "reb", "ast", "stl", "blk", "minutes", "fg_pct", "fg3_pct", "ft_pct", "tov")
LIVE_TRENDS = ("pts", "reb", "ast")
SIZES = (3, 5, 10)


def next_event_context(
    requests: DataFrame,
    people: DataFrame,
    events: DataFrame,
    history: DataFrame,
    stats: DataFrame,
    logs: DataFrame,
    *,
    as_of: str,
) -> DataFrame:
    """Name to the full context of that person's next event; ``status`` tells why one has none.

    requests: request_id, request_name, position; people: person_id, person_name, team_id,
    roster_status; events: event_id, team_id, side, home, visitor, date; history: team_id,
    past_date; stats: team_abbrev, def_rating, def_rank, pace; logs: person_id, game_date,
    game_id, minutes.
    """
    found = name_resolution(
        requests, people, request_id="request_id", request_name="request_name", name="person_name", ordinal="person_id"
    )
    coming = next_event(
        events, by="team_id", side="side", home="home", visitor="visitor", date_text="date", tiebreak="event_id",
        as_of=as_of,
    ).select("team_id", "side", "game_date", "home_game", "opponent_abbrev")
    rested = prev_event_rest(coming, history, side="team_id", next_time="game_date", event_time="past_date")
    sides = context_with_fallback(rested, stats, rival="opponent_abbrev", side="side", code="team_abbrev")
    shape = availability_inputs(
        logs, entity="person_id", event_time="game_date", tiebreak="game_id", minutes="minutes", as_of=as_of
    ).withColumn("has_log", F.lit(True))
    rows = lookup_join(lookup_join(found, sides, ["team_id"]), shape, ["person_id"])
    answer = F.when(F.col("person_id").isNull(), "unknown entity").when(F.col("game_date").isNull(), "no event").otherwise("ok")
    status = availability(
        "roster_status", "dnp_count", "days_since_last", F.coalesce("has_log", F.lit(False)), "request_name"
    )
    return rows.withColumn("_a", status).select(
        "request_id",
        F.col("request_name").alias("player_name"),
        F.col("person_id").alias("player_id"),
        "opponent_abbrev",
        F.col("home_game").cast("boolean").alias("home_game"),
        *("opp_def_rating", "opp_def_rank", "team_pace", "rest_days", "back_to_back", "position"),
        date_text("game_date").alias("_game_date"),
        F.col("side").alias("_player_team_abbrev"),
        F.col("_a.status").alias("_injury_status"),
        F.col("_a.warning").alias("_injury_warning"),
        answer.alias("status"),
    )


def live_inputs(live: DataFrame, *, entity, pace: DataFrame | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """The rows of a fresh log with their usage, the measures that roll and those with a running mean.

    ``pace`` has one row per entity with ``team_pace``; without one 99.5 is used.
    """
    rows = live
    if "trb" in rows.columns and "reb" not in rows.columns:
        rows = rows.withColumnRenamed("trb", "reb")
    if pace is not None:
        rows = lookup_join(rows, pace.select(entity, F.col("team_pace").alias("_pace")), [entity])
    measures = [m for m in LIVE_MEASURES if m in rows.columns]
    means = [m for m in TARGETS if m in rows.columns]
    if {"fga", "fta", "tov", "minutes"} <= set(rows.columns):
        speed = F.coalesce(F.nullif("_pace", F.lit(0.0)), F.lit(99.5)) if pace is not None else F.lit(99.5)
        rows = rows.withColumn("usage_rate", usage_rate(F.coalesce("fga", F.lit(0.0)), "fta", "tov", "minutes", speed))
        measures, means = [*measures, "usage_rate"], [*means, "usage_rate"]
    return rows, measures, means


def live_rows(live: DataFrame, *, entity, event_time, tiebreak, pace: DataFrame | None = None, **kw) -> DataFrame:
    """The newest row per entity of a fresh log with its rolling values."""
    rows, measures, means = live_inputs(live, entity=entity, pace=pace)
    out = over_series(
        rows, keys=[entity], order=[event_time, tiebreak], lookback=max(SIZES), inputs=measures,
        rolling=rolling_names(measures, SIZES),
        running=running_sums(means) | {"games_played_season": F.lit(1)}, **kw,
    )
    out = trend_ratios(running_means(out, means), [m for m in LIVE_TRENDS if m in measures])
    out = out.withColumn("games_played_season", F.coalesce("games_played_season", F.lit(0)).cast("bigint"))
    newest = latest_row(out, entity=entity, event_time=event_time, tiebreak=tiebreak)
    return newest.drop("_pace")


def request_features(
    requests: DataFrame,
    features: DataFrame,
    *,
    as_of: str,
    positional: DataFrame | None = None,
    live: DataFrame | None = None,
    entity="player_id",
    event_time="game_date",
    tiebreak="game_id",
    period="season",
    live_period: int = 2026,
    consistent: bool = False,
) -> DataFrame:
    """One feature row per request: newest row, live overlay, request context.

    Schedule fatigue, home factor and phase take the neutral values used for serving;
    ``consistent=True`` keeps those of the newest row instead.
    """
    rows = latest_row(features, entity=entity, event_time=event_time, tiebreak=tiebreak)
    if live is not None:
        pace = requests.groupBy(entity).agg(F.min("team_pace").alias("team_pace"))
        fresh = live_rows(live, entity=entity, event_time=event_time, tiebreak=tiebreak, pace=pace)
        rows = live_overlay(rows, fresh, entity=entity, period=period, period_value=live_period)
    out = request_overrides(rows, requests, entity=entity)
    if {"fga", "fta", "tov", "minutes"} <= set(out.columns):
        out = out.withColumn("usage_rate", usage_rate_serving("fga", "fta", "tov", "minutes", "team_pace"))
    out = out.withColumn("days_into_season", days_into_period(period, as_of))
    if not consistent:
        so_far = F.floor(F.col("days_into_season") / 2)
        out = out.withColumns(
            {
                "games_in_last_7_days": F.lit(3),
                "home_court_factor": F.lit(0.575),
                "season_phase": phase_bucket(so_far),
                "is_late_season": late_flag(so_far),
            }
        )
    out = out.drop("opp_pts_allowed_pos", "opp_pos_defense_rank")
    if positional is None:
        return out.withColumns({"opp_pts_allowed_pos": F.lit(0.0), "opp_pos_defense_rank": F.lit(15.0)})
    out = triple_lookup(out, positional, rival="opponent_abbrev", period=period, position="position")
    return out.withColumn("opp_pts_allowed_pos", F.coalesce("opp_pts_allowed_pos", F.lit(0.0)))


DIRECTIONS = ("over", "under")


def check_probability_request(stat: str, direction: str) -> None:
    """For a single request: raise where a table of requests would get a ``status``."""
    if stat not in TARGETS:
        raise ValueError(f"stat must be one of: {', '.join(TARGETS)}")
    if direction not in DIRECTIONS:
        raise ValueError("direction must be 'over' or 'under'")


def request_status(stats: Sequence[str], known: Column, n: Column) -> Column:
    """Why a probability request has no answer, or ``ok``."""
    return (
        F.when(~F.coalesce(F.col("stat").isin(*stats), F.lit(False)), "bad stat")
        .when(~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)), "bad direction")
        .when(~F.coalesce(known, F.lit(False)), "unknown entity")
        .when(F.coalesce(n, F.lit(0)) < 3, "too few rows")
        .otherwise("ok")
    )


def recent_values(
    asked: DataFrame, logs: DataFrame, live: DataFrame | None, stats: Sequence[str], *, entity, event_time, tiebreak, most: int
) -> DataFrame:
    """``entity, stat, is_live, values``: each entity's last values of the stats asked for, newest first.

    ``asked`` has ``entity, stat, _most``, one row each.  Entities in ``live`` answer from it alone: there
    missing values are left out before the last ones are taken, in ``logs`` after.
    """

    def long(rows: DataFrame, is_live: bool) -> DataFrame:
        have = [s for s in stats if s in rows.columns]
        each = F.array(*[F.struct(F.lit(s).alias("stat"), numeric(rows, s).alias("v")) for s in have])
        out = rows.where(F.col(entity).isNotNull()).select(entity, event_time, tiebreak, F.explode(each).alias("_e"))
        out = out.select(entity, event_time, tiebreak, "_e.*", F.lit(is_live).alias("is_live"))
        return out.where(F.col("v").isNotNull()) if is_live else out

    rows = long(logs, False)
    if live is not None:
        rows = rows.join(live.select(entity).distinct(), entity, "left_anti").unionByName(long(live, True))
    # The largest window of all limits the groups before the shuffle, that of the entity what is collected.
    newest = Window.partitionBy(entity, "stat").orderBy(F.col(event_time).desc_nulls_last(), F.col(tiebreak).desc())
    rows = rows.withColumn("_newest", F.row_number().over(newest)).where(F.col("_newest") <= most)
    rows = rows.join(asked, [entity, "stat"]).where(F.col("_newest") <= F.col("_most"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("_newest").alias("i"), "v")))
    return rows.groupBy(entity, "stat").agg(F.transform(listed, lambda x: x["v"]).alias("_values"))


def probabilities(
    requests: DataFrame,
    logs: DataFrame,
    *,
    entity="player_id",
    event_time="game_date",
    tiebreak="game_id",
    stats: Sequence[str] = TARGETS,
    window: int = 20,
    live: DataFrame | None = None,
) -> DataFrame:
    """Over/under probability for a table of (entity, stat, threshold, direction).

    A request may have a ``window`` of its own, of any size.  Entities with rows in ``live``,
    the log of the current period, are answered from it, others from ``logs``; ``source``
    tells which, with the number of values.  An (entity, stat) contributes one row with as
    many values as its largest request asks for.  Every request gives a row; ``status`` tells
    why one has no answer.
    """
    if live is not None and "trb" in live.columns and "reb" not in live.columns:
        live = live.withColumnRenamed("trb", "reb")
    stats = [s for s in stats if s in logs.columns or (live is not None and s in live.columns)]
    own = F.coalesce(F.col("window").cast("int"), F.lit(window)) if "window" in requests.columns else F.lit(window)
    rows = requests.withColumn("_window", F.greatest(own, F.lit(0)))
    asked = rows.where(F.col("stat").isin(*stats)).groupBy(entity, "stat").agg(F.max("_window").alias("_most"))
    most = window if "window" not in requests.columns else (asked.agg(F.max("_most")).first()[0] or 0)
    values = recent_values(asked, logs, live, stats, entity=entity, event_time=event_time, tiebreak=tiebreak, most=most)
    known = logs.where(F.col(entity).isNotNull()).select(entity, F.lit(False).alias("_live"))
    if live is not None:
        known = known.unionByName(live.where(F.col(entity).isNotNull()).select(entity, F.lit(True).alias("_live")))
    known = known.groupBy(entity).agg(F.max("_live").alias("_live"))
    rows = lookup_join(lookup_join(rows, known, [entity]), values, [entity, "stat"])
    none = F.array().cast("array<double>")
    held = F.filter(F.slice(F.coalesce("_values", none), F.lit(1), F.col("_window")), lambda v: v.isNotNull())
    rows = rows.withColumn("_values", held)
    rows = rows.withColumn("status", request_status(stats, F.col("_live").isNotNull(), F.size("_values")))
    n = F.when(F.col("status") == "ok", F.size("_values").cast("bigint"))
    total = F.aggregate("_values", F.lit(0.0), lambda got, v: got + v)
    rows = rows.withColumn("sample_size", n).withColumn("stat_mean", total / F.col("sample_size"))
    spread = F.aggregate("_values", F.lit(0.0), lambda got, v: got + (v - F.col("stat_mean")) * (v - F.col("stat_mean")))
    rows = rows.withColumn("stat_std", F.sqrt(spread / (F.col("sample_size") - 1)))
    over = F.size(F.filter("_values", lambda v: v > F.col("threshold")))
    under = F.size(F.filter("_values", lambda v: v < F.col("threshold")))
    rows = rows.withColumn("hit_rate", F.when(F.col("direction") == "over", over).otherwise(under) / F.col("sample_size"))
    rows = rows.withColumn("normal_prob", normal_probability("stat_mean", "stat_std", "threshold", "direction"))
    blended = probability_blend("hit_rate", "normal_prob", "sample_size")
    rows = rows.withColumn("probability", F.when(F.col("status") == "ok", blended))
    rows = rows.withColumn("normal_prob", F.when(F.col("status") == "ok", F.col("normal_prob")))
    kind = F.when(F.col("_live"), "current season").otherwise("training data")
    told = F.concat(kind, F.lit(" ("), F.col("sample_size").cast("string"), F.lit(" games)"))
    rows = rows.withColumn("source", told)
    found = ("probability", "hit_rate", "normal_prob", "sample_size", "stat_mean", "stat_std", "status", "source")
    return rows.select(*requests.columns, *found)


def probability_display(df: DataFrame) -> DataFrame:
    """The rounded values shown to users."""
    from ..functions.columns import percent_text

    digits = {"probability": 3, "hit_rate": 3, "normal_prob": 3, "stat_mean": 1, "stat_std": 1}
    return df.withColumn("pct_display", percent_text("probability")).withColumns(
        {c: F.bround(c, d) for c, d in digits.items()}
    )


def prediction_ranges(
    predictions: DataFrame, logs: DataFrame, *, entity, event_time, tiebreak, targets: Sequence[str] = TARGETS, window=15
) -> DataFrame:
    """Add ``range_<target>`` structs from the spread of the last ``window`` rows."""
    stats = recent_stats(
        logs, entity=entity, event_time=event_time, tiebreak=tiebreak, values=list(targets), window=window
    ).select(entity, F.col("n_rows").alias("_n"), *[F.col(f"{t}_std").alias(f"_std_{t}") for t in targets])
    rows = lookup_join(predictions, stats, [entity])
    ranges = {
        f"range_{t}": prediction_range(f"pred_{t}", f"_std_{t}", F.coalesce("_n", F.lit(0)), MIN_SPREAD[t])
        for t in targets
    }
    return rows.withColumns(ranges).drop("_n", *[f"_std_{t}" for t in targets])


def prediction_cards(
    feature_rows: DataFrame,
    logs: DataFrame,
    models: ModelSet,
    *,
    request="request_id",
    entity="player_id",
    event_time="game_date",
    tiebreak="game_id",
    context: Mapping[str, str] | None = None,
    first_match: bool = False,
) -> DataFrame:
    """Predictions, ranges, reasons and warnings for one feature row per request.

    ``context`` may name columns of ``feature_rows`` for ``game_date``,
    ``injury_warning`` and ``injury_status``.
    """
    context = dict(context or {})
    targets = list(models.models)
    scored = batch_score(feature_rows, models)
    scored = prediction_ranges(
        scored, logs, entity=entity, event_time=event_time, tiebreak=tiebreak, targets=targets
    )
    averages = entity_means(logs, entity=entity, value="minutes").withColumnRenamed("n_rows", "_rows")
    scored = lookup_join(scored, averages, [entity])

    wide, _ = row_contributions(feature_rows, models, key=request)
    explained = signed_summary(reason_arrays(wide, models.features, targets, first_match=first_match), targets)
    scored = lookup_join(scored, explained.select(request, "reasoning"), [request])

    def given(name: str):
        return F.col(context[name]) if name in context else F.lit(None).cast("string")

    warnings = warning_messages(
        availability_warning=given("injury_warning"), predicted="pred_minutes", average="avg_minutes",
        rows=F.coalesce("_rows", F.lit(0)), back_to_back="back_to_back",
    )
    return scored.select(
        request,
        entity,
        F.col("opponent_abbrev").alias("opponent"),
        given("game_date").alias("game_date"),
        F.struct(*[F.col(f"pred_{t}").alias(t) for t in targets]).alias("predictions"),
        F.struct(*[F.col(f"range_{t}").alias(t) for t in targets]).alias("ranges"),
        F.col("pred_fantasy_score").alias("fantasy_score"),
        "reasoning",
        warnings.alias("warnings"),
        given("injury_status").alias("injury_status"),
    )
