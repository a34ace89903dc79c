"""Lookups and as-of joins.

Dimension joins carry no broadcast hint: with adaptive execution Spark broadcasts
a side only when its size is below the session's limit, and otherwise splits the
skewed partitions of a sort-merge join.  Only tables whose size is bounded by
construction are broadcast by hint, and that is said where it happens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SHORT_CODES, clean_name, code_normalise, last_token, position_name


def lookup_join(df: DataFrame, dim: DataFrame, on: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left join to a table with one row per key."""
    if not null_safe:
        return df.join(dim, list(on), "left")
    right = dim.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        match = same if match is None else match & same
    return df.join(right, match, "left").drop(*[f"_r_{c}" for c in on])


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key in the given order; one row per key and task is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


def left_context(logs, schedule, *, on, context, order) -> DataFrame:
    """Add schedule columns to every log row; null keys match null keys.

    The schedule is reduced to its first row per key before the join.
    """
    slim = first_by_key(schedule, on, order).select(*on, *context)
    return lookup_join(logs, slim, on, null_safe=True)


def key_violations(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def assert_many_to_one(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Return ``df`` if its keys are unique, else raise."""
    if not key_violations(df, on).isEmpty():
        raise ValueError(f"keys are not unique: {', '.join(on)}")
    return df


def rival_dimension(schedule, stats, *, rival, period, side) -> DataFrame:
    """Rival's pace and ratings as ``opp_*`` columns."""
    dim = stats.select(
        F.col(side).alias(rival),
        F.col(period),
        F.col("team_pace").alias("opp_pace"),
        F.col("team_def_rating").alias("opp_def_rating"),
        *([F.col("team_off_rating").alias("opp_off_rating")] if "team_off_rating" in stats.columns else []),
    )
    return lookup_join(schedule, dim, [rival, period])


def side_dimension(schedule, stats, *, period, side, stats_side=None) -> DataFrame:
    """The side's own pace."""
    dim = stats.select(F.col(stats_side or side).alias(side), F.col(period), F.col("team_pace"))
    return lookup_join(schedule, dim, [side, period])


def id_to_code(df, codes, *, id_column, code_column) -> DataFrame:
    """Add the code of an id from a code table."""
    return lookup_join(df, codes.select(id_column, code_column), [id_column])


def first_rating(df, *, rival, period, rating, entity, event_time, tiebreak) -> DataFrame:
    """First non-null rating per (rival, period) in entity and time order."""
    order = F.struct(entity, event_time, tiebreak)
    known = df.where(F.col(rating).isNotNull() & F.col(rival).isNotNull() & F.col(period).isNotNull())
    return known.groupBy(rival, period).agg(F.min_by(rating, order).alias(rating))


def rank_backfill(
    df, *, rival, period, rating, entity, event_time, tiebreak, name="opp_def_rank", source=None, **kw
) -> DataFrame:
    """Rank the rivals of each period by rating and write the rank to every row.

    ``source`` may name a cheaper table with the same rating rows.
    """
    from .windows import average_rank

    ratings = first_rating(
        df if source is None else source, rival=rival, period=period, rating=rating, entity=entity, event_time=event_time, tiebreak=tiebreak
    )
    ranks = average_rank(ratings, partition=[period], value=rating, name=name, **kw)
    return lookup_join(df, ranks.select(rival, period, name), [rival, period])


def unique_only(dim: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once; a repeated key counts as no match."""
    aggs = [F.first(v).alias(v) for v in values]
    return dim.groupBy(*on).agg(F.count("*").alias("_n"), *aggs).where(F.col("_n") == 1).drop("_n")


def triple_lookup(df, table, *, rival, period, position, value="pts_allowed_per_game", rank="rank") -> DataFrame:
    """Points allowed and rank by (rival, period, position name); misses give null and 15.

    A missing position counts as the third one, a missing period as 2024.
    """
    dim = unique_only(table, [rival, period, "position"], [value, rank])
    right = dim.select(
        F.col(rival).alias("_rival"), F.col(period).alias("_period"), F.col("position").alias("_position"),
        F.col(value).cast("double").alias("opp_pts_allowed_pos"),
        F.col(rank).cast("double").alias("_rank"),
    )
    match = (
        (F.col(rival) == F.col("_rival"))
        & (F.coalesce(F.col(period), F.lit(2024)) == F.col("_period"))
        & (position_name(position) == F.col("_position"))
    )
    joined = df.join(right, match, "left").drop("_rival", "_period", "_position")
    return joined.withColumn("opp_pos_defense_rank", F.coalesce("_rank", F.lit(15.0))).drop("_rank")


def unmatched_report(df, *, missing, keys, n=10) -> DataFrame:
    """The ``n`` keys with most rows that found no match."""
    counts = df.where(F.col(missing).isNull()).groupBy(*keys).agg(F.count("*").alias("n_unmatched"))
    return counts.orderBy(F.col("n_unmatched").desc(), *keys).limit(n)


def parts_up_to(name: Column, token: Column) -> Column:
    """The parts of a cleaned name that end where ``token`` ends in it; all parts where the token is empty."""
    ends = F.filter(F.sequence(F.lit(0), F.length(name)), lambda e: F.endswith(F.substring(name, F.lit(1), e), token))
    starts = lambda e: F.transform(F.sequence(F.lit(1), e + 1), lambda s: F.substring(name, s, e + 1 - s))
    return F.array_distinct(F.flatten(F.transform(ends, starts)))


def name_resolution(requests, people, *, request_id, request_name, name, ordinal) -> DataFrame:
    """Resolve free-text names; every request gets a row, with null person columns if nobody shares its last token.

    Among the people with the request's last token the first in list order whose cleaned
    name equals, contains or is contained wins, else the first.  One name contains another
    exactly if the other is a part of it that ends with the token, so three joins on keys
    with one row each find the answer and no pairs are made.
    """

    def first(rows: DataFrame, keys: Sequence[str], found: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min(ordinal).alias(found))

    def bare(df: DataFrame, text: str) -> DataFrame:
        named = df.withColumn("_token", last_token(text)).withColumn("_bare", clean_name(text))
        return named.withColumn("_end", F.translate(F.col("_token"), "'.", ""))

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("_bare", F.explode(parts_up_to(F.col("_bare"), F.col("_end"))))

    known = bare(people.select(name, ordinal), name).select("_token", "_bare", "_end", ordinal)
    asked = bare(requests, request_name)
    inside = first(spread(known), ["_token", "_bare"], "_inside")
    around = spread(asked.select(request_id, "_token", "_bare", "_end"))
    around = around.join(first(known, ["_token", "_bare"], "_around"), ["_token", "_bare"])
    around = around.groupBy(request_id).agg(F.min("_around").alias("_around"))
    out = asked.join(inside, ["_token", "_bare"], "left").join(around, request_id, "left")
    out = out.join(first(known, ["_token"], "_any"), "_token", "left")
    hit = F.least("_inside", "_around")
    out = out.withColumn("matched", F.when(F.col("_any").isNotNull(), hit.isNotNull()))
    out = out.withColumn("_chosen", F.coalesce(hit, "_any"))
    out = out.select(*requests.columns, "_chosen", "matched")
    persons = people.withColumn("_chosen", F.col(ordinal))
    return out.join(persons, "_chosen", "left").select(*requests.columns, *people.columns, "matched")


def next_event(schedule, *, by, side, home, visitor, date_text, tiebreak, as_of) -> DataFrame:
    """Earliest event per ``by`` (a side's id) on or after ``as_of``.

    ``schedule`` has one row per side and event with the side's code, raw home and
    visitor codes and a text date.  A date that cannot be read sorts last (2099-01-01).  A side that is
    neither home nor visitor counts as home against the visitor.
    """
    day = F.coalesce(
        F.to_date(F.try_to_timestamp(F.substring(F.col(date_text), 1, 10), F.lit("yyyy-MM-dd"))),
        F.lit("2099-01-01").cast("date"),
    )
    rows = schedule.withColumn("game_date", day).where(F.col("game_date") >= F.lit(as_of).cast("date"))
    first = first_by_key(rows, [by], ["game_date", tiebreak])
    home_code, visitor_code = code_normalise(home, SHORT_CODES), code_normalise(visitor, SHORT_CODES)
    mine = F.upper(F.col(side))
    away = (visitor_code == mine) & (home_code != mine)
    return first.withColumns(
        {
            "home_game": F.when(away, 0).otherwise(1),
            "opponent_abbrev": F.when(away, home_code).otherwise(visitor_code),
        }
    )


def prev_event_rest(upcoming, history, *, side, next_time, event_time) -> DataFrame:
    """Rest before the upcoming event: days since the latest earlier one, less one.

    No earlier event gives -1, an unknown side gives 1.  ``upcoming`` has one row per
    side, so the join adds no rows and the maximum is taken before the shuffle.
    """
    known = history.join(upcoming.select(side, next_time), side, "inner")
    last = known.groupBy(side).agg(F.max(F.when(F.col(event_time) < F.col(next_time), F.col(event_time))).alias("_last"))
    joined = lookup_join(upcoming, last.withColumn("_known", F.lit(True)), [side])
    gap = F.timestamp_diff("DAY", F.col("_last").cast("timestamp"), F.col(next_time).cast("timestamp")) - 1
    rest = (
        F.when(F.col("_known").isNull(), F.lit(1))
        .when(F.col("_last").isNull(), F.lit(-1))
        .otherwise(F.greatest(F.lit(0), gap))
        .cast("int")
    )
    back = F.col("_last").isNotNull() & (F.col("rest_days") == 0)
    return joined.withColumn("rest_days", rest).withColumn("back_to_back", back).drop("_last", "_known")


def task_grid(entities: DataFrame, periods: Sequence, *, period: str) -> DataFrame:
    """Every entity once per listed period, as a narrow explode of a short list."""
    return entities.withColumn(period, F.explode(F.array(*[F.lit(p) for p in periods])))


def missing_pairs(entities, rows, periods, *, entity, period) -> DataFrame:
    """(entity, period) pairs of the grid without any row: the list to fetch again."""
    done = rows.select(entity, period).distinct()
    return task_grid(entities.select(entity).distinct(), periods, period=period).join(done, [entity, period], "left_anti")


def live_overlay(base, live, *, entity, period=None, period_value=None) -> DataFrame:
    """Overwrite shared columns of ``base`` with the non-null values of ``live``."""
    shared = [c for c in live.columns if c in base.columns and c != entity]
    fresh = live.select(entity, *[F.col(c).alias(f"_l_{c}") for c in shared], F.lit(True).alias("_live"))
    out = base.join(fresh, entity, "left")
    values = {c: F.coalesce(f"_l_{c}", c) for c in shared}
    if period is not None:
        values[period] = F.when(F.col("_live"), F.lit(period_value)).otherwise(values.get(period, F.col(period)))
    return out.withColumns(values).select(*base.columns)


def context_with_fallback(
    events, stats, *, rival, side, code, period: str | None = None, def_rating=113.5, def_rank=15, pace=99.5
) -> DataFrame:
    """Rival's rating and rank and the side's pace, with fixed values where unknown.

    ``stats`` has one row per code, or, with ``period``, one per code and period of the event.
    """
    of = [F.col(period).alias("_period")] if period else []
    rivals = stats.select(
        F.col(code).alias("_rival"), *of, F.col("def_rating").alias("_rating"), F.col("def_rank").alias("_rank")
    )
    sides = stats.select(F.col(code).alias("_side"), *[c.alias("_own_period") for c in of], F.col("pace").alias("_pace"))
    same, own = F.col(rival) == F.col("_rival"), code_normalise(side, SHORT_CODES) == F.col("_side")
    if period:
        same, own = same & (F.col(period) == F.col("_period")), own & (F.col(period) == F.col("_own_period"))
    joined = events.join(rivals, same, "left").join(sides, own, "left")
    return joined.select(
        *events.columns,
        F.bround(F.coalesce("_rating", F.lit(def_rating)), 1).alias("opp_def_rating"),
        F.coalesce("_rank", F.lit(def_rank)).cast("int").alias("opp_def_rank"),
        F.bround(F.coalesce("_pace", F.lit(pace)), 1).alias("team_pace"),
    )
