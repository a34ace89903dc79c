"""Point-in-time window operators: a row only ever sees earlier rows of its series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flag, numeric, rate_per_exposure, starter_input, trend_ratio, true_shooting
from .joins import lookup_join
from .series import ROWS_PER_SLICE, Rolling, over_series, slice_plan, value_ladder


def mean_of(name: str, n: int):
    return lambda frame: F.avg(name).over(frame(n))


def std_of(name: str, n: int, fill: float | None = None):
    def build(frame) -> Column:
        value = F.stddev_samp(name).over(frame(n))
        return value if fill is None else F.coalesce(value, F.lit(fill))

    return build


def rate_of(name: str, n: int, at_least: int, fill: float):
    def build(frame) -> Column:
        enough = F.count(name).over(frame(n)) >= at_least
        return F.coalesce(F.when(enough, F.avg(name).over(frame(n))), F.lit(fill))

    return build


def rolling_names(measures: Sequence[str], sizes: Sequence[int]) -> Rolling:
    return {f"rolling_last{n}_{m}": mean_of(m, n) for m in measures for n in sizes}


def lagged_rolling_mean(df, *, entity, event_time, tiebreak, measures, sizes=(3, 5, 10), plan=None, **kw) -> DataFrame:
    """Mean of the previous n rows; one non-null value is enough."""
    return over_series(
        df, keys=[entity], order=[event_time, tiebreak], lookback=max(sizes), plan=plan, inputs=measures,
        rolling=rolling_names(measures, sizes), **kw,
    )


def lagged_rolling_std(df, *, entity, event_time, tiebreak, measure, size=5, fill=3.5, plan=None, **kw) -> DataFrame:
    """Sample deviation of the previous rows; fewer than two values give ``fill``."""
    name = f"rolling_last{size}_{measure}_std"
    return over_series(
        df, keys=[entity], order=[event_time, tiebreak], lookback=size, plan=plan, inputs=[measure],
        rolling={name: std_of(measure, size, fill)}, **kw,
    )


def running_sums(measures: Sequence[str]) -> dict[str, Column]:
    sums = {f"_sum_{m}": F.col(m) for m in measures}
    return sums | {f"_num_{m}": F.when(F.col(m).isNotNull(), 1).otherwise(0) for m in measures}


def running_means(df: DataFrame, measures: Sequence[str], prefix: str = "season_avg_") -> DataFrame:
    """Turn running sums and counts into means and drop them."""
    means = {f"{prefix}{m}": F.col(f"_sum_{m}") / F.nullif(F.col(f"_num_{m}"), F.lit(0)) for m in measures}
    return df.withColumns(means).drop(*running_sums(measures))


def period_expanding_mean(
    df, *, entity, event_time, tiebreak, measures, period=None, prefix="season_avg_", plan=None, **kw
) -> DataFrame:
    """Mean of all earlier rows in (entity, period), or of the entity without period."""
    out = over_series(
        df, keys=[entity], order=[event_time, tiebreak], within=[period] if period else [], plan=plan,
        running=running_sums(measures), **kw,
    )
    return running_means(out, measures, prefix)


def rival_rolling_mean(df, *, entity, rival, event_time, tiebreak, measures, size=3, plan=None, **kw) -> DataFrame:
    """Mean of the previous meetings with the same rival."""
    return over_series(
        df, keys=[entity, rival], order=[event_time, tiebreak], lookback=size, plan=plan, inputs=measures,
        rolling={f"vs_opp_rolling{size}_{m}": mean_of(m, size) for m in measures}, **kw,
    )


def lagged_start_rate(df, *, entity, event_time, tiebreak, start, size=10, at_least=3, fill=0.8, plan=None, **kw):
    """Share of starts over the previous rows, ``fill`` below ``at_least`` values."""
    rows = df.withColumn("gs_binary", starter_input(numeric(df, start)))
    return over_series(
        rows, keys=[entity], order=[event_time, tiebreak], lookback=size, plan=plan, inputs=["gs_binary"],
        rolling={f"start_rate_last{size}": rate_of("gs_binary", size, at_least, fill)}, **kw,
    )


def cumulative_index(df, *, entity, event_time, tiebreak, period=None, name="games_played_season", plan=None, **kw):
    """Zero-based index of the row in its (entity, period)."""
    out = over_series(
        df, keys=[entity], order=[event_time, tiebreak], within=[period] if period else [], plan=plan,
        running={name: F.lit(1)}, **kw,
    )
    keyed = F.col(entity).isNotNull() & (F.col(period).isNotNull() if period else F.lit(True))
    return out.withColumn(name, F.when(keyed, F.coalesce(name, F.lit(0))).cast("bigint"))


def period_start_offset(df, *, period, event_time, name="days_into_season", source=None) -> DataFrame:
    """Whole days since the first event of the period over all entities.

    The minimum is taken before the shuffle; its result has one row per period.
    ``source`` may name a cheaper table with the same rows.
    """
    first = (df if source is None else source).where(F.col(period).isNotNull()).groupBy(period).agg(F.min(event_time).alias("_first"))
    days = F.timestamp_diff("DAY", F.col("_first").cast("timestamp"), F.col(event_time).cast("timestamp"))
    return lookup_join(df, first, [period]).withColumn(name, days.cast("bigint")).drop("_first")


def trailing_days_count(
    df, *, entity, event_time, tiebreak, days=7, name="games_in_last_7_days", plan=None, rows_per_slice=ROWS_PER_SLICE
) -> DataFrame:
    """Earlier rows of the entity not older than ``days`` (limit included)."""
    plan = plan or slice_plan(df, [entity], [event_time, tiebreak], rows_per_slice=rows_per_slice)
    if not plan.split:
        return _trailing_by_range(df, entity, event_time, tiebreak, days, name)
    return _trailing_by_index(df, entity, event_time, tiebreak, days, name, rows_per_slice)


def _trailing_by_range(df, entity, event_time, tiebreak, days, name) -> DataFrame:
    """Index of the row less the number of rows before its cutoff.

    Both frames only grow along the series, so the work per row does not depend on
    how many rows the last days hold.
    """
    rows = Window.partitionBy(entity).orderBy(F.col(event_time).asc_nulls_last(), F.col(tiebreak).asc_nulls_last())
    just_over = f"{days + 1}' day" if dict(df.dtypes)[event_time] == "date" else f"{days} 00:00:00.000001' day to second"
    older = F.expr(
        f"count(*) over (partition by `{entity}` order by `{event_time}` nulls last "
        f"range between unbounded preceding and (interval '{just_over}) preceding)"
    )
    # The finer order first: its sort also serves the window ordered by time alone.
    out = df.withColumn("_row", F.row_number().over(rows) - 1).withColumn("_older", older)
    timed = F.col(entity).isNotNull() & F.col(event_time).isNotNull()
    count = F.when(timed, F.col("_row") - F.col("_older")).otherwise(0)
    return out.withColumn(name, count.cast("bigint")).drop("_row", "_older")


def _trailing_by_index(df, entity, event_time, tiebreak, days, name, rows_per_slice) -> DataFrame:
    """Index of the row less the number of rows before its cutoff.

    Every row also sends a probe to its cutoff time; one running count over rows
    and probes gives both numbers, and they meet again on (entity, time, tiebreak),
    which is total.  Rows without an entity or a time have no earlier rows.
    """
    timed = df.where(F.col(entity).isNotNull() & F.col(event_time).isNotNull())
    rest = df.where(F.col(entity).isNull() | F.col(event_time).isNull()).withColumn(name, F.lit(0).cast("bigint"))
    keys = timed.select(F.col(entity), F.col(event_time).alias("_time"), F.col(tiebreak))
    cutoff = F.col("_time") - F.expr(f"interval '{days}' day")
    own = keys.withColumn("_at", F.col("_time")).withColumn("_is_row", F.lit(1))
    probe = keys.withColumn("_at", cutoff.cast(own.schema["_at"].dataType)).withColumn("_is_row", F.lit(0))
    counted = over_series(
        own.unionByName(probe), keys=[entity], order=["_at", "_is_row", tiebreak, "_time"],
        running={"_before": F.col("_is_row")}, rows_per_slice=rows_per_slice,
    )
    before = F.coalesce("_before", F.lit(0))
    signed = F.when(F.col("_is_row") == 1, before).otherwise(-before)
    # A repeated key sends as many rows as probes; the mean over them is that of one.
    counts = counted.groupBy(entity, "_time", tiebreak).agg((F.sum(signed) / F.sum("_is_row")).cast("bigint").alias(name))
    counts = counts.withColumnRenamed("_time", event_time)
    return lookup_join(timed, counts, [entity, event_time, tiebreak], null_safe=True).unionByName(rest)


def rest_days(df, *, side, event_time, tiebreak, period=None, plan=None, **kw) -> DataFrame:
    """Days off before the event (-1 for the first one) and the back-to-back flag."""
    keys = [side, period] if period else [side]
    out = over_series(
        df, keys=keys, order=[event_time, tiebreak], lookback=1, plan=plan, inputs=[],
        rolling={"_prev": lambda frame: F.max(event_time).over(frame(1))}, **kw,
    )
    gap = F.timestamp_diff("DAY", F.col("_prev").cast("timestamp"), F.col(event_time).cast("timestamp")) - 1
    return (
        out.withColumn("rest_days", F.coalesce(gap, F.lit(-1)).cast("int"))
        .withColumn("back_to_back", flag(F.col("rest_days") == 0))
        .drop("_prev")
    )


def average_rank(df, *, partition: Sequence[str], value: str, name: str, truncate=False, **kw) -> DataFrame:
    """Ascending rank with ties averaged; null values get no rank."""
    ladder = value_ladder(df, keys=partition, value=value, **kw)
    rank = F.col("smaller") + (F.col("n") + 1) / F.lit(2.0)
    ranks = ladder.select(*partition, value, (rank.cast("int") if truncate else rank).alias(name))
    return lookup_join(df, ranks, [*partition, value])


def latest_row(df, *, entity, event_time, tiebreak) -> DataFrame:
    """The last row of every entity; only one row per entity and task is shuffled."""
    return last_n(df, entity=entity, event_time=event_time, tiebreak=tiebreak, n=1)


def last_n(df, *, entity, event_time, tiebreak, n: int, index: str | None = None) -> DataFrame:
    """The last n rows of every entity (``index`` = 1 for the newest).

    Spark limits the groups before the shuffle, so a huge entity costs n rows per task.
    """
    newest = Window.partitionBy(entity).orderBy(F.col(event_time).desc_nulls_last(), F.col(tiebreak).desc())
    name = index or "_newest"
    out = df.withColumn(name, F.row_number().over(newest)).where(F.col(name) <= n)
    return out if index else out.drop(name)


def trend_ratios(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Short over long rolling mean, limited to [0.3, 3]."""
    return df.withColumns({f"trend_{m}": trend_ratio(f"rolling_last3_{m}", f"rolling_last10_{m}") for m in measures})


EFFICIENCY: Rolling = {
    "rolling_last3_ts_pct": mean_of("ts_pct", 3),
    "rolling_last5_ts_pct": mean_of("ts_pct", 5),
    "rolling_last5_pts_per_min": mean_of("pts_per_min", 5),
}


def efficiency_inputs(df: DataFrame, *, pts="pts", fga="fga", fta="fta", minutes="minutes") -> DataFrame:
    return df.withColumns(
        {"ts_pct": true_shooting(pts, fga, fta), "pts_per_min": rate_per_exposure(pts, minutes)}
    )


def rolling_ratios(df, *, entity, event_time, tiebreak, plan=None, **kw) -> DataFrame:
    """Rolling true shooting and points per minute."""
    return over_series(
        efficiency_inputs(df), keys=[entity], order=[event_time, tiebreak], lookback=5, plan=plan,
        inputs=["ts_pct", "pts_per_min"],
        rolling=EFFICIENCY, **kw,
    )


def as_of_next(df, *, entity, event_time, tiebreak, measures, sizes=(3, 5, 10), inclusive=False, **kw) -> DataFrame:
    """One row per entity for its upcoming event.

    ``inclusive=False`` takes the values of the last row as they are, which leave
    the last event out; ``inclusive=True`` averages the last n events themselves.
    """
    if not inclusive:
        out = lagged_rolling_mean(
            df, entity=entity, event_time=event_time, tiebreak=tiebreak, measures=measures, sizes=sizes, **kw
        )
        return latest_row(out, entity=entity, event_time=event_time, tiebreak=tiebreak)
    recent = last_n(
        df.where(F.col(entity).isNotNull()), entity=entity, event_time=event_time, tiebreak=tiebreak,
        n=max(sizes), index="_newest",
    )
    means = [
        F.avg(F.when(F.col("_newest") <= n, F.col(m))).alias(f"rolling_last{n}_{m}") for m in measures for n in sizes
    ]
    ids = [F.max_by(c, F.struct(event_time, tiebreak)).alias(c) for c in (event_time, tiebreak)]
    return recent.groupBy(entity).agg(*ids, *means)

