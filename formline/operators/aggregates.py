"""Grouped statistics and quality reports, each in one pass with map-side partial results."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, flag, won_flag
from ..session import stored
from .joins import lookup_join
from .series import over_series, value_ladder
from .windows import last_n

# Average points per position used to scale ratings.
POSITION_POINTS = {
    "Point Guard": 14.8,
    "Shooting Guard": 13.2,
    "Small Forward": 12.1,
    "Power Forward": 10.9,
    "Center": 9.4,
}


def entity_counts(df: DataFrame, *, name: str, event_time: str) -> DataFrame:
    """Events and last event per entity, by name."""
    return (
        df.where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(event_time).alias("games"), F.max(event_time).alias("last_game"))
        .orderBy(name)
    )


def home_win_rate(
    df, *, side: str, home: str, result: str, default: float = 0.575, source=None, as_of: str | None = None, **kw
) -> DataFrame:
    """Add each side's share of won home events (all rows of ``source``, else of ``df``, count).

    With ``as_of``, the name of a date or time column, only events before the row's own date
    count: all rows of one date see the same past.  Wins and events are added up per side and
    date first, so only those are put in order, hot sides in slices.
    """
    rows = df if source is None else source
    at_home = F.coalesce(F.col(home) == 1, F.lit(False))
    won = won_flag(result).cast("double")
    if as_of is None:
        rates = rows.where(at_home & F.col(side).isNotNull()).groupBy(side).agg(F.avg(won).alias("_rate"))
        out = lookup_join(df, rates, [side])
    else:
        day = F.to_date(as_of)
        counted = rows.select(side, day.alias("_day"), F.when(at_home, won).alias("_won"), F.when(at_home & won.isNotNull(), 1).alias("_one"))
        if source is not None:  # the days on which the rate is asked for
            asked = df.select(side, day.alias("_day"), F.lit(None).cast("double").alias("_won"), F.lit(None).cast("int").alias("_one"))
            counted = counted.unionByName(asked)
        days = counted.where(F.col(side).isNotNull() & F.col("_day").isNotNull()).groupBy(side, "_day")
        days = days.agg(F.sum("_won").alias("_won"), F.sum("_one").alias("_one"))
        past = over_series(days, keys=[side], order=["_day"], running={"_wins": F.col("_won"), "_games": F.col("_one")}, **kw)
        rates = past.select(side, "_day", (F.col("_wins") / F.col("_games")).alias("_rate"))
        out = lookup_join(df.withColumn("_day", day), rates, [side, "_day"]).drop("_day")
    return out.withColumn("home_court_factor", F.bround(F.coalesce("_rate", F.lit(default)), 3)).drop("_rate")


def group_medians(df: DataFrame, *, group: Sequence[str], value: str, name: str = "median", exact: bool = True, **kw):
    """The median per group.

    Exact medians come from counts per distinct value, so no task has to hold the
    values of a group; ``exact=False`` uses Spark's approximate percentile.
    """
    if not exact:
        return df.groupBy(*group).agg(F.percentile_approx(value, 0.5).cast("double").alias(name))
    ladder = value_ladder(df, keys=group, value=value, **kw)
    totals = ladder.groupBy(*group).agg(F.sum("n").alias("_total"))
    placed = lookup_join(ladder, totals, group)
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)

    def holds(at: Column) -> Column:
        return (F.col("smaller") <= at) & (at < F.col("smaller") + F.col("n"))

    middle = F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))
    return placed.groupBy(*group).agg((middle / F.lit(2.0)).alias(name))


DIGITS = (16, 8, 40)  # bits of a value that each pass over the rows settles, the highest first
HELD = 1 << 17  # counts of a column that a task holds before it adds equal ones up


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order; both zeros are one value."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def value_of_bits(bits: int) -> float:
    whole = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", whole))[0]


def _added_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)


def digit_counts(df: DataFrame, n_columns: int, n_parts: int, wanted: list[list[int]], done: int, width: int) -> DataFrame:
    """``column, slot, digit, n1..``: how many values of a column go on from a wanted beginning by each digit.

    ``df`` has ``part`` and the columns ``c0``, ``c1`` and so on; ``wanted`` lists the beginnings, ``done`` bits
    long, of every column in order.  Counted in the task, for as many rows as there are digits, before the shuffle.
    """
    beginnings, shift = [np.array(w, dtype=np.uint64) for w in wanted], np.uint64(64 - done - width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(n_columns)]
        for batch in batches:
            part = batch.column("part").to_numpy().astype(np.uint64)
            for i, seen in enumerate(held):
                if not len(beginnings[i]):
                    continue
                values = batch.column(f"c{i}").to_numpy(zero_copy_only=False)
                have = ~np.isnan(values)
                code, parts = ordered_bits(values[have]) >> shift, part[have]
                if done:
                    begins = code >> np.uint64(width)
                    slot = np.minimum(np.searchsorted(beginnings[i], begins), len(beginnings[i]) - 1)
                    own = beginnings[i][slot] == begins
                    digit = code[own] & np.uint64((1 << width) - 1)
                    code, parts = slot[own].astype(np.uint64) << np.uint64(width) | digit, parts[own]
                if len(code):
                    seen.append(np.unique(code * np.uint64(n_parts) + parts, return_counts=True))
                    if sum(len(c) for c, _ in seen) > HELD:
                        seen[:] = [_added_up(seen)]
        for i, seen in enumerate(held):
            if seen:
                codes, n = _added_up(seen)
                whole, parts = np.divmod(codes, np.uint64(n_parts))
                found = (np.full(len(n), i, np.int32), (whole >> np.uint64(width)).astype(np.int32), (whole & np.uint64((1 << width) - 1)).astype(np.int64), parts.astype(np.int32), n)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["column", "slot", "digit", "part", "n"])

    counted = df.mapInArrow(count, "column int, slot int, digit bigint, part int, n bigint")
    sums = [F.coalesce(F.sum(F.when(F.col("part") < p, F.col("n"))), F.lit(0)).alias(f"n{p}") for p in range(1, n_parts + 1)]
    return counted.groupBy("column", "slot", "digit").agg(*sums)


def prefix_medians(df: DataFrame, columns: Sequence[str], *, part: str, n_parts: int, **kw) -> DataFrame:
    """``column, part, median``: exact medians over the rows of all smaller parts, for parts 1 to ``n_parts``.

    All columns and all expanding prefixes come out of a few passes, whatever the number of distinct
    values: each settles the next bits of the two middle values by counting how many values go on by
    them.  Only counts are shuffled, and only the picked digits reach the driver.  Missing values
    (null, NaN) do not count; a column without values has no row.
    """
    spark, parts = df.sparkSession, range(1, n_parts + 1)
    rows = df.where(F.col(part) < n_parts).select(
        F.greatest(F.col(part), F.lit(0)).cast("int").alias("part"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    )
    wanted, done = [[0]] * len(columns), 0
    middles: dict[tuple[int, int, int], tuple[int, int]] = {}  # (column, part, which of two): beginning, place behind it
    for width in DIGITS:
        # Written once: the slices, the ladder and the totals read it.
        counts = stored(digit_counts(rows, len(columns), n_parts, wanted, done, width), "value_counts")
        if not done:
            for r in counts.groupBy("column").agg(*[F.sum(f"n{p}").alias(f"n{p}") for p in parts]).collect():
                middles |= {(r["column"], p, k): (0, (r[f"n{p}"] - 1 + k) // 2) for p in parts if r[f"n{p}"] for k in (0, 1)}
        asked = [(c, wanted[c].index(begin), p, k, place) for (c, p, k), (begin, place) in middles.items()]
        asked = spark.createDataFrame(asked, "column int, slot int, part int, which int, place bigint")
        ladder = over_series(counts, keys=["column", "slot"], order=["digit"], running={f"s{p}": F.col(f"n{p}") for p in parts}, **kw)
        below = F.get(F.array(*[F.coalesce(f"s{p}", F.lit(0)) for p in parts]), F.col("part") - 1)
        here = F.get(F.array(*[F.col(f"n{p}") for p in parts]), F.col("part") - 1)
        found = ladder.join(F.broadcast(asked), ["column", "slot"]).select("column", "part", "which", "digit", (F.col("place") - below).alias("place"), here.alias("n"))
        picked = {(r["column"], r["part"], r["which"]): r for r in found.where((F.col("place") >= 0) & (F.col("place") < F.col("n"))).collect()}
        middles = {at: (begin << width | picked[at]["digit"], picked[at]["place"]) for at, (begin, _) in middles.items()}
        done += width
        wanted = [sorted({begin for (c, _, _), (begin, _) in middles.items() if c == i}) for i in range(len(columns))]
    out = [
        (c, p, (value_of_bits(middles[i, p, 0][0]) + value_of_bits(middles[i, p, 1][0])) / 2.0)
        for i, c in enumerate(columns) for p in parts if (i, p, 0) in middles
    ]
    return spark.createDataFrame(out, "column string, part int, median double")


def group_median_fill(
    df: DataFrame, *, group: Sequence[str], value: str, exact: bool = True, source: DataFrame | None = None, **kw
) -> DataFrame:
    """Fill nulls with the median of the row's group; rows without a group stay null."""
    medians = group_medians(df if source is None else source, group=group, value=value, name="_median", exact=exact, **kw)
    out = lookup_join(df, medians, group)
    keyed = None
    for c in group:
        keyed = F.col(c).isNotNull() if keyed is None else keyed & F.col(c).isNotNull()
    return out.withColumn(value, F.when(keyed, F.coalesce(value, "_median"))).drop("_median")


def league_mean_scale(stats, *, period, rival, rating, categories=POSITION_POINTS) -> DataFrame:
    """Category average times the rival's rating over the period's mean rating."""
    known = stats.where(F.col(rival).isNotNull() & F.col(rating).isNotNull())
    means = known.groupBy(period).agg(F.avg(rating).alias("_mean"))
    table = F.explode(F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]))
    rows = lookup_join(known, means, [period]).select(period, rival, rating, "_mean", table.alias("position", "_points"))
    scaled = F.bround(F.col("_points") * (F.col(rating) / F.col("_mean")), 2)
    return rows.select(period, rival, "position", scaled.alias("pts_allowed_per_game"))


def profile(df, *, entity, period, event_time, measures: Sequence[str]) -> DataFrame:
    """Rows, entities, periods, time range and mean/min/max per measure, as one row.

    The periods are made distinct before the shuffle, so that only they are gathered.
    """
    periods = df.select(F.col(period).alias("p")).where(F.col("p").isNotNull()).distinct()
    listed = periods.agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p.cast("string")), ",")).scalar()
    stats = [
        f(m).cast("double").alias(f"{m}_{tag}")
        for m in measures
        for tag, f in (("mean", F.avg), ("min", F.min), ("max", F.max))
    ]
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.count_distinct(entity).alias("n_entities"),
        F.first(listed).alias("periods"),
        F.min(event_time).alias("first_event"),
        F.max(event_time).alias("last_event"),
        *stats,
    )


def null_rates(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The ``n`` columns with most nulls: share and count, only where there are any."""
    columns = list(columns or df.columns)
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return (
        shares.unpivot([], columns, "column", "null_rate")
        .where(F.col("null_rate") > 0)
        .orderBy(F.col("null_rate").desc(), "column")
        .limit(n)
    )


def value_counts(df: DataFrame, value: str, *, least=None, n: int | None = None) -> DataFrame:
    """Frequency per value in value order."""
    rows = df.where(F.col(value).isNotNull())
    if least is not None:
        rows = rows.where(F.col(value) >= least)
    counts = rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(value)
    return counts if n is None else counts.limit(n)


def low_counts(df: DataFrame, *, name: str, event_time: str, least: int = 50) -> DataFrame:
    """Events per entity, most first, with a mark on short histories."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(event_time).alias("games"))
    return counts.withColumn("is_low", flag(F.col("games") < least)).orderBy(F.col("games").desc(), name)


def mean_by_group(df: DataFrame, *, group: str, value: str, name: str = "mean") -> DataFrame:
    rows = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(value).alias(name))
    return rows.orderBy(F.col(name).desc_nulls_last(), group)


def best_per_period(stats, *, period, side, rating) -> DataFrame:
    """The side with the lowest rating of each period."""
    best = F.min_by(F.struct(side, rating), F.struct(rating, side))
    return stats.where(F.col(rating).isNotNull()).groupBy(period).agg(best.alias("_b")).select(period, "_b.*")


def flag_share(df: DataFrame, *, flag_column: str, by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.sum(flag_column).alias("n_flagged"), F.avg(F.col(flag_column).cast("double")).alias("share")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def availability_inputs(log, *, entity, event_time, tiebreak, minutes, as_of, recent=5) -> DataFrame:
    """Per entity: rows under one minute among the last five, and days since the last event."""
    rows = last_n(
        log.where(F.col(entity).isNotNull()), entity=entity, event_time=event_time, tiebreak=tiebreak, n=recent
    )
    gap = F.timestamp_diff("DAY", F.max(event_time).cast("timestamp"), F.lit(as_of).cast("timestamp"))
    return rows.groupBy(entity).agg(
        F.sum(flag(F.coalesce(minutes, F.lit(0.0)) < 1)).alias("dnp_count"), gap.cast("bigint").alias("days_since_last")
    )


def recent_stats(df, *, entity, event_time, tiebreak, values: Sequence[str], window=20, drop_nulls_first=False):
    """Mean, sample deviation and count per value over each entity's last ``window`` rows.

    By default nulls are dropped after the rows are taken; ``drop_nulls_first``
    drops rows without a value first and works on one value at a time.
    """
    rows = df.where(F.col(entity).isNotNull())
    if drop_nulls_first:
        if len(values) != 1:
            raise ValueError("drop_nulls_first needs exactly one value column")
        rows = rows.where(F.col(values[0]).isNotNull())
    rows = last_n(rows, entity=entity, event_time=event_time, tiebreak=tiebreak, n=window)
    aggs = [
        f(v).alias(f"{v}_{tag}")
        for v in values
        for tag, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))
    ]
    return rows.groupBy(entity).agg(F.count("*").alias("n_rows"), *aggs)


def hit_rate(value, threshold, direction) -> Column:
    """Aggregate: share of values strictly past the threshold."""
    value, threshold, direction = col(value), col(threshold), col(direction)
    hit = F.when(direction == "over", value > threshold).otherwise(value < threshold)
    return F.avg(F.when(value.isNotNull(), hit.cast("double")))


def fold_metrics(df: DataFrame, *, fold: str, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R² per fold."""
    miss = F.col(actual) - F.col(predicted)
    spread = F.var_pop(actual) * F.count(miss)
    return df.where(miss.isNotNull()).groupBy(fold).agg(
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (F.lit(1.0) - F.sum(miss * miss) / F.nullif(spread, F.lit(0.0))).alias("r2"),
    )


def error_metrics(folds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over folds and the population deviation of the MAE."""
    aggs = [
        F.avg("mae").alias("cv_mae"),
        F.stddev_pop("mae").alias("cv_mae_std"),
        F.avg("rmse").alias("cv_rmse"),
        F.avg("r2").alias("cv_r2"),
    ]
    if "best_round" in folds.columns:
        aggs.append(F.avg("best_round").alias("avg_best_round"))
    return folds.groupBy(*by).agg(*aggs)


def entity_means(df: DataFrame, *, entity: str, value: str) -> DataFrame:
    rows = df.where(F.col(entity).isNotNull()).groupBy(entity)
    return rows.agg(F.avg(value).alias(f"avg_{value}"), F.count("*").alias("n_rows"))


def value_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum and missing count per column, as one row."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_missing")]
    return df.agg(*aggs)


def marker_columns(df: DataFrame, marker: str = "@") -> DataFrame:
    """For every text column: does it hold nothing but the marker and blanks?"""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    only = [F.bool_and(F.coalesce(F.trim(f"`{c}`"), F.lit("")).isin(marker, "", "nan")).alias(c) for c in texts]
    return df.agg(*only).unpivot([], [f"`{c}`" for c in texts], "column", "is_marker")


def feature_stats(df: DataFrame, *, value: str, flag_column: str, filled: str) -> DataFrame:
    """Mean and maximum of a feature, share of a flag, count of filled rows."""
    return df.agg(
        F.avg(value).alias("mean_value"),
        F.max(value).alias("max_value"),
        F.avg(F.col(flag_column).cast("double")).alias("flag_share"),
        F.count(filled).alias("n_filled"),
    )
