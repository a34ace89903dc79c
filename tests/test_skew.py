"""One key holds a third of the rows and is cut into slices: nothing may change."""

import pytest
from pyspark.sql import functions as F

from formline import bindings as B
from formline.operators import aggregates as A
from formline.operators import splits as S
from formline.operators import windows as W
from formline.operators.series import slice_plan, value_ladder

SERIES = {"entity": "player_id", "event_time": "game_date", "tiebreak": "game_id"}
MEASURES = ("pts", "minutes")
SMALL = 100
WHOLE = 10**9


@pytest.fixture(scope="module")
def hot(spark):
    """Every third player is player 0; some rows have no player, a third of the times are tied."""
    rows = B.game_logs(spark, "/root/testdata/sf0.01")
    player = F.when(F.col("game_id") % 50 == 7, None).when(F.col("player_id") % 3 == 0, 0).otherwise(F.col("player_id"))
    tied = F.when(F.col("game_id") % 3 == 0, F.date_trunc("day", "game_date").cast("timestamp_ntz"))
    rows = rows.withColumn("player_id", player).withColumn("game_date", F.coalesce(tied, "game_date"))
    return rows.persist()


@pytest.fixture(scope="module")
def untimed(hot):
    """A fortieth of the rows has no time, and most of the others fall into one day."""
    time = F.when(F.col("game_id") % 40 == 3, None).when(
        F.col("game_id") % 10 != 1, F.lit("2024-01-09 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("game_id") % 5000)
    )
    return hot.withColumn("game_date", time.otherwise(F.col("game_date"))).persist()


@pytest.fixture(scope="module")
def text_order(hot):
    return hot.withColumn("label", F.concat(F.lit("g"), F.lpad(F.col("game_id").cast("string"), 7, "0")))


def same(a, b, *, places=9):
    kinds = dict(a.dtypes)
    assert a.columns == b.columns

    def shape(df):
        return df.select([F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])

    left, right = shape(a).collect(), shape(b).collect()
    assert len(left) == len(right)
    assert sorted(left, key=repr) == sorted(right, key=repr)


def close(a, b):
    """Equal but for the last digits of sums taken in another order, which rounding can tell apart at ties."""
    assert a.columns == b.columns
    key = lambda row: (repr([v for v in row if not isinstance(v, float)]), repr(row))
    left, right = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(left) == len(right)
    assert all(x == (pytest.approx(y, rel=1e-9) if isinstance(y, float) else y) for r, q in zip(left, right, strict=True) for x, y in zip(r, q, strict=True))


def test_plan_cuts_only_the_large_key(hot):
    plan = slice_plan(hot, ["player_id"], ["game_date", "game_id"], rows_per_slice=SMALL)
    rows = {r["player_id"]: r["_cuts"] for r in plan.cuts.collect()}
    assert rows[0] > 20
    n = hot.where("player_id = 0").count()
    assert rows[0] == (n - 1) // 64
    assert not slice_plan(hot, ["player_id"], ["game_date", "game_id"], rows_per_slice=WHOLE).split


def test_all_rows_of_one_instant(spark):
    """Cuts fall between rows with the same time by the tiebreak."""
    rows = spark.range(1000).select(F.lit(1).alias("e"), F.lit(5).alias("t"), "id", (F.col("id") % 7).alias("v"))
    kw = {"entity": "e", "event_time": "t", "tiebreak": "id", "measures": ["v"]}
    same(W.lagged_rolling_mean(rows, rows_per_slice=SMALL, **kw), W.lagged_rolling_mean(rows, rows_per_slice=WHOLE, **kw))


OPERATORS = {
    "rolling": lambda df, n: W.lagged_rolling_mean(df, measures=MEASURES, rows_per_slice=n, **SERIES),
    "std": lambda df, n: W.lagged_rolling_std(df, measure="minutes", rows_per_slice=n, **SERIES),
    "expanding": lambda df, n: W.period_expanding_mean(
        df, measures=MEASURES, period="season", rows_per_slice=n, **SERIES
    ),
    "rival": lambda df, n: W.rival_rolling_mean(
        df, rival="opponent_abbrev", measures=MEASURES, rows_per_slice=n, **SERIES
    ),
    "index": lambda df, n: W.cumulative_index(df, period="season", rows_per_slice=n, **SERIES),
    "rest": lambda df, n: W.rest_days(
        df, side="player_id", event_time="game_date", tiebreak="game_id", rows_per_slice=n
    ),
    "start": lambda df, n: W.lagged_start_rate(df, start="gs", rows_per_slice=n, **SERIES),
    "trailing": lambda df, n: W.trailing_days_count(df, rows_per_slice=n, **SERIES),
    "rank": lambda df, n: W.average_rank(df, partition=["season"], value="pts", name="r", rows_per_slice=n),
    "median": lambda df, n: A.group_medians(df, group=["season"], value="pts", rows_per_slice=n),
    "ladder": lambda df, n: value_ladder(df, keys=["home_game"], value="pts", rows_per_slice=n),
    "time_index": lambda df, n: S.time_index(df, ["game_date", "game_id"], rows_per_slice=n),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_slicing_changes_nothing(hot, name):
    run = OPERATORS[name]
    same(run(hot, SMALL), run(hot, WHOLE))


@pytest.mark.parametrize("name", OPERATORS)
def test_slicing_changes_nothing_without_times_or_in_a_burst(untimed, name):
    run = OPERATORS[name]
    close(run(untimed, SMALL), run(untimed, WHOLE))


def test_rows_without_a_time_come_last(untimed):
    out = W.cumulative_index(untimed, rows_per_slice=SMALL, **SERIES).where("player_id = 0")
    timed = out.where("game_date is not null").agg(F.max("games_played_season")).first()[0]
    assert out.where("game_date is null").agg(F.min("games_played_season")).first()[0] == timed + 1


def test_no_trailing_count_is_negative_or_lost(untimed):
    out = W.trailing_days_count(untimed, rows_per_slice=SMALL, **SERIES)
    assert out.count() == untimed.count()
    assert out.where("games_in_last_7_days < 0 or (game_date is null and games_in_last_7_days <> 0)").isEmpty()


def test_a_tiebreak_that_repeats_over_times(hot):
    """Only (time, tiebreak) need be total."""
    rows = hot.withColumn("game_id", F.col("game_id") % 7).withColumn("game_date", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.monotonically_increasing_id() * 60))
    rows = rows.persist()
    same(OPERATORS["trailing"](rows, SMALL), OPERATORS["trailing"](rows, WHOLE))


def test_a_text_order(text_order):
    run = lambda n: W.cumulative_index(text_order, entity="player_id", event_time="label", tiebreak="game_id", rows_per_slice=n)
    same(run(SMALL), run(WHOLE))


def test_median_is_exact(hot):
    got = A.group_medians(hot, group=["season"], value="pts", rows_per_slice=SMALL)
    same(got.orderBy("season"), hot.groupBy("season").agg(F.median("pts").alias("median")).orderBy("season"))


def test_rows_without_a_key_get_null(hot):
    out = W.lagged_rolling_mean(hot, measures=MEASURES, rows_per_slice=SMALL, **SERIES)
    assert out.where("player_id is null").count() > 0
    assert out.where("player_id is null and rolling_last3_pts is not null").count() == 0


def test_group_limit_is_pushed_before_the_shuffle(hot):
    plan = W.last_n(hot, n=5, **SERIES)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_many_rows_without_a_key_are_spread(hot):
    """A missing key with many rows is no series: its rows go to many slices."""
    rows = hot.withColumn("player_id", F.when(F.col("game_id") % 3 != 0, F.col("player_id")))
    plan = slice_plan(rows, ["player_id"], ["game_date", "game_id"], rows_per_slice=SMALL)
    assert plan.split
    for name in ("rolling", "index", "trailing"):
        same(OPERATORS[name](rows, SMALL), OPERATORS[name](rows, WHOLE))
