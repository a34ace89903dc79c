"""Streams run to the end of their input; the result is their final state."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from formline import bindings as B
from formline.session import new_path
from formline.streaming import live as L

from . import EVENTS, query, rounded, sql

SHOWN = ("pts", "minutes")


@contextmanager
def rocksdb(spark):
    """The state store that stateful processors need, for the streams started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, L.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query(
    "str_live_refresh",
    sql(
        "select player_id, game_id, games_played_season, "
        + ", ".join(f"round(rolling_last{n}_{m}, 9) as rolling_last{n}_{m}" for m in SHOWN for n in (3, 10))
        + ", round(season_avg_pts, 9) as season_avg_pts from (select *, row_number() over w - 1 as games_played_season, "
        + ", ".join(
            f"avg({m}) over (partition by player_id order by game_date, game_id rows between {n} preceding and 1 "
            f"preceding) as rolling_last{n}_{m}"
            for m in SHOWN
            for n in (3, 10)
        )
        + ", avg(pts) over (partition by player_id order by game_date, game_id rows between unbounded preceding and 1 "
        "preceding) as season_avg_pts, row_number() over (partition by player_id order by game_date desc, game_id desc) "
        "as i from game_logs window w as (partition by player_id order by "
        "game_date, game_id)) where i = 1",
        "game_logs",
    ),
)
def live_refresh(spark, sf):
    """A log in ten batches, out of order; a part of it came before, with other values."""
    source, table = new_path(spark, "fresh"), new_path(spark, "live")
    logs = B.game_logs(spark, sf)
    logs.where("game_id % 10 = 3").withColumn("pts", F.col("pts") + 1).coalesce(1).write.parquet(source)
    dealt = logs.withColumn("_part", F.pmod(F.xxhash64("game_id"), F.lit(9)))
    dealt.repartitionByRange(9, "_part").drop("_part").write.mode("append").parquet(source)
    stream = L.file_stream(spark, source, logs.schema)
    with rocksdb(spark):
        L.run_live_refresh(stream, table=table, checkpoint=new_path(spark, "check"), **EVENTS)
    rows = L.live_table(spark, table, entity="player_id")
    names = [f"rolling_last{n}_{m}" for m in SHOWN for n in (3, 10)]
    return rounded(rows, "player_id", "game_id", "games_played_season", *names, "season_avg_pts", digits=9)


@query(
    "str_rolling_state",
    sql(
        "select player_id, game_id, "
        + ", ".join(
            f"round(avg({m}) over (partition by player_id order by game_date, game_id rows between {n} preceding and 1 "
            f"preceding), 6) as rolling_last{n}_{m}"
            for m in SHOWN
            for n in (3, 5, 10)
        )
        + " from game_logs",
        "game_logs",
    ),
)
def rolling_state(spark, sf):
    """Three batches in time order, the last of which repeats a day of the second."""
    source, path = new_path(spark, "arrivals"), new_path(spark, "rolled")
    logs = B.game_logs(spark, sf).select("player_id", "game_date", "game_id", *SHOWN)
    at = F.col("game_date").cast("timestamp").cast("double")
    low, high = logs.agg(F.percentile_approx(at, [1 / 3, 2 / 3])).first()[0]
    parts = (at < low, (at >= low) & (at < high), at >= high - 86_400)
    for part in parts:
        logs.where(part).coalesce(1).write.mode("append").parquet(source)
    with rocksdb(spark):
        stream = L.rolling_state(L.file_stream(spark, source, logs.schema), measures=SHOWN, **EVENTS)
        L.run_to_table(stream, path=path, checkpoint=new_path(spark, "check"))
    return rounded(spark.read.parquet(path))
