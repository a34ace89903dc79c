"""Registered queries: each runs an operator over the whole tables, with its SQL twin."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline import bindings as B
from formline.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Keyword arguments of a series of events, as bound to ``game_logs``.
EVENTS = {"entity": "player_id", "event_time": "game_date", "tiebreak": "game_id"}

TABLES_SQL = {
    "game_logs": B.GAME_LOGS_SQL,
    "schedule": B.SCHEDULE_SQL,
    "team_stats": B.TEAM_STATS_SQL,
    "side_schedule": B.SIDE_SCHEDULE_SQL,
    "roster": B.ROSTER_SQL,
    "tied": B.TIED_RATINGS_SQL,
}


def sql(body: str, *tables: str, ctes: str = "") -> str:
    """SQL with the bound tables it names in front."""
    parts = [TABLES_SQL[t].strip() for t in tables] + ([ctes.strip().rstrip(",")] if ctes else [])
    return (f"with {', '.join(parts)}\n" if parts else "") + body.strip()


def query(name: str, oracle: str | None = None):
    """Register the decorated function under ``name`` together with its SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The named columns (all by default) with doubles rounded for comparison."""
    kinds = dict(df.dtypes)
    names = columns or df.columns
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in names])


def load() -> None:
    """Import every module that registers queries."""
    from . import aggregates, joins, models, plans, rows, scalars, sources, streams, windows  # noqa: F401
