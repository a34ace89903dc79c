"""Projections, filters and duplicate handling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import POSITION_CODES, TARGETS, lookup, text_key
from .joins import first_by_key
from .windows import latest_row

# Header texts of the source tables and the column each one becomes.
HEADERS = {
    "Rk": "rank",
    "G": "game_num",
    "Date": "game_date",
    "Age": "age",
    "Tm": "team",
    "Team": "team",
    "Opp": "opponent",
    "GS": "gs",
    "MP": "mp",
    "FG": "fg",
    "FGA": "fga",
    "FG%": "fg_pct",
    "3P": "fg3",
    "3PA": "fg3a",
    "3P%": "fg3_pct",
    "FT": "ft",
    "FTA": "fta",
    "FT%": "ft_pct",
    "ORB": "orb",
    "DRB": "drb",
    "TRB": "trb",
    "AST": "ast",
    "STL": "stl",
    "BLK": "blk",
    "TOV": "tov",
    "PF": "pf",
    "PTS": "pts",
    "+/-": "plus_minus",
    "GmSc": "game_score",
    "Unnamed: 5": "home_away",
    "Unnamed: 7": "result",
    "Unnamed: 3": "home_away",
    "Unnamed: 4": "home_away",
    "Unnamed: 6": "result",
    "W/L": "result",
    "Gcar": "game_num_career",
    "Gtm": "game_num_team",
    "Result": "result",
    "2P": "fg2",
    "2PA": "fg2a",
    "2P%": "fg2_pct",
    "eFG%": "efg_pct",
}
# Columns that come first in a parsed log.
LEAD_COLUMNS = (
    "player_id", "player_name", "position", "season", "game_date", "team", "home_game", "opponent", "result", "minutes",
)
# Texts in the minutes cell of a row that was not played.
NOT_PLAYED = r"(?i)Did Not|Inactive|Not With|Suspended"


def rename_map(df: DataFrame, names: Mapping[str, str] = HEADERS) -> DataFrame:
    """Rename by a header map; several headers of one target are coalesced in order."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(names.get(c, c), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cols]).alias(new) for new, cols in groups.items()])


def keep_existing(df: DataFrame, wanted: Sequence[str], lead_only: bool = False) -> DataFrame:
    """The wanted columns that exist; with ``lead_only`` the others follow them."""
    first = [c for c in wanted if c in df.columns]
    rest = [c for c in df.columns if c not in first] if lead_only else []
    return df.select(*first, *rest)


def select_by_prefix(df: DataFrame, *, lead=(), prefixes=(), names=()) -> DataFrame:
    """Columns by exact name and prefix, each once, in the order asked for."""
    picked = list(lead)
    for prefix in prefixes:
        picked += [c for c in df.columns if c.startswith(prefix)]
    picked += [c for c in df.columns if c in set(names)]
    return df.select(*dict.fromkeys(c for c in picked if c in df.columns))


def drop_private(df: DataFrame, mark: str = "_") -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith(mark)])


def default_columns(df: DataFrame, defaults: Mapping[str, Column | str | float | int]) -> DataFrame:
    """Add missing columns: a Column is taken as it is, anything else as a constant."""
    new = {c: v if isinstance(v, Column) else F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def literal_metadata(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in values.items()})


def request_overrides(rows: DataFrame, requests: DataFrame, *, entity: str) -> DataFrame:
    """Replace the context columns of each entity's row by those of its requests.

    ``requests`` has the fields of a prediction request; several per entity are fine.
    A request for an unknown entity keeps its row, with nulls in the entity's columns.
    """
    asked = requests.select(
        F.col(entity),
        *([F.col("request_id")] if "request_id" in requests.columns else []),
        F.col("home_game").cast("int").alias("home_game"),
        F.col("back_to_back").cast("int").alias("back_to_back"),
        F.least("rest_days", F.lit(7)).alias("rest_days_capped"),
        *[F.col(c) for c in ("opp_def_rating", "opp_def_rank", "team_pace", "opponent_abbrev")],
        text_key("position").alias("position"),
        lookup(text_key("position"), POSITION_CODES, F.lit(3)).alias("position_enc"),
    )
    kept = rows.drop(*[c for c in asked.columns if c != entity])
    return asked.join(kept, entity, "left")


def not_repeated_header(df: DataFrame, first: str, header: str = "Rk") -> DataFrame:
    """Drop header rows repeated inside the data; a missing first cell is kept."""
    return df.where(~F.col(first).eqNullSafe(F.lit(header)))


def not_summary(df: DataFrame, *, date: Column, rank: str | None = None) -> DataFrame:
    """Drop rows without a readable date or with a total mark as rank."""
    keep = date.isNotNull()
    if rank is not None:
        keep &= ~F.coalesce(F.trim(rank).isin("TOT", "Total", ""), F.lit(False))
    return df.where(keep)


def not_dnp(df: DataFrame, minutes: str) -> DataFrame:
    """Drop rows whose minutes text says the event was not played; missing text is kept."""
    return df.where(~F.coalesce(F.col(minutes).rlike(NOT_PLAYED), F.lit(False)))


def with_targets(df: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    return df.dropna(subset=list(targets))


def min_exposure(df: DataFrame, minutes: str = "minutes", least: float = 5.0) -> DataFrame:
    """Keep rows with enough exposure.  Filter before any window is computed."""
    return df.where(F.col(minutes) >= least)


def entity_named(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.where(F.lower(column) == F.lower(F.lit(name)))


def last_complete_row(df, features, *, entity, event_time, tiebreak) -> DataFrame:
    """The newest row of each entity in which no feature is missing."""
    return latest_row(df.dropna(how="any", subset=list(features)), entity=entity, event_time=event_time, tiebreak=tiebreak)


def alerts(df: DataFrame, status: str) -> DataFrame:
    return df.where(F.col(status).isNotNull() & ~F.col(status).isin("Active", "Unknown"))


def before(df: DataFrame, event_time: str, day: str) -> DataFrame:
    return df.where(F.col(event_time) < F.lit(day).cast(df.schema[event_time].dataType))


def on_or_after(df: DataFrame, event_time: str, day: str) -> DataFrame:
    return df.where(F.col(event_time) >= F.lit(day).cast(df.schema[event_time].dataType))


def roster_unique(df: DataFrame, *, key: str, ordinal: str) -> DataFrame:
    return first_by_key(df, [key], [ordinal])


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)

