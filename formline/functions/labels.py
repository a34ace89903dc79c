"""Readable labels for features, and the message arrays shown with a prediction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, messages

# Pattern, text when the contribution is positive, text when it is
# negative, in order of preference.  %s is replaced by the value with the given
# number of decimals (None: no number in the text).
LABELS = [
    ("rolling_last5_pts", "Strong recent scoring (last 5 avg: %s pts)", "Cold scoring recently (last 5 avg: %s pts)", 1),
    ("rolling_last10_pts", "High scoring baseline (last 10 avg: %s pts)", "Low scoring baseline (last 10 avg: %s pts)", 1),
    ("rolling_last5_reb", "Strong recent rebounding (last 5 avg: %s)", "Weak rebounding recently (last 5 avg: %s)", 1),
    ("rolling_last10_reb", "High rebounding baseline (last 10 avg: %s)", "Low rebounding baseline (last 10 avg: %s)", 1),
    ("rolling_last5_ast", "Strong recent assists (last 5 avg: %s)", "Fewer assists recently (last 5 avg: %s)", 1),
    ("rolling_last10_ast", "High assist baseline (last 10 avg: %s)", "Low assist baseline (last 10 avg: %s)", 1),
    ("rolling_last5_minutes", "Playing heavy minutes recently (%s avg)", "Lighter minutes load recently (%s avg)", 0),
    ("rolling_last5_minutes_std", "Consistent minutes (low variance: %s)", "Inconsistent minutes (high variance: %s)", 1),
    ("season_avg_pts", "Strong season scoring average (%s ppg)", "Modest season scoring average (%s ppg)", 1),
    ("season_avg_reb", "Strong season rebounding (%s rpg)", "Modest season rebounding (%s rpg)", 1),
    ("season_avg_ast", "High season assist rate (%s apg)", "Modest season assist rate (%s apg)", 1),
    ("season_avg_minutes", "Averaging heavy minutes this season (%s)", "Averaging lighter minutes this season (%s)", 0),
    ("season_avg_usage_proxy", "High usage rate this season", "Lower usage rate this season", None),
    ("opp_def_rating", "Facing weak defense (rated %s)", "Facing elite defense (rated %s)", 1),
    ("opp_def_rank", "Opponent is a weak defensive team (rank %s/30)", "Opponent is a strong defensive team (rank %s/30)", 0),
    ("back_to_back", "Well rested (not a back-to-back)", "Back-to-back game (fatigue factor)", None),
    ("home_game", "Home court advantage", "Away game", None),
    ("rest_days_capped", "Extended rest (%s days)", "Limited rest (%s days)", 0),
    ("team_pace", "Fast-paced team (more possessions: %s)", "Slow-paced team (fewer possessions: %s)", 1),
    ("trend_pts", "Scoring is trending up recently", "Scoring is trending down recently", None),
    ("trend_fantasy_score", "Overall performance trending up", "Overall performance trending down", None),
    ("vs_opp_rolling3_pts", "Historically scores well vs this opponent", "Historically struggles vs this opponent", None),
    ("vs_opp_rolling3_reb", "Historically rebounds well vs this opponent", "Historically fewer rebounds vs this opponent", None),
]
# Features whose text follows the feature value instead of the sign.
BY_VALUE = ("back_to_back", "home_game")


def label_table(first_match: bool = False) -> list[tuple]:
    """The labels in the order they are tried.

    ``first_match=True`` keeps the written order, in which a short pattern can hide
    a longer one.  ``False`` tries longer patterns first, gives ``home_game`` its
    texts the right way round and names the usage feature as it is called.
    """
    if first_match:
        return LABELS
    fixed = []
    for pattern, up, down, digits in LABELS:
        if pattern == "season_avg_usage_proxy":
            pattern = "season_avg_usage_rate"
        if pattern == "home_game":
            up, down = down, up
        fixed.append((pattern, up, down, digits))
    return sorted(fixed, key=lambda row: -len(row[0]))


def _shown(template: str, digits: int | None, value: Column) -> Column:
    if digits is None:
        return F.lit(template)
    head, tail = template.split("%s")
    return F.concat(F.lit(head), F.format_string(f"%.{digits}f", F.bround(value, digits)), F.lit(tail))


def reason_label(feature, contribution, value, *, first_match: bool = False) -> Column:
    """The text for one contribution, null for features without a label."""
    feature, contribution, value = col(feature), col(contribution), col(value)
    negative = F.when(feature.isin(*BY_VALUE), value > 0.5).otherwise(~(contribution > 0))
    chain = None
    for pattern, up, down, digits in label_table(first_match):
        label = F.when(negative, _shown(down, digits, value)).otherwise(_shown(up, digits, value))
        hit = F.contains(feature, F.lit(pattern))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def feature_label(feature: str, contribution, value, *, first_match: bool = False) -> Column | None:
    """As ``reason_label`` for a feature known beforehand; None if it never has a label."""
    contribution, value = col(contribution), col(value)
    for pattern, up, down, digits in label_table(first_match):
        if pattern in feature:
            negative = value > 0.5 if feature in BY_VALUE else ~(contribution > 0)
            return F.when(negative, _shown(down, digits, value)).otherwise(_shown(up, digits, value))
    return None


def warning_messages(*, availability_warning, predicted, average, rows, back_to_back) -> Column:
    """The warnings of a prediction, in fixed order."""
    predicted, average, rows = col(predicted), col(average), col(rows)
    shift = F.when(
        F.abs(predicted - average) > 8,
        F.concat(
            F.lit("Predicted minutes ("),
            F.bround(predicted).cast("int").cast("string"),
            F.lit(") differs from season average ("),
            F.bround(average).cast("int").cast("string"),
            F.lit("). Check for load management or injury news."),
        ),
    )
    short = F.when(
        rows < 20,
        F.concat(
            F.lit("Limited data ("),
            rows.cast("string"),
            F.lit(" games). Prediction may be less reliable."),
        ),
    )
    tired = F.when(
        col(back_to_back).cast("boolean"),
        F.lit(
            "Back-to-back game. Verify the player is confirmed in the starting lineup before using this prediction."
        ),
    )
    given = F.when(F.length(col(availability_warning)) > 0, col(availability_warning))
    return messages([given, shift, short, tired])
