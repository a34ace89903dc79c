"""Small frames with values worked out by hand or with pandas."""

import math

import pytest
from pyspark.sql import functions as F

from formline.functions import columns as C
from formline.operators import joins as J
from formline.operators import rows as R
from formline.operators import splits as S
from formline.operators import windows as W

SERIES = {"entity": "e", "event_time": "t", "tiebreak": "k"}
V = [1.0, None, 3.0, 4.0, None, 6.0]


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(1, i, i, v, 1) for i, v in enumerate(V)], "e int, t int, k int, v double, p int")


def column(df, name, order="k"):
    return [r[name] for r in df.orderBy(order).collect()]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None and w is None) or (g is not None and w is not None and math.isclose(g, w, abs_tol=1e-9)), (got, want)


def one(spark, schema, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {schema}")
    return column(rows.select("i", expr.alias("y")), "y", "i")


def test_rolling_mean(series):
    out = W.lagged_rolling_mean(series, measures=["v"], sizes=(3,), **SERIES)
    close(column(out, "rolling_last3_v"), [None, 1, 1, 2, 3.5, 3.5])


def test_rolling_std(series):
    out = W.lagged_rolling_std(series, measure="v", size=5, fill=None, **SERIES)
    close(column(out, "rolling_last5_v_std"), [None, None, None, 1.4142135624, 1.5275252317, 1.5275252317])
    filled = W.lagged_rolling_std(series, measure="v", size=5, **SERIES)
    close(column(filled, "rolling_last5_v_std")[:3], [3.5, 3.5, 3.5])


def test_expanding_mean(series):
    out = W.period_expanding_mean(series, measures=["v"], period="p", **SERIES)
    close(column(out, "season_avg_v"), [None, 1, 1, 2, 8 / 3, 8 / 3])


def test_rate_needs_three_values(series):
    out = W.over_series(series, keys=["e"], order=["t", "k"], lookback=10, rolling={"r": W.rate_of("v", 10, 3, -1.0)})
    close(column(out, "r"), [-1, -1, -1, -1, 8 / 3, 8 / 3])


def test_average_rank(spark):
    rows = spark.createDataFrame([(i, 1, v) for i, v in enumerate([3.0, 1.0, 3.0, 2.0, None])], "k int, p int, v double")
    out = W.average_rank(rows, partition=["p"], value="v", name="r")
    close(column(out, "r"), [3.5, 1, 3.5, 2, None])
    cut = W.average_rank(rows, partition=["p"], value="v", name="r", truncate=True)
    assert column(cut, "r") == [3, 1, 3, 2, None]


def test_rest_days_and_trailing_count(spark):
    def days(*n):
        return spark.createDataFrame([(1, d, i) for i, d in enumerate(n)], "e int, d int, k int").select(
            "e", "k", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, d)").alias("t")
        )

    rest = W.rest_days(days(1, 2, 5), side="e", event_time="t", tiebreak="k")
    assert column(rest, "rest_days") == [-1, 0, 2]
    assert column(rest, "back_to_back") == [0, 1, 0]
    assert column(W.trailing_days_count(days(1, 3, 8, 9), **SERIES), "games_in_last_7_days") == [0, 1, 2, 2]
    # Ties: only rows that come earlier count.
    assert column(W.trailing_days_count(days(1, 1, 1), **SERIES), "games_in_last_7_days") == [0, 1, 2]


def test_scalars(spark):
    x = F.col("x")
    assert one(spark, "double", V, C.clip("x", 2.0, 5.0)) == [2, None, 3, 4, None, 5]
    assert one(spark, "int", [5, 30, 60, 80, None], C.phase_bucket("x")) == [1, 2, 3, 4, 4]
    texts = ["LAL vs. DEN", "LAL @ DEN"]
    assert one(spark, "string", texts, C.rival_from_matchup("x")) == ["DEN", "DEN"]
    assert one(spark, "string", texts, C.home_from_matchup("x")) == [1, 0]
    assert one(spark, "string", [None, "W", "L (OT)"], C.won_flag("x")) == [0, 1, 0]
    close(one(spark, "string", ["33:24", " 12 ", "x", None, "1:2:3"], C.parse_minutes("x")), [33.4, 12, None, None, None])
    close(one(spark, "string", ["33:24", "x", None], C.parse_minutes("x", 0.0)), [33.4, 0, 0])
    assert one(spark, "string", [" brk", "SEA", "xyz", None], C.code_normalise("x")) == ["BKN", "OKC", "XYZ", None]
    assert one(spark, "double", [None, -1.0, 2.0], C.rest_or_default("x")) == [3, 3, 2]
    assert one(spark, "string", ["pg ", None, "?"], C.position_code("x")) == [1, 3, 3]
    assert one(spark, "int", [2022, 2000], C.season_label("x")) == ["2021-22", "1999-00"]
    # Halves go to the even neighbour.
    assert one(spark, "double", [0.125, 0.375], F.bround(x, 2)) == [0.12, 0.38]


def test_normal_cdf(spark):
    zs = [-8.0, -3.0, -1.96, -0.5, 0.0, 0.5, 1.0, 2.5, 6.0]
    got = one(spark, "double", zs, C.normal_cdf(F.col("x")))
    assert max(abs(g - 0.5 * (1 + math.erf(z / math.sqrt(2)))) for g, z in zip(got, zs, strict=True)) < 1e-7


def test_probability_rules(spark):
    rows = spark.createDataFrame(
        [(30.0, 0.0, "over", 25.0), (30.0, 0.0, "under", 25.0), (20.0, 0.0, "under", 25.0), (20.0, None, "over", 25.0)],
        "mean double, std double, direction string, threshold double",
    )
    got = column(rows.select("*", C.normal_probability("mean", "std", "threshold", "direction").alias("p")), "p", "mean")
    assert sorted(got) == [0.0, 0.0, 0.0, 1.0]
    assert one(spark, "double", [0.0, 1.0], C.probability_blend("x", "x", F.lit(20))) == [0.02, 0.98]


def test_unplayed_rows_and_null_keys(spark):
    rows = spark.createDataFrame([(None,), ("Did Not Play",), ("31:02",)], "mp string")
    assert {r["mp"] for r in R.not_dnp(rows, "mp").collect()} == {None, "31:02"}
    left = spark.createDataFrame([("x",), (None,)], "k string")
    right = spark.createDataFrame([("x", 5, 1), (None, 6, 1), ("x", 7, 2)], "k string, v int, o int")
    out = J.left_context(left, right, on=["k"], context=["v"], order=["o"])
    assert {(r["k"], r["v"]) for r in out.collect()} == {("x", 5), (None, 6)}


def test_assert_many_to_one(spark):
    rows = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="not unique"):
        J.assert_many_to_one(rows, ["k"])
    assert J.assert_many_to_one(rows.distinct(), ["k"]).count() == 1


def test_fold_starts():
    assert S.fold_starts(103, 5) == (17, [18, 35, 52, 69, 86])
    with pytest.raises(ValueError):
        S.fold_starts(3, 5)


def test_name_resolution_prefers_a_match_then_list_order(spark):
    people = spark.createDataFrame([(1, "Al Smith"), (2, "Bo O'Smith"), (3, "Joe Smith Jr."), (4, "Bob Smith")], "id int, name string")
    asked = spark.createDataFrame([(1, "bob SMITH"), (2, "Zed Smith"), (3, "bo o'smith"), (4, "Nobody Else")], "r int, q string")
    out = J.name_resolution(asked, people, request_id="r", request_name="q", name="name", ordinal="id")
    assert {(x["r"], x["id"], x["matched"]) for x in out.collect()} == {(1, 4, True), (2, 1, False), (3, 2, True), (4, None, None)}


def test_trailing_count_over_dates(spark):
    days = spark.createDataFrame([(1, d, i) for i, d in enumerate((1, 3, 8, 9, 9))], "e int, d int, k int")
    rows = days.select("e", "k", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("t"))
    assert column(W.trailing_days_count(rows, **SERIES), "games_in_last_7_days") == [0, 1, 2, 2, 3]
