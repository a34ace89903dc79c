"""Splits by date, medians of training parts, saved versions, as-of rates and answers from any window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.operators import aggregates as A
from formline.operators import models as M
from formline.operators import splits as S
from formline.plans import outlook as O


@pytest.fixture(scope="module")
def dated(spark):
    """300 rows on 40 dates of unequal length, some without a date, with missing values."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(300):
        d = int(rng.integers(0, 40) ** 2 // 40)
        value = None if k % 11 == 0 else float("nan") if k % 13 == 0 else float(rng.integers(0, 9))
        rows.append((None if k % 50 == 49 else d, k, value, float(rng.normal()), float(k % 7)))
    frame = spark.createDataFrame(rows, "d int, k int, a double, b double, y double")
    return frame.withColumn("t", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 3])
def test_no_date_is_split(dated, rows_per_slice):
    rows = S.time_series_split_by_date(dated, "t", k=5, rows_per_slice=rows_per_slice).collect()
    assert len(rows) == 300
    folds = {}
    for r in rows:
        folds.setdefault(r["d"], set()).add((r["test_fold"], r["date_start"]))
    assert all(len(f) == 1 for f in folds.values())
    at, size = 0, 300 // 6
    for d in sorted(folds, key=lambda d: (d is None, d)):
        ((fold, start),) = folds[d]
        assert start == at and fold == (0 if at < 300 - 5 * size else (at - (300 - 5 * size)) // size + 1)
        at += sum(r["d"] == d for r in rows)
    tail = S.holdout_tail_by_date(dated, "t").groupBy("d").agg(F.count_distinct("is_validation").alias("n"))
    assert {r["n"] for r in tail.collect()} == {1}


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 2])
def test_prefix_medians_equal_numpy(dated, rows_per_slice):
    rows = dated.withColumn("part", F.col("k") % 4).withColumn("none", F.lit(None).cast("double"))
    got = {(r["column"], r["part"]): r["median"] for r in A.prefix_medians(rows, ["a", "b", "none"], part="part", n_parts=4, rows_per_slice=rows_per_slice).collect()}
    held = rows.collect()
    want = {}
    for c in ("a", "b"):
        for p in range(1, 5):
            values = [r[c] for r in held if r["part"] < p and r[c] is not None and not np.isnan(r[c])]
            want[c, p] = float(np.median(values))
    assert got == pytest.approx(want)


def test_medians_do_not_see_what_a_model_is_tested_on(dated):
    """Values of the test block are moved: every median of a training part before it stays."""
    rows = S.time_index(dated, ["t", "k"])
    cuts = [50, 120, 200]
    moved = rows.withColumn("a", F.when(F.col("row_index") >= 200, F.col("a") + 1000).otherwise(F.col("a")))
    before, after = (M.training_medians(r, ["a", "b"], F.col("row_index"), cuts) for r in (rows, moved))
    assert before == after
    assert M.training_medians(moved, ["a"], F.col("row_index"), [300])[0] != M.training_medians(rows, ["a"], F.col("row_index"), [300])[0]


def test_fill_missing_reads_all_columns_at_once(spark, dated):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fill", "fill")
    wide = dated.select(*[(F.col("b") + i).alias(f"c{i}") for i in range(30)], "a")
    M.fill_missing(wide, wide.columns)
    few = len(jobs.getJobIdsForGroup("fill"))
    spark.sparkContext.setJobGroup("other", "other")
    M.fill_missing(dated, ["a"])
    assert few <= len(jobs.getJobIdsForGroup("other")) + 1
    values = [r["a"] for r in dated.collect() if r["a"] is not None and not np.isnan(r["a"])]
    assert M.fill_missing(dated, ["a"]).where("a is null").isEmpty() and np.median(values) in {r["a"] for r in M.fill_missing(dated, ["a"]).collect()}


def test_medians_shuffle_counts_of_digits_not_values(spark, monkeypatch):
    """However many values a column has, few counts leave the tasks; every kind of number is placed right."""
    rng = np.random.default_rng(3)
    odd = [-0.0, 0.0, -1.5, float("inf"), float("-inf"), float("nan"), None, 5e-324, -1e300, 7.25]
    held = [(float(rng.normal()), float(rng.normal() * 1e-9 - 3.0), odd[k % len(odd)], k % 3) for k in range(6000)]
    rows, written, stored = spark.createDataFrame(held, "a double, b double, odd double, part int"), [], A.stored
    monkeypatch.setattr(A, "stored", lambda df, name: (made := stored(df, name), written.append(made.count()))[0])
    got = {(r["column"], r["part"]): r["median"] for r in A.prefix_medians(rows, ["a", "b", "odd"], part="part", n_parts=2).collect()}
    for i, c in enumerate(("a", "b", "odd")):
        for p in (1, 2):
            values = [r[i] for r in held if r[3] < p and r[i] is not None and not np.isnan(r[i])]
            assert got[c, p] == float(np.median(values))
    assert sum(written) < 6000


@pytest.mark.parametrize("made, operator", [("models", "train_per_target"), ("folds", "temporal_cv")])
def test_registered_models_are_trained_with_their_whole_settings(spark, monkeypatch, made, operator):
    """No setting of a target is replaced by a smaller one, neither in training nor in validation."""
    from registry import models as R

    asked = []
    monkeypatch.setattr(R, "_held", {})
    monkeypatch.setattr(R, "feature_table", lambda *given: None)
    monkeypatch.setattr(R, "stored", lambda rows, name: rows)
    monkeypatch.setattr(R.M, operator, lambda *given, **kw: asked.append(kw))
    getattr(R, made)(spark, "somewhere")
    settings = asked[0].get("settings")
    for t in M.TARGETS:
        model = M._regressor(t, settings, None)
        assert {name: model.getOrDefault(name) for name in M.SETTINGS[t]} == M.SETTINGS[t]


SMALL = {"maxIter": 2, "maxDepth": 2, "subsamplingRate": 1.0}


def test_models_are_saved_in_versions(spark, dated, tmp_path):
    rows = dated.where("t is not null and not isnan(a)").withColumn("pts", F.col("y")).withColumn("reb", F.when(F.col("k") % 3 != 0, F.col("y")))
    found = M.train_per_target(rows, features=["a", "b", "absent"], order=["t", "k"], targets=["pts", "reb"], settings=SMALL, refit=True)
    assert found.features == ["a", "b"] and found.rows == {"pts": rows.count(), "reb": rows.where("reb is not null").count()}
    folds = M.temporal_cv(rows, features=["a", "b"], order=["t", "k"], targets=["pts", "reb"], k=3, settings=SMALL, by_date=True)
    assert {(r["target"], r["fold"]) for r in folds.collect()} <= {(t, f) for t in ("pts", "reb") for f in (1, 2, 3)}
    folder = str(tmp_path / "models")
    assert found.save(folder) == 1 and found.save(folder, M.cv_summary(folds)) == 2
    first, second = M.load_models(spark, folder, version=1), M.load_models(spark, folder, targets=["pts", "reb", "ast"])
    assert list(second.models) == ["pts", "reb"] and second.rows == found.rows and second.features == found.features
    assert first.metrics == {"pts": {}, "reb": {}} and second.metrics == found.metrics and set(found.metrics["pts"]) == set(M.METRICS)
    same = lambda m: [tuple(r) for r in M.batch_score(rows, m).select("k", "pred_pts", "pred_reb").orderBy("k").collect()]
    assert same(second) == same(found)
    told = M.model_metadata(second).collect()
    assert {(r["target"], r["n_training_rows"], r["cv_mae"]) for r in told} == {(t, found.rows[t], found.metrics[t]["cv_mae"]) for t in found.rows}
    with pytest.raises(FileNotFoundError):
        M.load_models(spark, str(tmp_path / "nothing"))


def test_home_rate_of_earlier_dates(spark):
    rows = [("a", 1, 1, "W"), ("a", 1, 1, "L"), ("a", 1, 0, "W"), ("a", 2, 1, "W 3"), ("a", 4, 0, None), ("a", None, 1, "W"), (None, 2, 1, "W"), ("b", 3, 1, None), ("b", 5, 1, "W")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, d int, home int, result string")
    frame = frame.withColumn("t", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).cast("timestamp_ntz"))
    for rows_per_slice in (1000, 1):
        out = A.home_win_rate(frame, side="s", home="home", result="result", as_of="t", rows_per_slice=rows_per_slice)
        got = [r["home_court_factor"] for r in out.orderBy("i").collect()]
        # One date sees the same past; without a date or a side, or before the first event, the fixed value.
        assert got == [0.575, 0.575, 0.575, 0.5, 0.667, 0.575, 0.575, 0.575, 0.0]
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "s string").withColumn("t", F.lit("2024-01-04").cast("date"))
    out = A.home_win_rate(asked, side="s", home="home", result="result", as_of="t", source=frame)
    assert {r["s"]: r["home_court_factor"] for r in out.collect()} == {"a": 0.667, "b": 0.575, "c": 0.575}


def test_answers_from_any_window_and_either_log(spark):
    log = [(p, d, d, float(d), None if d % 3 == 0 else float(d)) for p in (1, 2) for d in range(40)]
    logs = spark.createDataFrame(log, "player_id int, game_date int, game_id int, pts double, reb double")
    live = spark.createDataFrame([(2, d, d, "x" if d % 2 else str(d), 1.0) for d in range(10)], "player_id int, game_date int, game_id int, pts string, trb double")
    asks = [(p, s, w) for p in (1, 2, 3) for s in ("pts", "reb", "ast") for w in (None, 2, 4, 35, 1000)]
    asked = spark.createDataFrame([(i, *a, 5.0, "over") for i, a in enumerate(asks)], "i int, player_id int, stat string, window int, threshold double, direction string")
    got = {r["i"]: r for r in O.probabilities(asked, logs, live=live, stats=["pts", "reb", "ast"]).collect()}
    assert len(got) == len(asks)
    for i, (player, stat, window) in enumerate(asks):
        n = 20 if window is None else window
        if stat == "ast":
            want = None
        elif player == 1:  # the last rows, then those with a value
            want = [v for v in [r[3 if stat == "pts" else 4] for r in log if r[0] == 1][::-1][:n] if v is not None]
        elif player == 2:  # the last values
            want = ([8.0, 6.0, 4.0, 2.0, 0.0] if stat == "pts" else [1.0] * 10)[:n]
        else:
            want = None
        row = got[i]
        if stat == "ast":
            assert row["status"] == "bad stat"
        elif player == 3:
            assert row["status"] == "unknown entity"
        elif len(want) < 3:
            assert row["status"] == "too few rows" and row["source"] is None
        else:
            kind = "current season" if player == 2 else "training data"
            assert row["source"] == f"{kind} ({len(want)} games)" and row["stat_mean"] == pytest.approx(np.mean(want))


def test_training_rows_are_sliced_and_made_vectors_once(dated, monkeypatch):
    """The index of a small table is cut as well, and the targets of a fold share its vectors."""
    rows = dated.where("t is not null and not isnan(a)").withColumns({"pts": F.col("y"), "reb": F.col("b")})
    asked = {"features": ["a", "b"], "order": ["t", "k"], "targets": ["pts", "reb"], "settings": SMALL}
    slices, made, time_index, prepared = [], [], M.time_index, M.prepared
    monkeypatch.setattr(M, "ROWS_PER_PART", 50)
    monkeypatch.setattr(M, "time_index", lambda *given, **kw: (slices.append(kw.get("rows_per_slice")), time_index(*given, **kw))[1])
    monkeypatch.setattr(M, "prepared", lambda *given: (made.append(1), prepared(*given))[1])
    found = M.train_per_target(rows, **asked)
    assert found.rows == {"pts": rows.count(), "reb": rows.count()} and slices == [50] and len(made) == 1
    made.clear()
    folds = M.temporal_cv(rows, **asked, k=3).collect()
    assert {(r["target"], r["fold"], r["n_tested"]) for r in folds} == {(t, f, rows.count() // 4) for t in ("pts", "reb") for f in (1, 2, 3)}
    assert len(made) == 3


def test_features_are_neither_sorted_nor_written_for_training(dated, monkeypatch):
    """Only the order of the rows and their dates are; ties and missing keys have their place."""
    rows = dated.where("not isnan(a)").withColumns({"pts": F.col("y"), "reb": F.when(F.col("k") % 5 != 0, F.col("b"))})
    rows = rows.unionByName(rows)
    asked = {"features": ["a", "b"], "order": ["t", "k"], "targets": ["pts", "reb"], "settings": SMALL}
    written, stored, fits, fit = [], M.stored, [], M.GBTRegressor.fit
    monkeypatch.setattr(M, "stored", lambda df, name: (written.append(df.columns), stored(df, name))[1])
    monkeypatch.setattr(M.GBTRegressor, "fit", lambda self, data: (fits.append((self.getLabelCol(), data.groupBy("is_validation").count().collect())), fit(self, data))[1])
    found = M.train_per_target(rows, **asked, threads=1)
    assert found.rows == {"pts": rows.count(), "reb": rows.where("reb is not null").count()}
    for target, counts in fits:
        trained = {r["is_validation"]: r["count"] for r in counts}
        assert sum(trained.values()) == found.rows[target] and 0 <= trained[False] - int(0.85 * found.rows[target]) <= 1
    M.temporal_cv(rows, **asked, k=3, by_date=True)
    assert written and not any({"a", "b"} & set(columns) for columns in written)
    alike = rows.withColumns({"t": F.lit(None).cast("date"), "k": F.lit(1), "pts": F.lit(2.0)})
    assert M.train_per_target(alike, **asked | {"targets": ["pts"]}).rows == {"pts": rows.count()}


def test_queries_leave_no_method_too_large_to_compile(spark):
    """Whole-stage code over all features is more than HotSpot compiles."""
    import registry

    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 65535)
    try:
        registry.query("a_query_of_a_test")(lambda spark, sf: spark.range(1))
        registry.QUERIES.pop("a_query_of_a_test")(spark, "").collect()
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)
