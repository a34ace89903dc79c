"""Properties that hold for any data."""

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

import registry
from formline import bindings as B
from formline.operators import attribution as X
from formline.operators import models as M
from formline.operators import splits as S
from formline.operators import windows as W
from formline.plans import features as E
from formline.plans import outlook as O
from registry import models as RM
from registry import plans as RP

registry.load()


def rows_of(df, *keys):
    names = sorted(df.columns)
    return sorted(tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect())


@pytest.fixture(scope="module")
def training(spark, sf):
    return RP.training_table(spark, sf)


WINDOWED = [f for f in E.feature_names() if f.startswith(("rolling", "season_avg", "trend", "vs_opp"))]


def test_there_are_72_features(training):
    names = E.feature_names()
    assert len(names) == len(set(names)) == 72
    assert [c for c in E.select_features(E.add_features(training)).columns if c != "game_id"] == names


def test_no_leakage(training):
    """Changing one row leaves the features of it and of all earlier rows as they were."""
    player, at = training.groupBy("player_id").agg(F.sort_array(F.collect_list("game_date"))[10]).first()
    here = (F.col("player_id") == player) & (F.col("game_date") >= F.lit(at))
    changed = training.withColumns({c: F.when(here, F.col(c) + 7).otherwise(F.col(c)) for c in ("pts", "reb", "minutes", "fga")})
    keep = (F.col("player_id") != player) | (F.col("game_date") <= F.lit(at))
    before = E.add_features(training).where(keep).select("game_id", *WINDOWED)
    after = E.add_features(changed).where(keep).select("game_id", *WINDOWED)
    assert rows_of(before) == rows_of(after)


def test_partitioning_changes_nothing(training):
    shuffled = training.repartition(13, F.rand(3))
    a = E.select_features(E.add_features(training))
    b = E.select_features(E.add_features(shuffled))
    assert rows_of(a) == rows_of(b)


def test_skewed_features_equal_plain_ones(spark, sf, training):
    hot = training.withColumn("player_id", F.when(F.col("player_id") % 3 == 0, 0).otherwise(F.col("player_id")))
    plain = E.select_features(E.add_features(hot))
    sliced = E.select_features(E.add_features(hot, rows_per_slice=70))
    assert rows_of(plain) == rows_of(sliced)


def test_rank_sum(spark, sf):
    ranked = W.average_rank(B.tied_ratings(spark, sf), partition=["period"], value="rating", name="r")
    for r in ranked.where("rating is not null").groupBy("period").agg(F.sum("r").alias("s"), F.count("*").alias("n")).collect():
        assert r["s"] == r["n"] * (r["n"] + 1) / 2


def test_folds_are_disjoint_and_ordered(spark, sf):
    rows = S.time_series_split(B.schedule(spark, sf), ["game_date", "game_id"], k=5)
    got = rows.groupBy("test_fold").agg(F.min("row_index").alias("lo"), F.max("row_index").alias("hi"), F.count("*").alias("n"))
    folds = sorted(got.collect(), key=lambda r: r["test_fold"])
    assert [r["test_fold"] for r in folds] == [0, 1, 2, 3, 4, 5]
    assert all(a["hi"] + 1 == b["lo"] for a, b in itertools.pairwise(folds))
    assert len({r["n"] for r in folds[1:]}) == 1


def test_probability_bounds_and_rejections(spark, sf):
    logs = B.game_logs(spark, sf)
    asked = RP.chance_requests(spark, sf)
    out = O.probabilities(asked, logs)
    assert out.where("probability < 0.02 or probability > 0.98").count() == 0
    bad = asked.limit(1).select("player_id", F.lit("xyz").alias("stat"), "threshold", "direction")
    assert O.probabilities(bad, logs).where("status = 'ok'").isEmpty() and O.probabilities(bad, logs).count() == bad.count()
    few = logs.where("game_id < 20")
    counts = few.groupBy("player_id").count().where("count < 3").select("player_id")
    short = O.probabilities(asked.join(counts, "player_id", "left_semi"), few)
    assert short.where("status = 'ok'").isEmpty()
    with pytest.raises(ValueError):
        O.check_probability_request("xyz", "over")
    with pytest.raises(ValueError):
        O.check_probability_request("pts", "above")


def brute_force(nodes, x, n_features):
    """Shapley values of one tree by summing over all coalitions."""
    by_id = {r["id"]: r for r in nodes}
    used = sorted({r["split"]["featureIndex"] for r in nodes if r["leftChild"] >= 0})

    def expected(known, node):
        if node["leftChild"] < 0:
            return node["prediction"]
        left, right = by_id[node["leftChild"]], by_id[node["rightChild"]]
        f, limit = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return expected(known, left if x[f] <= limit else right)
        return (left["rawCount"] * expected(known, left) + right["rawCount"] * expected(known, right)) / node["rawCount"]

    phi = np.zeros(n_features)
    for f in used:
        others = [o for o in used if o != f]
        for size in range(len(others) + 1):
            weight = factorial(size) * factorial(len(used) - size - 1) / factorial(len(used))
            for group in itertools.combinations(others, size):
                phi[f] += weight * (expected({*group, f}, by_id[0]) - expected(set(group), by_id[0]))
    return phi, expected(set(), by_id[0])


def test_contributions_equal_brute_force(spark, sf, tmp_path):
    found = RM.models(spark, sf)
    model, n = found.models["pts"], len(found.features)
    path = str(tmp_path / "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    wide = X.contributions(RM.feature_table(spark, sf).orderBy("game_id").limit(4), found, key="game_id")
    for row in wide.where("target = 'pts'").collect():
        phi, base = np.zeros(n), 0.0
        for tree, weight in enumerate(model.treeWeights):
            part, mean = brute_force([r for r in nodes if r["treeID"] == tree], row["values"], n)
            phi, base = phi + weight * part, base + weight * mean
        assert np.allclose(phi, row["contributions"], atol=1e-9)
        assert abs(base - row["base"]) < 1e-9


def test_contributions_keep_keys_and_order_over_many_batches(spark):
    """Keys beside a missing one stay exact, and rows of a partition longer than a batch keep their own values."""
    n = 2 * X.BATCH + 7
    rows = [(None if i == 5 else 2**60 + i, float(i % 13), None if i % 7 == 0 else float(i % 5), float(i % 13 * (i % 5))) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y double").coalesce(1)
    prep = M.preparation(["a", "b"], {"b": 2.0})
    gbt = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="raw_y", maxIter=2, maxDepth=2, seed=1)
    found = M.ModelSet(["a", "b"], prep, {"y": gbt.fit(M.prepared(df, prep, ["a", "b"]))})
    got = {r["id"]: r for r in X.contributions(df, found, key="id").collect()}
    want = {r["id"]: r for r in M.batch_score(df, found, keep_raw=True).collect()}
    assert got.keys() == want.keys() and len(got) == n
    for i, r in got.items():
        assert r["values"] == [want[i]["a"], 2.0 if want[i]["b"] is None else want[i]["b"]]
        assert abs(r["base"] + sum(r["contributions"]) - want[i]["raw_y"]) < 1e-9


def test_contributions_query_broadcasts_no_rows(spark, sf):
    plan = RM.contributions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "MapInPandas" not in plan


def test_card_is_complete(spark, sf):
    cards = RM.cards(spark, sf)
    rows = cards.collect()
    assert len(rows) == B.game_logs(spark, sf).select("player_id").distinct().join(
        RM.feature_table(spark, sf), "player_id", "left_semi"
    ).count()
    for r in rows:
        assert r["reasoning"].startswith("Reasoning:\n")
        assert all(r["ranges"][t]["lo"] <= r["predictions"][t] <= r["ranges"][t]["hi"] for t in r["predictions"].asDict())
        assert r["fantasy_score"] >= 0
