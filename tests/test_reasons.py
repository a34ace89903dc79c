"""Contributions and reasons that stand on one row."""

import itertools
import time
import tracemalloc
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

import registry
from formline.operators import attribution as X
from formline.operators import ranking as K
from registry import models as RM

registry.load()


def leaves(rng, n, size, n_features):
    low = rng.normal(-1, 1, (n, size))
    share = rng.uniform(0.02, 1, (n, size))
    return {
        "value": rng.normal(size=n),
        "feature": np.array([rng.choice(n_features, size, replace=False) for _ in range(n)]),
        "bound": np.stack([low, low + rng.exponential(2, (n, size)), share], -1),
    }


def by_coalitions(x, paths, n_features):
    """Shapley values of every leaf by summing over all coalitions of its features."""
    out = np.zeros((len(x), n_features))
    for size, g in paths.items():
        for (value, feature, bound), r in itertools.product(zip(g["value"], g["feature"], g["bound"], strict=True), range(len(x))):
            agrees = [float(b[0] < x[r, f] <= b[1]) for f, b in zip(feature, bound, strict=True)]
            for i in range(size):
                for k in range(size):
                    for known in itertools.combinations([j for j in range(size) if j != i], k):
                        rest = np.prod([agrees[j] if j in known else bound[j, 2] for j in range(size) if j != i])
                        weight = factorial(k) * factorial(size - k - 1) / factorial(size)
                        out[r, feature[i]] += weight * value * rest * (agrees[i] - bound[i, 2])
    return out


@pytest.mark.parametrize("limit", [8, 2, 0])
def test_division_and_tables_equal_coalitions(monkeypatch, limit):
    rng = np.random.default_rng(1)
    paths = {size: leaves(rng, 5, size, 11) for size in (1, 2, 3, 6, 9)} | {0: {"value": np.ones(1)}}
    x = rng.normal(size=(3, 11))
    monkeypatch.setattr(X, "TABLED", limit)
    monkeypatch.setattr(X, "CELLS", 4)
    assert np.allclose(X.shapley(x, X.tabled(paths), 11), by_coalitions(x, {s: p for s, p in paths.items() if s}, 11), atol=1e-12)


def test_full_models_fit_time_and_memory():
    """600 trees of depth 5: 19,200 leaves."""
    rng = np.random.default_rng(2)
    paths = {size: leaves(rng, n, size, 72) for size, n in ((3, 1200), (4, 6000), (5, 12_000))}
    x = rng.normal(size=(256, 72))
    tracemalloc.start()
    ready = X.tabled(paths)
    X.shapley(x, ready, 72)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    start = time.perf_counter()
    phi = X.shapley(x, ready, 72)
    assert (time.perf_counter() - start) / len(x) < 0.02
    whole = sum((g["value"] * ((x[:, g["feature"]] > g["bound"][..., 0]) & (x[:, g["feature"]] <= g["bound"][..., 1])).all(-1)).sum(-1) for g in paths.values())
    assert np.allclose(phi.sum(1) + X.base_value(paths), whole)


@pytest.mark.parametrize("name", ["top_reasons", "top_signed_summary"])
def test_reasons_need_no_exchange(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_reasons_of_odd_rows(spark):
    names = ["rolling_last5_pts", "home_game", "unknown", "rolling_last10_pts", "trend_pts"]
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0, 9.0, 2.0, None], [0.5, -0.2, 9.0, 0.5, None], [0.0] * 5), (2, [0.0] * 5, [0.04] * 5, [None] * 5)],
        "id int, values array<double>, phi_pts array<double>, phi_minutes array<double>",
    )
    wide = K.reason_arrays(rows, names, ["pts", "minutes"], n=2)
    got = {r["id"]: r for r in K.signed_summary(wide, ["pts", "minutes"], positives=1).collect()}
    # Equal contributions are settled by name; features without a text, small and missing ones are left out.
    assert [(r["position"], r["feature"], r["direction"]) for r in got[1]["reasons_pts"]] == [(1, "rolling_last10_pts", "+"), (2, "rolling_last5_pts", "+")]
    assert got[1]["reasoning"] == "Reasoning:\n\n+ High scoring baseline (last 10 avg: 2.0 pts)"
    assert got[2]["reasons_pts"] == [] and got[2]["reasoning"] == "Reasoning:\n"
    assert K.top_reasons(wide, ["pts", "minutes"], row="id").count() == 2


def test_rows_explain_each_target_once(spark, sf):
    found = RM.models(spark, sf)
    rows = RM.feature_table(spark, sf).limit(50)
    wide, bases = X.row_contributions(rows, found, key="game_id")
    assert wide.columns == ["game_id", "values", *[f"phi_{t}" for t in found.models]]
    total = F.aggregate("phi_pts", F.lit(bases["pts"]), lambda a, b: a + b).alias("total")
    assert {r["n"] for r in wide.select(F.size("phi_pts").alias("n"), total).collect()} == {len(found.features)}
