"""Additive feature contributions of the tree models, and of a linear one."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import new_path
from .models import ModelSet, prepared


def leaf_paths(spark: SparkSession, model: GBTRegressionModel, path: str | None = None) -> dict[int, dict]:
    """Leaves of all trees as arrays, grouped by the number of features on the path.

    The nodes are read from the saved model; their number is bounded by the model's
    settings, not by the data.  Per leaf and feature: the interval the feature must
    lie in, and the share of training rows that go the leaf's way when the feature
    is unknown.
    """
    if path is None:
        path = new_path(spark, "model")
        model.write().save(path)
    weights = list(model.treeWeights)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, object]] = {}
    for row in rows:
        trees.setdefault(row["treeID"], {})[row["id"]] = row

    grouped: dict[int, list] = {}
    for tree_id, nodes in trees.items():
        stack = [(nodes[0], {})]
        while stack:
            node, held = stack.pop()
            if node["leftChild"] < 0:
                features = sorted(held)
                grouped.setdefault(len(features), []).append(
                    (node["prediction"] * weights[tree_id], features, [held[f] for f in features])
                )
                continue
            split = node["split"]
            feature, limit = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            for child, (low, high) in (("leftChild", (-np.inf, limit)), ("rightChild", (limit, np.inf))):
                below = nodes[node[child]]
                old_low, old_high, share = held.get(feature, (-np.inf, np.inf, 1.0))
                share *= below["rawCount"] / node["rawCount"]
                stack.append((below, held | {feature: (max(low, old_low), min(high, old_high), share)}))
    return {
        size: {
            "value": np.array([leaf[0] for leaf in leaves]),
            "feature": np.array([leaf[1] for leaf in leaves], dtype=np.int64).reshape(len(leaves), size),
            "bound": np.array([leaf[2] for leaf in leaves], dtype=float).reshape(len(leaves), size, 3),
        }
        for size, leaves in grouped.items()
    }


def base_value(paths: Mapping[int, dict]) -> float:
    """Mean prediction over the training rows."""
    return float(sum((g["value"] * g["bound"][:, :, 2].prod(axis=1)).sum() for g in paths.values()))


def leaf_weights(share: np.ndarray, agrees: np.ndarray) -> np.ndarray:
    """What each feature of a leaf's path adds, per unit of the leaf's value (last axis: features of the path).

    A leaf pays its value only if every feature on its path agrees; an unknown feature
    agrees with its share.  Summed over coalition sizes this needs only the coefficients
    of the product of (share + agrees * t) over the *other* features.  The product over
    all of them is built once and divided by one factor at a time: work of the path's
    length squared.  Dividing by (share + t) runs from the highest power down, where
    every step multiplies by the share, which is at most 1, so that errors do not grow.
    """
    size = share.shape[-1]
    share, agrees = np.broadcast_arrays(share, agrees)
    product = np.zeros((size + 1, *share.shape[:-1]))
    product[0] = 1.0
    for j in range(size):
        known, unknown = agrees[..., j], share[..., j]
        for k in range(j + 1, 0, -1):
            product[k] = product[k] * unknown + product[k - 1] * known
        product[0] *= unknown
    order = [factorial(k) * factorial(size - k - 1) / factorial(size) for k in range(size)]
    out = np.empty(share.shape)
    for i in range(size):
        known, unknown = agrees[..., i], share[..., i]
        mixed = np.zeros(share.shape[:-1])
        above = np.zeros(share.shape[:-1])
        for k in range(size - 1, -1, -1):
            above = np.where(known > 0, product[k + 1] - unknown * above, product[k] / unknown)
            mixed += order[k] * above
        out[..., i] = mixed * (known - unknown)
    return out


TABLED = 8  # features of a path whose patterns of agreement are tabled: 2 ** TABLED rows a leaf
CELLS = 1 << 18  # (row, leaf) pairs worked on at a time: two megabytes an array


def tabled(paths: Mapping[int, dict]) -> dict[int, dict]:
    """``paths`` ready for many rows: leaves in the order of each place's features, short paths with a table.

    The table holds the contributions of every pattern of agreeing features, so that a row
    only has to find its pattern at each leaf.  Its size is bounded by the model's settings:
    (leaves) * 2 ** depth * depth numbers.
    """
    out = {}
    for size, group in paths.items():
        if size == 0:
            continue
        places = []
        for j in range(size):
            by_feature = np.argsort(group["feature"][:, j], kind="stable")
            features, first = np.unique(group["feature"][by_feature, j], return_index=True)
            places.append((by_feature, features, first))
        group = group | {"places": places}
        if size <= TABLED:
            patterns = (np.arange(1 << size)[:, None] >> np.arange(size)) & 1
            paid = leaf_weights(group["bound"][:, None, :, 2], patterns[None].astype(float))
            paid *= group["value"][:, None, None]
            group["paid"] = [np.ascontiguousarray(paid[..., j]).ravel() for j in range(size)]
        out[size] = group
    return out


def _block(x: np.ndarray, size: int, group: dict, out: np.ndarray) -> None:
    """Adds what the leaves of one path length pay to a few rows."""
    bound, feature = group["bound"], group["feature"]
    agrees = []
    for j in range(size):
        picked = x[:, feature[:, j]]
        agrees.append((picked > bound[:, j, 0]) & (picked <= bound[:, j, 1]))
    if "paid" in group:
        pattern = np.arange(len(feature)) << size
        pattern = pattern + sum(a.astype(np.int64) << j for j, a in enumerate(agrees))
    else:
        weights = leaf_weights(bound[:, :, 2], np.stack(agrees, axis=-1).astype(float)) * group["value"][:, None]
    for j, (by_feature, features, first) in enumerate(group["places"]):
        paid = group["paid"][j][pattern[:, by_feature]] if "paid" in group else weights[:, by_feature, j]
        out[:, features] += np.add.reduceat(paid, first, axis=1)


def shapley(x: np.ndarray, ready: Mapping[int, dict], n_features: int) -> np.ndarray:
    """Path-dependent Shapley values of a batch of rows; ``ready`` comes from ``tabled``."""
    out = np.zeros((x.shape[0], n_features))
    for size, group in ready.items():
        step = max(1, CELLS // (len(group["value"]) * (1 if "paid" in group else size)))
        for start in range(0, len(x), step):
            _block(x[start : start + step], size, group, out[start : start + step])
    return out


BATCH = 2048  # rows whose contributions are made and sent back at a time


def row_contributions(df: DataFrame, models: ModelSet, *, key: str) -> tuple[DataFrame, dict[str, float]]:
    """One line per row: ``values`` and, per target, ``phi_<target>`` (in model order); and the base values.

    The leaves are broadcast (their number is bounded by the model settings); the rows
    stay where they are, so there is no shuffle.
    """
    spark, n = df.sparkSession, len(models.features)
    paths = {t: leaf_paths(spark, m) for t, m in models.models.items()}
    shared = spark.sparkContext.broadcast(paths)
    kind = df.schema[key].dataType.simpleString()

    def rows_of(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(x.ravel()))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tables are made in the task: they are larger than the paths that are sent.
        ready = {target: tabled(tree_paths) for target, tree_paths in shared.value.items()}
        names = ["key", "values", *[f"phi_{target}" for target in ready]]
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, n)
                found = [rows_of(shapley(x, held, n)) for held in ready.values()]
                yield pa.RecordBatch.from_arrays([part.column("key"), rows_of(x), *found], names)

    rows = prepared(df, models.prep, models.features).select(
        F.col(key).alias("key"), vector_to_array("features").alias("x")
    )
    phis = ", ".join(f"phi_{t} array<double>" for t in paths)
    wide = rows.mapInArrow(explain, f"key {kind}, values array<double>, {phis}").withColumnRenamed("key", key)
    return wide, {t: base_value(p) for t, p in paths.items()}


def contributions(df: DataFrame, models: ModelSet, *, key: str) -> DataFrame:
    """Per row and target: base value and one contribution per feature (in model order)."""
    wide, bases = row_contributions(df, models, key=key)
    each = [
        F.struct(F.lit(t).alias("target"), F.lit(base).alias("base"), F.col(f"phi_{t}").alias("contributions"))
        for t, base in bases.items()
    ]
    return wide.select(key, "values", F.explode(F.array(*each)).alias("c")).select(key, "c.*", "values")


def long_contributions(wide: DataFrame, features: Sequence[str], *, key: str, least: float = 0.0) -> DataFrame:
    """One line per row, target and feature; small contributions are dropped before they are spread."""
    names = F.array(*[F.lit(f) for f in features])
    zipped = F.zip_with(
        F.arrays_zip("contributions", "values"),
        names,
        lambda cv, f: F.struct(
            f.alias("feature"), cv["contributions"].alias("contribution"), cv["values"].alias("value")
        ),
    )
    strong = F.filter(zipped, lambda z: F.abs(z["contribution"]) >= least)
    return wide.select(key, "target", F.explode(strong).alias("c")).select(key, "target", "c.*")


def linear_row_contributions(df: DataFrame, weights: Mapping[str, Mapping[str, float]], *, key: str) -> DataFrame:
    """``weight * (value - mean)`` of one linear model per target, on one line per row as in ``row_contributions``.

    All targets have the same features; a missing value contributes null.
    """
    features = list(next(iter(weights.values())))
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    phis = {
        f"phi_{t}": F.array(*[F.lit(float(w[f])) * (col(f) - F.lit(means[f])) for f in features]) for t, w in weights.items()
    }
    values = F.array(*[col(f).cast("double") for f in features])
    return df.select(key, values.alias("values"), *[phi.alias(name) for name, phi in phis.items()])


def linear_contributions(df: DataFrame, weights: Mapping[str, float], *, key: str) -> DataFrame:
    """Long table of ``weight * (value - mean)``: the same additive contract for a linear model."""
    means = df.agg(*[F.avg(f).alias(f) for f in weights]).first()
    parts = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                (F.lit(float(w)) * (col(f) - F.lit(means[f]))).alias("contribution"),
                col(f).cast("double").alias("value"),
            )
            for f, w in weights.items()
        ]
    )
    return df.select(key, F.explode(parts).alias("c")).select(key, "c.*").where(F.col("value").isNotNull())
