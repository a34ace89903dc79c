"""Ordered per-key computations that stay balanced when one key is huge.

A plain ``Window.partitionBy(key).orderBy(time)`` sends a whole key to one task.
That is right for ordinary keys and hopeless for a key that holds a third of the
table.  ``slice_plan`` looks for such keys by counting.  Without any, the functions
below are plain windows.  With some, only those keys are cut into
consecutive slices, and every slice is given what it needs from earlier ones:

* bounded frames get the last ``lookback`` rows before the slice,
* running sums get one row with the total of all earlier slices.

Both are added as extra rows in front of the slice, so one exchange on
(key, slice) and one sort serve all columns.  The results are exact wherever
the cuts fall; rows without a time come last in their series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import stored

ROWS_PER_SLICE = 4_000_000
SAMPLES_PER_SLICE = 64
CHUNK = 256  # cuts that are looked through together

SLICE = "_slice"
KIND = "_kind"
CARRY, HALO, OWN = 0, 1, 2


@dataclass(frozen=True)
class SlicePlan:
    """Where to cut the keys that are too large for one task."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    cuts: DataFrame | None = None

    @property
    def split(self) -> bool:
        return self.cuts is not None


def _has_key(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def slice_plan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
    lookback: int = 0,
) -> SlicePlan:
    """Find the keys with more than ``rows_per_slice`` rows and cut them.

    Keys are found by counting their rows, combined before the shuffle, whatever the
    size of the table.  ``order`` must order the rows of a key totally, nulls last.  A
    hash of key and order picks about ``SAMPLES_PER_SLICE`` rows per slice of such a key
    as candidates for cuts; they decide only where the work is cut, never what is
    computed.  The cuts are a stored table with one row per large key.
    """
    keys, order = tuple(keys), tuple(order)
    rows = df.select(*keys, *order)
    large = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows_per_slice).drop("_rows")
    if large.isEmpty():
        return SlicePlan(keys, order)
    large = stored(large, "large_keys")
    stride = max(SAMPLES_PER_SLICE, lookback)
    rate = max(1, rows_per_slice // stride)
    sample = rows if rate == 1 else rows.where(F.pmod(F.xxhash64(*keys, *order), F.lit(rate)) == 0)
    # Rows without a key need no cuts, only spreading; without a time, they are the end of their series.
    sample = sample.where(F.col(order[0]).isNotNull()).join(large, list(keys), "left_semi")
    by_key = Window.partitionBy(*keys).orderBy(*_ascending(order))
    cuts = (
        sample.withColumn("_n", F.row_number().over(by_key) - 1)
        .where((F.col("_n") > 0) & (F.col("_n") % stride == 0))
        .select(*keys, F.floor((F.col("_n") / stride - 1) / CHUNK).cast("int").alias("_chunk"), F.struct(*order).alias("_cut"))
    )
    # Two levels, so that a row compares with the heads of the chunks and with one chunk.
    chunks = cuts.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list("_cut")).alias("cuts"))
    cell = F.struct("_chunk", (F.col("_chunk") * CHUNK).alias("base"), "cuts")
    cells = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("_cells"), F.sum(F.size("cuts")).cast("int").alias("_cuts"))
    heads = F.transform("_cells", lambda c: c["cuts"][0])
    return SlicePlan(keys, order, stored(cells.withColumn("_heads", heads), "cuts"))


def _ascending(order: Sequence[str]) -> list[Column]:
    """A series is ordered with missing values last."""
    return [F.col(c).asc_nulls_last() for c in order]


def _slice_of(plan: SlicePlan) -> Column:
    """The number of cuts that a row is not before."""
    here = F.struct(*[F.col(c) for c in plan.order])
    cell = F.get("_cells", F.size(F.filter("_heads", lambda head: head <= here)) - 1)
    found = F.coalesce(cell["base"] + F.size(F.filter(cell["cuts"], lambda cut: cut <= here)), F.lit(0))
    return F.when(F.col("_cuts").isNull(), None).when(F.col(plan.order[0]).isNull(), F.col("_cuts")).otherwise(found)


def _sliced(df: DataFrame, plan: SlicePlan, how: str) -> DataFrame:
    """Add the slice number; ``how='inner'`` keeps only the rows of split keys.

    Rows without a key belong to no series: they are spread evenly instead.
    """
    joined = df.join(plan.cuts, list(plan.keys), how)
    spread = F.when(~_has_key(plan.keys), F.xxhash64(*plan.order))
    number = F.coalesce(_slice_of(plan).cast("bigint"), spread, F.lit(0))
    return joined.withColumn(SLICE, number).drop("_cells", "_heads", *([] if how == "inner" else ["_cuts"]))


Rolling = dict[str, Callable[[Callable[[int], WindowSpec]], Column]]


def over_series(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    rolling: Rolling | None = None,
    running: dict[str, Column] | None = None,
    within: Sequence[str] = (),
    lookback: int = 0,
    inputs: Sequence[str] | None = None,
    plan: SlicePlan | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add columns computed from the earlier rows of the same series.

    ``rolling`` maps a name to a function of ``frame``, where ``frame(n)`` is the
    window of the ``n`` rows before the current one (``n <= lookback``).
    ``running`` maps a name to a column that is summed over all earlier rows with
    the same keys and ``within`` columns (null before the first value).
    ``inputs`` names the columns that ``rolling`` reads (all, if not given): only they
    are copied from slice to slice, and nothing else is computed for the copies.
    Rows whose key is null get null.
    """
    rolling, running = rolling or {}, running or {}
    keys, order, within = list(keys), list(order), list(within)
    plan = plan or slice_plan(df, keys, order, rows_per_slice=rows_per_slice, lookback=lookback)
    if plan.split and plan.keys != tuple(keys):
        plan = slice_plan(df, keys, order, rows_per_slice=rows_per_slice, lookback=lookback)
    sums = {f"_in_{name}": value for name, value in running.items()}
    rows = df.withColumns(sums) if sums else df

    if plan.split:
        copied = df.columns if inputs is None else [*dict.fromkeys([*keys, *within, *order, *inputs])]
        rows = _with_slices(rows, plan, list(sums), within, lookback if rolling else 0, copied)
        part, sort = [*keys, SLICE], [KIND, *order]
    else:
        part, sort = keys, order
    base = Window.partitionBy(*part).orderBy(*_ascending(sort))
    whole = Window.partitionBy(*part, *within).orderBy(*_ascending(sort)).rowsBetween(Window.unboundedPreceding, -1)

    def frame(n: int) -> WindowSpec:
        if n > lookback:
            raise ValueError(f"frame({n}) needs lookback >= {n}")
        return base.rowsBetween(-n, -1)

    keyed, total_keyed = _has_key(keys), _has_key([*keys, *within])
    added = {name: F.when(keyed, build(frame)) for name, build in rolling.items()}
    added |= {name: F.when(total_keyed, F.sum(f"_in_{name}").over(whole)) for name in running}
    out = rows.withColumns(added)
    if plan.split:
        out = out.where(F.col(KIND) == OWN).select(*[c for c in df.columns if c not in added], *added)
    return out.drop(*sums)


def _with_slices(
    rows: DataFrame, plan: SlicePlan, sums: list[str], within: list[str], lookback: int, copied: list[str]
) -> DataFrame:
    own = _sliced(rows, plan, "left").withColumn(KIND, F.lit(OWN))
    parts = []
    if lookback:
        backwards = Window.partitionBy(*plan.keys, SLICE).orderBy(*[F.col(c).desc_nulls_first() for c in plan.order])
        halo = (
            _sliced(rows.select(*copied), plan, "inner")
            .withColumn("_back", F.row_number().over(backwards))
            .where((F.col("_back") <= lookback) & (F.col(SLICE) < F.col("_cuts")))
            .withColumn(SLICE, F.col(SLICE) + 1)
            .withColumn(KIND, F.lit(HALO))
            .drop("_back", "_cuts")
        )
        parts.append(halo)
    if sums:
        split_rows = _sliced(rows.select(*dict.fromkeys([*plan.keys, *within, *plan.order, *sums])), plan, "inner")
        totals = split_rows.groupBy(*plan.keys, *within, SLICE).agg(*[F.sum(c).alias(c) for c in sums])
        before = Window.partitionBy(*plan.keys, *within).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.withColumns({c: F.sum(c).over(before) for c in sums}).withColumn(KIND, F.lit(CARRY))
        parts.append(carry)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, own)


def value_ladder(
    df: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per (key, distinct value): its count and the count of smaller values.

    Rows are counted before the shuffle, so only distinct values are ordered.
    """
    counts = df.where(_has_key([*keys, value])).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ladder = over_series(
        counts, keys=keys, order=[value], running={"smaller": F.col("n")}, rows_per_slice=rows_per_slice
    )
    return ladder.withColumn("smaller", F.coalesce("smaller", F.lit(0)))
