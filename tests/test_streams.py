"""Streams over several batches."""

import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.session import numbered_folders
from formline.streaming import live as L

SERIES = {"entity": "e", "event_time": "t", "tiebreak": "k"}


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def day(d):
    return F.date_add(F.lit("2024-01-01").cast("date"), d).cast("timestamp_ntz")


def write(spark, path, rows):
    table = spark.createDataFrame(rows, "e int, d int, k int, v double")
    table.select("e", day(F.col("d")).alias("t"), "k", "v").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def test_rolling_state_drops_repeats_and_late_rows(spark, tmp_path, store):
    source = str(tmp_path / "in")
    write(spark, source, [(1, 0, 0, 2.0), (1, 1, 1, 4.0)])
    write(spark, source, [(1, 40, 3, 8.0), (1, 39, 2, None), (2, 40, 9, 1.0)])
    write(spark, source, [(1, 40, 3, 8.0), (1, 41, 4, 6.0)])
    schema = write(spark, source, [(1, 2, 7, 100.0)])
    stream = L.rolling_state(L.file_stream(spark, source, schema), measures=["v"], sizes=(2, 3), delay="5 days", **SERIES)
    L.run_to_table(stream, path=str(tmp_path / "out"), checkpoint=str(tmp_path / "check"))
    got = {r["k"]: (r["rolling_last2_v"], r["rolling_last3_v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # Row 3 comes twice and counts once; row 7 is older than the watermark in force.
    assert got == {0: (None, None), 1: (2.0, 2.0), 2: (3.0, 3.0), 3: (4.0, 3.0), 4: (8.0, 6.0), 9: (None, None)}


def test_live_refresh_replaces_entities(spark, tmp_path, store):
    source, table = str(tmp_path / "in"), str(tmp_path / "live")
    write(spark, source, [(1, 0, 0, 2.0), (1, 1, 1, 4.0), (2, 0, 5, 7.0), (2, 1, 6, 9.0)])
    schema = write(spark, source, [(1, 0, 0, 2.0), (1, 1, 1, 4.0), (1, 2, 2, 6.0)])
    stream = L.file_stream(spark, source, schema).withColumnRenamed("v", "pts")
    L.run_live_refresh(stream, table=table, checkpoint=str(tmp_path / "check"), **SERIES)
    rows = {r["e"]: (r["k"], r["rolling_last3_pts"]) for r in L.live_table(spark, table, entity="e").collect()}
    assert rows == {1: (2, 3.0), 2: (6, 7.0)}


def test_live_refresh_over_a_log_in_many_files(spark, tmp_path, store):
    """Thirteen events of one entity over three files and two batches count together."""
    source, table = str(tmp_path / "in"), str(tmp_path / "live")
    for part in (range(0, 13, 3), range(1, 13, 3), range(2, 13, 3)):
        schema = write(spark, source, [(1, d, d, float(d)) for d in part])
    stream = L.file_stream(spark, source, schema, files_per_trigger=2).withColumnRenamed("v", "pts")
    L.run_live_refresh(stream, table=table, checkpoint=str(tmp_path / "check"), **SERIES)
    row = L.live_table(spark, table, entity="e").first()
    assert (row["k"], row["games_played_season"], row["rolling_last10_pts"]) == (12, 12, 6.5)


def test_live_refresh_over_many_batches_equals_the_whole_log(spark, tmp_path, store):
    """Late, repeated and corrected rows, over more batches than a snapshot holds."""
    rng = np.random.default_rng(5)
    source, table, check = (str(tmp_path / name) for name in ("in", "live", "check"))
    rows, kept = [(int(e), int(d), int(k), float(k % 7)) for k, (e, d) in enumerate(rng.integers(0, [3, 40], (60, 2)))], {}
    for batch in range(6):
        part = [rows[i] for i in rng.permutation(60)[:10]] if batch < 5 else rows
        part = [(e, d, k, v + batch) for e, d, k, v in part]
        kept |= {(e, d, k): v for e, d, k, v in part}
        schema = write(spark, source, part)
        if batch % 2:  # a query that starts again goes on from its state
            stream = L.file_stream(spark, source, schema).withColumnRenamed("v", "pts")
            L.run_live_refresh(stream, table=table, checkpoint=check, **SERIES)
    got = {r["e"]: r for r in L.live_table(spark, table, entity="e").collect()}
    for e in range(3):
        series = [v for (own, _, _), v in sorted(kept.items()) if own == e]
        row = got[e]
        assert row["games_played_season"] == len(series) - 1 and row["pts"] == series[-1]
        assert row["season_avg_pts"] == pytest.approx(np.mean(series[:-1]))
        for n in (3, 5, 10):
            assert row[f"rolling_last{n}_pts"] == pytest.approx(np.mean(series[:-1][-n:]))
    # Snapshots have taken in older batches, whose folders are gone.
    assert numbered_folders(spark, f"{table}/snapshots", "upto")
    assert len(os.listdir(f"{table}/batches")) < 6


def test_a_hot_entity_is_ordered_in_bounded_memory():
    rng = np.random.default_rng(6)
    n = 100_000
    at, tie = rng.integers(0, 5_000, n), rng.permutation(n)

    def frames(rows):
        for start in range(0, rows, 10_000):
            part = slice(start, min(rows, start + 10_000))
            yield pd.DataFrame({"t": at[part], "k": tie[part], "v": at[part] * 0.5})

    peaks = []
    for rows in (n // 4, n):
        tracemalloc.start()
        last, seen = (-1, -1), 0
        for part in L.in_order(frames(rows), ["t", "k"], chunk=5_000, step=50):
            keys = list(zip(part["t"], part["k"], strict=True))
            assert last < keys[0] and all(a < b for a, b in zip(keys, keys[1:], strict=False)) and len(part) <= 10_000
            last, seen = keys[-1], seen + len(part)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert seen == rows
    assert peaks[1] < 1.5 * peaks[0]


@pytest.mark.parametrize("size", [0, 1, 7, 100])
def test_runs_with_ties_missing_and_few_rows(size):
    rng = np.random.default_rng(size)
    whole = pd.DataFrame({"t": rng.integers(0, 3, size), "k": rng.integers(0, 4, size)})
    parts = [whole.iloc[i : i + 13] for i in range(0, size, 13)]
    got = list(L.in_order(iter(parts), ["t", "k"], chunk=16, step=3))
    assert [tuple(r) for p in got for r in p.to_numpy()] == sorted(tuple(r) for r in whole.to_numpy())


class Held:
    """A value or map of a state store, in memory, that counts the calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def exists(self):
        return None in self.held

    def get(self):
        self.calls += 1
        return self.held[None]

    def update(self, value):
        self.calls += 1
        self.held[None] = value

    def containsKey(self, key):  # noqa: N802
        return key in self.held

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.held[key] = value


class Store:
    def __init__(self):
        self.made = []

    def _make(self, *_):
        self.made.append(Held())
        return self.made[-1]

    getValueState = getMapState = _make  # noqa: N815


def test_rolling_state_of_many_entities_takes_two_calls_a_batch():
    processor, store = L.RollingMeans(["v"], (2, 3), ["e", "t", "k"], T.LongType()), Store()
    processor.init(store)
    rows = pd.DataFrame([(e, t, t, None if (e + t) % 5 == 0 else float(e * t)) for e in range(50) for t in range(8)], columns=["e", "t", "k", "v"])
    got = []
    for part in (rows[rows["t"] < 3], rows[(rows["t"] >= 3) & (rows["e"] % 2 == 0)], rows[(rows["t"] >= 3) & (rows["e"] % 2 == 1)]):
        got += list(processor.handleInputRows((0,), iter([part.sample(frac=1, random_state=1)]), None))
    assert sum(h.calls for h in store.made) == 1 + 2 + 2
    found = pd.concat(got).set_index(["key", "k"])
    for n in (2, 3):
        want = rows.groupby("e")["v"].transform(lambda v, n=n: v.shift(1).rolling(n, min_periods=1).mean())
        told = found.loc[list(zip(rows["e"], rows["k"], strict=True)), f"rolling_last{n}_v"].astype(float)
        assert np.allclose(told.to_numpy(), want.to_numpy(), equal_nan=True)


def test_recent_rows_of_many_entities_share_the_calls_of_their_bucket():
    processor, store = L.RecentRows(["v"], T.StringType(), T.LongType(), 2), Store()
    processor.init(store)

    def frame(rows):
        return pd.DataFrame(rows, columns=["key", "at", "tie", "row", "m0"])

    first = [(f"e{e}", 10 * t, t, f"{e}:{t}", float(t)) for e in range(30) for t in range(4)]
    again = [(f"e{e}", 10, 1, f"{e}:new", None if e else 7.0) for e in range(2)] + [("e29", 5, 9, "late", 1.0)]
    told = pd.concat(processor.handleInputRows((0,), iter([frame(first)]), None)).set_index("key")
    assert sum(h.calls for h in store.made) <= 2 + len(store.made[0].held)
    assert told.loc["e3"].tolist() == [["3:2", "3:3"], 4, [6.0], [4]]
    told = pd.concat(processor.handleInputRows((0,), iter([frame(again)]), None)).set_index("key")
    assert sorted(told.index) == ["e0", "e1", "e29"]
    assert told.loc["e0"].tolist() == [["0:2", "0:3"], 4, [12.0], [4]]
    assert told.loc["e1"].tolist() == [["1:2", "1:3"], 4, [5.0], [3]]
    assert told.loc["e29"].tolist() == [["29:2", "29:3"], 5, [7.0], [5]]
