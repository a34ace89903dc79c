"""Streams that keep recent-form tables fresh."""

from __future__ import annotations

import bisect
import pickle
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.joins import first_by_key
from ..plans.outlook import SIZES, live_inputs, live_rows
from ..session import numbered_folders, remove_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int = 1, **options):
    """A stream over Parquet files.  The files per trigger bound what one batch can hold; no result depends on them
    but which rows count as late."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**options).parquet(path)


# Entities share keys of the state, as every call to the store costs the same however little it carries.  Fixed, so that
# a batch's calls do not grow with the number of entities; a key holds the tails of its entities in memory.
BUCKETS = 1024


def bucket_of(entity: str) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).alias("_bucket")


class RecentRows(StatefulProcessor):
    """Keeps the newest rows of the entities of a bucket, and counts and sums over all of their rows.

    Rows may come in any order and again.  What was counted is remembered in blocks of
    time, so that a row that comes again replaces its own numbers; a frame of rows reads
    and writes the blocks that it falls into, and a batch the bucket's totals and tails once.
    A block's width is set when a bucket first comes, for about ``PER_BLOCK`` rows at the
    density of that frame.
    """

    PER_BLOCK = 512
    WIDTH = 28 * 86_400_000_000  # microseconds, for a bucket that comes with one row
    TOLD = 1_000  # entities of a frame of results

    def __init__(self, measures: Sequence[str], entity: T.DataType, tie: T.DataType, kept: int):
        self.measures, self.entity, self.tie, self.kept = list(measures), entity, tie, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        many = lambda name, kind: T.StructField(name, T.ArrayType(kind))
        places = [many("entity", self.entity), many("at", T.LongType()), many("tie", self.tie)]
        # Flat lists: one number of rows, and as many sums and counts as measures, for each entity.
        totals = T.StructType([T.StructField("width", T.LongType()), many("entity", self.entity), many("n", T.LongType())])
        totals = totals.add(many("sums", T.DoubleType())).add(many("nums", T.LongType()))
        self.blocks = handle.getMapState("blocks", T.StructType([T.StructField("block", T.LongType())]), T.StructType([*places, T.StructField("numbers", T.BinaryType())]))
        self.totals = handle.getValueState("totals", totals)
        self.tails = handle.getValueState("tails", T.StructType([*places, many("row", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        width, totals, tails = self._held()
        k, touched = len(self.measures), {}
        for frame in rows:
            ids, at, tie = frame["key"].tolist(), frame["at"].tolist(), frame["tie"].tolist()
            if width is None:
                span = max(at) - min(at)
                width = max(1, span * self.PER_BLOCK // len(at)) if span else self.WIDTH
            numbers = [[None if pd.isna(v) else float(v) for v in frame[f"m{i}"].tolist()] for i in range(k)]
            fresh: dict[int, dict] = {}
            for place, *values in zip(zip(ids, at, tie, strict=True), *numbers, strict=True):
                fresh.setdefault(place[1] // width, {})[place] = values
            for block, new in fresh.items():
                held = self._block(block)
                for place, values in new.items():
                    old = held.get(place)
                    total = totals.setdefault(place[0], [0, [0.0] * k, [0] * k])
                    total[0] += old is None
                    for i, value in enumerate(values):
                        was = None if old is None else old[i]
                        total[1][i] += (value or 0.0) - (was or 0.0)
                        total[2][i] += (value is not None) - (was is not None)
                    held[place] = values
                # Bytes: a list of numbers costs the store many times as much.
                self.blocks.updateValue((block,), (*self._places(held), np.array(list(held.values()), float).tobytes()))
            come = dict.fromkeys(ids)
            for entity, *place, row in zip(ids, at, tie, frame["row"].tolist(), strict=True):
                tails.setdefault(entity, {})[tuple(place)] = row
            for entity in come:
                tails[entity] = dict(sorted(tails[entity].items(), key=lambda item: item[0])[-self.kept :])
            touched |= come
        flat = lambda i: [v for total in totals.values() for v in total[i]]
        self.totals.update((width, list(totals), [total[0] for total in totals.values()], flat(1), flat(2)))
        last = {(entity, *place): row for entity, tail in tails.items() for place, row in tail.items()}
        self.tails.update((*self._places(last), list(last.values())))
        names = list(touched)
        for start in range(0, len(names), self.TOLD):
            part = names[start : start + self.TOLD]
            n, sums, nums = zip(*[totals[entity] for entity in part], strict=True)
            newest = [list(tails[entity].values()) for entity in part]
            yield pd.DataFrame({"key": part, "rows": newest, "n": n, "sums": sums, "nums": nums})

    def _held(self) -> tuple[int | None, dict, dict]:
        """The width of a block, and per entity its number of rows, sums and counts, and its newest rows in order."""
        if not self.totals.exists():
            return None, {}, {}
        k = len(self.measures)
        width, entities, n, sums, nums = self.totals.get()
        totals = {e: [n[i], list(sums[i * k : i * k + k]), list(nums[i * k : i * k + k])] for i, e in enumerate(entities)}
        tails: dict = {}
        for entity, at, tie, row in zip(*self.tails.get(), strict=True):
            tails.setdefault(entity, {})[at, tie] = row
        return width, totals, tails

    @staticmethod
    def _places(held: dict) -> list[list]:
        return [[place[i] for place in held] for i in range(3)]

    def _block(self, block: int) -> dict:
        if not self.blocks.containsKey((block,)):
            return {}
        ids, at, tie, numbers = self.blocks.getValue((block,))
        rows = np.frombuffer(bytes(numbers)).reshape(len(ids), -1)
        rows = np.where(np.isnan(rows), None, rows.astype(object)).tolist()
        return dict(zip(zip(ids, at, tie, strict=True), rows, strict=True))

    def close(self) -> None:
        pass


def recent_state(stream: DataFrame, *, entity: str, event_time: str, tiebreak: str) -> tuple[DataFrame, T.StructType, list[str]]:
    """Per entity that a batch touches: its newest rows as JSON, and number and sums of all its rows so far.

    Also the schema of the rows and the names of the summed measures.  Rows without an entity
    or a time belong to no series and are left out.  Needs the RocksDB state store.
    """
    rows, _, means = live_inputs(stream.where(F.col(entity).isNotNull() & F.col(event_time).isNotNull()), entity=entity)
    kinds, row = {f.name: f.dataType for f in rows.schema.fields}, rows.schema
    told = rows.select(
        bucket_of(entity), F.col(entity).alias("key"),
        F.unix_micros(F.col(event_time).cast("timestamp")).alias("at"), F.col(tiebreak).alias("tie"),
        F.to_json(F.struct(*rows.columns)).alias("row"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(means)],
    )
    out = T.StructType([T.StructField("key", kinds[entity]), T.StructField("rows", T.ArrayType(T.StringType()))])
    out = out.add("n", T.LongType()).add("sums", T.ArrayType(T.DoubleType())).add("nums", T.ArrayType(T.LongType()))
    state = told.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=RecentRows(means, kinds[entity], kinds[tiebreak], max(SIZES) + 1), outputStructType=out,
        outputMode="Update", timeMode="None",
    )
    return state, row, means


def rows_of_state(state: DataFrame, row: T.StructType, means: Sequence[str], *, entity, event_time, tiebreak) -> DataFrame:
    """The live row of each entity in ``state``: rolling values from its newest rows, running means from its sums."""
    tails = state.select("n", "sums", "nums", F.explode("rows").alias("row"))
    tails = tails.select("n", "sums", "nums", F.from_json("row", row).alias("row")).select("row.*", "n", "sums", "nums")
    totals = tails.withColumnsRenamed({"n": "_n", "sums": "_sums", "nums": "_nums"})
    live = live_rows(totals, entity=entity, event_time=event_time, tiebreak=tiebreak)
    # The newest row is in the sums and not in its own means.
    earlier = {
        f"season_avg_{m}": (F.get("_sums", F.lit(i)) - F.coalesce(F.col(m).cast("double"), F.lit(0.0)))
        / F.nullif(F.get("_nums", F.lit(i)) - F.col(m).isNotNull().cast("bigint"), F.lit(0))
        for i, m in enumerate(means)
    }
    return live.withColumns(earlier | {"games_played_season": F.col("_n") - 1}).drop("_n", "_sums", "_nums")


def run_live_refresh(stream: DataFrame, *, table: str, checkpoint: str, entity: str, event_time: str, tiebreak: str) -> None:
    """Keep a table of live rows, one per entity, from a log that arrives in any order; runs until the input is used up.

    All that a batch needs of earlier ones stands in the state of the buckets of entities it touches,
    so its work depends on its own rows and those buckets' entities, not on the length of the log.  Rows that repeat (entity,
    time, tiebreak) count once, the last to come.  Live rows of a batch go to a folder of its
    own: a batch that is run again replaces its own output and nothing else.
    """
    order = {"entity": entity, "event_time": event_time, "tiebreak": tiebreak}
    state, row, means = recent_state(stream, **order)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        touched = batch.persist()
        try:
            if touched.isEmpty():
                return
            live = rows_of_state(touched, row, means, **order)
            live.write.mode("overwrite").parquet(f"{table}/batches/batch={batch_id}")
        finally:
            touched.unpersist()
        compact_live_table(batch.sparkSession, table, entity=entity)

    query = (
        state.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _parts(spark: SparkSession, table: str) -> tuple[int | None, list[int]]:
    """The last batch that the newest snapshot holds, and the batches after it."""
    upto = (numbered_folders(spark, f"{table}/snapshots", "upto") or [None])[-1]
    return upto, [b for b in numbered_folders(spark, f"{table}/batches", "batch") if upto is None or b > upto]


def live_table(spark: SparkSession, table: str, *, entity: str) -> DataFrame:
    """The live rows: those of the last batch that touched each entity."""
    upto, batches = _parts(spark, table)
    parts = [] if upto is None else [spark.read.parquet(f"{table}/snapshots/upto={upto}").withColumn("_batch", F.lit(-1))]
    if batches:
        paths = [f"{table}/batches/batch={b}" for b in batches]
        rows = spark.read.option("basePath", f"{table}/batches").parquet(*paths).withColumnRenamed("batch", "_batch")
        parts.append(rows.withColumn("_batch", F.col("_batch").cast("int")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return first_by_key(rows, [entity], [F.col("_batch").desc()]).drop("_batch")


def compact_live_table(spark: SparkSession, table: str, *, entity: str) -> bool:
    """Fold the batches since the last snapshot into a new one, sorted by entity, once they hold as many rows as it.

    Each row of a batch thus pays for a bounded number of rows rewritten, however many batches
    come.  A snapshot counts from the moment it is complete; the one before it and its batches
    are kept for readers that began earlier, older ones are removed.
    """
    upto, batches = _parts(spark, table)
    count = lambda *paths: spark.read.parquet(*paths).count()
    fresh = count(*[f"{table}/batches/batch={b}" for b in batches]) if batches else 0
    if not batches or len(batches) < 2 or (upto is not None and fresh < count(f"{table}/snapshots/upto={upto}")):
        return False
    rows = live_table(spark, table, entity=entity)
    path = f"{table}/snapshots/upto={batches[-1]}"
    rows.repartitionByRange(entity).sortWithinPartitions(entity).write.mode("overwrite").parquet(path)
    if upto is not None:
        for b in numbered_folders(spark, f"{table}/batches", "batch"):
            if b <= upto:
                remove_folder(spark, f"{table}/batches/batch={b}")
        for s in numbered_folders(spark, f"{table}/snapshots", "upto"):
            if s < upto:
                remove_folder(spark, f"{table}/snapshots/upto={s}")
    return True


CHUNK = 65_536  # rows of an entity held at a time
STEP = 256  # rows of a sorted run read at least at once; beyond CHUNK / STEP runs the memory grows by that a run


def in_order(frames: Iterator[pd.DataFrame], order: Sequence[str], chunk: int = CHUNK, step: int = STEP) -> Iterator[pd.DataFrame]:
    """The rows of the frames, sorted, in frames of bounded size.

    Up to ``chunk`` rows are sorted in memory.  More are written as sorted runs to a file that
    goes with the task, and merged: what every run has up to the smallest of the runs' last
    held rows is complete and can be handed on.
    """
    order = list(order)
    with tempfile.TemporaryFile() as file:
        runs: list[list[int]] = []
        held: list[pd.DataFrame] = []

        def write() -> None:
            whole = pd.concat(held, ignore_index=True).sort_values(order, ignore_index=True)
            places = []
            for start in range(0, len(whole), step):
                places.append(file.tell())
                pickle.dump(whole.iloc[start : start + step], file, protocol=5)
            runs.append(places)
            held.clear()

        for frame in frames:
            for start in range(0, len(frame), chunk):
                held.append(frame.iloc[start : start + chunk])
                if sum(map(len, held)) >= chunk:
                    write()
        if not runs:
            if held:
                yield pd.concat(held, ignore_index=True).sort_values(order, ignore_index=True)
            return
        if held:
            write()

        def read(run: int) -> list | None:
            """The next block of a run, its sort keys, and how many of its rows are done."""
            if not runs[run]:
                return None
            pieces = []
            for place in runs[run][:at_once]:
                file.seek(place)
                pieces.append(pickle.load(file))
            del runs[run][:at_once]
            block = pd.concat(pieces, ignore_index=True)
            return [block, list(zip(*[block[c].tolist() for c in order], strict=True)), 0]

        at_once = max(1, chunk // len(runs) // step)  # all runs together hold one chunk
        heads = {run: read(run) for run in range(len(runs))}
        while heads:
            more = [head[1][-1] for run, head in heads.items() if runs[run]]
            bound = min(more) if more else None
            ready = []
            for run, head in list(heads.items()):
                block, keys, done = head
                cut = len(keys) if bound is None else bisect.bisect_right(keys, bound, lo=done)
                if cut > done:
                    ready.append(block.iloc[done:cut])
                    head[2] = cut
                if cut == len(keys):
                    heads[run] = read(run)
                    if heads[run] is None:
                        del heads[run]
            yield pd.concat(ready, ignore_index=True).sort_values(order, ignore_index=True)


class RollingMeans(StatefulProcessor):
    """Keeps the last rows of the entities of a bucket and emits lagged means for each new one."""

    def __init__(self, measures: Sequence[str], sizes: Sequence[int], order: Sequence[str], entity: T.DataType):
        self.measures, self.sizes, self.order, self.entity = list(measures), list(sizes), list(order), entity

    def init(self, handle: StatefulProcessorHandle) -> None:
        many = lambda name, kind: T.StructField(name, T.ArrayType(kind))
        numbers = [many(f"m{i}", T.DoubleType()) for i in range(len(self.measures))]
        # How many rows each entity has, and the rows, one entity after the other.
        kept = [many("entity", self.entity), many("n", T.LongType()), *numbers]
        self.last = handle.getValueState("last", T.StructType(kept))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tails: dict = {}
        if self.last.exists():
            entities, n, *numbers = self.last.get()
            tails = dict(zip(entities, np.split(np.array(numbers, float).T, np.cumsum(n)[:-1]), strict=True))
        for fresh in in_order(rows, self.order):
            out = self._means(fresh, tails)
            yield out.astype(object).where(out.notna(), None)
        whole = np.concatenate(list(tails.values())).T.tolist()
        self.last.update((list(tails), [len(t) for t in tails.values()], *whole))

    def _means(self, fresh: pd.DataFrame, tails: dict) -> pd.DataFrame:
        """The means of rows in order; ``tails``, the last rows of each entity, are brought up to date."""
        most, entities = max(self.sizes), fresh[self.order[0]].tolist()
        values = fresh[self.measures].to_numpy(float)
        starts = [0, *[i for i in range(1, len(entities)) if entities[i] != entities[i - 1]], len(entities)]
        pieces, is_new, place = [], [], []
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            tail = tails.get(entities[start], values[:0])
            pieces += [tail, values[start:end]]
            is_new += [np.zeros(len(tail), bool), np.ones(end - start, bool)]
            place.append(np.arange(len(tail) + end - start))
            # Copied, so that a tail does not keep the rows it was cut from.
            tails[entities[start]] = np.concatenate([tail, values[start:end][-most:]])[-most:].copy()
        rows, is_new, place = np.concatenate(pieces), np.concatenate(is_new), np.concatenate(place)
        at = np.flatnonzero(is_new)
        total, number, means = np.zeros(values.shape), np.zeros(values.shape), {}
        for lag in range(1, most + 1):
            before = rows[np.maximum(at - lag, 0)]
            known = (place[at] >= lag)[:, None] & ~np.isnan(before)
            total += np.where(known, before, 0.0)
            number += known
            if lag in self.sizes:
                means[lag] = np.divide(total, number, out=np.full(values.shape, np.nan), where=number > 0)
        out = fresh[[self.order[2]]].reset_index(drop=True)
        for i, m in enumerate(self.measures):
            for n in self.sizes:
                out[f"rolling_last{n}_{m}"] = means[n][:, i]
        out.insert(0, "key", entities)
        return out

    def close(self) -> None:
        pass


def rolling_state(
    stream: DataFrame,
    *,
    entity: str,
    event_time: str,
    tiebreak: str,
    measures: Sequence[str],
    sizes: Sequence[int] = (3, 5, 10),
    delay: str = "7 days",
) -> DataFrame:
    """Lagged rolling means for every arriving row, from the last rows of each entity, kept by buckets of entities.

    Repeated (entity, time, tiebreak) rows within the watermark count once and rows older
    than the watermark in force are dropped (Spark enforces a watermark one batch after the
    one it was computed for); within a batch an entity's rows are put in order.
    Needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    rows = stream.select(
        entity, F.col(event_time).cast("timestamp").alias(event_time), tiebreak,
        *[F.col(m).cast("double").alias(m) for m in measures],
    ).where(F.col(entity).isNotNull())
    rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([entity, event_time, tiebreak])
    out = T.StructType([T.StructField("key", kinds[entity]), T.StructField(tiebreak, kinds[tiebreak])])
    for m in measures:
        for n in sizes:
            out = out.add(f"rolling_last{n}_{m}", T.DoubleType())
    processor = RollingMeans(measures, sizes, [entity, event_time, tiebreak], kinds[entity])
    result = rows.select("*", bucket_of(entity)).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None"
    )
    return result.withColumnRenamed("key", entity)


def run_to_table(stream: DataFrame, *, path: str, checkpoint: str) -> None:
    """Append a stream to a Parquet table until its input is used up."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
