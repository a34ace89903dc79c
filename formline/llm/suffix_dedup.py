"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes over it also starts earlier.  Each window of that length has one anchor,
the k-gram of the smallest hash in it, so equal windows share an anchor's hash and a place around it.  Anchors whose
hash occurs once are done with.  Of the others, equal surroundings keep their first occurrence; the different
surroundings of one hash are sorted as suffixes, and previous and next smaller places in that order give, for every
start, the longest factor that starts earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import stored

from .common import texts

LENGTH = 100
GRAM = 24  # bytes of an anchor
BUFFER = 1 << 21  # bytes looked at together
HOT = 5_000  # surroundings of one anchor from which they are split by window
CHUNK = 1 << 22  # bytes of suffixes sorted together
PLACE = np.uint64((1 << 24) - 1)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number, their inverses modulo 2 ** 64, and a random number per byte."""
    base = 0x9E3779B97F4A7C15
    ones = lambda m: np.cumprod(np.r_[1, np.full(n, m, np.uint64)].astype(np.uint64))
    table = np.frombuffer(hashlib.shake_128(b"bytes").digest(2048), "<u8")
    return ones(base), ones(pow(base, -1, 1 << 64)), table


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` keys."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :])


def anchors(data: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, in texts laid end to end (``ends``: where each ends).

    Gives the anchor's hash, the hash of the run's bytes and of where the anchor lies, the first start and the number
    of starts.  Windows that cross the end of a text do not count.
    """
    n = len(data)
    if n < length:
        none = np.array([], np.int64)
        return none, none, none, none
    power, inverse, table = _powers(BUFFER * 4 if n <= BUFFER * 4 else n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(table[np.frombuffer(data, np.uint8)] * power[:n], out=prefix[1:])
    grams = _mixed((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    places = np.arange(len(grams), dtype=np.uint64)
    at = (_smallest((grams & ~PLACE) | places, length - gram + 1) & PLACE).astype(np.int64)
    starts = np.arange(len(at))
    whole = ends[np.searchsorted(ends, starts, "right")] - starts >= length
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    if not len(first):
        none = np.array([], np.int64)
        return none, none, none, none
    # A run goes on until the next new start or the first window that is not whole.
    stop = np.flatnonzero(np.r_[new | ~whole, True])
    count = stop[np.searchsorted(stop, first, "right")] - first
    last = first + count - 1 + length
    around = (prefix[last] - prefix[first]) * inverse[first]
    around = _mixed(around + _mixed((at[first] - first).astype(np.uint64) * np.uint64(1 << 32) + count.astype(np.uint64)))
    return grams[at[first]].view(np.int64), around.view(np.int64), first, count


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """Ids, bytes and ends of texts, laid end to end up to ``BUFFER`` bytes; a longer text comes alone."""
    for batch in batches:
        ids, held, n = [], [], 0
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
        for doc_id, text in rows:
            if held and n + len(text) > BUFFER:
                yield np.array(ids), b"".join(held), np.cumsum([len(t) for t in held])
                ids, held, n = [], [], 0
            ids.append(doc_id)
            held.append(text)
            n += len(text)
        if held:
            yield np.array(ids), b"".join(held), np.cumsum([len(t) for t in held])


def _pieces(data: bytes, ends: np.ndarray, length: int, gram: int):
    """``anchors``, a very long text cut into overlapping parts, as places must fit ``PLACE``."""
    step = 1 << 23
    if len(data) <= 2 * step:
        yield anchors(data, ends, length, gram)
        return
    for at in range(0, len(data) - length + 1, step):
        part = data[at : at + step + length - 1]
        h, c, first, count = anchors(part, np.array([len(part)]), length, gram)
        yield h, c, first + at, count


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, ends in _buffers(batches):
            for h, c, first, count in _pieces(data, ends, length, gram):
                which = np.searchsorted(ends, first, "right")
                begins = np.r_[0, ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(c), pa.array(ids[which].astype(np.int64)), pa.array((first - begins[which]).astype(np.int64)), pa.array(count.astype(np.int32))],
                    ["h", "c", "doc_id", "start", "n"],
                )

    return run


def _surroundings(length: int, hot: int):
    """The bytes of each run; those of a hot anchor window by window, each under the hash of its own bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, starts, out, size = [], [], [], [], 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True)
            for doc_id, text, runs in rows:
                text = text.encode()
                for r in runs:
                    begin, n = r["start"], r["n"]
                    if r["m"] <= hot:
                        found = [(r["h"], begin, text[begin : begin + n - 1 + length])]
                    else:
                        windows = ((s, text[s : s + length]) for s in range(begin, begin + n))
                        found = [(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True), s, w) for s, w in windows]
                    for key, s, w in found:
                        keys.append(key)
                        ids.append(doc_id)
                        starts.append(s)
                        out.append(w)
                        size += len(w)
                if size > CHUNK:
                    yield _as_rows(keys, ids, starts, out)
                    keys, ids, starts, out, size = [], [], [], [], 0
            yield _as_rows(keys, ids, starts, out)

    return run


def _as_rows(keys: list, ids: list, starts: list, out: list) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in (keys, ids, starts)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], ["key", "doc_id", "start", "around"])


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes numbered by their place in the text.

    ``order``: the suffixes in suffix order; ``lcp[i]``: what suffixes ``order[i - 1]`` and ``order[i]`` have in common.
    One pass with a stack: a suffix leaves it when a smaller place comes, its next smaller place, and what lies below
    it is its previous smaller place; it shares with them the least ``lcp`` in between.
    """
    out = np.zeros(len(order), np.int64)
    stack: list[list[int]] = []  # place, and the least lcp towards the one below
    for place, common in zip([*order.tolist(), -1], [*lcp.tolist(), 0], strict=True):
        while stack and stack[-1][0] > place:
            gone, below = stack.pop()
            out[gone] = max(below, common)
            common = min(below, common)
        stack.append([place, common])
    return out


def _repeats(rows: list[tuple[int, int, bytes]], length: int) -> Iterator[tuple[int, int, int]]:
    """Intervals ``doc_id, low, high`` of the starts in the rows whose previous factor is ``length`` or longer."""
    rows.sort(key=lambda r: r[:2])
    data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    sizes = np.array([len(r[2]) for r in rows])
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)[begins[row] + inside]
    order = np.argsort(windows.view(f"S{length}").ravel(), kind="stable")
    sorted_ = windows[order]
    differ = sorted_[1:] != sorted_[:-1]
    lcp = np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), length)]
    hit = np.flatnonzero(previous_factors(order, lcp) >= length)
    if not len(hit):
        return
    cut = np.flatnonzero(np.r_[True, (row[hit][1:] != row[hit][:-1]) | (inside[hit][1:] != inside[hit][:-1] + 1), True])
    for a, b in zip(cut[:-1], cut[1:] - 1, strict=True):
        doc_id, start, _ = rows[row[hit[a]]]
        yield doc_id, start + int(inside[hit[a]]), start + int(inside[hit[b]]) + length


def _factor_rows(length: int):
    """Works off rows sorted by key, whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = list(_repeats(held, length))
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "low", "high"])

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "start", "around")), strict=True):
                if key != last and size > CHUNK // 8:
                    yield flush()
                    held.clear()
                    size = 0
                held.append(tuple(row))
                size += len(row[2])
                last = key
        if held:
            yield flush()

    return run


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Byte intervals ``doc_id, low, high`` to remove, which may overlap, and the texts of the documents they lie in."""
    rows = texts(docs).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    runs = rows.mapInArrow(_anchor_rows(length, gram), "h bigint, c bigint, doc_id bigint, start bigint, n int")
    twice = runs.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").select("h")
    shared = stored(runs.join(twice, "h"), "anchors")
    first = shared.groupBy("h", "c").agg(F.min(F.struct("doc_id", "start", "n")).alias("first"))
    first = stored(first.select("h", "c", "first.*"), "surroundings")
    place = first.select("h", "c", F.col("doc_id").alias("d"), F.col("start").alias("s"))
    copies = shared.join(place, ["h", "c"]).filter("doc_id <> d or start <> s")
    copies = copies.select("doc_id", F.col("start").alias("low"), (F.col("start") + F.col("n") - 1 + length).alias("high"))
    mixed = first.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    asked = first.join(mixed, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n", "m")).alias("runs"))
    involved = shared.select("doc_id").distinct()
    held = stored(rows.join(involved, "doc_id", "left_semi"), "texts")
    around = held.join(asked, "doc_id").mapInArrow(_surroundings(length, hot), "key bigint, doc_id bigint, start bigint, around binary")
    around = around.repartition("key").sortWithinPartitions("key")
    return copies.unionByName(around.mapInArrow(_factor_rows(length), "doc_id bigint, low bigint, high bigint")), held


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, intervals in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("intervals").to_pylist(), strict=True):
            kept, at, spans, removed = [], 0, 0, 0
            high = -1
            for low, end in sorted((min(i["low"], len(text)), min(i["high"], len(text))) for i in intervals):
                if low > high:
                    spans += low < end
                    kept.append(text[at:low])
                    removed += end - low
                else:
                    removed += max(0, end - high)
                high = max(high, end)
                at = high
            kept.append(text[max(at, 0) :])
            out.append((len(text), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest(), b"".join(kept)))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``, the bytes that are left, null where all are.

    Order is by document id, then by start.  A null text counts as empty; texts shorter than ``length`` and rows
    without an id keep everything; rows that repeat an id and a text are one document that comes as often as they do
    (ids are taken to be of one text); an empty table gives no rows; other columns are left out.
    """
    intervals, held = repeated_intervals(docs, length)
    found = stored(intervals.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("intervals")), "intervals")
    cut = held.join(found, "doc_id").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
    whole = texts(docs).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256")
    )
    whole = whole.join(found.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        "kept_sha256", F.lit(None).cast("binary").alias("kept"),
    )
    return cut.unionByName(whole)
