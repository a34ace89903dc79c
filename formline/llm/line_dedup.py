"""Line dedup by pairwise alignment.

Documents that share a block are found through its runs: a run is consecutive lines that just reach the words of a
block, and leads from every later document to the first that holds it, so pairs grow with the lines and not with their
square.  A patience diff aligns the two documents, and aligned common blocks go from the later one.  What is left of the
later document and stands elsewhere in the first is aligned again, with the lines of the first where it stands.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import stored

from .common import let, words_of

BLOCK_WORDS = 20  # words of an aligned block that is deleted


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first place, whose second place rises too (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect.bisect_left(tops, j)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


LCS_BITS = 1 << 28  # bits of the table that is kept to trace one alignment; larger ranges are halved first


def _lcs_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each start of ``a`` the bits of ``b`` where the longest common subsequence does not grow."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole
    yield row
    for x in a:
        same = row & at.get(x, 0)
        row = ((row + same) | (row - same)) & whole
        yield row


def _lcs_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` with each start of ``b``."""
    row = 0
    for row in _lcs_rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), count=len(b), bitorder="little")
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: rows of bits, traced back; halved as long as the rows are too many."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        left, right = a[a0:a1], b[b0:b1]
        if len(left) > 1 and (len(left) + 1) * len(right) > LCS_BITS:
            half = len(left) // 2
            cut = int(np.argmax(_lcs_lengths(left[:half], right) + _lcs_lengths(left[: half - 1 : -1], right[::-1])[::-1]))
            todo += [(a0, a0 + half, b0, b0 + cut), (a0 + half, a1, b0 + cut, b1)]
            continue
        rows = list(_lcs_rows(left, right))
        i, j = len(left), len(right)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif rows[i - 1] >> (j - 1) & 1:
                i, j = i - 1, j - 1
                out.append((a0 + i, b0 + j))
            else:
                i -= 1
    return sorted(out)


def _shared_lines(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two ranges, of the lines that both hold."""
    both = set(a[a0:a1]) & set(b[b0:b1])
    at_a, at_b = [i for i in range(a0, a1) if a[i] in both], [j for j in range(b0, b1) if b[j] in both]
    return [(at_a[i], at_b[j]) for i, j in longest_common([a[i] for i in at_a], [b[j] for j in at_b])]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines, rising in both, by patience diff.

    Lines that both ranges hold once are matched along their longest rising run, extended over equal neighbours, and
    the gaps are aligned in the same way.  A range without such lines is aligned by a longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {a[i]: i for i in range(a0, a1) if once_a[a[i]] == 1}
        shared = sorted((place[b[j]], j) for j in range(b0, b1) if once_b[b[j]] == 1 and b[j] in place)
        anchors = longest_rising(shared)
        if not anchors:
            out += _shared_lines(a, b, a0, a1, b0, b1)
            continue
        last = (a0, b0)
        for i, j in [*anchors, (a1, b1)]:
            if (i, j) != (a1, b1):
                out.append((i, j))
            if last[0] < i and last[1] < j:
                todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
    return sorted(out)


# An odd number, whose powers weigh the lines of a run, and its inverse, both modulo 2 ** 64.
WEIGHT = 0x9E3779B97F4A7C15
BACK = pow(WEIGHT, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs(lines: np.ndarray, words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs of documents laid end to end, ``ends`` being where each ends.

    Runs are the shortest from each line on, and the shortest up to each line, of at least ``least`` words.  Both kinds
    together cover every block of so many words, and only it.
    """
    n = len(lines)
    total = np.r_[0, np.cumsum(words, dtype=np.int64)]
    at = np.arange(n)
    doc = np.searchsorted(ends, at, "right")
    stop, begin = ends[doc], np.r_[0, ends][doc]
    from_here = np.searchsorted(total, total[:-1] + max(1, least))
    up_to = np.searchsorted(total, total[1:] - max(1, least), "right") - 1
    ahead, behind = from_here <= stop, up_to >= begin
    found = np.unique(np.stack([np.r_[at[ahead], up_to[behind]], np.r_[from_here[ahead], at[behind] + 1]]), axis=1)
    start, end = found
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(lines.astype(np.int64).view(np.uint64) * _powers(WEIGHT, n), dtype=np.uint64)]
    return start, end, ((sums[end] - sums[start]) * _powers(BACK, n + 1)[start]).view(np.int64)


def _aligned_blocks(first: list[int], later: list[int], words: list[int], least: int) -> Iterator[tuple[int, int]]:
    """Starts and ends in ``later`` of the alignment's runs, consecutive in both, of at least ``least`` words."""
    start, last = 0, (-2, -2)
    for i, j in [*patience(first, later), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if last[1] >= 0 and sum(words[start : last[1] + 1]) >= least:
                yield start, last[1] + 1
            start = j
        last = (i, j)


def _runs_elsewhere(first: list[int], later: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """Starts and ends in ``later`` of runs of at least ``least`` words that ``first`` holds, and where it does."""
    n, both = len(first), [*first, *later]
    # Equal lines have equal words; a line of ``first`` alone is in no common run.
    of = dict.fromkeys(first, 0) | dict(zip(later, words, strict=True))
    number = dict(zip(of, np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, len(of)).tolist(), strict=True))
    lines, sizes = (np.array([x[line] for line in both], np.int64) for x in (number, of))
    start, end, run = runs(lines, sizes, np.array([n, len(both)]), least)
    held, at = np.unique(run[start < n], return_index=True)
    if not len(held):
        return []
    at = start[start < n][at]
    place = np.minimum(np.searchsorted(held, run), len(held) - 1)
    shared = (start >= n) & (held[place] == run)
    return list(zip((start[shared] - n).tolist(), (end[shared] - n).tolist(), at[place[shared]].tolist(), strict=True))


def common_blocks(first: list[int], later: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Places in ``later`` of runs of lines of at least ``least`` words that a patience diff aligns with ``first``.

    One alignment cannot hold blocks that changed places, nor a block twice: a run that it left and that ``first``
    holds elsewhere is aligned again, with those lines of ``first``.
    """
    out = np.zeros(len(later), bool)
    for low, high in _aligned_blocks(first, later, words, least):
        out[low:high] = True
    for low, high, at in _runs_elsewhere(first, later, words, least):
        if not out[low:high].all():
            for a, b in _aligned_blocks(first[at : at + high - low], later[low:high], words[low:high], least):
                out[low + a : low + b] = True
    return np.flatnonzero(out).tolist()


def _run_hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, words = batch.column("lines"), batch.column("words")
            ends = np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64))
            start, _, found = runs(lines.flatten().to_numpy(), words.flatten().to_numpy(), ends, least)
            doc = np.searchsorted(ends, start, "right")
            kept = np.unique(np.stack([doc, found]), axis=1)
            ids = batch.column("doc_id").take(pa.array(kept[0]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kept[1])], ["doc_id", "run"])

    return run


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                common_blocks(a, b, w, least)
                for a, b, w in zip(*(batch.column(c).to_pylist() for c in ("first_lines", "lines", "words")), strict=True)
            ]
            keep = np.array([bool(f) for f in found], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").filter(pa.array(keep)),
                    pa.array([f for f in found if f], pa.list_(pa.int32())),
                ],
                ["doc_id", "places"],
            )

    return run


def repeated_places(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, places``: the lines (from 0) of each document that an earlier document holds in a block."""
    rows = docs.filter("doc_id is not null and text is not null")
    lines = F.split("text", "\n", -1)
    hashed = rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.transform(lines, lambda line: F.xxhash64(F.trim(line))).alias("lines"),
        F.transform(lines, lambda line: F.size(words_of(line))).alias("words"),
    )
    hashed = stored(hashed, "lines")
    held = hashed.mapInArrow(_run_hashes(block_words), "doc_id bigint, run bigint")
    first = held.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    pairs = held.join(first, "run").filter("doc_id > first").select("first", "doc_id").distinct()
    # Rows that repeat an id are one document, of the row with the smallest lines.
    one = hashed.groupBy("doc_id").agg(F.min(F.struct("lines", "words")).alias("x")).select("doc_id", "x.lines", "x.words")
    one = stored(one, "line_lists")
    both = pairs.join(one.select(F.col("doc_id").alias("first"), F.col("lines").alias("first_lines")), "first")
    both = both.select("doc_id", "first_lines").join(one, "doc_id")
    found = both.mapInArrow(_align(block_words), "doc_id bigint, places array<int>")
    return found.select("doc_id", F.explode("places").alias("place")).groupBy("doc_id").agg(F.collect_set("place").alias("places"))


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not hold."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def dedup_lines(
    docs: DataFrame, block_words: int = BLOCK_WORDS, places: str | None = "removed_places"
) -> DataFrame:
    """The documents, all columns kept, without the lines of blocks that an earlier document (smaller id) holds.

    A block is consecutive lines of at least ``block_words`` words that stand in the earlier document in a row too.
    Every document is judged on the input.  Long texts are read whole, as one list of line hashes.  A document of which nothing is left keeps its row with an empty text.  Null
    and empty texts and rows without an id stay as they are; rows that repeat an id lose the same places; lines
    compare without surrounding spaces; an empty table gives no rows.  ``places`` names an added column of the lines
    removed, empty where nothing went; None adds none.
    """
    key, gone = _unused("id", docs), _unused("gone", docs)
    removed = repeated_places(docs, block_words).select(F.col("doc_id").alias(key), F.sort_array("places").alias(gone))
    out = docs.join(removed, docs["doc_id"].cast("bigint") == removed[key], "left")
    # The lines between one removed place and the next.
    lows = F.concat(F.array(F.lit(-1)), F.col(gone))
    left = let(
        F.split("text", "\n", -1),
        lambda lines: F.flatten(
            F.zip_with(
                lows, F.concat(F.col(gone), F.array(F.size(lines))), lambda low, high: F.slice(lines, low + 2, high - low - 1)
            )
        ),
    )
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != places]
    if places:
        columns.append(F.coalesce(F.col(gone), F.array().cast("array<int>")).alias(places))
    return out.select(*columns)
