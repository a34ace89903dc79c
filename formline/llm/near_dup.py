"""Near-duplicates by bottom-k sketches of one hash function.

The k smallest shingle hashes of a document are its sketch.  Inverted lists of retained values give overlapping
documents; the sketch of the union estimates their similarity; links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.session import stored

from .common import texts
from .graph import components

K = 64  # values in a sketch
SHARED = 32  # values that linked documents' sketches share at least, where a sketch is not the whole set
TURNS = (64, 512)  # documents of a list that are asked in the second and third round; the next takes all that are left
BITS = 1 << 24  # marks for hashed ids, by which rows are picked before they are shuffled
MEMO, MEMO_WORD = 100_000, 64  # words that a task remembers, and bytes of the longest of them


class _WordHash(dict):
    """Hashes of words; each task has its own, which goes with it."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes, width: int, hashes: _WordHash | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    hashes = _WordHash() if hashes is None else hashes
    words = text.lower().split()
    if not words:
        return np.array([], np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out.view(np.int64))


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in batches:
            sets = [shingle_hashes(t, width, hashes) for t in _bytes(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "digest", "sketch"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in batches:
            sets = [shingle_hashes(t, width, hashes) for t in _bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return run


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    return texts(docs).mapInArrow(_sketches(width, k), "doc_id bigint, n bigint, digest binary, sketch array<bigint>")


def _roughly(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is asked for, and a few others, which share its mark; only marks travel.

    The marks are bounded by ``BITS``, so texts and sets that nobody asks for are not shuffled by a join to come.
    """
    place = "cast(xxhash64(doc_id) & 63 as int)"
    slot = F.expr(f"shiftright(xxhash64(doc_id), 6) & {BITS // 64 - 1}")
    marks = asked.groupBy(slot.alias("slot_")).agg(F.expr(f"bit_or(shiftleft(1L, {place}))").alias("marks_"))
    marked = (slot == F.col("slot_")) & F.expr(f"shiftright(marks_, {place}) & 1 = 1")
    return rows.join(F.broadcast(marks), marked).drop("slot_", "marks_")


def _ends(pairs: DataFrame) -> DataFrame:
    """``doc_id`` of both sides of the pairs."""
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def _postings(rows: DataFrame, percent: int, k: int) -> DataFrame:
    """``value, doc_id, n, own``: of each sketch as many of its rarest values as linked documents need to share one.

    Values of one document alone come first in that order and are never posted.  While whole sets fit a sketch the
    number is exact; beyond, linked sketches share ``SHARED`` of ``k`` values but for a chance below 1e-11.  ``own`` is
    the share of a sketch's values that no other document holds.
    """
    values = rows.select("doc_id", "n", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    listed = values.join(shared, "value").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    whole = F.col("n") <= percent * k // 100
    size = F.least(F.col("n"), F.lit(k))
    need = F.when(whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(SHARED))
    keep = size - need + 1 - (size - F.size("common"))
    kept = F.slice("common", F.lit(1), F.greatest(keep, F.lit(0)).cast("int"))
    own = 1 - F.size("common") / size
    return listed.select("doc_id", "n", own.alias("own"), F.explode(kept).alias("c")).select(
        "doc_id", "n", "own", F.col("c.value").alias("value")
    )


class _FullSets:
    """The full shingle sets of the documents asked for so far, each made and stored once."""

    def __init__(self, docs: DataFrame, width: int):
        self.docs, self.width, self.made = texts(docs), width, None

    def holding(self, asked: DataFrame) -> DataFrame:
        """``doc_id, shingles`` of at least the documents ``asked``."""
        if self.made is not None:
            asked = asked.join(self.made.select("doc_id"), "doc_id", "left_anti")
        asked = stored(asked, "asked")
        rows = _roughly(self.docs, asked).join(asked, "doc_id", "left_semi")
        new = stored(rows.mapInArrow(_sets(self.width), "doc_id bigint, shingles array<bigint>"), "shingles")
        self.made = new if self.made is None else self.made.union(new)
        return self.made


def _prefixes(lists: DataFrame, sets: _FullSets, percent: int) -> DataFrame:
    """``value, doc_id, n, u``: of the documents in some lists, as many of each full set's rarest shingles as a linked
    document must hold one of, and how many of the set's shingles are rarer (``u``).

    Shingles of one document alone come first and are never posted.  In the first list that two documents share, each
    has ``n - u`` shingles at most in common with the other, so what edited near copies all hold brings few of them
    together.  The few others that ``_roughly`` lets through change the order of the shingles, for all documents alike.
    """
    asked = lists.select("doc_id").distinct()
    held = _roughly(sets.holding(asked), asked).withColumns({"n": F.size("shingles"), "text": F.xxhash64("shingles")})
    held = held.select("doc_id", "n", "text", F.explode("shingles").alias("value"))
    shared = held.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    listed = held.join(shared, "value").groupBy("doc_id", "n", "text").agg(F.sort_array(F.collect_set(F.struct("df", "value"))).alias("common"))
    alone = F.col("n") - F.size("common")
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    kept = F.slice("common", F.lit(1), F.greatest(keep, F.lit(0)).cast("int"))
    return listed.select("doc_id", "n", alone.alias("alone"), F.posexplode(kept).alias("at", "c")).select(
        F.col("c.value").alias("value"), "doc_id", "n", (F.col("alone") + F.col("at")).alias("u")
    )


def _open(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold several components: their rows with the ``label`` of each, and the list's ``largest``
    component, number of components ``m`` and size of its smallest set, ``least``."""
    members = posts.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    members = members.withColumn("label", F.coalesce("label", "doc_id"))
    sizes = members.groupBy("value", "label").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    lists = sizes.groupBy("value").agg(
        F.max_by("label", F.struct("size", "label")).alias("largest"), F.count("*").alias("m"), F.min("least").alias("least")
    )
    return members.join(lists.filter("m > 1"), "value")


def estimate(a: Column, b: Column, k: int) -> Column:
    """Similarity by the sketch of the union: the share of its values that both sketches hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def _asked_pairs(members: DataFrame, asked: DataFrame, percent: int, once: bool) -> DataFrame:
    """The members of lists beside those ``p`` that are asked in them, where a link of the two could matter.

    With ``once``, a pair is told in the first list where it is asked, and only there: near copies share most of their
    lists.  Both sides then carry their lists.  It is for lists whose ``u`` is the document's in all of them alike.
    """
    most = F.least(F.col("n") - F.col("u"), F.col("pn") - F.col("pu"))
    likely = (F.col("label") != F.col("pl")) & (100 * most >= percent * (F.col("n") + F.col("pn") - most))
    if once:
        members = members.join(members.groupBy("doc_id").agg(F.collect_list("value").alias("held")), "doc_id")
        asked = asked.join(asked.groupBy("p").agg(F.collect_list("value").alias("at")), "p")
        likely &= F.array_min(F.array_intersect("held", "at")) == F.col("value")
    return members.join(asked, "value").filter(likely)


def _linked(pairs: DataFrame, sketch: DataFrame, sets: _FullSets, percent: int, k: int) -> DataFrame:
    """Those pairs ``a, b`` whose full shingle sets are similar."""

    def beside(table: DataFrame, side: str, column: str) -> DataFrame:
        return table.select(F.col("doc_id").alias(side), F.col(column).alias(f"{column}_{side}"))

    pairs = stored(pairs, "asked_pairs")
    sketch = _roughly(sketch, _ends(pairs))
    likely = pairs.join(beside(sketch, "a", "sketch"), "a").join(beside(sketch, "b", "sketch"), "b")
    likely = stored(likely.filter(estimate(F.col("sketch_a"), F.col("sketch_b"), k) >= SHARED / k).select("a", "b"), "pairs")
    full = _roughly(sets.holding(_ends(likely).distinct()), _ends(likely))
    both = likely.join(beside(full, "a", "shingles"), "a").join(beside(full, "b", "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    both = both.select("a", "b", common.alias("common"), (F.size("shingles_a") + F.size("shingles_b") - common).alias("union"))
    return both.filter(f"100 * common >= {percent} * union").select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents of equal sets are one class from the start; the rest works on one document of each class.  A list of
    documents that share a posted value is worked off in rounds.  First all of it is compared with the document that
    has the fewest values of its own.  The documents of the lists that still hold several components then get new lists,
    by the rarest shingles of their full sets.  Only documents outside a list's largest component are asked, each
    against the list, and only where the shingles from there on could suffice for a link: some, then more, then all that
    are left, so rounds do not grow with the lists.  A group of near copies takes about as many comparisons as it has
    members, and no link between components is lost.

    A null or text without words has no shingles and is linked with nothing; rows without an id are linked with
    nothing and kept; rows that repeat an id count as one document; an empty table gives no rows.
    """
    sketch = stored(sketches(docs, width, k), "sketches")
    classes = stored(sketch.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    digests = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list("digest").alias("digests"))
    # A repeated id may stand for some of its texts only; all of them are compared, those it stands for are posted.
    reps = sketch.join(digests, "doc_id").select("doc_id", "n", "sketch", F.expr("array_contains(digests, digest)").alias("posted"))
    reps = stored(reps, "reps")
    posts = stored(_postings(reps.filter("posted"), percent, k), "postings")
    sets = _FullSets(docs, width)
    pivots = posts.groupBy("value").agg(F.min_by("doc_id", F.struct("own", "n", "doc_id")).alias("doc_id"))
    members = posts.withColumn("label", F.col("doc_id")).withColumn("u", F.lit(0))
    done = edges = None
    for turn in itertools.count():
        pivots = stored(pivots, "pivots")
        if turn and pivots.isEmpty():
            break
        asked = members.join(pivots, ["value", "doc_id"]).select(
            "value", F.col("doc_id").alias("p"), F.col("n").alias("pn"), F.col("u").alias("pu"), F.col("label").alias("pl")
        )
        pairs = _asked_pairs(members, asked, percent, once=False)
        pairs = pairs.select(F.least("doc_id", "p").alias("a"), F.greatest("doc_id", "p").alias("b")).distinct()
        found = stored(_linked(pairs, reps, sets, percent, k), "links")
        edges = found if edges is None else edges.union(found)
        labels = stored(components(edges), "labels")
        if turn:
            done = pivots if done is None else done.union(pivots)
        else:
            posts = stored(_prefixes(_open(posts, labels), sets, percent), "prefixes")
        members = stored(_open(posts, labels), "open")
        # A link needs n - u shared shingles at most, with a document of the list's least size at least.
        shared = F.col("n") - F.col("u")
        able = 100 * shared >= percent * F.greatest(F.col("n"), F.col("least") + F.col("u"))
        members = members.filter(able)
        pivots = members.filter("label <> largest").select("value", "doc_id").distinct()
        if done is not None:
            pivots = pivots.join(done, ["value", "doc_id"], "left_anti")
        if turn < len(TURNS):
            place = F.row_number().over(Window.partitionBy("value").orderBy(F.xxhash64("doc_id"), "doc_id"))
            pivots = pivots.withColumn("place", place).filter(F.col("place") <= TURNS[turn]).select("value", "doc_id")
    of_class = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", F.coalesce("label", "rep").alias("component_id")
    )
    out = sketch.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
