"""Byte-level BPE encoding and decoding.

Documents become blocks of numbers: the texts as numbers of their chunks, and each chunk that is new to the task as
numbers of its words.  The ranked merges are made for each word that is new to the task, its ids are decoded, and the
documents are put together from the chunks.  A block stays in its task, so nothing is shuffled and a word is encoded
once per task; ids outside blocks are decoded by concatenating their binary pieces in Spark.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

BLOCK_CHARS = 2_000_000  # text in a block
NUMBERED = 400_000  # chunks a task numbers before it starts anew
LONG_WORD = 1_000  # bytes from which a word is merged with a heap
NO_PAIR = 1 << 40
BYTES = [bytes([b]) for b in range(256)]
# A space before white space or the end: such texts are one chunk.
UNEVEN = re.compile(r" (?:\s|\Z)")


@lru_cache(4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(4)
def tokens_of(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks_of(path).items()}


@lru_cache(4)
def pattern_of(pattern: str) -> regex.Pattern:
    """The splitting pattern with Unicode's white space, which the library's ``\\s`` exceeds."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word by a heap of pairs: the same merges as the fold, in n log n."""
    if word in ranks:
        return [ranks[word]]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < len(parts) and (rank := ranks.get(both := parts[i] + parts[after[i]])) is not None:
            heapq.heappush(heap, (rank, i, both))

    for i in range(len(parts) - 1):
        push(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
            continue
        gone = after[i]
        parts[i], parts[gone], after[i] = both, None, after[gone]
        if after[i] < len(parts):
            before[after[i]] = i
        push(i)
        push(before[i])
    return [ranks[p] for p in parts if p is not None]


class _Numbers(dict):
    """Numbers keys in the order they are first asked for, and keeps the new ones until they are taken."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        i = self[key] = len(self)
        return i

    def taken(self) -> list:
        new, self.new = self.new, []
        return new


BLOCK = pa.schema(
    [
        ("doc_ids", pa.list_(pa.int64())),
        ("docs", pa.list_(pa.binary())),
        ("chunks", pa.list_(pa.list_(pa.int32()))),
        ("words", pa.list_(pa.list_(pa.int16()))),
        ("anew", pa.bool_()),
        ("long", pa.list_(pa.struct([("word", pa.int32()), ("ids", pa.list_(pa.int64())), ("decoded", pa.binary())]))),
    ]
)

def _lists(values: list[list[int]], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(values), kind.to_pandas_dtype(), int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


class _Numbering:
    """What a task has numbered so far."""

    def __init__(self, pattern: regex.Pattern, ranks_path: str):
        self.pattern, self.ranks_path = pattern, ranks_path
        self.chunks, self.words = _Numbers(), _Numbers()

    def block(self, doc_ids: list, held: list[str]) -> pa.RecordBatch:
        anew = len(self.chunks) > NUMBERED
        if anew:
            self.chunks, self.words = _Numbers(), _Numbers()
        docs = []
        for text in held:
            if not text:
                parts = []
            elif "\0" in text or UNEVEN.search(text):
                parts = [text]
            else:
                parts = text.replace(" ", "\0 ").split("\0")
                parts = parts if parts[0] else parts[1:]
            docs.append(np.fromiter(map(self.chunks.__getitem__, parts), "<i4", len(parts)).tobytes())
        by_chunk = [[self.words[w] for w in self.pattern.findall(c)] for c in self.chunks.taken()]
        as_bytes = [w.encode() for w in self.words.taken()]
        long = []
        for i, w in enumerate(as_bytes):
            if len(w) > LONG_WORD:
                ids, tokens = merge_long(w, ranks_of(self.ranks_path)), tokens_of(self.ranks_path)
                long.append({"word": i, "ids": ids, "decoded": b"".join([tokens[t] for t in ids])})
                as_bytes[i] = b""
        lengths = np.cumsum([0, *map(len, as_bytes)], dtype=np.int32)
        flat = pa.array(np.frombuffer(b"".join(as_bytes), "u1").astype(np.int16))
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays(
            [
                one(pa.array(doc_ids, pa.int64())),
                one(pa.array(docs, pa.binary())),
                one(_lists(by_chunk, pa.int32())),
                one(pa.ListArray.from_arrays(pa.array(lengths), flat)),
                pa.array([anew]),
                pa.array([long], BLOCK.field("long").type),
            ],
            schema=BLOCK,
        )


def _blocks(pattern: str, ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        numbering = _Numbering(pattern_of(pattern), ranks_path)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                held.append(text)
                n += len(text)
                if n >= BLOCK_CHARS:
                    yield numbering.block(ids, held)
                    ids, held, n = [], [], 0
        if held:
            yield numbering.block(ids, held)

    return run


def _literal(value: list, kind: str) -> Column:
    """A constant too large for an expression tree; Spark folds it into one literal."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def decoded(ids: Column, ranks_path: str) -> Column:
    """The bytes of ids: their pieces, concatenated."""
    ranks = ranks_of(ranks_path)
    by_id: list[str | None] = [None] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        by_id[rank] = base64.b64encode(token).decode()
    tokens = _literal(by_id, "array<binary>")
    return F.aggregate(ids, F.lit(b""), lambda got, i: F.concat(got, F.get(tokens, i.cast("int"))))


def merge_parts(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: the leftmost pair of the lowest rank merges, again and again.

    A word that is a token is that token, even where its own merges do not give it.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    rank = ranks.get
    parts = list(map(BYTES.__getitem__, word))
    pairs = list(map(rank, map(add, parts, parts[1:]), repeat(NO_PAIR)))
    while pairs and (lowest := min(pairs)) != NO_PAIR:
        i = pairs.index(lowest)
        del pairs[i]
        both = parts[i] = parts[i] + parts.pop(i + 1)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + both, NO_PAIR)
        if i < len(pairs):
            pairs[i] = rank(both + parts[i + 1], NO_PAIR)
    return list(map(ranks.__getitem__, parts))


def _merged(ranks_path: str):
    """Blocks with the ids, and the bytes that these decode to, in place of the bytes of each word."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, tokens = ranks_of(ranks_path), tokens_of(ranks_path)
        at = BLOCK.get_field_index("words")
        for block in blocks:
            words = block.column("words").flatten()
            flat, ends = words.flatten().to_numpy().astype("u1").tobytes(), words.offsets.to_numpy().tolist()
            ids = [merge_parts(flat[a - ends[0] : b - ends[0]], ranks) for a, b in zip(ends, ends[1:], strict=False)]
            back = pa.array([b"".join([tokens[i] for i in w]) for w in ids], pa.binary())
            told = pa.StructArray.from_arrays([_lists(ids, pa.int32()), back], ["ids", "decoded"])
            yield block.set_column(at, "words", pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), told))

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], list[bytes], list[bytes]]]:
    """Per block: document ids, the chunk numbers of each document, and all the task's chunks so far as ids
    (little-endian 32 bit) and as decoded bytes."""
    word_ids: list[bytes] = []
    word_bytes: list[bytes] = []
    ids: list[bytes] = []
    decoded: list[bytes] = []
    for batch in batches:
        for at in range(len(batch)):
            cell = lambda name, at=at: batch.column(name)[at]  # noqa: B023, E731
            if cell("anew").as_py():
                word_ids, word_bytes, ids, decoded = [], [], [], []
            told = cell("words").values
            flat, ends = told.field("ids").flatten().to_numpy().astype("<i4").tobytes(), told.field("ids").offsets.to_numpy()
            ends = ((ends - ends[0]) * 4).tolist()
            before = len(word_ids)
            word_ids += [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            word_bytes += told.field("decoded").to_pylist()
            for w in cell("long").as_py():
                word_ids[before + w["word"]], word_bytes[before + w["word"]] = np.array(w["ids"], "<i4").tobytes(), w["decoded"]
            chunks = cell("chunks").values
            held, ends = chunks.flatten().to_numpy().tolist(), (chunks.offsets.to_numpy() - chunks.offsets[0].as_py()).tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                # Most chunks are one word.
                if b - a == 1:
                    ids.append(word_ids[held[a]])
                    decoded.append(word_bytes[held[a]])
                else:
                    ids.append(b"".join([word_ids[w] for w in held[a:b]]))
                    decoded.append(b"".join([word_bytes[w] for w in held[a:b]]))
            yield cell("doc_ids").as_py(), [np.frombuffer(d, "<i4") for d in cell("docs").as_py()], ids, decoded


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_ids, docs, ids, _ in _told(batches):
        out = [np.frombuffer(b"".join([ids[c] for c in d.tolist()]), "<i4") for d in docs]
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, shown = None, []
    for doc_ids, docs, ids, decoded in _told(batches):
        if ids is not known:
            known, shown = ids, []
        # The ids of a chunk as they are digested, each behind a space.
        for chunk in ids[len(shown) :]:
            shown.append("".join([f" {i}" for i in np.frombuffer(chunk, "<i4").tolist()]).encode())
        out: list[tuple] = []
        for d in docs:
            at = d.tolist()
            told = b"".join([shown[c] for c in at])
            text = b"".join([decoded[c] for c in at])
            out.append((told.count(b" "), hashlib.sha256(told[1:]).hexdigest(), hashlib.sha256(text).hexdigest()))
        n, first, second = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, out: Callable, schema: str) -> DataFrame:
    """What ``out`` makes of the blocks of documents with the ids and the decoded bytes of their words."""
    blocks, merged = _blocks(pattern, ranks_path), _merged(ranks_path)
    return texts(docs).mapInArrow(lambda batches: out(merged(blocks(batches))), schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and the ids of the whole text.

    A null or empty text has no ids; repeated rows give repeated rows; other columns are left out.  Words of more than
    ``LONG_WORD`` bytes take the same merges from a heap, where plain merging would be quadratic.
    """
    return _encoded(docs, ranks_path, pattern, _ids, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id`` and ``text``: the bytes of ``ids``; null ids give a null text."""
    return encoded.select("doc_id", decoded(F.col("ids"), ranks_path).cast("string").alias("text"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the number of ids, a digest of the ids and a digest of the text decoded from them."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, ranks_path, pattern, _digests, schema)
