"""Best-fit packing of token sequences, improved by a swap-based local search.

Documents become pieces of at most ``capacity`` tokens; pieces are packed where they are made, a bounded block at a
time, and the bins that stay underfull are packed once more across blocks.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import new_path

from .common import texts

CAPACITY = 2048
BLOCK = 65_536  # pieces packed together in memory
MEMO = 8_000_000  # characters of words that a task remembers
OPEN_SHARE = 1 / 64  # free share of a bin from which it is packed again across blocks

# Text of these characters is lower-cased and composed alike by every Unicode version.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÿ]*")
PLAIN_TEXT = re.compile(r"[\x20-\x7e\nÀ-ÿ]*")
# The splitting pattern of the tokenizer, a fixed value: 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
# Here for lower-cased plain text, whose letters and digits are these.
TOKEN_WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-zß-öø-ÿ]+")


@functools.cache
def _tokenizer(path: str):
    """The tokenizer, which a worker reads once, and which of its ids end a word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        ends[i] = token.endswith("</w>")
    return tokenizer, ends, tuple(t.content.lower() for t in tokenizer.get_added_tokens_decoder().values())


class WordTokens:
    """Ids (little-endian unsigned 32 bit) of texts, by way of their words, which a task remembers.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its chunks between
    spaces or line ends in a row, and those of a plain text or chunk are those of its words.  A chunk with the name of
    an added token, which the tokenizer takes out before it looks for words, is left to it.
    """

    def __init__(self, path: str):
        self.tokenizer, self.ends, self.added = _tokenizer(path)
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of the words that are new, encoded together."""
        if self.held > MEMO:
            self.words.clear()
            self.held = 0
        fresh = [w for w in words if w not in self.words]
        self.held += sum(map(len, fresh))
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            ids = self._ids(" ".join(part))
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                self.words.update((w, raw[a:b]) for w, a, b in zip(part, [0, *cuts], cuts, strict=False))
            else:
                self.words.update((w, self._ids(w).tobytes()) for w in part)

    def _plain(self, text: str, kind: re.Pattern) -> list[str] | None:
        """The words of a text of plain characters without the name of an added token."""
        if not kind.fullmatch(text):
            return None
        lower = text.lower()
        return None if any(name in lower for name in self.added) else TOKEN_WORD.findall(lower)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        parts: list[tuple[list, bool]] = []  # words, and ids of what is not plain; whether all are words
        seen: set[str] = set()
        for text in texts:
            words = self._plain(text, PLAIN_TEXT)
            plain = words is not None
            if not plain:
                words = []
                for chunk in text.replace("\n", " ").split(" "):
                    own = self._plain(chunk, PLAIN)
                    words += [self._ids(chunk).tobytes()] if own is None else own
            parts.append((words, plain))
            seen.update(words if plain else (w for w in words if type(w) is str))
        self._learn(seen)
        known = self.words
        return [b"".join(map(known.__getitem__, words) if plain else [known[w] if type(w) is str else w for w in words]) for words, plain in parts]


def pieces(docs: list[tuple[int | None, str]], tokens: WordTokens, capacity: int = CAPACITY) -> pd.DataFrame:
    """The documents' token ids, each closed by id 0, cut into pieces of at most ``capacity``."""
    rows, most = [], 4 * capacity
    for at in range(0, len(docs), 200):
        part = docs[at : at + 200]
        for (doc_id, _), ids in zip(part, tokens.encode([t for _, t in part]), strict=True):
            ids += b"\0\0\0\0"
            for k, start in enumerate(range(0, len(ids), most)):
                piece = ids[start : start + most]
                rows.append((doc_id, k, start // 4, len(piece) // 4, zlib.crc32(piece)))
    return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes, longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when a bin with room r exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        if room - size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


class _Underfull:
    """Bins with room, found by the size of a piece they hold (0 for any bin) and their room."""

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size = bins, size
        self.room = [capacity - sum(size[i] for i in b) for b in bins]
        self.at: dict[tuple[int, int], set[int]] = {}
        self.rooms = [0] * (capacity + 1)  # by size: bit r is set when a bin with room r holds a piece of it
        for b in range(len(bins)):
            self.add(b)

    def _keys(self, b: int) -> set[tuple[int, int]]:
        return {(t, self.room[b]) for t in (0, *(self.size[i] for i in self.bins[b]))} if self.bins[b] and self.room[b] else set()

    def add(self, b: int) -> None:
        for t, room in self._keys(b):
            self.at.setdefault((t, room), set()).add(b)
            self.rooms[t] |= 1 << room

    def remove(self, b: int) -> None:
        for t, room in self._keys(b):
            held = self.at[t, room]
            held.remove(b)
            if not held:
                self.rooms[t] ^= 1 << room

    def taker(self, giver: int, t: int, gain: int) -> int | None:
        """The fullest bin that holds a piece of size ``t``, has room for ``gain`` and is not emptier than the giver."""
        most = self.room[giver]
        fitting = (self.rooms[t] & ((2 << most) - 1)) >> gain
        while fitting:
            room = gain + (fitting & -fitting).bit_length() - 1
            for b in self.at[t, room]:
                if b != giver:
                    return b
            fitting &= fitting - 1
        return None

    def widest(self, giver: int) -> int:
        """The largest room of the bins that are not emptier than the giver."""
        most = self.room[giver]
        rooms = self.rooms[0] & ((2 << most) - 1)
        if self.at[0, most] == {giver}:
            rooms ^= 1 << most
        return rooms.bit_length() - 1

    def step(self, giver: int) -> tuple[int, tuple[int, ...], int] | None:
        """The exchange that gains most: the taker, the giver's pieces and the size that comes back (0 for none)."""
        widest = self.widest(giver)
        if widest < 1:
            return None
        mine: dict[int, list[int]] = {}
        for i in self.bins[giver]:
            mine.setdefault(self.size[i], []).append(i)
        best, found = 0, None
        for s, held in mine.items():
            if best < s <= widest and (b := self.taker(giver, 0, s)) is not None:
                best, found = s, (b, (held[0],), 0)
        offers = [(s, (held[0],)) for s, held in mine.items()]
        sizes = sorted(mine)
        for k, x in enumerate(sizes):
            offers += [(x + y, (mine[x][0], mine[y][0])) for y in sizes[:k]]
            offers += [(2 * x, tuple(mine[x][:2]))] if len(mine[x]) > 1 else []
        for s, out in offers:
            # The smallest piece that comes back gains most.
            for t in range(max(1, s - widest), min(s - best, len(self.rooms))):
                if self.rooms[t] >> (s - t) and (b := self.taker(giver, t, s - t)) is not None:
                    best, found = s - t, (b, out, t)
                    break
        return found

    def apply(self, giver: int, taker: int, out: tuple[int, ...], t: int) -> None:
        back = [next(i for i in self.bins[taker] if self.size[i] == t)] if t else []
        gain = sum(self.size[i] for i in out) - t
        self.remove(giver)
        self.remove(taker)
        for b, gone, come in ((giver, out, back), (taker, back, out)):
            self.bins[b] = [i for i in self.bins[b] if i not in gone] + list(come)
        self.room[giver] += gain
        self.room[taker] -= gain
        self.add(giver)
        self.add(taker)


def exchange(bins: list[list[int]], lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Local search over underfull bins.

    Each bin, the emptiest first, gives to bins at least as full: a document moves, one is exchanged for a shorter one,
    or two are exchanged for one shorter than both together.  Passes over all bins end when one changes nothing, or the
    bins are as few as their tokens allow.  Every step raises the sum of squared fills, so that comes; a bin that has
    given everything away is gone.
    """
    size = lengths.tolist()
    left, least = len(bins), -(-sum(size[i] for b in bins for i in b) // capacity)
    if left <= least:
        return bins
    under = _Underfull([list(b) for b in bins], size, capacity)
    changed = True
    while changed and left > least:
        changed = False
        for giver in sorted(range(len(bins)), key=lambda b: -under.room[b]):
            while under.bins[giver] and under.room[giver] and (step := under.step(giver)):
                under.apply(giver, *step)
                changed = True
            if not under.bins[giver] and under.room[giver] == capacity:
                under.room[giver] = 0
                left -= 1
                if left <= least:
                    break
    return [b for b in under.bins if b]


PACKED = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, open boolean"
)


def pack_block(block: pd.DataFrame, first_id: int, capacity: int, search: bool = True) -> pd.DataFrame:
    """``sequence_id``, ``offset`` and whether the sequence is still open, for the pieces of one block."""
    lengths = block["length"].to_numpy(np.int64)
    bins = best_fit(lengths, capacity)
    if search:
        bins = exchange(bins, lengths, capacity)
    order = np.fromiter((i for b in bins for i in b), np.int64, len(lengths))
    counts = np.fromiter(map(len, bins), np.int64, len(bins))
    which = np.repeat(np.arange(len(bins)), counts)
    out = block.iloc[order].copy()
    size = lengths[order]
    ends = np.cumsum(size)
    starts = np.r_[0, ends[np.cumsum(counts)[:-1] - 1]] if len(bins) else ends
    fills = np.bincount(which, size, len(bins))
    out["sequence_id"] = first_id + which
    out["offset"] = ends - size - starts[which]
    out["open"] = (capacity - fills)[which] > capacity * OPEN_SHARE
    return out


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for frame in frames:
        for at in range(0, len(frame), BLOCK):
            held.append(frame.iloc[at : at + BLOCK])
            n += len(held[-1])
            if n >= BLOCK:
                yield pd.concat(held)
                held, n = [], 0
    if held:
        yield pd.concat(held)


def _packer(source, round_: int, capacity: int):
    """Packs the blocks of a partition; ids are unique over rounds, partitions and blocks."""

    def run(items):
        first = (round_ << 60) + (TaskContext.get().partitionId() << 36)
        for block in _blocks(source(items)):
            packed = pack_block(block, first, capacity)
            first += len(block)
            yield pa.RecordBatch.from_pandas(packed[SCHEMA.names], SCHEMA, preserve_index=False)

    return run


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32())]
    + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]
    + [("open", pa.bool_())]
)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the sequence and the offset each is packed at.

    Columns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  A null or empty text is the closing id
    alone; the name of a special token in a text is that token.  Only documents longer than ``capacity`` are cut.  Repeated rows are packed as often as they occur; other
    columns are left out; an empty table gives no rows.

    The first round packs where the tokens are made: no shuffle, a block of ``BLOCK`` pieces in memory.  Its rows are
    stored; the bins left open (a few per block) are dealt out evenly and packed again.
    """
    spark = docs.sparkSession

    def tokenised(batches):
        tokens = WordTokens(tokenizer)  # its words go with the task
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
            yield pieces(rows, tokens, capacity)

    def read(batches):
        for batch in batches:
            yield batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    path = new_path(spark, "packed")
    texts(docs).mapInArrow(_packer(tokenised, 0, capacity), PACKED).write.parquet(path)
    stored = spark.read.schema(PACKED).parquet(path)
    waiting = stored.filter("open").count()
    closed = stored.filter("not open")
    if waiting:
        again = stored.filter("open").repartition(-(-waiting // BLOCK)).mapInArrow(_packer(read, 1, capacity), PACKED)
        closed = closed.unionByName(again)
    return closed.drop("open")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, and the least number of sequences any packing needs."""
    return packed.agg(
        F.countDistinct("sequence_id").alias("n_sequences"),
        F.sum("length").alias("n_tokens"),
        F.ceil(F.sum("length") / capacity).alias("least_sequences"),
    )
