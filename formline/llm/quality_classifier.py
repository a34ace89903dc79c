"""A quality classifier without labels.

Heuristic labellers vote on each text.  Expectation-maximisation over the counts of vote patterns estimates how each
labeller votes on good and on bad documents; the posterior of a document's pattern is its soft label.  The soft labels
train a logistic scorer over hashed word shapes and repetition marks, which judges every document.

Texts are looked at once: their votes and marks are stored, and every step of the fit sums its gradient over the marks
of all documents, so that the model does not depend on how the rows are dealt over partitions.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import stored

from .common import texts

DIMENSIONS = 1 << 14
STEPS = 100  # of the scorer's fit, at most
ENOUGH = 1e-8  # the largest slope of the mean loss at which the fit ends
MOVES = 10  # steps that the next one is shaped by
PENALTY = 1e-4  # on the squared weights
EM_STEPS = 50
REJECT = 0.5  # probability of being bad from which a document is rejected
MEMO = 100_000  # words whose shape a task remembers; none is longer than PIECE
SPAN = 2_000  # words among which distinct ones are counted
PIECE = 64  # characters of a word that make a shape; a longer word has several
SYMBOLS = re.compile(r"[#*$%&|<>{}\\^~=_]")

# What a labeller says: the document is bad, it is good, or nothing.
BAD, GOOD, SILENT = "b", "g", "-"
LABELLERS = (
    "symbols", "symbol_ends", "capitals", "exclaimed", "repeated_windows", "repeated_neighbours", "few_distinct",
    "separators", "repeated_lines", "sentences",
)


@dataclass
class Text:
    """What labellers and scorer see of a text."""

    words: list[str]
    chars: int
    counts: dict[str, float]


def look(text: str) -> Text:
    words = text.split()
    n = max(1, len(words))
    chars = max(1, sum(map(len, words)))
    lines = [line for line in text.split("\n") if line.strip()]
    ids: dict[str, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    windows = (seq[:-2] * 1_000_003 + seq[1:-1]) * 1_000_003 + seq[2:] if len(seq) > 2 else seq[:0]
    _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
    ends = Counter(w[-1] for w in words)
    return Text(
        words,
        chars,
        {
            "symbols": len(SYMBOLS.findall(text)) / chars,
            "symbol_ends": sum(c for e, c in ends.items() if not e.isalnum() and e not in ".,;:!?'\")-") / n,
            "capitals": sum(map(str.isupper, text)) / chars,
            "exclaimed": ends["!"] / n,
            "repeated_windows": float((times[inverse] > 1).mean()) if len(windows) else 0.0,
            "repeated_neighbours": float((seq[1:] == seq[:-1]).mean()) if len(seq) > 1 else 0.0,
            # The mean over consecutive spans, by their words.
            "distinct": len(np.unique(np.arange(len(seq)) // SPAN * len(ids) + seq)) / n,
            "separators": sum(len(w) == 1 and not w.isalnum() for w in words) / n,
            "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
            "stops": sum(ends[e] for e in ".!?") / n,
        },
    )


def _vote(value: float, bad_from: float, good_to: float) -> str:
    return BAD if value >= bad_from else GOOD if value <= good_to else SILENT


def votes(seen: Text) -> str:
    """One letter per labeller; texts too short for a labeller get no vote from it."""
    c, n = seen.counts, len(seen.words)
    long = n >= 20
    return "".join(
        (
            _vote(c["symbols"], 0.06, 0.01),
            _vote(c["symbol_ends"], 0.2, 0.02),
            _vote(c["capitals"], 0.35, 0.12),
            _vote(c["exclaimed"], 0.3, 0.02),
            _vote(c["repeated_windows"], 0.4, 0.1) if long else SILENT,
            _vote(c["repeated_neighbours"], 0.15, 0.03) if long else SILENT,
            _vote(-c["distinct"], -0.2, -0.45) if long else SILENT,
            _vote(c["separators"], 0.15, 0.03) if long else SILENT,
            _vote(c["repeated_lines"], 0.5, 0.1) if long else SILENT,
            (GOOD if 0.02 <= c["stops"] <= 0.4 else SILENT) if long else SILENT,
        )
    )


def fit_labellers(patterns: dict[str, int]) -> dict[str, float]:
    """The probability of being bad of each vote pattern, by expectation-maximisation over the patterns' counts.

    The model: a document is bad with some probability, and where a labeller votes, it is right with an accuracy of its
    own for good and for bad documents; silence says nothing.  It starts from the patterns with any vote for bad.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    onehot = np.array([[(c == BAD, c == GOOD) for c in p] for p in names], float)
    bad = np.where(onehot[:, :, 0].any(axis=1), 0.9, 0.05)
    for _ in range(EM_STEPS):
        weights = np.stack([n * (1 - bad), n * bad])
        prior = weights.sum(axis=1) / weights.sum()
        table = np.einsum("cp,plo->clo", weights, onehot) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(prior + 1e-12)[:, None] + np.einsum("plo,clo->cp", onehot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return dict(zip(names, bad.tolist(), strict=True))


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSIONS


class _Shapes(dict):
    """The slot of the shape of a word, or of a piece of a long one: letters, capitals and digits as classes, runs once, other characters as they are."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word]
        shape = "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])
        slot = self[word] = _slot(f"shape {shape}")
        return slot


def features(seen: Text, shapes: _Shapes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots, rising, and values of a text, of length one."""
    shapes = _Shapes() if shapes is None else shapes
    parts = seen.words
    if any(len(w) > PIECE for w in parts):
        parts = [w[at : at + PIECE] for w in parts for at in range(0, len(w), PIECE)]
    n = max(1, len(parts))
    slots, times = np.unique(np.fromiter(map(shapes.__getitem__, parts), np.int64, len(parts)), return_counts=True)
    marks = [_slot("always")]
    for name in ("repeated_windows", "repeated_neighbours", "repeated_lines", "capitals", "exclaimed", "distinct"):
        marks.append(_slot(f"{name} {min(9, int(10 * seen.counts[name]))}"))
    both = np.concatenate([slots, np.array(marks)])
    values = np.concatenate([np.sqrt(times / n), np.ones(len(marks))])
    values /= np.sqrt((values**2).sum())
    slots, place = np.unique(both, return_inverse=True)
    return slots, np.bincount(place, values)


MARKS = "doc_id bigint, votes string, slots array<int>, marks array<double>"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = _Shapes()  # goes with the task
    for batch in batches:
        said, slots, values = [], [], []
        for text in batch.column("text").to_pylist():
            seen = look(text)
            own, worth = features(seen, shapes)
            said.append(votes(seen))
            slots.append(own.astype(np.int32))
            values.append(worth)
        arrays = [batch.column("doc_id"), pa.array(said, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "votes", "slots", "marks"])


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``votes`` and the scorer's ``slots`` and ``marks`` of every text."""
    return texts(docs).mapInArrow(_marks, MARKS)


def _logits(slots: pa.ListArray, marks: pa.ListArray, weights: np.ndarray) -> np.ndarray:
    """The scorer's logit of each row."""
    if not len(slots):
        return np.zeros(0)
    # No row is empty: every text has the mark that all have.
    parts = weights[slots.flatten().to_numpy()] * marks.flatten().to_numpy()
    return np.add.reduceat(parts, np.r_[0, np.cumsum(slots.value_lengths().to_numpy())[:-1]])


def _chances(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def _slopes(posterior: dict[str, float], weights: np.ndarray):
    """Of a partition: the sum of the scorer's gradient by slot, of its loss (slot -1) and of the rows (slot -2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, loss, n = np.zeros(DIMENSIONS), 0.0, 0
        for batch in batches:
            slots, marks = batch.column("slots"), batch.column("marks")
            bad = np.array([posterior[v] for v in batch.column("votes").to_pylist()])
            logits = _logits(slots, marks, weights)
            wrong = np.repeat(_chances(logits) - bad, slots.value_lengths().to_numpy())
            gradient += np.bincount(slots.flatten().to_numpy(), wrong * marks.flatten().to_numpy(), DIMENSIONS)
            loss += float((np.logaddexp(0, logits) - bad * logits).sum())
            n += len(bad)
        if n:
            used = np.flatnonzero(gradient)
            arrays = [pa.array(np.r_[-2, -1, used], pa.int32()), pa.array(np.r_[n, loss, gradient[used]], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["slot", "total"])

    return run


def fit_scorer(marks: DataFrame, posterior: dict[str, float]) -> np.ndarray:
    """The weights of the logistic scorer: each document counts as bad with its posterior and as good with the rest.

    Each step sums the gradient over all documents; the steps are those of limited-memory BFGS, whose few vectors of
    ``DIMENSIONS`` numbers the driver holds.  The loss is convex: where the steps end does not depend on partitions.
    """
    weights = np.zeros(DIMENSIONS)
    if not posterior:
        return weights

    def slope(at: np.ndarray) -> tuple[float, np.ndarray]:
        parts = marks.select("votes", "slots", "marks").mapInArrow(_slopes(posterior, at), "slot int, total double")
        found = {r["slot"]: r["total"] for r in parts.groupBy("slot").agg(F.sum("total").alias("total")).collect()}
        n, loss = found.pop(-2), found.pop(-1)
        gradient = PENALTY * at
        gradient[list(found)] += np.array(list(found.values())) / n
        return loss / n + PENALTY / 2 * (at @ at), gradient

    loss, gradient = slope(weights)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(gradient).max() < ENOUGH:
            break
        way, shares = gradient.copy(), []
        for moved, turned in reversed(moves):
            shares.append((moved @ way) / (moved @ turned))
            way -= shares[-1] * turned
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 4.0
        for (moved, turned), share in zip(moves, reversed(shares), strict=True):
            way += moved * (share - (turned @ way) / (moved @ turned))
        length = 1.0
        while True:
            ahead = weights - length * way
            new_loss, new_gradient = slope(ahead)
            if new_loss <= loss - 1e-4 * length * (gradient @ way):
                break
            length /= 2
            if length < 1e-3:  # rounding is all that is left
                return weights
        moves = [*moves, (ahead - weights, new_gradient - gradient)][-MOVES:]
        weights, loss, gradient = ahead, new_loss, new_gradient
    return weights


def _score(posterior: dict[str, float], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = _chances(_logits(batch.column("slots"), batch.column("marks"), weights))
            weak = [posterior.get(v, 0.0) for v in batch.column("votes").to_pylist()]
            arrays = [batch.column("doc_id"), batch.column("votes"), pa.array(weak, pa.float64()), pa.array(chances)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "votes", "weak_bad", "score_bad"])

    return run


@dataclass
class QualityModel:
    posterior: dict[str, float]
    weights: np.ndarray

    def score(self, marks: DataFrame) -> DataFrame:
        return marks.mapInArrow(
            _score(self.posterior, self.weights), "doc_id bigint, votes string, weak_bad double, score_bad double"
        )

    def keep(self, docs: DataFrame) -> DataFrame:
        """The documents, all columns, that the scorer does not reject; those with a null text count as empty."""
        weights = self.weights

        def good(text: str | None, shapes: _Shapes) -> bool:
            slots, values = features(look(text or ""), shapes)
            return 1 / (1 + np.exp(-np.clip((weights[slots] * values).sum(), -50, 50))) < REJECT

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shapes = _Shapes()
            for batch in batches:
                at = batch.schema.get_field_index("text")
                kept = [good(t, shapes) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(kept, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)


def fit_marks(marks: DataFrame) -> QualityModel:
    """Fit labellers and scorer on the stored marks of all documents.

    The driver holds the counts of vote patterns (at most three to the number of labellers) and ``DIMENSIONS`` weights.
    """
    counted = marks.groupBy("votes").agg(F.count("*").alias("n"))
    posterior = fit_labellers({r["votes"]: r["n"] for r in counted.collect()})
    return QualityModel(posterior, fit_scorer(marks, posterior))


def fit(docs: DataFrame) -> QualityModel:
    """Fit labellers and scorer on all documents."""
    return fit_marks(stored(marked(docs), "quality_marks"))


def classify(docs: DataFrame) -> DataFrame:
    """``doc_id``, the labellers' ``votes``, ``weak_bad`` (their posterior), ``score_bad`` (the scorer) and ``kept``.

    A null text counts as empty; the labellers are silent on it.  Repeated rows are judged alike; other columns are
    left out; an empty table gives no rows.  Long texts are seen whole; equal votes have equal posteriors.
    """
    marks = stored(marked(docs), "quality_marks")
    return fit_marks(marks).score(marks).withColumn("kept", F.col("score_bad") < REJECT)
