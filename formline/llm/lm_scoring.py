"""Language-model scoring by a hidden Markov model.

Frequent words are symbols of their own from the start; the others first share classes, from which they are drawn by
their counts.  Baum-Welch passes over all training documents gather expected counts in every partition, which Spark
sums.  The last pass unties the classes: it gathers the expected counts of every training word in every state, a table
that grows with the vocabulary, and each word gets emissions of its own.  The scaled forward recursion gives a text's
exact likelihood.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import stored

from .common import texts

STATES = 8
OWN = 16_384  # most frequent words, symbols of their own in all passes; others get emissions of their own in the last
KNOWN = 262_144  # most frequent words, at most, whose counts every task holds; others' counts are joined
CLASSES = 256
STEPS = 6  # Baum-Welch passes, that which unties the classes included
PADDED = 1_000_000  # tokens, padding included, of the documents that are scored together
FLUSH = 400_000  # distinct words a task counts before it hands them on
PRIOR = 10.0  # weight of the symbols' overall shares in each state
WORD_PRIOR = 10.0  # weight of a class's states in those of its words


def word_class(word: bytes) -> int:
    """The class of a word: by its length and its last bytes."""
    return (min(len(word), 15) * 16 + zlib.crc32(word[-2:]) % 16) % CLASSES


def _lines(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, and the number of documents under the null word."""
    found: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
        )

    for batch in batches:
        lines = _lines(batch)
        found[None] += len(lines)
        for line in lines:
            found.update(line.lower().split())
            if len(found) > FLUSH:
                yield rows()
                found.clear()
    if found:
        yield rows()


def word_counts(train: DataFrame) -> DataFrame:
    """``word, c``: the counts of all words, and of document ends under the null word."""
    return train.mapInArrow(_count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [word_class(w) for w in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), batch.column("c")], ["kind", "c"])


@dataclass
class Lexicon:
    """What every task knows of the words; all sizes are bounded by ``KNOWN`` and ``CLASSES``."""

    words: list[bytes]
    counts: np.ndarray  # of the words
    own: int  # so many of them are symbols of their own
    total: int  # training tokens
    ends: int
    distinct: int
    kinds: np.ndarray  # classes of the words that are not symbols of their own
    class_total: np.ndarray  # log10 of the smoothed total of each class
    shares: np.ndarray  # of the symbols: own words, classes, the end

    @property
    def symbols(self) -> int:
        return len(self.shares)

    @property
    def band(self) -> int:
        """How many known words are not symbols of their own."""
        return len(self.words) - self.own


def known_words(words: DataFrame, most: int) -> list:
    """At most ``most`` rows ``word, c``, the most frequent first, equal counts by word; whole steps of equal counts.

    The cut is found on the steps' sizes, so only rows above it travel.  The step that would exceed ``most`` is left
    out with all below, unless fewer than ``OWN`` are above it: then its first words, by word, make up ``OWN``.
    """
    steps = words.groupBy("c").agg(F.count("*").alias("v"))
    # Steps are counted together from the first power of two on that holds too many, so few rows reach the driver.
    rough = {r["p"]: r["v"] for r in steps.groupBy((F.length(F.bin("c")) - 1).alias("p")).agg(F.sum("v").alias("v")).collect()}
    above, low = 0, 0
    for power in sorted(rough, reverse=True):
        if above + rough[power] > most:
            low = 2 ** (power + 1)
            within = steps.filter(F.col("c").between(2**power, low - 1)).orderBy(F.desc("c")).collect()
            for step in within:
                if above + step["v"] > most:
                    break
                above, low = above + step["v"], step["c"]
            break
        above += rough[power]
    top = words.filter(F.col("c") >= low).collect()
    if low and above < OWN:
        top += words.filter(F.col("c") < low).orderBy(F.desc("c"), "word").limit(OWN - above).collect()
    return sorted(top, key=lambda r: (-r["c"], bytes(r["word"])))


def build_lexicon(counts: DataFrame) -> Lexicon:
    """The most frequent words by (count, word), and the totals of the classes of all others."""
    summed = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = counts.filter("word is null").agg(F.sum("c").alias("n")).first()["n"] or 0
    words = counts.filter("word is not null")
    top = known_words(words, KNOWN)
    known = [bytes(r["word"]) for r in top]
    sizes = np.array([r["c"] for r in top], np.int64)
    own = min(OWN, len(known))
    total, types = np.zeros(CLASSES), np.zeros(CLASSES)
    kinds = words.mapInArrow(_classes, "kind int, c bigint").groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    for r in kinds.collect():
        total[r["kind"]], types[r["kind"]] = r["n"], r["v"]
    for w, c in zip(known[:own], sizes[:own].tolist(), strict=True):
        total[word_class(w)] -= c
        types[word_class(w)] -= 1
    shares = np.r_[sizes[:own], total, ends] + 0.5
    band = np.array([word_class(w) for w in known[own:]], np.int64)
    class_total = np.log10(total + 0.5 * (types + 1))
    return Lexicon(known, sizes, own, summed["n"] or 0, ends, summed["v"], band, class_total, shares / shares.sum())


class _Places(dict):
    """The number of a word: its rank among the known ones, or the end of those plus its class."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.n = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.n + word_class(word)


def _encode(shared):
    """Each document as symbols, with the sums that its known words give and its other words to be looked up.

    ``spots`` tells which words stand behind the symbols that are classes: the known ones by rank, then ``rare``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        places, n = _Places(lex.words), len(lex.words)
        symbol = np.r_[np.arange(lex.own), lex.own + lex.kinds, lex.own + np.arange(CLASSES)].astype("<u2")
        logs = np.r_[np.log10(lex.counts + 0.5), np.zeros(CLASSES)]
        inside = np.r_[np.zeros(lex.own), logs[lex.own : n] - lex.class_total[lex.kinds], -lex.class_total]
        end = np.array([lex.symbols - 1], "<u2")
        for batch in batches:
            out: list[tuple] = []
            for line in _lines(batch):
                words = line.lower().split()
                at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                rare = np.flatnonzero(at >= n)
                place: dict[bytes, int] = {}
                local = np.array([place.setdefault(words[i], len(place)) for i in rare.tolist()], np.int64)
                spots = at - lex.own
                spots[rare] = lex.band + local
                others = zip(place, np.bincount(local).tolist(), strict=True)
                out.append(
                    (
                        len(words) + 1,
                        len(words) - len(rare) + (lex.ends > 0),
                        float(logs[at].sum() + np.log10(lex.ends + 0.5)),
                        float(inside[at].sum()),
                        np.r_[symbol[at], end].tobytes(),
                        spots[at >= lex.own].astype("<u4").tobytes(),
                        [{"word": w, "n": k} for w, k in others],
                    )
                )
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds_ = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), RARE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *[pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)]],
                ["doc_id", "held_out", "n_tokens", "n_known", "logs", "inside", "symbols", "spots", "rare"],
            )

    return run


RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
ENCODED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, inside double, symbols binary, "
    "spots binary, rare array<struct<word:binary,n:bigint>>"
)


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    def single(self) -> Hmm:
        return Hmm(*(a.astype(np.float32) for a in (self.start, self.move, self.emit)))


def first_guess(shares: np.ndarray, states: int, seed: int = 7) -> Hmm:
    """The symbols' shares in every state, disturbed, and states that tend to stay."""
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * rng.uniform(0.5, 1.5, (len(shares), states))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Hmm(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _groups(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of like length, longest first: their numbers, lengths, and symbols as a padded (time, document) table."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    at = 0
    while at < len(order):
        longest = len(docs[order[at]])
        some = order[at : at + max(1, PADDED // longest)]
        sizes = np.array([len(docs[i]) for i in some])
        padded = np.zeros((longest, len(some)), np.int64)
        for k, i in enumerate(some):
            padded[: sizes[k], k] = docs[i]
        yield some, sizes, padded
        at += len(some)


def forward(model: Hmm, sizes: np.ndarray, symbols: np.ndarray, keep: bool = False):
    """The natural log-likelihood of each document; with ``keep`` also the scaled alphas and the scales.

    ``sizes`` fall, so the documents still running at a time are the first ones.
    """
    steps, n = symbols.shape
    running = np.searchsorted(-sizes, -np.arange(steps), "left")
    log = np.zeros(n)
    alphas = np.zeros((steps, n, len(model.start)), model.emit.dtype) if keep else None
    scales = np.ones((steps, n), model.emit.dtype) if keep else None
    alpha = None
    for t in range(steps):
        k = running[t]
        seen = model.emit[symbols[t, :k]]
        alpha = (model.start if t == 0 else alpha[:k] @ model.move) * seen
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        log[:k] += np.log(scale)
        if keep:
            alphas[t, :k], scales[t, :k] = alpha, scale
    return (log, alphas, scales, running) if keep else log


def expected(model: Hmm, sizes: np.ndarray, symbols: np.ndarray, counts: list[np.ndarray]) -> float:
    """Adds the expected starts, moves and emissions of the documents to ``counts``; their log-likelihood."""
    log, alphas, scales, running = forward(model, sizes, symbols, keep=True)
    steps, n = symbols.shape
    start, move, emit = counts
    beta = np.ones((n, len(model.start)), model.emit.dtype)
    moved = np.zeros_like(move)
    for t in range(steps - 1, -1, -1):
        k = running[t]
        if t + 1 < steps and (m := running[t + 1]):
            ahead = model.emit[symbols[t + 1, :m]] * beta[:m] / scales[t + 1, :m, None]
            moved += alphas[t, :m].T @ ahead
            beta[:m] = ahead @ model.move.T
        alphas[t, :k] *= beta[:k]  # now the states' probabilities
    move += model.move * moved
    start += alphas[0].sum(axis=0)
    live = np.arange(steps)[:, None] < sizes[None, :]
    flat, shown = alphas[live], symbols[live]
    for s in range(len(model.start)):
        emit[:, s] += np.bincount(shown, flat[:, s], len(emit))
    return float(log.sum())


def _rows_of(keys: np.ndarray, values: np.ndarray, words: pa.Array, c: np.ndarray) -> pa.RecordBatch:
    states = [f"s{s}" for s in range(values.shape[1])]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), words, pa.array(c, pa.int64()), *map(pa.array, np.ascontiguousarray(values.T))],
        ["key", "word", "c", *states],
    )


def _count_columns(states: int) -> list[str]:
    return ["c", *[f"s{s}" for s in range(states)]]


def _expect(shared, lexicon=None):
    """Expected counts ``key, word, c, s0...``: of the log-likelihood, the starts, the moves and the symbols.

    With the lexicon the classes are untied: known words follow the symbols, and each other word has rows of its own,
    under the key of its class, with the times it occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = shared.value.single()
        lex: Lexicon | None = lexicon.value if lexicon else None
        states = len(model.start)
        if lex:
            model = Hmm(model.start, model.move, np.vstack([model.emit, model.emit[lex.own + lex.kinds]]))
        fixed = len(model.emit)
        total = [np.zeros(states), np.zeros((states, states)), np.zeros((fixed, states))]
        log, seen = 0.0, False
        for batch in batches:
            docs = [np.frombuffer(s, "<u2") for s in batch.column("symbols").to_pylist()]
            seen |= bool(docs)
            now, counts = model, total
            if lex:
                words = batch.column("words").flatten().dictionary_encode()
                docs, kinds = _untied(docs, batch, lex, words.indices.to_numpy(), len(words.dictionary))
                now = Hmm(model.start, model.move, np.vstack([model.emit, model.emit[lex.own + kinds]]))
                counts = [total[0], total[1], np.zeros((len(now.emit), states))]
            for _, sizes, symbols in _groups(docs):
                log += expected(now, sizes, symbols, counts)
            if lex:
                total[2] += counts[2][:fixed]
                if len(kinds):
                    times = np.bincount(np.concatenate(docs), minlength=len(now.emit))[fixed:]
                    yield _rows_of(lex.own + kinds, counts[2][fixed:], words.dictionary, times)
        if seen:
            used = np.flatnonzero(total[2].any(axis=1))
            first = np.r_[log, np.zeros(states - 1)]
            values = np.vstack([first, total[0], total[1], total[2][used]])
            keys = np.r_[np.arange(-2 - states, 0), used]
            yield _rows_of(keys, values, pa.nulls(len(keys), pa.binary()), np.zeros(len(keys), np.int64))

    return run


def _untied(docs: list[np.ndarray], batch: pa.RecordBatch, lex: Lexicon, number: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The documents with the words behind their classes: the known ones after the symbols, then the batch's others.

    ``number`` gives the numbers, below ``size``, of all documents' other words, one after the other; also their classes.
    """
    kinds = np.zeros(size, np.int64)
    out, at = [], 0
    for doc, spots, n in zip(docs, batch.column("spots").to_pylist(), batch.column("others").to_pylist(), strict=True):
        where = np.frombuffer(spots, "<u4").astype(np.int64)
        classed = np.flatnonzero((doc >= lex.own) & (doc < lex.symbols - 1))
        other = where >= lex.band
        mine = number[at : at + n][where[other] - lex.band]
        kinds[mine] = doc[classed[other]] - lex.own
        where[other] = lex.band + mine
        doc = doc.astype(np.int32)
        doc[classed] = lex.symbols + where
        out.append(doc)
        at += n
    return out, kinds


@dataclass
class Emissions:
    """How the words of a class lean to the states; ``lift`` is a word's share of its class in a state, over that at all."""

    lean: np.ndarray  # classes x states: the states' shares in a class
    scale: np.ndarray  # classes x states: what the lifted shares of a class add up to
    known: np.ndarray  # lifts of the known words that are not symbols of their own

    def lift(self, kinds: np.ndarray, c: np.ndarray, found: np.ndarray) -> np.ndarray:
        lean = self.lean[kinds]
        return (found + WORD_PRIOR * lean) / ((c[:, None] + WORD_PRIOR) * lean) / self.scale[kinds]


def untie(lex: Lexicon, band: np.ndarray, rare: dict[int, tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, Emissions]:
    """The classes' expected counts, and the emissions of their words.

    ``band`` are the expected counts of the known words; ``rare`` are, by class, the sums over all other words of their
    expected counts, and of these and of 1 weighted by (c + 0.5) / (c + WORD_PRIOR).
    """
    states = band.shape[1]
    c = lex.counts[lex.own :].astype(float)
    weight = (c + 0.5) / (c + WORD_PRIOR)
    sums, leaning, plain = np.zeros((CLASSES, states)), np.zeros((CLASSES, states)), np.zeros(CLASSES)
    np.add.at(sums, lex.kinds, band)
    np.add.at(leaning, lex.kinds, band * weight[:, None])
    np.add.at(plain, lex.kinds, weight)
    for kind, (found, weighted, weights) in rare.items():
        sums[kind] += found
        leaning[kind] += weighted
        plain[kind] += weights
    lean = (sums + 0.1) / (sums + 0.1).sum(axis=1, keepdims=True)
    scale = (leaning / lean + WORD_PRIOR * plain[:, None] + 0.5) / 10 ** lex.class_total[:, None]
    out = Emissions(lean, scale, np.zeros((0, states)))
    out.known = out.lift(lex.kinds, c, band)
    return sums, out


def train(encoded: DataFrame, lex: Lexicon, states: int = STATES, steps: int = STEPS) -> tuple[Hmm, list[float], Emissions, DataFrame]:
    """Baum-Welch over all rows, the last step untied.

    Returns the model, the log-likelihood (natural) before each step, the emissions of the classes' words, and the table
    ``key, word, c, s0...`` of the expected counts of the words that not every task knows.
    """
    spark = encoded.sparkSession
    model, logs = first_guess(lex.shares, states), []
    columns = _count_columns(states)
    schema = "key int, word binary, c bigint, " + ", ".join(f"{c} double" for c in columns[1:])
    sums = [F.sum(c).alias(c) for c in columns]
    lexicon = spark.sparkContext.broadcast(lex)
    none = np.zeros((lex.band, states))
    emissions, rare = untie(lex, none, {})[1], spark.createDataFrame([], schema)
    for step in range(steps):
        shared = spark.sparkContext.broadcast(model)
        if last := step == steps - 1:
            parts = encoded.select("symbols", "spots", F.col("rare.word").alias("words"), F.size("rare").alias("others")).mapInArrow(_expect(shared, lexicon), schema)
            parts = stored(parts.groupBy("key", "word").agg(*sums), "expected")
            rare, parts = parts.filter("word is not null"), parts.filter("word is null")
        else:
            parts = encoded.select("symbols").mapInArrow(_expect(shared), schema).groupBy("key").agg(*sums)
        # Keys are bounded: states, symbols and known words.
        rows = parts.select("key", *columns[1:]).toArrow()
        if not rows.num_rows:
            break
        keys = rows.column("key").to_numpy()
        values = np.column_stack([rows.column(c).to_numpy() for c in columns[1:]])
        table = np.zeros((2 + states + lex.symbols + lex.band, states))
        table[keys + 2 + states] = values
        logs.append(float(table[0, 0]))
        start, move, found = table[1] + 0.1, table[2 : 2 + states] + 0.1, table[2 + states :]
        if last:
            weight = (F.col("c") + 0.5) / (F.col("c") + WORD_PRIOR)
            weighted = [F.sum(weight * F.col(c)).alias(f"w_{c}") for c in columns[1:]]
            by_class = rare.groupBy("key").agg(*sums[1:], *weighted, F.sum(weight).alias("w")).collect()
            of_rare = {r["key"] - lex.own: (np.array(r[1 : 1 + states]), np.array(r[1 + states : -1]), r["w"]) for r in by_class}
            classes, emissions = untie(lex, found[lex.symbols :], of_rare)
            found[lex.own : lex.own + CLASSES] += classes
        emit = PRIOR * lex.shares[:, None] + found[: lex.symbols]
        model = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model, logs, emissions, rare


def _likelihoods(shared, lexicon, emissions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lex, words = shared.value, lexicon.value, emissions.value
        fixed = np.vstack([model.emit, model.emit[lex.own + lex.kinds] * words.known])
        states = len(model.start)
        for batch in batches:
            docs = [np.frombuffer(s, "<u2") for s in batch.column("symbols").to_pylist()]
            sizes = batch.column("others").to_numpy()
            n = int(sizes.sum())
            docs, kinds = _untied(docs, batch, lex, np.arange(n), n)
            found, c = np.zeros((n, states)), np.zeros(n)
            rows = batch.column("found").flatten()
            brought = pc.fill_null(pc.list_value_length(batch.column("found")), 0).to_numpy()
            at = np.repeat(np.cumsum(sizes) - sizes, brought) + rows.field("at").to_numpy()
            found[at] = rows.field("s").flatten().to_numpy().reshape(-1, states)
            c[at] = rows.field("c").to_numpy()
            own = model.emit[lex.own + kinds] * words.lift(kinds, c, found)
            full = Hmm(model.start, model.move, np.vstack([fixed, own]))
            out = np.zeros(len(docs))
            for some, sizes, symbols in _groups(docs):
                out[some] = forward(full, sizes, symbols)
            kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "inside", "rare_logs", "rare_known"]
            yield pa.RecordBatch.from_arrays([*[batch.column(f) for f in kept], pa.array(out / np.log(10))], [*kept, "likelihood"])

    return run


def score_texts(docs: DataFrame, states: int = STATES, steps: int = STEPS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Words are lower-cased (A-Z) runs without ASCII white space, then one end.  A document is held out if the CRC-32 of
    its id as text leaves 1 modulo 5; the others train.  ``base_score`` is the smoothed unigram's, ``score`` the
    model's log10 probability, in which every training word has emissions of its own.  A very long text is scored whole, in
memory that grows with its words.  A null or empty text is the end alone; a null id counts as the empty text and trains;
    repeated rows train and score as often as they occur; without training documents every word is unknown; an empty
    table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    rows = texts(docs).withColumn("held_out", rest == 1)
    counts = stored(word_counts(rows.filter("not held_out").select("text")), "word_counts")
    lex = build_lexicon(counts)
    encoded = rows.mapInArrow(_encode(spark.sparkContext.broadcast(lex)), ENCODED)
    encoded = stored(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    model, _, emissions, counted = train(encoded.filter("not held_out"), lex, states, steps)
    # What a document's other words bring travels to it: as many rows as it has such words.
    counted = counted.select("word", "c", F.array(*[F.col(f"s{s}").cast("float") for s in range(states)]).alias("s"))
    rare = encoded.select("row", F.posexplode("rare").alias("at", "r")).select("row", "at", "r.word", "r.n")
    rare = rare.join(counted, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.collect_list(F.when(F.col("c") > 0, F.struct("at", "c", "s"))).alias("found"),
    )
    shared = [spark.sparkContext.broadcast(x) for x in (model, lex, emissions)]
    out = encoded.withColumn("others", F.size("rare")).drop("rare").join(rare, "row", "left").mapInArrow(
        _likelihoods(*shared),
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, inside double, "
        "rare_logs double, rare_known bigint, likelihood double",
    ).withColumn("rare_logs", F.coalesce("rare_logs", F.lit(0.0)))
    base = float(np.log10(lex.total + 0.5 * (lex.distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("likelihood") + F.col("inside") + F.col("rare_logs")).alias("score"),
    )
