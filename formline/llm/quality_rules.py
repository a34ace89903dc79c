"""Quality rules as a learned decision list.

Sequential covering grows conjunctions of thresholds from labelled statistics, prunes each on labelled rows it was
not grown on, and emits the list as one ordered Spark condition.  All work is DataFrame expressions; the driver sees
counts per feature and bin only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.session import stored

from .common import let, texts, words_of

FEATURES = (
    "n_words", "symbol_share", "repeat_share", "dup_line_share", "word_length", "upper_share", "bang_share", "distinct_share",
)
BINS = 32
MAX_RULES = 12
MAX_CONDITIONS = 3
LEAST_PRECISION = 0.9  # of a rule, on the rows it was not grown on
LEAST_COVER = 3  # bad rows a rule must find among those


def repeated_words(words: Column) -> Column:
    """Words in windows of three that the text holds twice or more; windows compare by a 64-bit hash."""
    none = F.array().cast("array<int>")
    last = F.size(words) - 3
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window))

    def covered(starts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda got, p: F.struct(
            (p + 3).alias("end"), (got["n"] + p + 3 - F.greatest(got["end"], p)).alias("n")
        )
        return F.aggregate(F.sort_array(starts), begin, step, lambda got: got["n"])

    def starts(placed: Column) -> Column:
        """``placed``: the windows with their places, sorted; equal ones are neighbours."""
        same = lambda w, j: F.coalesce(w["h"] == F.get(placed, j)["h"], F.lit(False))
        return F.transform(F.filter(placed, lambda w, j: same(w, j - 1) | same(w, j + 1)), lambda w: w["i"])

    def of(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = F.size(F.array_distinct(found)) < F.size(found)
        return F.when(twice, covered(let(placed, starts))).otherwise(F.lit(0))

    return let(F.coalesce(windows, none.cast("array<bigint>")), of).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """Counts and shares of each whole text: ``doc_id``, the contract's counts, and ``FEATURES``."""
    text = F.col("text")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.concat_ws("", words)).cast("bigint").alias("word_chars"),
            F.size(F.array_distinct(words)).alias("distinct"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines")
        )

    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    found = texts(docs).select(
        "doc_id",
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count(text, F.lit("!")).alias("n_bangs"),
    )
    flat = found.select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_bangs")
    per = lambda part, whole: (F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("double")
    return flat.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("n_symbols", "word_chars").alias("symbol_share"),
        per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("word_chars", "n_words").alias("word_length"),
        per("n_upper", "word_chars").alias("upper_share"),
        per("n_bangs", "n_words").alias("bang_share"),
        per("distinct", "n_words").alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    found = F.lit(True)
    for condition in rule:
        found = found & condition.column()
    return found


def rejected(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that a row meets, else 0."""
    number = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        number = F.when(holds(rule), i).otherwise(number)
    return number


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Cut points per feature: quantiles of all rows and of the bad ones."""
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(
        *[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES],
        *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), shares, 10_000).alias(f"{f}_bad") for f in FEATURES],
    ).first()
    return {f: sorted({float(v) for v in (found[f] or []) + (found[f"{f}_bad"] or [])}) for f in FEATURES}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Bad and good rows per feature and bin, in one grouping."""

    def placed(feature: str) -> Column:
        reached = F.filter(F.array(*map(F.lit, cuts[feature])), lambda c: c <= F.col(feature))
        return F.struct(F.lit(feature).alias("feature"), F.size(reached).alias("bin"))

    bins = [placed(f) for f in FEATURES if cuts[f]]
    out = {f: [(0, 0)] * (len(cuts[f]) + 1) for f in FEATURES}
    if bins:
        counted = rows.select("bad", F.explode(F.array(*bins)).alias("b")).groupBy("b.feature", "b.bin")
        for r in counted.agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect():
            out[r["feature"]][r["bin"]] = (r["bad"], r["good"])
    return out


def _best(counts: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]], bad: int, good: int):
    """The condition of the highest gain in information on the bad rows, if any gains."""
    now, best = math.log2((bad + 1) / (bad + good + 2)), (1e-9, None)
    for f in FEATURES:
        below = [0, 0]
        for cut, (b, g) in zip(cuts[f], counts[f], strict=False):
            below = [below[0] + b, below[1] + g]
            for above in (True, False):
                p, n = (bad - below[0], good - below[1]) if above else below
                gain = p * (math.log2((p + 1) / (p + n + 2)) - now)
                if p and p + n < bad + good and gain > best[0]:
                    best = (gain, (Condition(f, above, cut), p, n))
    return best[1]


def learn(labelled: DataFrame) -> list[Rule]:
    """A decision list from rows with ``FEATURES`` and ``bad`` (1 or 0); empty without bad or without good rows.

    Two thirds of the rows, by a hash of their id, grow a rule; the rest prune it to the prefix of the highest
    (bad - good) / (bad + good), and the list ends with the first rule that is not precise enough there.  All rows
    are used; the driver holds at most 2 * ``BINS`` counts per feature.
    """
    rows = labelled.withColumn("grows", F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2)
    rows = stored(rows.select("bad", "grows", *[F.col(f).cast("double").alias(f) for f in FEATURES]), "labelled")
    cuts = _thresholds(rows.filter("grows"))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = rows.filter(rejected(rules) == 0)
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            counts = _counts(left.filter("grows").filter(holds(rule)), cuts)
            first = next((counts[f] for f in FEATURES if cuts[f]), [(0, 0)])
            bad, good = sum(b for b, _ in first), sum(g for _, g in first)
            found = _best(counts, cuts, bad, good) if bad and good else None
            if not found:
                break
            rule += (found[0],)
        if not rule:
            break
        worth = left.filter("not grows").agg(
            *[F.coalesce(F.sum(F.when(holds(rule[: i + 1]), F.col("bad"))), F.lit(0)).alias(f"b{i}") for i in range(len(rule))],
            *[F.coalesce(F.sum(F.when(holds(rule[: i + 1]), 1)), F.lit(0)).alias(f"n{i}") for i in range(len(rule))],
        ).first()
        size = max(range(len(rule)), key=lambda i: (2 * worth[f"b{i}"] - worth[f"n{i}"]) / max(1, worth[f"n{i}"]))
        bad, n = worth[f"b{size}"], worth[f"n{size}"]
        if bad < LEAST_COVER or bad < LEAST_PRECISION * n:
            break
        rules.append(rule[: size + 1])
    return rules


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document, and ``rule``: the number of the rule that rejects it.

    ``labels``: ``doc_id`` and ``quality`` (1 good, 0 bad; null is no label); of repeated labels the lowest counts.
    Null and empty texts have no words and fail; repeated rows are judged alike; other columns are left out; without
    labels the base checks alone decide.
    """
    stats = stored(statistics(docs), "statistics")
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.join(known, "doc_id").withColumn("bad", F.when(F.col("quality") > 0, 0).otherwise(1))
    rules = learn(labelled)
    few = F.col("n_words") < 50
    failed = few | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (rejected(rules) == 0)).alias("kept"),
        rejected(rules).alias("rule"),
    )
