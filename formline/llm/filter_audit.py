"""What filters take from a corpus in every order: which failures they share, and what each is worth.

Four filters judge a text alone.  The fifth fails a text that a smaller doc_id holds too: a left-semi join on hash,
exact text and smaller doc_id, whose other side is one row per text with the smallest id that holds it, so that a
group of copies of any size meets one row.  The ids it marks are united with those that fail the other filters, and
the bits of each document are added up to combinations.  Everything after that works on at most 32 counts per part.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, words_of

LETTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
SYMBOLS = "[#$%&*|]"


def text_failures(docs: DataFrame) -> DataFrame:
    """``docs`` with ``bits``: which of the filters A to D its ``text`` fails."""
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.translate("text", UPPER, ""))
    fails = {
        "A": words < 50,
        "B": 100 * distinct < 65 * words,
        "C": 100 * capitals > 5 * F.length("text"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    bits = sum((F.when(fail, F.lit(BIT[letter])).otherwise(F.lit(0)) for letter, fail in fails.items()), F.lit(0))
    return docs.withColumn("words", words_of(F.col("text"))).withColumn("bits", bits).drop("words")


def later_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, mark, text, ...) whose text a smaller doc_id holds; ``mark`` is a hash of the text."""
    known = docs.filter("doc_id is not null")
    holders = known.groupBy("mark", "text").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    holders = holders.filter("first_id < last_id").withColumnsRenamed({"mark": "held_mark", "text": "held_text"})
    same = (F.col("mark") == F.col("held_mark")) & (F.col("text") == F.col("held_text"))
    return known.join(holders, same & (F.col("first_id") < F.col("doc_id")), "left_semi")


def combinations(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, bits, n, good, toxic``: documents of each part by the filters they fail, and how many are labelled so."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("mark", F.xxhash64("text"))
    key = ["doc_id", "part", "mark"]
    others = text_failures(rows).select(*key, "bits", F.lit(1).alias("n"))
    copies = later_copies(rows).select(*key, F.lit(BIT["E"]).alias("bits"), F.lit(0).alias("n"))
    marked = others.unionByName(copies).groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    known = known.agg(is_one("quality").alias("is_good"), is_one("toxic").alias("is_toxic"))
    marked = marked.join(known, "doc_id", "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return marked.groupBy("part", "bits").agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def _steps() -> Column:
    """Every step of every order, as one folded literal of fixed size."""
    steps = []
    for order in itertools.permutations(LETTERS):
        prior = 0
        for i, letter in enumerate(order, 1):
            steps.append({"filter_order": "".join(order), "step": i, "own": BIT[letter], "prior": prior})
            prior |= BIT[letter]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,prior:int>>")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; counts of the part's documents.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.  A null text
    counts as empty, a null part as the empty string.  Every row of ``docs`` counts, repeated ones too; rows without an
    id are never copies of, nor copied by, others, and rows of equal id and text are not copies of one another.  A
    document is good or toxic if any label with its id says so.  An empty table gives no rows; other columns are not read.
    """
    counts = combinations(docs, labels, part)
    counts = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("counts"))
    steps = counts.select("part", "counts", F.explode(_steps()).alias("at")).select("part", "counts", "at.*")

    def total(field: str, here) -> Column:
        return F.aggregate(F.filter("counts", lambda c: here(c["bits"])), F.lit(0).cast("bigint"), lambda sum_, c: sum_ + c[field])

    own, prior, none = F.col("own"), F.col("prior"), F.lit(0)
    fails = lambda bits: bits.bitwiseAND(own) != none
    removed = lambda bits: fails(bits) & (bits.bitwiseAND(prior) == none)
    # Of the orders, an equal share puts each of a combination's filters before its others.
    orders = math.factorial(len(LETTERS))
    worth = F.aggregate(
        F.filter("counts", lambda c: fails(c["bits"])), F.lit(0).cast("bigint"),
        lambda sum_, c: sum_ + c["n"] * (F.lit(orders) / F.bit_count(c["bits"])).cast("bigint"),
    )
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda bits: bits.bitwiseAND(prior.bitwiseOR(own)) == none).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda bits: fails(bits) & (bits.bitwiseAND(prior) != none)).alias("redundant"),
        total("n", lambda bits: bits == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        worth.alias("shapley"),
    )


def sql() -> str:
    """The same in DuckDB, for documents with distinct ids."""
    orders = " cross join ".join(f"(select unnest(string_split('A,B,C,D,E', ',')) as {c})" for c in "vwxyz")
    differ = " and ".join(f"{a} <> {b}" for a, b in itertools.combinations("vwxyz", 2))
    removed = "c.bits & s.own <> 0 and c.bits & s.prior = 0"
    return f"""
with docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
marked as (select doc_id, part, (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::int
  + 8 * regexp_matches(text, '{SYMBOLS}')::int + 16 * (doc_id > min(doc_id) over (partition by text))::int as bits from docs),
known as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
counts as (select part, bits, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from marked left join known using (doc_id) group by 1, 2),
orders as (select v || w || x || y || z as filter_order from {orders} where {differ}),
letters as (select filter_order, unnest(range(1, 6))::int as step from orders),
steps as (select filter_order, step, (1 << (ascii(filter_order[step]) - 65)) as own,
  list_sum([0] || [1 << (ascii(filter_order[j]) - 65) for j in range(1, step)])::int as prior from letters)
select part, filter_order, step,
  sum(case when c.bits & (s.prior | s.own) = 0 then n else 0 end)::bigint as kept,
  sum(case when {removed} then n else 0 end)::bigint as removed,
  sum(case when c.bits & s.own <> 0 and c.bits & s.prior <> 0 then n else 0 end)::bigint as redundant,
  sum(case when c.bits = s.own then n else 0 end)::bigint as unique_fails,
  sum(case when {removed} then good else 0 end)::bigint as good_lost,
  sum(case when {removed} then toxic else 0 end)::bigint as toxic_lost,
  sum(case when c.bits & s.own <> 0 then n * 120 // bit_count(c.bits::int) else 0 end)::bigint as shapley
from counts c cross join steps s group by 1, 2, 3"""
