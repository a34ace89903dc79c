"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue, which starts anew when it ends.  A copy's virtual finish time is
the words of its source up to and with it, divided by the source's target; sorted by that time over all sources, the
queue gives every source its share at every point, and is cut where the total budget ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from formline.session import stored

from .common import WORD
from .ordering import range_slices, running_totals

WEIGHTS = (3, 1, 2)  # of the sources in ascending order, over and over
SHARE = 1.5  # of all words
REPEATS = 2  # times that a document is taken, at most
SEED = "mix"


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, float]:
    """Adds ``target`` to each source (tree, source_size); and the words of all targets.

    Each round shares what the full sources leave by the weights of the others, until no target is above ``repeats``
    times its source.  Only two sums reach the driver in a round, and every round but the last fills a source.
    """
    ordered = running_totals(sources.withColumns({"all": F.lit("all"), "one": F.lit(1)}), ["all"], ["tree"], "one", "mix_sources")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("before") % len(weights)).cast("int"))
    ordered = stored(ordered.select("tree", "source_size", weight.alias("weight"), (repeats * F.col("source_size")).alias("most")), "mix_weights")
    total = ordered.agg(F.sum("source_size")).first()[0] or 0
    budget = min(share * total, float(repeats * total))
    level, full = 0.0, -1
    while True:
        is_full = F.col("most") < F.col("weight") * F.lit(level)
        now = ordered.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("most")).otherwise(0)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if now[0] == full or not now[2]:
            break
        full, level = now[0], (budget - now[1]) / now[2]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    return ordered.select("tree", "source_size", target.alias("target")), budget


def mix(
    docs: DataFrame, *, source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """How many words of each document the mix takes.

    ``doc_id, size, source_size, target, taken``: every row is a document, repeated ones too.  A null text has no words,
    and such documents and sources take nothing; a null source is a source of its own, after the others.  Equal ids
    are ordered by size, rows equal in both in any order.  The copy at which the budget ends is taken in part.  The same
    rows and seed give the same mix.  An empty table gives no rows; other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("-"), F.col(source).cast("string")), F.lit("="))  # '=' sorts after '-'
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    sizes = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("tree"), size.alias("size"), F.monotonically_increasing_id().alias("row")
    )
    sizes = stored(sizes.withColumn("key", shuffle_key(F.col("doc_id"), seed)), "mix_sizes")
    shares, budget = targets(stored(sizes.groupBy("tree").agg(F.sum("size").alias("source_size")), "mix_totals"), weights, share, repeats)
    queue = running_totals(sizes, ["tree"], ["key", "doc_id", "size", "row"], "size", "mix_queue")
    queue = queue.drop("whole", "key").join(shares, "tree")
    copies = queue.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    reached = F.col("copy") * F.col("source_size") + F.col("before") + F.col("size")
    finish = F.when(F.col("target") > 0, reached / F.col("target")).otherwise(F.lit(0.0))
    copies = stored(copies.withColumn("finish", finish), "mix_copies")
    order = ["finish", "tree", "copy", "before", "row"]
    line = range_slices(copies, order, "mix_line")
    # One number per slice: where in the line the budget ends.
    room, last = int(budget), -1
    for r in sorted(line.groupBy("slice").agg(F.sum("size").alias("words")).collect()):
        last = r["slice"]
        if r["words"] > room:
            break
        room -= r["words"]
    inside = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(room) - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.when(F.col("slice") < last, F.col("size")).when(F.col("slice") > last, F.lit(0))
    line = line.withColumn("words", part.otherwise(F.greatest(F.lit(0), F.least(F.col("size"), left))))
    taken = line.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("words").cast("bigint").alias("taken"))
    return taken.drop("row")


def sql() -> str:
    """The same in DuckDB, for documents with distinct ids."""
    weights = f"[{', '.join(map(str, WEIGHTS))}]"
    return f"""
with sizes as (select doc_id, coalesce('-' || source, '=') as tree, md5(concat_ws(':', '{SEED}', doc_id::varchar)) as key,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
sources as (select tree, sum(size)::bigint as source_size,
  {weights}[1 + ((row_number() over (order by tree) - 1) % {len(WEIGHTS)})::int] as weight from sizes group by 1),
ranked as (select *, {REPEATS} * source_size as most, row_number() over (order by {REPEATS} * source_size / weight, tree) as spot from sources),
budget as (select {SHARE} * sum(source_size) as words, sum(weight) as weights from sources),
levels as (select 0 as k, words::double / weights as level from budget
  union all select spot, ((select words from budget) - sum(most) over (order by spot))::double
    / nullif((select weights from budget) - sum(weight) over (order by spot), 0) from ranked),
level as (select level from levels l where k = (select count(*) from ranked r where r.most < r.weight * l.level) order by k limit 1),
shares as (select tree, source_size, least(most::double, weight * (select level from level)) as target from ranked),
queue as (select *, coalesce(sum(size) over (partition by tree order by key, doc_id, size
  rows between unbounded preceding and 1 preceding), 0) as before from sizes),
copies as (select *, case when target > 0 then (copy * source_size + before + size)::double / target else 0.0 end as finish
  from queue join shares using (tree) cross join (select unnest(range({REPEATS})) as copy)),
line as (select *, coalesce(sum(size) over (order by finish, tree, copy, before, doc_id
  rows between unbounded preceding and 1 preceding), 0) as ahead from copies)
select doc_id, size, source_size, target,
  sum(greatest(0, least(size, floor((select words from budget))::bigint - ahead)))::bigint as taken
from line group by tree, doc_id, size, source_size, target"""
