"""I-Match fingerprints: terms of a document-frequency band, sorted, hashed within randomised subsets of the lexicon.

Everything is a DataFrame expression.  The lexicon is a literal: terms that at least a share ``LEAST`` of the
documents hold number at most (mean distinct terms of a document) / ``LEAST``, however many documents there are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.session import stored

from .common import let, lower_ascii, texts, words_of

LEAST, MOST = 0.001, 0.1  # shares of documents between which a term's frequency lies
SUBSETS = 128
BUCKETS = 4096  # of the literal lexicon
BLOCK_BITS = 10  # ids that share all but so many low bits are ordered together


def terms_of(text: Column) -> Column:
    return F.array_distinct(words_of(lower_ascii(text)))


def subset_of(term: Column) -> Column:
    """The randomised subset a term belongs to."""
    return (F.conv(F.substring(F.md5(term), 1, 6), 16, 10).cast("int") % SUBSETS).cast("int")


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """``term, df, subset`` of the terms whose document frequency lies in the band, over all documents.

    A term of one document alone is never in it: it cannot tell two documents to be alike.
    """
    n = docs.count()
    counts = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counts.filter((F.col("df") >= max(2.0, least * n)) & (F.col("df") <= most * n))
    return band.withColumn("subset", subset_of(F.col("term")))


def literal(terms: DataFrame) -> Column:
    """The lexicon as one folded literal: buckets of term to subset."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for r in terms.select("term", "subset", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("bucket")).collect():
        buckets[r["bucket"]][r["term"]] = r["subset"]
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def hashes(text: Column, lexicon_: Column) -> Column:
    """The hash of each subset's terms in ``text``, empty where it has none."""

    def of(lexicon_: Column) -> Column:
        member = lambda t: F.struct(
            F.get(lexicon_, F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))[t].alias("subset"), t.alias("term")
        )
        known = F.filter(F.transform(terms_of(text), member), lambda m: m["subset"].isNotNull())
        return let(F.sort_array(known), by_subset)

    def by_subset(known: Column) -> Column:
        def one(subset: Column) -> Column:
            terms = F.concat_ws(" ", F.transform(F.filter(known, lambda m: m["subset"] == subset), lambda m: m["term"]))
            return let(terms, lambda t: F.when(t == "", F.lit("")).otherwise(F.substring(F.md5(t), 1, 8)))

        return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one)

    return let(lexicon_, of)


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets hashed alike among those that either text has terms of; 1 where neither has any."""
    some = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != "") | (y != "")), lambda x: x))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != "") & (x == y)), lambda x: x))
    return F.when(some == 0, F.lit(1.0)).otherwise(same / some)


def _next_heads(rows: DataFrame) -> DataFrame:
    """``block, next_id``: the first id after each block of ids, the very first after the last.

    Blocks are looked up level by level, so that no task sees more than 2 ** ``BLOCK_BITS`` of them.
    """
    level = rows.groupBy(F.shiftright("doc_id", BLOCK_BITS).alias("block")).agg(F.min("doc_id").alias("head"))
    level = stored(level, "heads")
    ends = level.agg(F.min("head").alias("first"), F.min("block").alias("low"), F.max("block").alias("high")).first()
    blocks = level.withColumnRenamed("block", "key")
    answers: list[DataFrame] = []
    low, high = ends["low"], ends["high"]
    while low is not None and low != high:
        group = Window.partitionBy(F.shiftright("key", BLOCK_BITS)).orderBy("key")
        answers.append(blocks.select(F.col("key"), F.lead("head").over(group).alias("next")))
        blocks = blocks.groupBy(F.shiftright("key", BLOCK_BITS).alias("key")).agg(F.min("head").alias("head"))
        low, high = low >> BLOCK_BITS, high >> BLOCK_BITS
    found = level.select("block", F.lit(None).cast("bigint").alias("next"))
    for i, answer in enumerate(answers):
        at = F.shiftright("block", i * BLOCK_BITS) if i else F.col("block")
        found = found.withColumn("key", at).join(answer.withColumnRenamed("next", "own"), "key", "left")
        found = found.select("block", F.coalesce("next", "own").alias("next"))
    return found.select("block", F.coalesce("next", F.lit(ends["first"])).alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is replaced by the start of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  The next document is
    the next in ascending (doc_id, text), the first after the last; rows without an id follow one another and are
    followed by the first of the others.  A null text counts as empty; texts without a term of the lexicon have an
    empty fingerprint, and two such are alike by 1; an empty table gives no rows; other columns are left out.
    """
    rows = texts(docs)
    lex = literal(lexicon(rows))
    heads = stored(_next_heads(rows.filter("doc_id is not null")), "next_heads")
    head_text = rows.join(heads.withColumnRenamed("next_id", "doc_id"), "doc_id").groupBy("block").agg(F.min("text").alias("head_text"))
    head_text = stored(head_text, "head_texts")
    in_block = Window.partitionBy("block").orderBy("doc_id", "text")
    block = F.shiftright("doc_id", BLOCK_BITS)
    own = rows.select("doc_id", "text", block.alias("block"))
    # Only the text travels: its marks are made behind the exchange that both windows share.
    own = own.withColumn("following", F.lead("text").over(in_block)).withColumn("own", hashes(F.col("text"), lex))
    own = own.withColumn("next_marks", F.lead("own").over(in_block)).join(head_text, "block", "left")
    own = own.select(
        "doc_id", "text", "own", "next_marks",
        F.coalesce("following", "head_text", F.lit("")).alias("next_text"), F.length("text").cast("bigint").alias("n_chars"),
    )
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.substring("next_text", F.lit(1), half))
    marked = own.withColumn("edited", edited)
    marked = marked.select(
        "doc_id", "n_chars", "own", F.sha2("edited", 256).alias("edited_sha256"), hashes(F.col("edited"), lex).alias("edited_marks"),
        F.when(F.col("next_marks").isNull(), hashes(F.col("next_text"), lex)).otherwise(F.col("next_marks")).alias("next_marks"),
    )
    return marked.select(
        "doc_id", "n_chars", "edited_sha256",
        F.concat_ws("-", "own").alias("fingerprint"),
        F.concat_ws("-", "edited_marks").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_marks")).alias("near_next"),
    )


def sql() -> str:
    """The same in DuckDB, for documents with distinct ids."""
    terms = (
        "list_distinct(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[^\\x20\\x09-\\x0D]+'))"
    )

    def marks(name: str, text: str, source: str) -> str:
        return f"""
{name}_terms as (select doc_id, unnest({terms.format(text)}) as term from {source}),
{name}_hashes as (select doc_id, subset, substr(md5(string_agg(term, ' ' order by term)), 1, 8) as mark
  from {name}_terms join lexicon using (term) group by all),
{name} as (select d.doc_id, list(coalesce(mark, '') order by g.subset) as marks
  from docs d cross join subsets g left join {name}_hashes h on h.doc_id = d.doc_id and h.subset = g.subset group by 1)"""

    near = """case when len(list_filter(list_zip({0}, {1}), lambda z: z[1] <> '' or z[2] <> '')) = 0 then 1.0::double
      else len(list_filter(list_zip({0}, {1}), lambda z: z[1] <> '' and z[1] = z[2]))::double
        / len(list_filter(list_zip({0}, {1}), lambda z: z[1] <> '' or z[2] <> '')) end"""
    return f"""
with docs as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
subsets as (select unnest(range({SUBSETS})) as subset),
following as (select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next_text,
  coalesce(lead(doc_id) over (order by doc_id), first_value(doc_id) over (order by doc_id)) as next_id from docs),
edits as (select doc_id, n, next_id, left(text, n - n // 2) || left(next_text, n // 2) as edited from following),
counted as (select term, count(*) as df from (select unnest({terms.format('text')}) as term from docs) group by 1),
lexicon as (select term, (('0x' || substr(md5(term), 1, 6))::int % {SUBSETS})::int as subset from counted
  where df >= greatest(2, {LEAST} * (select count(*) from docs)) and df <= {MOST} * (select count(*) from docs)),
{marks('own', 'text', 'docs')},
{marks('changed', 'edited', 'edits')}
select e.doc_id, e.n::bigint as n_chars, sha256(edited) as edited_sha256, array_to_string(o.marks, '-') as fingerprint,
  array_to_string(c.marks, '-') as edited_fingerprint, {near.format('o.marks', 'c.marks')} as near_edited,
  {near.format('o.marks', 'x.marks')} as near_next
from edits e join own o on o.doc_id = e.doc_id join changed c on c.doc_id = e.doc_id join own x on x.doc_id = e.next_id"""
