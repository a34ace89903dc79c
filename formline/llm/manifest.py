"""A Merkle manifest of a dataset: a digest for every row, one root for all, and a proof that ties each row to it.

Nodes of a level are numbered; consecutive runs of ``fanout`` have a parent.  Conditional aggregates spread each
parent's children into slot columns: hashing the columns in a row gives the parent, leaving the own slot column out
gives a node's siblings.  Levels are climbed in bands of up to 1,024 nodes a block: a block needs one exchange for all
the levels of its band, and the next band has one node per block.  Siblings come down again by one join per band.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.session import stored

from .ordering import running_totals

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = 1024  # nodes of a block, at most


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read alike; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _levels(fanout: int, block: int) -> int:
    levels = 1
    while fanout ** (levels + 1) <= block:
        levels += 1
    return levels


def _climb(nodes: DataFrame, fanout: int, block: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``path`` and what ``finish`` says of a tree's last node to every node (tree, place, size, digest, ...).

    ``path`` lists, from the lowest level up, the digests before and after the node's own in its run.
    ``finish`` is given the last node of each tree (tree, place, digest) and adds a ``path`` and other columns.
    """
    levels = _levels(fanout, block)
    slot = lambda k: f"_slot{k}"
    width = lambda k: F.ceil(F.col("size") / fanout**k)
    rows = nodes.withColumn("_block", F.floor(F.col("place") / fanout**levels))
    rows = rows.withColumns({slot(k): (F.floor(F.col("place") / fanout**k) % fanout).cast("int") for k in range(levels)})
    rows = rows.repartition("tree", "_block").withColumn("_top", F.col("digest"))
    for k in range(levels):
        # Outer slots first: every level's runs are then in the order that the lowest level is sorted by.
        run = Window.partitionBy("tree", "_block", *[slot(j) for j in range(levels - 1, k, -1)])
        child = [f"_child{s}" for s in range(fanout)]
        rows = rows.withColumns({c: F.max(F.when(F.col(slot(k)) == s, F.col("_top"))).over(run) for s, c in enumerate(child)})
        many = width(k) > 1
        before = F.concat_ws("", *[F.when(F.col(slot(k)) > s, F.col(c)) for s, c in enumerate(child)])
        after = F.concat_ws("", *[F.when(F.col(slot(k)) < s, F.col(c)) for s, c in enumerate(child)])
        rows = rows.withColumns(
            {
                f"_step{k}": F.when(many, F.struct(before.alias("before"), after.alias("after"))),
                "_top": F.when(many, F.sha2(F.concat_ws("", *child), 256)).otherwise(F.col("_top")),
            }
        ).drop(*child)
    steps = F.filter(F.array(*[f"_step{k}" for k in range(levels)]), lambda s: s.isNotNull())
    rows = rows.select(*nodes.columns, "_block", "_top", steps.alias("_steps"))
    band = stored(rows, "merkle_band")
    parents = band.groupBy("tree", F.col("_block").alias("place")).agg(
        F.max(F.ceil(F.col("size") / fanout**levels)).alias("size"), F.max("_top").alias("digest")
    )
    parents = stored(parents, "merkle_parents")
    if parents.filter("size > 1").isEmpty():
        above = finish(parents.drop("size"))
    else:
        above = _climb(parents, fanout, block, finish).drop("size")
    above = above.drop("digest").withColumnRenamed("place", "_block")
    joined = band.join(above, ["tree", "_block"])
    own = [c for c in above.columns if c not in ("tree", "_block", "path")]
    return joined.select(*nodes.columns, F.concat("_steps", "path").alias("path"), *own)


def _no_steps() -> Column:
    return F.array().cast("array<struct<before:string,after:string>>")


def manifest(
    docs: DataFrame, *, fields: Sequence[str] = FIELDS, group: str = "lang", claims: dict[str, Column] | None = None,
    fanout: int = 2, block: int = BLOCK,
) -> DataFrame:
    """A tree over the rows of each group, and one over the groups' roots.

    Returns ``doc_id, leaf, subroot, root, path`` and a leaf ``claimed`` of values that ``claims`` puts in place of
    fields.  Rows of a group ascend by doc_id, a null id first, then by leaf; rows that are equal in all fields are
    leaves of their own, in any order.  Groups ascend bytewise, null first.  A null field is marked as such, which no
    empty text is.  An empty table has no root and gives no rows; other columns are not read.
    """
    values = {c: F.col(c) for c in fields}
    told = values | (claims or {})
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # '-' sorts before '='
    leaves = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("tree"), leaf(list(values.values())).alias("leaf"),
        leaf(list(told.values())).alias("claimed"), F.monotonically_increasing_id().alias("row"), F.lit(1).alias("one"),
    )
    leaves = stored(leaves, "merkle_leaves")
    placed = running_totals(leaves, ["tree"], ["doc_id", "leaf", "row"], "one", "merkle_places")
    nodes = placed.select("tree", F.col("before").alias("place"), F.col("whole").alias("size"), F.col("leaf").alias("digest"), "doc_id", "claimed")

    def crown(subroots: DataFrame) -> DataFrame:
        """The tree over the groups; every group's last node is told its way to the root."""
        named = subroots.select(F.col("tree").alias("name"), "digest", F.lit("all").alias("tree"), F.lit(1).alias("one"))
        ordered = running_totals(named, ["tree"], ["name"], "one", "merkle_groups")
        tops = ordered.select("tree", F.col("before").alias("place"), F.col("whole").alias("size"), "digest", "name")
        last = lambda rows: rows.withColumns({"root": F.col("digest"), "path": _no_steps()})
        way = _climb(tops, fanout, block, last)
        return way.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("place"), "digest", F.col("digest").alias("subroot"), "root", "path")

    found = _climb(nodes, fanout, block, crown)
    return found.select("doc_id", F.col("digest").alias("leaf"), "claimed", "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def tampered(doc_id: Column, n_chars: Column) -> Column:
    """``n_chars``, one more where 7 divides the checksum of the id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, n_chars + 1).otherwise(n_chars)


def proofs(docs: DataFrame) -> DataFrame:
    """Every row's proof, and whether the row as tampered with still leads to the root.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``; odd rows as in ``manifest``.
    """
    found = manifest(docs, claims={"n_chars": tampered(F.col("doc_id"), F.col("n_chars"))})
    siblings = F.transform("path", lambda step: F.concat(step["before"], step["after"]))
    found = found.withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", siblings), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def sql(levels: int = 24, crown_levels: int = 8) -> str:
    """The same in DuckDB, for up to ``2 ** levels`` rows of a group and ``2 ** crown_levels`` groups."""
    text = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    row = lambda n: "sha256(" + " || ".join(text(n if c == "n_chars" else c) for c in FIELDS) + ")"
    table = ["t0 as (select range::bigint as b, range::bigint as c from range(256))"]
    table += [
        f"t{i} as (select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from t{i - 1})"
        for i in range(1, 9)
    ]

    def climbs(name: str, n: int, keep: str) -> list[str]:
        out = []
        for k in range(1, n + 1):
            out.append(f"""{name}{k} as materialized (select {keep}, place, size,
  case when many then sha256(coalesce(a, '') || coalesce(b, '')) else digest end as digest,
  case when not many then claim when slot = 0 then sha256(claim || coalesce(b, '')) else sha256(a || claim) end as claim,
  case when not many then proof when slot = 0 then proof || coalesce(b, '') else proof || a end as proof
  from (select *, (size + {2 ** (k - 1) - 1}) // {2 ** (k - 1)} > 1 as many, (place // {2 ** (k - 1)}) % 2 as slot,
    max(case when (place // {2 ** (k - 1)}) % 2 = 0 then digest end) over run as a,
    max(case when (place // {2 ** (k - 1)}) % 2 = 1 then digest end) over run as b
    from {name}{k - 1} window run as (partition by tree, place // {2**k})))""")
        return out

    ctes = [
        *table,
        """codes as (select distinct doc_id, doc_id::varchar as rest, 4294967295::bigint as c from documents where doc_id is not null
  union all select codes.doc_id, substr(rest, 2), xor(codes.c >> 8, t8.c)
  from codes join t8 on t8.b = xor(codes.c & 255, ascii(rest)) where rest <> '')""",
        "checksums as (select doc_id, xor(c, 4294967295) as crc from codes where rest = '')",
        f"""leaves as (select d.doc_id, coalesce('=' || lang, '-') as tree, {row('n_chars')} as leaf, {row('told')} as claimed
  from (select documents.*, case when crc % 7 = 0 then n_chars + 1 else n_chars end as told
    from documents left join checksums using (doc_id)) d)""",
        """g0 as materialized (select doc_id, leaf, tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place,
  count(*) over (partition by tree) as size, leaf as digest, claimed as claim, '' as proof from leaves)""",
        *climbs("g", levels, "doc_id, leaf, tree"),
        f"""tops as (select tree as name, any_value(digest) as digest from g{levels} group by 1)""",
        """r0 as materialized (select 'all' as tree, name, row_number() over (order by name) - 1 as place,
  count(*) over () as size, digest, '' as claim, '' as proof from tops)""",
        *climbs("r", crown_levels, "tree, name"),
    ]
    # A claimed subroot climbs on beside the groups' own.
    steps = [f"q0 as (select g.*, r0.place as spot, r0.size as width, g.digest as subroot from g{levels} g join r0 on r0.name = g.tree)"]
    for k in range(1, crown_levels + 1):
        half = 2 ** (k - 1)
        steps.append(f"""q{k} as (select q.* exclude (claim, proof),
  case when (width + {half - 1}) // {half} <= 1 then claim when (spot // {half}) % 2 = 0 then sha256(claim || coalesce(o.digest, ''))
    else sha256(o.digest || claim) end as claim,
  case when (width + {half - 1}) // {half} <= 1 then q.proof else q.proof || coalesce(o.digest, '') end as proof
  from q{k - 1} q left join (select distinct place // {half} as node, digest from r{k - 1}) o on o.node = xor(q.spot // {half}, 1))""")
    return f"""
with recursive {', '.join([*ctes, *steps])}
select doc_id, leaf, subroot, (select any_value(digest) from r{crown_levels}) as root, sha256(proof) as proof_sha256,
  claim as folded_root, claim = (select any_value(digest) from r{crown_levels}) as verified from q{crown_levels}"""
