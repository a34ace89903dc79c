"""The filter audit, the manifest and the mix against brute force, on odd rows and on the smallest tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm.conftest import CLASHING, SCHEMA
from pyspark.sql import functions as F

from formline.llm import filter_audit, manifest, mixing, ordering

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id bigint, quality int, toxic int"
NAMES = [*CLASHING, "words", "bits", "part", "mark", "tree", "slice", "size", "row", "before", "whole", "copy", "finish", "path", "digest", "_block"]


@pytest.fixture
def odd_rows(odd):
    """Odd texts under odd ids, languages and sources; repeated rows; a text of five megabytes."""
    langs, sources = ["en", None, "", "de", "en", "é"], [None, "b", "a", "", "b", "ü", "b"]
    rows = [(i, t, langs[k % 6], sources[k % 7], None if k % 5 == 4 else k) for k, (i, t) in enumerate(odd)]
    many = [(100 + i, f"Copy of ONE text # {i % 3}", "en", "b", 7) for i in range(40)]
    return [*rows, *rows[:4], *many, (99, "word of a long text " * 250_000, "en", "long", 1), (-5, "x" * 300, None, None, None)]


@pytest.fixture(params=["odd", "table"])
def rows(request, odd_rows, spark, sf):
    if request.param == "odd":
        return odd_rows
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


def frame(spark, rows, extra=NAMES):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.selectExpr("*", *[f"'x' as `{c}`" for c in extra]).repartition(5)


def test_running_totals_over_a_hot_key(spark):
    rows = spark.range(0, 20_000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("k"), F.col("id") % 11)).otherwise("hot").alias("key"), "id", (F.col("id") % 5).alias("n")
    )
    got = ordering.running_totals(rows, ["key"], ["id"], "n", "test").collect()
    sums = Counter()
    for r in sorted(got, key=lambda r: r["id"]):
        assert r["before"] == sums[r["key"]]
        sums[r["key"]] += r["n"]
    assert len(got) == 20_000 and all(r["whole"] == sums[r["key"]] for r in got)


def failed(rows, row):
    doc_id, text = row[0], row[1] or ""
    words = WORD.findall(text)
    out = {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
    out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
    return out | ({"E"} if doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows) else set())


def test_audit_equals_running_every_order(spark, rows):
    labels = [(r[0], k % 3, (k + 1) % 2) for k, r in enumerate(rows) if k % 2] + [(None, 1, 1), (0, 1, None), (0, None, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = [(r[3] or "", r[0], failed(rows, r)) for r in rows]
    want = {}
    shapley = Counter()
    for part in {p for p, _, _ in fails}:
        docs = [(i, f) for p, i, f in fails if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, letter in enumerate(order, 1):
                out = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                fail = [d for d in docs if letter in d[1]]
                shapley[part, letter] += len(out)
                want[part, order, step] = (
                    len(left), len(out), len(fail) - len(out), sum(d[1] == {letter} for d in docs),
                    sum(d[0] in good for d in out), sum(d[0] in toxic for d in out),
                )
    got = filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(want)
    for r in got:
        key = r["part"], r["filter_order"], r["step"]
        assert tuple(r)[3:] == (*want[key], shapley[key[0], key[1][key[2] - 1]])


def test_audit_without_labels_or_rows(spark, make):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(make([]), none).count() == 0
    got = filter_audit.audit(make([None]), none).filter("step = 1 and filter_order = 'ABCDE'").collect()
    assert [tuple(r)[3:] for r in got] == [(0, 1, 0, 1, 0, 0, 120)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(digests, fanout=2):
    """The root and each leaf's steps, a level at a time."""
    at, steps = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        runs = [digests[i : i + fanout] for i in range(0, len(digests), fanout)]
        for i, node in enumerate(at):
            run, slot = runs[node // fanout], node % fanout
            steps[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[i] = node // fanout
        digests = [sha(*run) for run in runs]
    return digests[0], steps


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 4), (3, 9), (5, 5)])
def test_manifest_equals_a_tree_built_in_a_loop(spark, rows, fanout, block):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        told = n_chars + 1 if n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else n_chars
        own, other = leaf_of([doc_id, source, lang, n_chars, text]), leaf_of([doc_id, source, lang, told, text])
        groups[lang].append(((doc_id is not None, doc_id or 0, own), own, other))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([leaf for _, leaf, _ in sorted(groups[g])], fanout) for g in names}
    root, crown = tree_of([trees[g][0] for g in names], fanout)
    want = Counter()
    for g, upper in zip(names, crown, strict=True):
        for (key, own, other), steps in zip(sorted(groups[g]), trees[g][1], strict=True):
            path = steps + upper
            node = other
            for before, after in path:
                node = sha(before, node, after)
            doc_id = key[1] if key[0] else None
            want[doc_id, own, trees[g][0], root, sha(*[b + a for b, a in path]), node, node == root] += 1
    docs = frame(spark, rows)
    if (fanout, block) == (2, 1024):
        got = manifest.proofs(docs)
    else:
        claims = {"n_chars": manifest.tampered(F.col("doc_id"), F.col("n_chars"))}
        got = manifest.manifest(docs, claims=claims, fanout=fanout, block=block)
        way = F.concat_ws("", F.transform("path", lambda s: F.concat(s["before"], s["after"])))
        got = got.withColumn("folded_root", manifest.folded(F.col("claimed"), F.col("path")))
        got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(way, 256), "folded_root", F.col("folded_root") == F.col("root"))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {v for *_, v in want} == {True, False}


def test_manifest_of_few_rows(spark, make):
    assert manifest.proofs(make([])).count() == 0
    (one,) = manifest.proofs(make([(1, "a")])).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha() and one["verified"]
    # A null is not an empty text, and bytes cannot move from one field to the next.
    texts = spark.createDataFrame([(1, None, "e", "s", 1), (1, "", "e", "s", 1), (1, "", "es", "", 1), (1, "", "", "es", 1)], SCHEMA)
    assert manifest.proofs(texts).select("leaf").distinct().count() == 4


def shares_of(sizes, share=1.5, repeats=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > repeats * sizes[s]}
        for s in full or open_:
            target[s] = repeats * sizes[s] if full else weight[s] * level
        open_ -= full or set(open_)
        left -= sum(target[s] for s in full)
    return target


def test_mix_meets_targets_and_equals_a_plain_queue(spark, rows):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    target = shares_of({r[3]: total[r[3]] for r in rows})
    line = []
    for s in target:
        key = lambda k: (hashlib.md5(":".join(["mix", *([] if rows[k][0] is None else [str(rows[k][0])])]).encode()).hexdigest(), size[k])
        mine, at = sorted((k for k in range(len(rows)) if rows[k][3] == s), key=key), 0
        for copy in range(2):
            for place, k in enumerate(mine):
                at += size[k]
                line.append((at / target[s] if target[s] else 0, s is None, s or "", copy, place, k))
    left, taken = int(1.5 * sum(size)), Counter()
    for *_, k in sorted(line):
        took = min(size[k], left)
        taken[k] += took
        left -= took
    assert left == 0
    want = Counter((rows[k][0], size[k], total[rows[k][3]], taken[k]) for k in range(len(rows)))
    got = mixing.mix(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got) == want
    by_source = defaultdict(set)
    for r in got:
        by_source[r["source_size"]].add(round(r["target"], 6))
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert by_source == {n: {round(target[s], 6) for s in target if total[s] == n} for n in set(total.values())}
    for s in target:
        took = sum(taken[k] for k in range(len(rows)) if rows[k][3] == s)
        longest = max(size[k] for k in range(len(rows)))
        assert abs(took - target[s]) <= longest


def test_mix_reruns_agree_and_need_no_words(spark, make, odd_rows, sf):
    docs = frame(spark, odd_rows)
    once, again = (Counter(map(tuple, mixing.mix(docs.repartition(n)).collect())) for n in (3, 8))
    assert once == again
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Counter(map(tuple, mixing.mix(docs, seed="other").collect())) != Counter(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mix(make([])).count() == 0
    assert sorted(tuple(r) for r in mixing.mix(make([None, " "])).collect()) == [(0, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 0, "b": 4}, {"a": 7}, {f"s{i:02}": 3 ** (i % 6) for i in range(20)}])
def test_targets_refill_until_none_is_above(spark, sizes):
    sources = spark.createDataFrame([("=" if s is None else "-" + s, n) for s, n in sizes.items()], "tree string, source_size bigint")
    got, budget = mixing.targets(sources)
    want = shares_of(sizes)
    assert {r["tree"]: round(r["target"], 6) for r in got.collect()} == {"=" if s is None else "-" + s: round(t, 6) for s, t in want.items()}
    assert budget == pytest.approx(sum(want.values()))
