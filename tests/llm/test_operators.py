"""The text operators against brute force, on odd rows and on the smallest tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm.conftest import CLASHING
from pyspark.sql import functions as F

from formline.llm import byte_bpe, fingerprints, line_dedup, lm_scoring, near_dup, packing, pii, quality_classifier, quality_rules
from formline.llm import suffix_dedup
from formline.llm.queries import BYTE_RANKS, WORD_TOKENIZER
from formline.session import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(params=["odd", "table"])
def docs(request, spark, sf, make, odd):
    return make(odd, CLASHING) if request.param == "odd" else documents(spark, sf).limit(60)


def grouped(rows, key="doc_id"):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_packing_keeps_every_token(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_TOKENIZER)
    want = Counter()
    for doc_id, text in rows_of(docs):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack_documents(docs, WORD_TOKENIZER).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for rows in grouped(got, "sequence_id").values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_ids_equal_the_library_on_special_names_and_odd_signs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_TOKENIZER)
    texts = [
        "hello <|endoftext|> world", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext|", "", " \n ",
        "Plain words, and it's they'll 12 3.5\nnext LINE", "tab\tand\rothers\x0b", "naïve É ß\u0130stanbul e\u0301 \u2026 日本", "x" * 5000, "'s 's'S",
    ]
    assert t.encode(texts[0], add_special_tokens=False).ids == [3306, 49407, 1002]
    tokens = packing.WordTokens(WORD_TOKENIZER)
    for _ in range(2):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in tokens.encode(texts)]
        assert got == [t.encode(text, add_special_tokens=False).ids for text in texts]
        tokens.held = packing.MEMO + 1


def test_local_search_never_loses_and_helps():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 1400, 120)
        bins = packing.best_fit(lengths)
        better = packing.exchange([list(b) for b in bins], lengths)
        assert sorted(i for b in better for i in b) == list(range(120))
        assert max(sum(lengths[i] for i in b) for b in better) <= 2048
        assert math.ceil(lengths.sum() / 2048) <= len(better) <= len(bins)
    lengths = np.array([1024, 1000, 600, 424, 1024, 24])
    assert len(packing.exchange([[0, 1, 5], [2, 3, 4]], lengths)) == 2
    # A move, a one-for-one and a two-for-one exchange empty a bin that best fit leaves.
    assert len(packing.exchange([[0], [1], [2]], np.array([1500, 500, 500]))) == 2


def gains(giver, taker, size, room):
    """What the exchanges of two bins would fill the taker by, by trying all."""
    outs = [(i,) for i in giver] + [(i, j) for i in giver for j in giver if i < j]
    moved = [sum(size[i] for i in o) - back for o in outs for back in ([0] if len(o) == 1 else []) + [size[i] for i in taker]]
    return [g for g in moved if 0 < g <= room]


def test_local_search_ends_where_no_two_bins_have_an_exchange():
    """Pieces that nothing can be done with lead the order, more than a few bins behind them can be improved."""
    rng = np.random.default_rng(4)
    behind = np.repeat([690, 680, 678], 90)
    cases = [np.r_[np.repeat(1379, 70), behind], rng.integers(500, 1400, 150), rng.integers(1, 1500, 150), rng.integers(600, 720, 200)]
    for lengths in cases:
        bins = packing.best_fit(lengths)
        better = packing.exchange([list(b) for b in bins], lengths)
        assert sorted(i for b in better for i in b) == list(range(len(lengths)))
        rooms = [2048 - int(sum(lengths[i] for i in b)) for b in better]
        assert min(rooms) >= 0 and len(better) <= len(bins)
        if len(better) > math.ceil(lengths.sum() / 2048):
            for x, giver in enumerate(better):
                for y, taker in enumerate(better):
                    assert x == y or rooms[x] < rooms[y] or not gains(giver, taker, lengths.tolist(), rooms[y])
        if lengths is cases[0]:
            assert len(bins) == 70 + 45 + 30 + 30 and len(better) <= 70 + 102


def test_byte_bpe_equals_the_library(docs):
    import tiktoken

    with open(BYTE_RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, text in rows_of(docs):
        ids = e.encode_ordinary(text)
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = byte_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN).collect()
    assert Counter(tuple(r) for r in got) == want


def test_byte_bpe_round_trip_in_spark(make, odd):
    docs = make(odd)
    back = byte_bpe.decode(byte_bpe.encode(docs, BYTE_RANKS, public_tokenizers.PATTERN), BYTE_RANKS)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows_of(docs))


def test_heap_merges_equal_plain_merges():
    ranks = byte_bpe.ranks_of(BYTE_RANKS)
    rng = np.random.default_rng(1)
    for _ in range(50):
        word = bytes(rng.choice(list(b"abcetho "), 60).tolist())
        assert byte_bpe.merge_long(word, ranks) == byte_bpe.merge_parts(word, ranks)


def test_long_words_are_decoded_from_their_ids(monkeypatch):
    numbering = byte_bpe._Numbering(byte_bpe.pattern_of(public_tokenizers.PATTERN), BYTE_RANKS)
    word = "abcdefg" * 200
    assert numbering.block([1], [word]).column("long")[0].as_py()[0]["decoded"] == word.encode()
    ranks = byte_bpe.ranks_of(BYTE_RANKS)
    monkeypatch.setattr(byte_bpe, "merge_long", lambda word, _: [ranks[b"x"], ranks[b"y"]])
    assert numbering.block([1], ["b" * 1_001]).column("long")[0].as_py()[0]["decoded"] == b"xy"


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns(docs):
    want = Counter((d, tuple(base_spans(t))) for d, t in rows_of(docs))
    got = pii.find_personal_data(docs).collect()
    only = lambda r: tuple(tuple(s) for s in r["spans"] if s["kind"] in pii.BASE)
    assert Counter((r["doc_id"], only(r)) for r in got) == want


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_on_random_texts(seed):
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(list("aZ0123456789@@..--++ ()%\n"), 400))
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == base_spans(text)


def test_masks_and_added_kinds():
    text = "see https://u.example.org/x?y=1, password=b7db7aa4a5fcc78305 or token = \"24be64439e3e\" iban DE89 3704 0044 0532 0130 00."
    assert [s[0] for s in pii.spans(text)] == ["account", "secret", "secret", "url"]
    assert pii.masked(text, pii.spans(text)).startswith('see <URL>, password=<SECRET> or token = "<SECRET>" iban <ACCOUNT>')


def shingles(text, width):
    words = text.encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def components_of(texts, width, percent):
    ids = sorted(texts)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(texts[i], width) for i in ids}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = documents(spark, sf)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    assert got == components_of(dict(rows_of(docs)), 3, 85)


def test_a_cloud_of_near_copies(make):
    """Copies with a growing number of edits: many lists stay open after the first round."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(120):
        words = list(base)
        for at in rng.choice(150, k % 14, replace=False):
            words[at] = f"e{rng.integers(40)}"
        texts.append(" ".join(words))
    docs = make(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    assert got == components_of(dict(enumerate(texts)), 3, 85)


def test_near_duplicates_of_odd_rows(make, odd):
    got = grouped(near_dup.near_duplicates(make(odd, CLASHING)).collect())
    assert len(got[None]) == 2 and all(r["kept"] for r in got[None])
    assert [r["kept"] for r in got[3]] == [False] and got[3][0]["component_id"] == 0
    assert got[2][0]["n_shingles"] == 0 and got[2][0]["kept"]
    assert near_dup.near_duplicates(make([])).count() == 0


def test_statistics_equal_brute_force(docs):
    want = Counter()
    for doc_id, text in rows_of(docs):
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        symbols = sum(c in "#*$%&|<>" for c in text)
        want[doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)] += 1
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter(tuple(r) for r in quality_rules.statistics(docs).select(columns).collect()) == want


def test_decision_list_finds_bad_documents_it_has_not_seen(spark, sf):
    big = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    train = labels.filter("doc_id % 2 = 0")
    found = quality_rules.judge(documents(spark, big), train).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    right = found.filter("(quality = 0) = (rule > 0)").count() / found.count()
    assert right > 0.9
    assert found.filter("quality = 1 and rule > 0").count() <= 0.01 * found.count()
    assert quality_rules.learn(spark.createDataFrame([], "doc_id long, bad int, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))) == []


def test_judging_odd_rows(make, odd, spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(make(odd, CLASHING), labels).count() == len(odd)
    assert quality_rules.judge(make([]), labels).count() == 0


def test_weak_labels_find_bad_documents(spark, sf):
    big = sf.replace("0.001", "0.01")
    found = quality_classifier.classify(documents(spark, big)).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    n = found.count()
    assert found.filter("(quality = 1) = kept").count() / n > 0.97
    assert found.filter("quality = 1 and not kept").count() <= 0.01 * n


def test_scores_do_not_depend_on_partitions(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, labels = documents(spark, big), spark.read.parquet(f"{big}/labels.parquet")
    bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    scores = []
    for n in (1, 8, 211):
        got = {r["doc_id"]: r for r in quality_classifier.classify(docs.repartition(n)).collect()}
        scores.append(np.array([got[i]["score_bad"] for i in sorted(got)]))
        assert sum(got[i]["kept"] for i in bad) <= 0.03 * len(bad)
    assert max(np.abs(s - scores[0]).max() for s in scores) < 1e-6


def test_labellers_and_scorer_equal_plain_loops(spark, make, sf):
    """Expectation-maximisation document by document, and the gradient of the scorer's loss, which must vanish."""
    docs = documents(spark, sf)
    marks = quality_classifier.marked(docs).cache()
    rows = marks.collect()
    model = quality_classifier.fit_marks(marks)
    said = [r["votes"] for r in rows]
    bad = [0.9 if "b" in v else 0.05 for v in said]
    for _ in range(quality_classifier.EM_STEPS):
        prior, right = [0.0, 0.0], defaultdict(lambda: 0.1)
        for v, p in zip(said, bad, strict=True):
            for c, w in ((0, 1 - p), (1, p)):
                prior[c] += w
                for place, vote in enumerate(v):
                    right[c, place, vote] += w
        old, bad = bad, []
        for v in said:
            like = [prior[c] / len(said) for c in (0, 1)]
            for c in (0, 1):
                for place, vote in enumerate(v):
                    if vote != "-":
                        like[c] *= right[c, place, vote] / (right[c, place, "b"] + right[c, place, "g"])
            bad.append(like[1] / sum(like))
        if max(abs(a - b) for a, b in zip(old, bad, strict=True)) < 1e-9:
            break
    assert np.allclose([model.posterior[v] for v in said], bad, atol=1e-6)
    gradient = np.zeros(quality_classifier.DIMENSIONS)
    for r in rows:
        slots, values = np.array(r["slots"]), np.array(r["marks"])
        assert abs((values**2).sum() - 1) < 0.2 and (np.diff(slots) > 0).all()
        chance = 1 / (1 + math.exp(-(model.weights[slots] * values).sum()))
        gradient[slots] += (chance - model.posterior[r["votes"]]) * values
    gradient = gradient / len(rows) + quality_classifier.PENALTY * model.weights
    assert np.abs(gradient).max() < 1e-6


def test_long_texts_and_long_words_are_seen_whole():
    rng = np.random.default_rng(13)
    at = quality_classifier.LABELLERS.index("few_distinct")
    for n in (1_900, 2_001, 5_000, 20_000):
        salad = quality_classifier.look(" ".join(f"w{k}" for k in rng.integers(0, 40, n)))
        assert quality_classifier.votes(salad)[at] == quality_classifier.BAD
    plain = quality_classifier.look(" ".join(f"w{k}" for k in rng.integers(0, 3_000, 9_000)))
    assert quality_classifier.votes(plain)[at] == quality_classifier.GOOD
    # Unspaced lines that differ behind their first characters only.
    slots = [set(quality_classifier.features(quality_classifier.look("x" * 300 + end))[0].tolist()) for end in ("", "#1#2" * 9)]
    assert slots[0] < slots[1]


def test_classifying_odd_rows(make, odd):
    docs = make(odd, CLASHING)
    assert quality_classifier.classify(docs).count() == len(odd)
    assert quality_classifier.classify(make([])).count() == 0
    kept = quality_classifier.fit(docs).keep(docs)
    assert kept.columns == docs.columns
    assert quality_classifier.fit_labellers({}) == {}


def test_fingerprints_of_odd_rows(make, odd):
    docs = make([r for r in odd if r[0] is not None and r != (8, "a")] + [(8, "a")], CLASHING)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    texts = dict(rows_of(docs))
    order = sorted(texts)
    for at, doc_id in enumerate(order):
        text, following = texts[doc_id], texts[order[(at + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[doc_id]["n_chars"] == len(text)
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0]["fingerprint"] == got[3]["fingerprint"] and got[0]["near_next"] >= 0
    assert fingerprints.fingerprints(make(odd)).count() == len(odd)
    assert fingerprints.fingerprints(make([])).count() == 0


def test_next_document_over_sparse_ids(make):
    ids = [0, 1, 1023, 1024, 5_000_000, 5_000_001, 2**40, 2**40 + 1]
    texts = {i: f"text{k} " * 4 for k, i in enumerate(ids)}
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(make(list(texts.items()))).collect()}
    for at, i in enumerate(ids):
        t, f = texts[i], texts[ids[(at + 1) % len(ids)]]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest()


def base_scores(rows):
    tokens = [(d, t.encode().lower().split() + [None]) for d, t in rows]
    held = [zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1 for d, _ in tokens]
    c = Counter(w for (_, ws), h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [
        (d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for (d, ws), h in zip(tokens, held, strict=True)
    ]


def test_base_scores_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "OWN", 100)
    monkeypatch.setattr(lm_scoring, "KNOWN", 300)
    got = lm_scoring.score_texts(docs, states=3, steps=2).collect()
    shown = lambda rows: sorted(((str(r[0]), *r[1:5], round(r[5], 5)) for r in rows), key=repr)
    assert shown(got) == shown(base_scores(rows_of(docs)))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize(("own", "most"), [(1, 1000), (1, 40), (1, 23), (30, 33), (1, 0)])
def test_known_words_are_whole_steps_of_equal_counts(spark, monkeypatch, own, most):
    monkeypatch.setattr(lm_scoring, "OWN", own)
    counts = [(f"w{i % 97:02}".encode(), c) for i, c in enumerate([1] * 40 + [2] * 9 + [3, 4, 7, 8, 8, 9, 64, 64, 63, 1 << 29] * 2)]
    words = spark.createDataFrame([(w, c) for w, c in counts], "word binary, c bigint")
    got = [(r["c"], bytes(r["word"])) for r in lm_scoring.known_words(words, most)]
    order = sorted(((c, w) for w, c in counts), key=lambda x: (-x[0], x[1]))
    whole = [n for n in range(len(order) + 1) if n in (0, len(order)) or order[n - 1][0] != order[n][0]]
    assert got == order[: max(own, max(n for n in whole if n <= most))]


def test_the_model_beats_the_base_on_held_out_texts(spark, sf):
    rows = lm_scoring.score_texts(documents(spark, sf)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_every_training_word_gets_emissions_of_its_own(docs, monkeypatch):
    """The untied model as one table of all words, by a plain loop, gives the same probabilities and adds up to one."""
    monkeypatch.setattr(lm_scoring, "OWN", 40)
    monkeypatch.setattr(lm_scoring, "KNOWN", 120)
    seen = {}
    train = lm_scoring.train

    def spy(encoded, lex, states, steps):
        seen["lex"], seen["out"] = lex, train(encoded, lex, states, steps)
        return seen["out"]

    monkeypatch.setattr(lm_scoring, "train", spy)
    got = sorted(((str(r["doc_id"]), r["score"]) for r in lm_scoring.score_texts(docs, states=3, steps=3).collect()))
    lex, (model, logs, emissions, rare) = seen["lex"], seen["out"]
    assert logs == sorted(logs)
    rows = [(d, t.encode().lower().split()) for d, t in rows_of(docs)]
    c = Counter(w for d, ws in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    counted = {bytes(r["word"]): r for r in rare.collect()}
    assert set(counted) == set(c) - set(lex.words) and len(counted) > 20
    assert all(r["c"] == c[w] and math.isclose(sum(r[k] for k in ("s0", "s1", "s2")), c[w], rel_tol=1e-4) for w, r in counted.items())

    def of_class(kind, n, found):
        lift = emissions.lift(np.array([kind]), np.array([n]), np.array([found]))[0]
        return model.emit[lex.own + kind] * lift * (n + 0.5) / 10 ** lex.class_total[kind]

    table = {w: model.emit[i] for i, w in enumerate(lex.words[: lex.own])}
    for i, w in enumerate(lex.words[lex.own :]):
        kind = lm_scoring.word_class(w)
        table[w] = model.emit[lex.own + kind] * emissions.known[i] * (c[w] + 0.5) / 10 ** lex.class_total[kind]
    for w, r in counted.items():
        table[w] = of_class(lm_scoring.word_class(w), c[w], [r["s0"], r["s1"], r["s2"]])
    unknown = [of_class(k, 0, [0, 0, 0]) for k in range(lm_scoring.CLASSES)]
    assert np.allclose(sum(table.values()) + sum(unknown) + model.emit[-1], 1)
    assert len({tuple(table[w] / table[w].sum()) for w in counted}) > 10  # words of a class differ
    want = []
    for d, words in rows:
        alpha, log = model.start, 0.0
        for w in [*words, None]:
            alpha = alpha * (model.emit[-1] if w is None else table.get(w, unknown[lm_scoring.word_class(w or b"")]))
            log, alpha = log + math.log10(alpha.sum()), alpha / alpha.sum() @ model.move
        want.append((str(d), log))
    assert [d for d, _ in got] == sorted(d for d, _ in want)
    assert np.allclose([x for _, x in got], [x for _, x in sorted(want)], rtol=1e-5)


def test_forward_and_expected_counts_equal_enumeration():
    rng = np.random.default_rng(2)
    model = lm_scoring.Hmm(np.array([0.3, 0.7]), np.array([[0.6, 0.4], [0.2, 0.8]]), rng.dirichlet(np.ones(4), 2).T)
    sizes, symbols = np.array([4, 2]), np.array([[0, 1], [2, 3], [1, 0], [3, 0]])
    want = []
    counts = [np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))]
    for k, n in enumerate(sizes):
        paths = [[(s >> t) & 1 for t in range(n)] for s in range(2**n)]
        p = [
            model.start[q[0]] * np.prod([model.move[a, b] for a, b in zip(q, q[1:], strict=False)])
            * np.prod([model.emit[symbols[t, k], q[t]] for t in range(n)]) for q in paths
        ]
        want.append(math.log(sum(p)))
        for q, w in zip(paths, np.array(p) / sum(p), strict=True):
            counts[0][q[0]] += w
            for t in range(n):
                counts[2][symbols[t, k], q[t]] += w
                if t:
                    counts[1][q[t - 1], q[t]] += w
    assert np.allclose(lm_scoring.forward(model, sizes, symbols), want)
    got = [np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))]
    assert np.isclose(lm_scoring.expected(model, sizes, symbols, got), sum(want))
    assert all(np.allclose(a, b) for a, b in zip(got, counts, strict=True))


def test_scoring_an_empty_table(make):
    assert lm_scoring.score_texts(make([])).count() == 0


def repeats(rows):
    """Brute force: per document the bytes that a string of 100 bytes with an earlier start covers."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data, mask = text.encode(), np.zeros(len(text.encode()), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                mask[i : i + 100] = True
            seen.add(data[i : i + 100])
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        out[doc_id] = (doc_id, len(data), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [5_000, 1])
def test_suffix_dedup_equals_brute_force(spark, sf, make, odd, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup.repeated_intervals, "__defaults__", (100, 24, hot))
    for docs in (documents(spark, sf), make([*dict(r for r in odd if r[0] is not None).items()], CLASHING)):
        got = {r["doc_id"]: tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs).collect()}
        assert got == repeats(rows_of(docs))


def test_suffix_dedup_of_odd_rows(make, odd):
    assert suffix_dedup.remove_repeats(make(odd)).count() == len(odd)
    assert suffix_dedup.remove_repeats(make([])).count() == 0


def test_previous_factors_equal_brute_force():
    rng = np.random.default_rng(4)
    text = bytes(rng.choice(list(b"ab"), 60).tolist())
    order = np.array(sorted(range(60), key=lambda i: text[i:]))

    def common(i, j):
        return next((k for k in range(60) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or max(i, j) + k >= 60), 60)

    lcp = np.array([0] + [common(order[i - 1], order[i]) for i in range(1, 60)])
    got = suffix_dedup.previous_factors(order, lcp)
    assert got.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(60)]


def removed_by_all_pairs(rows, least=line_dedup.BLOCK_WORDS):
    """Brute force without alignment: each run of enough words that any earlier document holds in a row."""
    lines = {d: [x.strip(" ") for x in t.split("\n")] for d, t in rows}
    count = {x: len(WORD.findall(x)) for held in lines.values() for x in held}
    out = {d: set() for d in lines}
    for d, b in lines.items():
        for a in (lines[e] for e in lines if e < d):
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                        k += 1
                    if sum(count[x] for x in b[j : j + k]) >= least:
                        out[d] |= set(range(j, j + k))
    return out


def test_line_dedup_equals_brute_force(spark, sf, monkeypatch):
    docs = documents(spark, sf)
    got = line_dedup.dedup_lines(docs).collect()
    want = removed_by_all_pairs(rows_of(docs))
    texts = dict(rows_of(docs))
    for r in got:
        assert set(r["removed_places"]) == want[r["doc_id"]]
        if r["text"] is not None:
            lines = texts[r["doc_id"]].split("\n")
            assert r["text"] == "\n".join(x for i, x in enumerate(lines) if i not in want[r["doc_id"]])
    assert any(want.values())


def test_alignment_decides_what_is_cut(monkeypatch):
    rng = np.random.default_rng(13)
    pairs = [[rng.integers(0, 9, rng.integers(0, 16)).tolist() for _ in range(2)] for _ in range(300)]
    found = [line_dedup.common_blocks(a, b, [7] * len(b)) for a, b in pairs]
    # Blocks that stand in both in the same order need no second alignment.
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "_runs_elsewhere", lambda *_: [])
        assert line_dedup.common_blocks([1, 2, 3, 8, 4, 5, 6], [1, 2, 3, 9, 4, 5, 6], [7] * 7) == [0, 1, 2, 4, 5, 6]
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert any(found) and not any(line_dedup.common_blocks(a, b, [7] * len(b)) for a, b in pairs)


def removed_places(docs):
    return {r["doc_id"]: set(r["removed_places"]) for r in line_dedup.dedup_lines(docs).collect()}


def test_line_dedup_finds_blocks_whose_lines_came_first_elsewhere(make):
    one, two, three = (" ".join(f"{c}{i}" for i in range(12)) for c in "xyz")
    texts = [one, two, f"{one}\n{two}", f"{one}\n{two}", f"{two}\n{three}\n{one}", f"a b\n{one}\n{two}\n{three}\n{one}"]
    # Blocks of short lines, changed in order and held twice.
    short = [f"s{i} t{i} u{i}" for i in range(14)]
    texts += ["\n".join([*short, "", one]), "\n".join(["new", *short[7:], *short[:7], *short[7:]])]
    got = removed_places(make(texts))
    assert got == removed_by_all_pairs(enumerate(texts))
    assert got[3] == {0, 1} and got[7] == set(range(1, 22))


def test_line_dedup_equals_brute_force_over_all_earlier_documents(make):
    rng = np.random.default_rng(11)
    stock = ["", *(" ".join(f"v{k}w{i}" for i in range(rng.integers(1, 14))) for k in range(14))]
    texts = ["\n".join(stock[k] for k in rng.integers(0, len(stock), rng.integers(0, 14))) for _ in range(90)]
    got, want = removed_places(make(texts)), removed_by_all_pairs(enumerate(texts))
    assert got == want and sum(map(len, want.values())) > 50
    # What an alignment with any earlier document gives is among it.
    lines = [t.split("\n") for t in texts]
    for d in range(len(lines)):
        words = [len(WORD.findall(x)) for x in lines[d]]
        for e in range(d):
            ids = {x: i for i, x in enumerate(dict.fromkeys(lines[e] + lines[d]))}
            assert set(line_dedup.common_blocks([ids[x] for x in lines[e]], [ids[x] for x in lines[d]], words)) <= got[d]


def test_patience_keeps_order_and_equality():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 14)).tolist() for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert line_dedup.patience([1, 2, 3, 4], [9, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 40])
def test_ranges_without_unique_lines_are_aligned_like_a_plain_lcs(monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "LCS_BITS", bits)
    rng = np.random.default_rng(12)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 30)).tolist() for _ in range(2))
        # Each line twice in both, so that no line is unique.
        for x, y in ((a, b), (a + a[::-1], b + b[::-1])):
            pairs = line_dedup.longest_common(x, y)
            assert len(pairs) == lcs_length(x, y) and all(x[i] == y[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        twice = [7, *a, *a, 7], [8, *b, *b, 8]
        if len(set(twice[0]) & set(twice[1])):
            assert len(line_dedup.patience(*twice)) == lcs_length(*twice)
    # A passage that stands twice in the later text, and one that stands twice in the first.
    assert line_dedup.patience([1, 2], [9, 1, 2, 8, 1, 2, 7]) == [(0, 1), (1, 2)]
    assert line_dedup.common_blocks([1, 2], [9, 1, 2, 8, 1, 2, 7], [12] * 7) == [1, 2, 4, 5]
    assert line_dedup.common_blocks([5, 1, 2, 6, 1, 2, 4], [9, 1, 2, 7], [12] * 4) == [1, 2]


def test_line_dedup_of_odd_rows(make, odd):
    docs = make(odd, [*CLASHING, "__id", "__places", "id", "id_", "Gone", "places", "lines", "first"])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "removed_places"] and out.count() == len(odd)
    assert line_dedup.dedup_lines(make([])).count() == 0


def test_blocks_number_words_once_and_start_anew(monkeypatch):
    """Many blocks in one task, with words told in earlier ones, and a numbering that starts anew."""
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 60)
    monkeypatch.setattr(byte_bpe, "NUMBERED", 25)
    ranks = byte_bpe.ranks_of(BYTE_RANKS)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{rng.integers(30)}" for _ in range(rng.integers(0, 20))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    blocks = list(byte_bpe._blocks(public_tokenizers.PATTERN, BYTE_RANKS)([batch]))
    assert len(blocks) > 5 and sum(b.column("anew")[0].as_py() for b in blocks) > 1

    def encoded(block):
        words = [[{"ids": byte_bpe.merge_parts(bytes(w), ranks), "decoded": bytes(w)} for w in block.column("words")[0].as_py()]]
        kind = pa.list_(pa.struct([("ids", pa.list_(pa.int64())), ("decoded", pa.binary())]))
        return block.set_column(block.schema.get_field_index("words"), "words", pa.array(words, kind))

    out = [r for b in byte_bpe._ids(map(encoded, blocks)) for r in b.to_pylist()]
    by_rank = {r: t for t, r in ranks.items()}
    assert [b"".join(by_rank[i] for i in r["ids"]).decode() for r in out] == texts


def test_near_copies_that_share_many_lists_are_told_once(spark):
    lists = [(v, d) for v in range(10, 30) for d in (1, 2, 3)] + [(30, 3), (30, 4)]
    members = spark.createDataFrame([(v, d, 100, d, 0) for v, d in lists], "value bigint, doc_id bigint, n bigint, label bigint, u bigint")
    asked = spark.createDataFrame([(v, 1, 100, 0, 1) for v in range(15, 30)] + [(30, 3, 100, 0, 3)], "value bigint, p bigint, pn bigint, pu bigint, pl bigint")
    told = near_dup._asked_pairs(members, asked, 85, once=True).select("doc_id", "p").collect()
    assert sorted(map(tuple, told)) == [(2, 1), (3, 1), (4, 3)]
    every = near_dup._asked_pairs(members, asked, 85, once=False).select("doc_id", "p").collect()
    assert len(every) == 31 and set(every) == set(told)


def test_byte_bpe_merges_no_words_in_interpreted_expressions(make):
    """A word takes a few microseconds in the task; folded by Spark's expressions it took about a hundred."""
    docs = make(["some text", "other text"])
    plan = byte_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("MapInArrow") == 1


def test_short_words_merge_the_leftmost_pair_of_the_lowest_rank():
    letters = {bytes([c]): i for i, c in enumerate(b"abc")}
    assert byte_bpe.merge_parts(b"aaaa", letters | {b"aa": 3}) == [3, 3]
    assert byte_bpe.merge_parts(b"aaa", letters | {b"aa": 3}) == [3, 0]
    assert byte_bpe.merge_parts(b"abc", letters | {b"bc": 3, b"ab": 4}) == [0, 3]
    assert byte_bpe.merge_parts(b"abcabc", letters | {b"ab": 3, b"ca": 4, b"abc": 5}) == [5, 5]
    # A word that is a token is that token, even if no merge gives it.
    assert byte_bpe.merge_parts(b"abc", letters | {b"abc": 9}) == [9]


def test_texts_that_nobody_asks_for_are_not_shuffled(spark, monkeypatch):
    """Where ids are too many to broadcast, a join by id sent every text; rows are now picked by marks of hashed ids."""
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('a b c d ', id) as text")
    asked = docs.filter("doc_id % 100 = 7").select("doc_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(near_dup, "stored", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = near_dup._FullSets(docs, 3)
        held = {r["doc_id"]: r["shingles"] for r in sets.holding(asked).collect()}
        picked = {r["doc_id"] for r in near_dup._roughly(docs, asked).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    wanted = set(range(7, 4000, 100))
    assert set(held) == wanted and all(len(s) == 3 for s in held.values())
    assert wanted <= picked and len(picked) < 60
    # The texts meet the marks before the first exchange.
    assert "BroadcastHashJoin" in plans["shingles"]


def test_noisy_copies_out_of_reach_of_each_other_are_not_paired(make, monkeypatch):
    """Copies with many edits share most lists of a group, and no link: pairs must not grow with the group's square."""
    rng = np.random.default_rng(3)
    texts = []
    for k in range(300):
        words = [f"w{i}" for i in range(150)]
        for at in rng.choice(150, 7 if k % 3 else 1, replace=False):
            words[at] = f"e{rng.integers(3)}"
        texts.append(" ".join(words))
    told = []

    ask = near_dup._asked_pairs

    def counted(*args, **options):
        out = stored(ask(*args, **options), "told")
        told.append(out.select("doc_id", "p").distinct().count())
        return out

    monkeypatch.setattr(near_dup, "_asked_pairs", counted)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dup.near_duplicates(make(texts), 3, 85).collect()}
    assert got == components_of(dict(enumerate(texts)), 3, 85)
    assert sum(told[1:]) < 10 * len(texts), told
