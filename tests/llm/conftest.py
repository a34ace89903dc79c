import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that clash with names used inside the operators.
CLASHING = ["spans", "label", "n", "block", "h", "subset", "value", "key", "row", "kept"]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts (or (id, text) pairs)."""

    def build(texts, extra=()):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        docs = spark.createDataFrame(rows, SCHEMA)
        for name in extra:
            docs = docs.selectExpr("*", f"'x' as `{name}`")
        return docs

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty texts, repeated rows, missing and repeated ids, odd spacing, a very long text."""
    long = " ".join(f"w{i % 977} x{i % 313}." for i in range(30_000))
    plain = "The quick brown fox jumps over the lazy dog. " * 6
    return [
        (0, plain), (1, None), (2, ""), (3, plain), (None, plain), (None, None), (5, "  two  spaces \n\n\t and tabs   nbsp "),
        (6, long), (7, "ÀÉß naïve ñandú İstanbul Ω日本語 \U0001f600\U0001f600"), (8, "a"), (8, "a"), (9, "\0nul\0 \x1c sep"), (10, "aaaa" * 400),
        (11, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +1 (222) 333-4444 a@b@c.com 1.2.3.4.5.6.7.8 x@y.z."), (12, "It's 'S we'll <|endoftext|> 12345"),
    ]
