"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, URL schemes and identifier cues) in one pass
over a text; a small deterministic parser at each anchor expands it to its boundaries and validates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

# In the order of the result.
KINDS = ("email", "ip", "card", "phone", "account", "secret", "url")
BASE = KINDS[:4]

ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "konto", "cuenta", "compte")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCOUNT = re.compile(r"[ \t]*(?:number|no\.?|nr\.?|#)?[ \t]*[:=#]?[ \t]*([A-Za-z]{0,2}[0-9](?:[ -]?[A-Za-z0-9]){4,33})", re.I)
SECRET = re.compile(r"[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_+/.~-]{8,})")
REST = re.compile(r"[^\s<>\"'|]+")

SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, sorted by kind and start; of one kind they never overlap."""
    found: list[tuple[str, int, int]] = []
    after = dict.fromkeys(KINDS, 0)  # where the search for a kind goes on

    def keep(kind: str, start: int, end: int, valid: bool = True) -> None:
        after[kind] = end
        if valid:
            found.append((kind, start, end))

    for at, anchor in automaton().iter(text):
        if anchor == "digit":
            if at >= after["ip"]:
                if m := QUAD.match(text, at):
                    keep("ip", at, m.end(), all(map(octet, m.groups())))
                else:
                    after["ip"] = DIGITS.match(text, at).end()
            if at >= after["card"]:
                if m := CARD.match(text, at):
                    digits = m[0].replace(" ", "").replace("-", "")
                    keep("card", at, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
                else:
                    after["card"] = at + 1
        elif anchor == "at":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                keep("email", start, m.end())
        elif anchor == "plus":
            if at >= after["phone"] and (m := PHONE.match(text, at)):
                keep("phone", at, m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif anchor == "scheme":
            start = at - 2
            while start > after["url"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at - 2 and not text[start].isalpha():
                start += 1
            if start < at - 2 and (m := REST.match(text, at + 1)) and (rest := m[0].rstrip(".,;:!?)]}")):
                keep("url", start, at + 1 + len(rest))
        else:
            parser = ACCOUNT if anchor == "account" else SECRET
            if (m := parser.match(text, at + 1)) and m.start(1) >= after[anchor]:
                digits = sum(c.isdigit() for c in m[1])
                keep(anchor, m.start(1), m.end(1), digits >= (6 if anchor == "account" else 1))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one of the first kind."""
    parts, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [spans(t) for t in batch.column("text").to_pylist()]
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, SPAN_TYPE)], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document with its spans: ``doc_id``, ``spans`` (kind, start, end in code points, end exclusive).

    A null text counts as empty; empty texts have no spans; repeated rows give repeated rows; other columns are left
    out.  Each text is read whole, in one pass, without a shuffle.
    """
    return texts(docs).mapInArrow(_scan, f"doc_id bigint, spans {SPANS}")


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        new = [None if t is None else masked(t, spans(t)) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, with each span in ``text`` replaced by ``<KIND>``; a null text stays null."""
    return docs.mapInArrow(_mask, docs.schema)


def listed(found: Column) -> Column:
    """Spans as comma-joined ``kind:start:end``."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def base_report(found: DataFrame) -> DataFrame:
    """Counts and a digest of the four base kinds, and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
