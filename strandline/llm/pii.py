"""Personal data by anchor expansion.

An Aho-Corasick automaton over short anchors (at-signs, schemes, digit cues, identifier cues) makes one pass over
a text. At each anchor a small local parser walks left and right to the boundaries and validates what it finds;
nothing else in the text is parsed. Kinds `email`, `ip`, `card`, `phone` equal their leftmost, non-overlapping
patterns; `url` (from schemes) and `account` are what anchors add. An account follows an identifier cue such as token or
password; after an iban cue its check digits must be right, or it is taken as any other account; and keys that begin
with a fixed sign of their own, such as AKIA, need no cue.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, unused, with_arrow_columns

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LETTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGIT = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s\"'<>\\^`{|}]+")
ACCOUNT = re.compile(r"[\x20\t]{0,3}(?:[=:#]|is\b|no\.?)?[\x20\t]{0,3}[\"']?([A-Za-z0-9][A-Za-z0-9_-]{5,})")
IBAN = re.compile(r"[\x20\t]{0,3}[:=]?[\x20\t]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
#: Words that announce an identifier, and how keys begin that need no such word.
CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "apiKey", "accessKey", "secretKey", "account", "iban", "passport", "ssn")
KEY_SIGNS = ("AKIA", "ASIA")
NOT_DIGIT = re.compile(r"[^0-9]")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    digits = "0123456789"
    a.add_word("@", ("email", 1))
    a.add_word("://", ("url", 3))
    for d in digits:
        a.add_word(f".{d}", ("ip", 2))
        a.add_word(f"+{d}", ("phone", 2))
        for e in digits:
            for gap in ("", " ", "-"):
                a.add_word(f"{d}{gap}{e}", ("card", 2 + len(gap)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("account", len(form)))
    for sign in KEY_SIGNS:
        a.add_word(sign, ("key", len(sign)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def iban_holds(number: str) -> bool:
    """Whether the check digits are right: the rest after moving four signs to the end, letters as 10 to 35, is 1."""
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start and then kind as listed."""
    ends = dict.fromkeys(KINDS, 0)  # where the last span of a kind ended, kept or dropped
    spans: list[tuple[int, int, str]] = []
    for last, (kind, length) in anchors.iter(text):
        signed, kind = kind == "key", "account" if kind == "key" else kind
        at, floor = last - length + 1, ends[kind]
        if at < floor:
            continue
        if kind == "card":
            end = CARD.match(text, at).end()
            ends[kind] = end
            number = NOT_DIGIT.sub("", text[at:end]) if end - at >= 12 else ""
            if 12 <= len(number) <= 19 and luhn(number):
                spans.append((at, end, kind))
        elif kind == "email":
            start = at
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                ends[kind] = m.end()
                spans.append((start, m.end(), kind))
        elif kind == "ip":
            start = at
            while start > floor and text[start - 1] in DIGIT:
                start -= 1
            if start < at and (m := QUAD.match(text, start)):
                ends[kind] = m.end()
                if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
                    spans.append((start, m.end(), kind))
        elif kind == "phone":
            if m := PHONE.match(text, at):
                ends[kind] = m.end()
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    spans.append((at, m.end(), kind))
        elif kind == "url":
            start = at
            while start > floor and text[start - 1] in LETTER:
                start -= 1
            while start < at and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            if start < at and (m := URL.match(text, at + 3)):
                end = m.end()
                while end > at + 3 and text[end - 1] in ".,;:!?)]&*$#%":
                    end -= 1
                if end > at + 3:
                    ends[kind] = end
                    spans.append((start, end, kind))
        elif signed:
            if (at == 0 or not text[at - 1].isalnum()) and (m := KEY.match(text, last + 1)):
                ends[kind] = m.end()
                spans.append((at, m.end(), kind))
        elif at == 0 or not text[at - 1].isalnum():
            if text[at : last + 1].lower() == "iban" and (m := IBAN.match(text, last + 1)) and iban_holds(m[1].replace(" ", "")):
                ends[kind] = m.end(1)
                spans.append((m.start(1), m.end(1), kind))
            elif (m := ACCOUNT.match(text, last + 1)) and sum(c in DIGIT for c in m[1]) >= 4:
                ends[kind] = m.end(1)
                spans.append((m.start(1), m.end(1), kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or each run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


@functools.cache
def anchors() -> ahocorasick.Automaton:
    """One automaton for each Python worker."""
    return automaton()


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def with_spans(docs: DataFrame, text: str = "text", spans: str = "pii_spans", redacted: str | None = None) -> DataFrame:
    """docs with the spans of each whole text, and, if asked for, the text without them.

    Map-only: rows stay where they are, so a hot source or group of copies costs nothing extra. A null text has no
    spans and stays null; an empty text has none. Repeated rows give equal results. An input column that has the
    name of an output is replaced.
    """
    docs = docs.drop(spans, *([redacted] if redacted and redacted != text else []))
    added = {redacted: "string"} if redacted else {}

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(text).to_pylist()
        found = [find(t, anchors()) if t else [] for t in texts]
        out = {spans: pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in found], ARROW_SPANS)}
        if redacted:
            out[redacted] = pa.array([redact(t, x) if t else t for t, x in zip(texts, found)], pa.string())
        return out

    return with_arrow_columns(docs, run, added | {spans: SPANS})


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, all spans as a string, and their number.

    Map-only. A null or empty text has no spans. Null and repeated doc_ids are kept as they are; an empty table gives
    none. Extra columns are not used.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": [], "n_spans": []}
        for t in batch.column("text").to_pylist():
            found = find(t, anchors()) if t else []
            for kind in BASE:
                out[f"n_{kind}"].append(sum(kind == k for _, _, k in found))
            out["base_sha256"].append(hashlib.sha256(joined(x for x in found if x[2] in BASE).encode()).hexdigest())
            out["spans"].append(joined(found))
            out["n_spans"].append(len(found))
        return {k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()}

    kinds = {f"n_{k}": "long" for k in BASE} | {"base_sha256": "string", "spans": "string", "n_spans": "long"}
    return with_arrow_columns(docs.select("doc_id", "text"), run, kinds).drop("text")


def redact_documents(docs: DataFrame) -> DataFrame:
    """documents with every span replaced in text, n_chars to match, and the columns unchanged."""
    (spans,) = unused(docs, "_pii")
    out = with_spans(docs, redacted="text", spans=spans)
    return out.select(*[F.length("text").cast("long").alias("n_chars") if name == "n_chars" else c for name, c in zip(docs.columns, columns_of(docs))])
