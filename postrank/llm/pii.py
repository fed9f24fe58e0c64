"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Email addresses, IP addresses, card numbers and phone numbers are the base kinds:
leftmost matches that do not overlap within a kind; a match that fails its check
is dropped and its characters are not tried again. IBANs (mod 97) and US social
security numbers (by their context words only) are added where they do not
overlap a base span. Every scan is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGITS = re.compile(r"[0-9]")

# Score of a proposal that passed its check, and words nearby that raise or lower it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "@"), "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment", "amex"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "isbn", "order", "serial", "example", "release")
NEAR = 40  # characters of context before and after
STEP = 0.3
LEAST = 0.5  # added kinds need this score; base spans always stay


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str):
    """Every match holds one @ with the run of local characters before it, so each @ is tried once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def ips(text: str):
    """A run of dotted numbers gives a match for every four of them."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i:i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield at, end
                at = end + 1


def cards(text: str):
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def ibans(text: str):
    """The longest prefix of a proposal, from its first two letters, that passes mod 97."""
    for m in IBAN.finditer(text):
        if m.start() and text[m.start() - 1].isalnum():
            continue
        raw = m.group()
        for end in range(len(raw), 14, -1):
            code = raw[:end].replace(" ", "")
            if raw[end - 1] != " " and len(code) >= 15 and not text[m.start() + end:m.start() + end + 1].isalnum() and mod97(code):
                yield m.start(), m.start() + end
                break


def ssns(text: str):
    for m in SSN.finditer(text):
        yield m.span()


def scored(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]).lower()
    found = set(re.findall(r"[a-z@]+", near))
    score = SCORE[kind] + STEP * bool(found & set(CONTEXT[kind])) - STEP * bool(found & set(AGAINST))
    return round(min(1.0, max(0.0, score)), 3)


def spans(text: str) -> list[Span]:
    """All spans of a text by start, then by kind in the order of KINDS."""
    out: list[Span] = []
    digits = DIGITS.search(text) is not None
    found = {"email": emails(text) if "@" in text else (),
             "ip": ips(text) if digits else (), "card": cards(text) if digits else (),
             "phone": phones(text) if digits and "+" in text else (),
             "iban": ibans(text) if digits else (), "ssn": ssns(text) if digits and "-" in text else ()}
    taken = bytearray(len(text))
    for k, kind in enumerate(KINDS):
        for s, e in found[kind]:
            score = scored(text, kind, s, e)
            if kind in BASE or score >= LEAST and not any(taken[s:e]):
                out.append(Span(s, k, e, score))
                taken[s:e] = b"\x01" * (e - s)
    return sorted(out)


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[x.kind]}:{x.start}:{x.end}" for x in found)


def redacted(text: str, found: list[Span]) -> str:
    """Each group of overlapping spans becomes the name of its first span's kind in brackets."""
    out, last = [], 0
    for x in found:
        if x.start >= last:
            out += [text[last:x.start], f"[{KINDS[x.kind].upper()}]"]
        last = max(last, x.end)
    return "".join([*out, text[last:]])


def find(df: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """``df`` with n_<kind> for each base kind, base_sha256 (of the base spans as kind:start:end, code
    points, comma-joined), spans (all spans, joined likewise), scores, and with ``redact`` the text with
    its spans replaced.

    A null text is searched as an empty one and stays null; no span gives the digest of the empty
    string. Whole texts, one pass, no shuffle; repeated rows each get their result; a result column
    replaces an input column of its name.
    """
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
               T.StructField("scores", T.ArrayType(T.DoubleType()))]
    if redact:
        fields.append(T.StructField("__redacted", T.StringType()))

    def make():
        def function(column: pa.Array) -> list:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, lists, scores, texts = [], [], [], []
            for x in column:
                body = x.as_py()
                found = spans(body) if body else []
                base = [s for s in found if s.kind < len(BASE)]
                for k, column_of in enumerate(counts):
                    column_of.append(sum(s.kind == k for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(found))
                scores.append([s.score for s in found])
                if redact:
                    texts.append(body and redacted(body, found))
            return [*counts, digests, lists, scores] + [texts] * redact
        return function

    out = map_text(df, text, T.StructType(fields), make)
    if redact:
        rest = [c for c in out.columns if c not in ("__redacted", text)]
        out = out.select(*[F.col("`" + c + "`") for c in rest], F.col("__redacted").alias(text))
    return out
