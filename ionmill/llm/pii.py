"""Operator 8: personal data in whole texts: patterns propose, checksums confirm, context words adjust.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and without overlap per kind; a match that fails its check is dropped and
the text it covers is not tried again. Every start that the patterns could try in vain is skipped by look-behind or by starting at the one sign
a match must hold (@, +), so a run of a million digits or letters takes linear time.

The method adds two kinds: ``iban`` (country, two check digits, as many letters and digits as the country's numbers have, mod-97 equal to 1) and ``ssn`` (three, two and
four digits, no all-zero part). Each span has a score: a confirmed checksum starts high, a bare pattern low; a context word within
``window`` characters before the span raises it, a word that speaks against it lowers it. Additions below ``least`` go; base spans stay at any score.

Offsets are code points, end excluded. Null and empty texts have no spans. Rows: one per input row, repeated rows alike; an empty table gives
no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

#: Fixed patterns of the base kinds, each started only where a match can begin.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of an account number by country.
_IBAN_LENGTHS = """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28
HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24
RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20""".split()
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(f"{x[:2]}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{int(x[2:]) - 4}}}" for x in _IBAN_LENGTHS) + r")(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")

#: Context words and what they add to a score.
CONTEXT = {
    "email": {"email": 0.1, "mail": 0.1, "contact": 0.1},
    "ip": {"ip": 0.2, "address": 0.1, "host": 0.1, "server": 0.1, "version": -0.3, "section": -0.2},
    "card": {"card": 0.1, "visa": 0.1, "credit": 0.1, "order": -0.1, "isbn": -0.3},
    "phone": {"phone": 0.2, "tel": 0.2, "call": 0.2, "fax": 0.1, "mobile": 0.2},
    "iban": {"iban": 0.1, "account": 0.1, "bank": 0.1, "serial": -0.2},
    "ssn": {"ssn": 0.4, "social": 0.3, "security": 0.2, "part": -0.2, "isbn": -0.3},
}
START = {"email": 0.8, "ip": 0.6, "card": 0.85, "phone": 0.6, "iban": 0.9, "ssn": 0.3}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(map(_small, m.groups())):
            yield m.span()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield m.span()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if all(int(x) for x in m.groups()) and m[1] != "666" and m[1] < "900":
            yield m.span()


_FIND = {"email": emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}
_HINT = {"email": re.compile("@"), "ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile(r"[0-9][\x20-]?[0-9]"), "phone": re.compile(r"\+[0-9]"), "iban": re.compile(r"[A-Z]{2}[0-9]{2}"), "ssn": re.compile(r"[0-9]-[0-9]{2}-")}


def score(text: str, kind: str, start: int, window: int = 40) -> float:
    words = set(re.findall(r"[a-z]+", text[max(0, start - window):start].lower()))
    return min(1.0, max(0.0, START[kind] + sum(v for w, v in CONTEXT[kind].items() if w in words)))


def find(text: str | None, window: int = 40, least: float = 0.5) -> list[Span]:
    """All spans by kind as listed in KINDS, then by start."""
    out: list[Span] = []
    if not text:
        return out
    for kind in KINDS:
        if _HINT[kind].search(text):
            spans = [Span(kind, a, b, round(score(text, kind, a, window), 3)) for a, b in _FIND[kind](text)]
            out += spans if kind in BASE else [s for s in spans if s.score >= least]
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def detect(docs: DataFrame, window: int = 40, least: float = 0.5) -> DataFrame:
    """doc_id and found: array of (kind, start, end, score), ordered."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found = [[s._asdict() for s in find(t.as_py(), window, least)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return common.map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>")

