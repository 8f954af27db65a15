"""Operator 4 — personal data: patterns propose, checksums confirm, context adjusts.

Patterns find spans kind by kind, leftmost and without overlap; a proposal that
fails its kind's check (octets at most 255, Luhn, digit counts, mod-97, entropy)
is dropped, with no retry inside it.  Beyond the base kinds there are bank
account numbers (iban) and secrets: the value that a text assigns to a name such
as token or password, if its characters are as varied as a random key's.  A confirmed span's score starts from its
kind and rises with a context word of that kind within ``NEAR`` code points
before it; the score never removes a span.  Every pattern reads a text once:
e-mail addresses are found from their ``@`` outwards, and digit runs are taken
whole (possessive), so long junk costs linear time.

Offsets are code points, the end exclusive.  Defined results: a null or empty
text has no spans; texts of any length are searched whole; rows are judged one by one, so ties and repeats give equal
rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log2
from typing import Iterator, List, Tuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "secret")
NEAR = 40

Span = Tuple[str, int, int, float]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The possessive runs and the look-behind spare retries that cannot succeed: a digit run is followed by no digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:token|secret|passwo?r?d|pwd|(?:api|access|private|secret|auth)[_-]?key|auth)(?![A-Za-z0-9])"
                     r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9+/_=.-]{12,512}+)", re.I)
_DIGITS = re.compile(r"[0-9]")
_CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write to", re.I),
    "ip": re.compile(r"\bip\b|address|server|host", re.I),
    "card": re.compile(r"card|visa|credit|payment", re.I),
    "phone": re.compile(r"phone|tel|call|mobile", re.I),
    "iban": re.compile(r"iban|bank|account|konto", re.I),
    "secret": re.compile(r"secret|api|auth|private|bearer|credential|login", re.I),
}
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9, "secret": 0.7}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def random_like(value: str) -> bool:
    """A key rather than a word or a name: digits and letters, at least 2.8 bits of entropy a character."""
    n = len(value)
    bits = -sum(c / n * log2(c / n) for c in Counter(value).values())
    return bits >= 2.8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[Tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at  # characters before a failed @ belong to no later match
        at = text.find("@", max(done, at + 1))


def spans(text) -> List[Span]:
    """(kind, start, end, score) by kind as listed, then start."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
                      if 9 <= len(_DIGITS.findall(m[0])) <= 15]
        found += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
        found += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text) if random_like(m[1])]
    return [(k, a, b, min(1.0, _PRIOR[k] + (0.1 if k in ("email", "iban") else 0.2)
                          if _CONTEXT[k].search(text, max(0, a - NEAR), a) else _PRIOR[k])) for k, a, b in found]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans), one row per input row; spans: array of (kind, start, end, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], [id_col, "spans"])

    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>")


def redact(text, found: List[Span]) -> str:
    """The text with each span replaced by its kind in brackets (of overlapping spans the first stays)."""
    out, at = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join(out) + text[at:]
