"""Personal data: patterns propose, checksums confirm, context words adjust.

Four base kinds (email, ip, card, phone) are found as the contract states
them. Further kinds are proposed more loosely: iban is confirmed by its
country's length and mod-97; secrets (keys, tokens, passwords) by a name before
them and by how evenly their characters are spread; national ids and local
phone numbers have neither, so they need context words nearby to pass the
threshold. Words that speak against a kind lower its score. Every pattern is
written so that a match attempt never rescans a run, and spans are compared in
one sweep: time is linear in the text but for sorting, also for runs of 100,000
digits and for thousands of spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, row_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "local_phone", "secret")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
#: A name, a sign and a value; keys whose form says what they are; heads of key files.
_NAMED = re.compile(r"(?i)(?<![a-z])(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|auth)(?:[_-][a-z_-]{1,20})?[\"']?\s{0,3}(?:=|:|=>)\s{0,3}(?:bearer )?[\"']?([A-Za-z0-9_/+=.~!@#$%^&*-]{8,512})")
_KEYS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk-[A-Za-z0-9_-]{20,128})(?![A-Za-z0-9])|-----BEGIN (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----")
_HINT = re.compile(r"[0-9@]|(?i:key|secret|token|passw|pwd|auth)")
#: Bits a character that the values of named secrets have at least.
SECRET_BITS = 2.5

#: Lengths of IBANs by country, as the registry of ISO 13616 gives them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Scores before context, and context words that raise and lower them. Fixed values of this operator.
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3, "local_phone": 0.3, "secret": 0.8}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact"),
    "ip": ("ip", "server", "address", "host", "adresse"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "id", "tax"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "secret": ("login", "credentials", "bearer", "private", "key"),
}
AGAINST = {
    "email": ("example",),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("isbn", "order", "invoice", "tracking"),
    "phone": ("isbn", "order", "invoice"),
    "iban": ("serial",),
    "national_id": ("part", "order", "serial", "isbn"),
    "local_phone": ("part", "order", "serial", "isbn"),
    "secret": ("placeholder", "dummy", "changeme"),
}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
THRESHOLD = 0.5
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches end in a domain after an @; the local part is the run before it, back to the last match."""
    end = at_before = 0
    for m in _DOMAIN.finditer(text):
        floor = max(end, at_before)
        before = text[floor : m.start()]
        run = len(before) - len(before.rstrip(_LOCAL))
        if run:
            end = m.end()
            yield m.start() - run, end
        at_before = m.start() + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by start, then kind."""
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], BASE.index(x[0])))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Candidates cut to their country's length that mod-97 confirms; a candidate is short, so time stays linear."""
    at = 0
    while m := _IBAN.search(text, at):
        at, end, left = m.start() + 1, m.start(), IBAN_LENGTHS.get(m[0][:2].upper(), 0)
        while left and end < len(text) and (text[end] == " " or text[end].isascii() and text[end].isalnum()):
            left -= text[end] != " "
            end += 1
        whole = end > m.start() and not left and not (end < len(text) and text[end].isascii() and text[end].isalnum())
        if whole and mod97(text[m.start() : end].replace(" ", "").upper()):
            yield m.start(), end
            at = end


def bits_a_character(value: str) -> float:
    """Entropy of a value's characters."""
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts)


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values behind a name that hold letters and digits, spread evenly enough; and keys known by their form."""
    known = [m.span() for m in _KEYS.finditer(text)]
    for m in _NAMED.finditer(text):
        value = m[1]
        mixed = any(map(str.isdigit, value)) and any(map(str.isalpha, value))
        if mixed and bits_a_character(value) >= SECRET_BITS:
            known.append(m.span(1))
    end = 0
    for s, e in sorted(known):
        if s >= end:
            yield s, e
            end = e


def further_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Confirmed or still to be scored candidates of the other kinds, none over a base span."""
    out = []
    out += [("iban", *x) for x in ibans(text)]
    out += [("national_id", *m.span()) for m in _NATIONAL.finditer(text)]
    out += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    out += [("secret", *x) for x in secrets(text)]
    # Base spans by start, with the furthest end so far: the last that starts before a candidate's end tells whether any reaches into it
    starts, ends, furthest = [], [], 0
    for _, s, e in base:
        furthest = max(furthest, e)
        starts.append(s)
        ends.append(furthest)
    return [x for x in out if not ((i := bisect_left(starts, x[2])) and ends[i - 1] > x[1])]


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = set(_WORDS.findall(near.lower()))
    change = any(w in words for w in CONTEXT[kind]) - any(w in words for w in AGAINST[kind])
    return max(0.0, min(1.0, START[kind] + CONTEXT_GAIN * change))


def find(text: str) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, int, int]]]:
    """All accepted spans with scores, and the base ones."""
    if not _HINT.search(text):
        return [], []
    base = base_spans(text)
    scored = [(*x, score(text, *x)) for x in base]
    scored += [(*x, s) for x in further_spans(text, base) if (s := score(text, *x)) >= THRESHOLD]
    return sorted(scored, key=lambda x: (x[1], KINDS.index(x[0]))), base


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches):
        out = []
        for text in part.column(1).to_pylist():
            spans, base = find(text or "")
            known = set(base)
            out.append([{"kind": k, "start": s, "end": e, "score": w, "base": (k, s, e) in known} for k, s, e, w in spans])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(SPAN))], ["id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans array of (kind, start, end, score, base); offsets in code points.

    A map over the texts without any shuffle. Edge cases: null text is empty
    and gives no spans; very long texts are searched whole; spans that start
    together are ordered as KINDS; repeated rows give repeated results; a null
    id stays; an empty table gives an empty result; other columns, whatever
    their names, are ignored.
    """
    span = "struct<kind: string, start: long, end: long, score: double, base: boolean>"
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(lean(_find), f"id long, spans array<{span}>").withColumnRenamed("id", id_col)

