"""Personal data in texts: patterns propose, checksums confirm, context weighs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers.llm.batches import with_text_columns
from tellers.llm.text import whole_text

KINDS = ("email", "ip", "card", "phone", "iban")  # the order of listing
BASE_KINDS = KINDS[:4]
CONTEXT_CHARS = 40

# The characters and shapes of the kinds. Quantifiers are possessive
# where what follows cannot take over a character, so no text is searched twice.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

# Characters of an account number by country.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_IBAN_OF_LENGTH = {
    n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(_IBAN_LENGTHS.values())
}

# Score of a span by itself, and words near it that speak for or against it.
_ALONE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
_FOR = {
    "email": re.compile(r"\b(e-?mail|mail|contact|kontakt|correo|courriel|write)\b", re.I),
    "ip": re.compile(r"\b(ip|host|server|address|adresse|client|login)\b", re.I),
    "card": re.compile(r"\b(card|karte|carte|tarjeta|visa|mastercard|credit|cvv)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|telephone|telefon|téléphone|teléfono|mobile|call|fax)\b", re.I),
    "iban": re.compile(r"\b(iban|account|konto|compte|cuenta|bank)\b", re.I),
}
_AGAINST = re.compile(r"\b(version|example|sample|test|dummy|serial|order)\b", re.I)

SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
]))


def luhn(digits: str) -> bool:
    """Whether the digits pass the check of card numbers."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number passes the check of IBANs."""
    compact = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts as far left of its @ as its characters go, or at the one before."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    free = 0
    for m in _IBAN.finditer(text):
        length = _IBAN_LENGTHS.get(m[0][:2])
        whole = _IBAN_OF_LENGTH[length].match(text, m.start()) if length and m.start() >= free else None
        if whole and mod97(whole[0]):
            free = whole.end()
            yield "iban", m.start(), free


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS):start] + " | " + text[end:end + CONTEXT_CHARS]
    bonus = 0.2 * bool(_FOR[kind].search(near)) - 0.3 * bool(_AGAINST.search(near))
    return round(min(1.0, max(0.0, _ALONE[kind] + bonus)), 3)


def find_spans(text: str) -> list[dict]:
    """All spans of one text by kind, then start; start and end in code points."""
    found = [("email", *span) for span in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found.extend(_numbers(text))
    found.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return [{"kind": k, "start": a, "end": b, "score": _score(text, k, a, b)} for k, a, b in found]


def _compute(texts: list[str]) -> list[pa.Array]:
    return [pa.array([find_spans(t) for t in texts], type=SPANS)]


def find_personal_data(
    docs: DataFrame, text: str = "text", spans_name: str = "spans", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end, score) by kind, then start.

    Each kind is searched from the left without overlaps; a match that fails its
    checksum or limits is dropped and its characters are not searched again. Context
    changes a span's score and drops none, so a caller sets the least score to act on.
    Kinds beyond ``BASE_KINDS`` may overlap them. An account number has the length of
    its country, so what follows it is no part of it; other countries have none.

    NULL text counts as empty and gives an empty list; texts of any length are
    searched in whole, in time linear in their length. Other columns stay (``keep``
    names them, all by default), one named ``spans`` is replaced. Repeated rows each
    give a row, and an empty table gives no rows.
    """
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double")
    added = T.StructType().add(spans_name, T.ArrayType(span))
    return with_text_columns(docs, whole_text(F.col(f"`{text}`")), _compute, added, keep)
