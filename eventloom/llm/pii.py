"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")  # in this order at equal starts; iban is what the method adds
BASE_KINDS = KINDS[:4]
# Words that raise the score of a kind when they stand within CONTEXT characters before a span, in four languages
CONTEXT = 48
CONTEXT_WORDS = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "servidor", "serveur", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefono", "teléfono", "téléphone", "telefon", "anruf"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
}
PROPOSED, CHECKED, NEARBY = 0.5, 0.35, 0.15

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of an account number: moved, spelled in digits, remainder 1."""
    rest = 0
    for c in code[4:] + code[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def emails(text: str):
    """Leftmost non-overlapping matches of local@domain, in linear time: the local part is the run before the sign."""
    low = at = 0
    while (at := text.find("@", at)) >= 0:
        got = _DOMAIN.match(text, at)
        start = at
        if got:
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
        if got and start < at:
            yield start, got.end()
            low = at = got.end()
        else:
            at += 1


def addresses(text: str):
    """Four numbers joined by dots; a run of more falls into fours from its start."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points by start, then kind as listed."""
    found = [("email", a, b, False) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", a, b, False) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end(), True))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    found.append(("phone", m.start(), m.end(), False))
        for m in _IBAN.finditer(text):
            code = m.group().replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                found.append(("iban", m.start(), m.end(), True))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    out = []
    for kind, a, b, checked in found:
        before = text[max(0, a - CONTEXT):a].lower()
        near = any(re.search(rf"\b{re.escape(w)}\b", before) for w in CONTEXT_WORDS[kind])
        out.append((kind, a, b, PROPOSED + CHECKED * checked + NEARBY * near))
    return out


def find(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end, score) of every whole text.

    Null and empty texts have an empty array. Every pattern runs in time linear in the text. Rows are independent: ties, repeated rows
    and other columns do not matter, and nothing is shuffled. Spans of the base kinds stay whatever their score; an account number is
    added only if its checksum holds.
    """
    @F.pandas_udf("array<struct<kind string, start int, end int, score double>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t)] if t else [] for t in texts])

    return docs.withColumn(name, spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text", at_least: float = PROPOSED) -> DataFrame:
    """``docs`` with every span of score ``at_least`` or more replaced by its kind in angle brackets."""
    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        def clean(t):
            if t is None:
                return None
            out, at = [], 0
            for kind, a, b, score in spans_of(t):
                if score >= at_least and b > at:
                    out += [t[at:max(a, at)], f"<{kind}>"]
                    at = b
            return "".join([*out, t[at:]])
        return texts.map(clean, na_action=None)

    return docs.withColumn(text, cleaned(F.col(text)))
