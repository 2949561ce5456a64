"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are email, ip, card and phone, found leftmost and without overlap within a kind; what fails its check is dropped and not tried
again from a later start. Added kinds are iban (confirmed by mod-97, on its country's registered length or the whole run), ssn (area, group and
serial rules, and a context word must stand near) and mac. Every finder takes time in proportion to the text, also on adversarial ones: no start is tried twice for one run of characters.

Nulls and empty texts have no spans. Offsets are code points, ends exclusive. Equal texts give equal rows, so repeated rows are harmless;
columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import documents, map_rows

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "mac")
KINDS = BASE + ADDED

#: Score before context, and the least score of a span that is kept.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.35, "mac": 0.6}
KEEP_AT = 0.5
WINDOW = 48
NEAR = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security", "taxpayer"),
    "mac": ("mac", "ethernet", "device", "adapter"),
}
#: Words that speak for a number of another kind.
AGAINST = ("isbn", "version", "serial no", "part no", "invoice no", "order no")

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_MAC = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOUBLED = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    """The mod-10 checksum of payment cards."""
    n = [ord(c) - 48 for c in reversed(digits)]
    return (sum(n[::2]) + sum(_DOUBLED[d] for d in n[1::2])) % 10 == 0


#: Characters of an account number by country, after the IBAN registry.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LENGTH = {country: n for n, countries in _IBAN_LENGTHS.items() for country in countries.split()}


def mod97(iban: str) -> bool:
    """The ISO 7064 checksum of account numbers."""
    code = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.groups()):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """A run is cut to its country's length where that ends a word and passes, and else taken whole. The next start follows what was found, or
    is the next one in a run that failed; each start reads one run of bounded length."""
    m = _IBAN.search(text)
    while m:
        start, whole = m.span()
        at = [i for i in range(start, whole) if text[i] != " "]
        n = IBAN_LENGTH.get(text[start : start + 2], 0)
        ends = [at[n - 1] + 1] if 0 < n < len(at) and at[n] > at[n - 1] + 1 else []
        end = next((e for e in [*ends, whole] if 15 <= len(text[start:e].replace(" ", "")) <= 34 and mod97(text[start:e])), None)
        if end:
            yield start, end
        m = _IBAN.search(text, end or start + 4)


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns, "mac": lambda text: (m.span() for m in _MAC.finditer(text))}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The prior of its kind, raised by a word of the kind within WINDOW characters and lowered by one that speaks against it."""
    around = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
    return round(min(1.0, max(0.0, PRIOR[kind] + 0.2 * any(w in around for w in NEAR[kind]) - 0.3 * any(w in around for w in AGAINST))), 2)


def find(text: str) -> list[tuple[int, int, int, float]]:
    """(start, place of the kind in KINDS, end, score) of every span, in that order. Base spans stay whatever their score."""
    found = []
    digits = any(d in text for d in string.digits)
    for k, kind in enumerate(KINDS):
        if ("@" in text) if kind == "email" else ("+" in text) if kind == "phone" else (text.count(":") >= 5) if kind == "mac" else digits:
            for start, end in FINDERS[kind](text):
                s = score(text, kind, start, end)
                if kind in BASE or s >= KEEP_AT:
                    found.append((start, k, end, s))
    return sorted(found)


def joined(spans: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end, _ in spans)


def redact(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, done = [], 0
    for start, k, end, _ in find(text):
        if start >= done:
            out += [text[done:start], f"[{KINDS[k].upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text


def annotate(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with counts by base kind, the digest of base spans, all spans, their scores and the least score."""

    def make():
        def row(x: str) -> tuple:
            spans = find(x)
            base = [s for s in spans if s[1] < len(BASE)]
            counts = [0] * len(BASE)
            for s in base:
                counts[s[1]] += 1
            return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), ",".join(f"{s[3]:g}" for s in spans)

        return row

    return map_rows(df, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string", text)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with personal data in `text` replaced; null stays null. Columns keep their order, and n_chars follows a changed text."""
    columns, was, now = df.columns, "__pii_text", "__pii_new"
    out = map_rows(df.withColumn(was, F.col(text)), lambda: lambda x: (redact(x),), f"{now} string", was)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(text) == F.col(now), F.col("n_chars")).when(F.col(text).isNotNull(), F.char_length(now).cast(df.schema["n_chars"].dataType)))
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.col(now))).select(*columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(documents(spark, sf_dir, "doc_id", "text"))
