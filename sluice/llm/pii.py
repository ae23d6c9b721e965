"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import aside, others, restored, ship

#: Kinds in their order; the first four are always reported once their check holds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone", "access_key", "secret")
#: Score of a confirmed span before its context, by kind; base kinds stand above the threshold.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "local_phone": 0.3, "access_key": 0.9, "secret": 0.3}
THRESHOLD = 0.5
#: Added to the score if one of the kind's words stands near.
CONTEXT_BONUS = 0.35
#: Code points before and after a span that are searched for context words.
BEFORE, AFTER = 48, 16
CONTEXT = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "whatsapp"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "whatsapp", "telefon"},
    "access_key": {"key", "aws", "access"},
    "secret": {"token", "secret", "password", "passwd", "apikey", "api_key", "key", "bearer"},
}

LOCAL_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}((?: ?[A-Z0-9]){11,30}))")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
_ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_-]{24,}+")
_WORD = re.compile(r"[a-z_]+")
#: Characters of an account number by the country that it begins with.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20,
    "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """An account number's check: letters become two digits, the remainder by 97 is 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        value = int(c, 36)
        rest = (rest * (10 if value < 10 else 100) + value) % 97
    return rest == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with a name before and a dotted domain behind it; time grows with the text."""
    done, last, at = 0, -1, text.find("@")
    while at >= 0:
        begin = max(done, last + 1)
        if begin < at and (name := at - begin - len(text[begin:at].rstrip(LOCAL_CHARS))) and (m := _DOMAIN.match(text, at + 1)):
            yield at - name, m.end()
            done = m.end()
        last, at = at, text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, whatever word or number follows: as long as their country's are, or up to the last word's end where mod 97 holds."""
    done = 0
    for m in _IBAN.finditer(text):
        start = m.start()
        if start < done:
            continue
        ends = [i + 1 for i in range(start, m.end(1)) if text[i] != " "]
        known = IBAN_LENGTHS.get(text[start : start + 2])
        for n in (known,) if known else range(len(ends), 14, -1):
            if n > len(ends) or _ALNUM.match(text, end := ends[n - 1]) or not mod97(text[start:end].replace(" ", "")):
                continue
            yield start, end
            done = end
            break


def _octets(ip: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in ip.split("."))


def _ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose pattern and check hold."""
    yield from (("email", *s) for s in emails(text))
    if not _DIGIT.search(text):
        return
    yield from (("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0]))
    yield from (("card", *m.span()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d))
    if "+" in text:
        yield from (("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)
    yield from (("iban", *s) for s in ibans(text))
    yield from (("ssn", *m.span()) for m in _SSN.finditer(text) if _ssn(m[0]))
    yield from (("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text))
    yield from (("access_key", *m.span()) for m in _ACCESS_KEY.finditer(text))
    yield from (("secret", *m.span()) for m in _SECRET.finditer(text) if _DIGIT.search(m[0]))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end in code points, score) by start, then kind."""
    text, out = text or "", []
    base: list[tuple[int, int]] = []
    for kind, start, end in _proposals(text):
        near = set(_WORD.findall(text[max(0, start - BEFORE) : start].lower())) | set(_WORD.findall(text[end : end + AFTER].lower()))
        score = min(1.0, SCORES[kind] + CONTEXT_BONUS * bool(near & CONTEXT[kind]))
        if kind in BASE_KINDS:
            base.append((start, end))
        elif score < THRESHOLD or any(start < e and s < end for s, e in base):
            continue
        out.append((kind, start, end, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def spans_column(text: Column) -> Column:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, SPANS)(text)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``spans``: the personal data in each whole text.

    E-mail addresses, IP addresses, card numbers and international phone
    numbers are reported whenever their pattern and check (octets, Luhn,
    number of digits) hold.  The method adds account numbers (their country's
    length, mod 97), access keys, and, where the score with nearby words reaches ``THRESHOLD``, social
    security numbers, local phone numbers and secrets; these never overlap a
    base span.  A map over rows: no shuffle.

    Cases: a null or empty text has no spans; spans of different kinds may
    overlap; repeated rows are searched each; an input column named ``spans``
    is replaced, and no other name matters; no rows give no rows.
    """
    ship(docs.sparkSession)
    docs, renamed = aside(docs, "_spans")
    found = docs.withColumn("_spans", spans_column(F.col(renamed.get(text_col, text_col))))
    return restored(found.select(*others(docs, "spans"), F.col("_spans").alias("spans")), renamed)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
