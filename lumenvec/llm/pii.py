"""Personal data: patterns propose spans, checksums confirm, context adjusts the score.

Base kinds are email, ip, card and phone; every base span is reported whatever
its score.  Beyond them the method adds ``iban`` (mod-97, tried at each border
of a group), ``short_card`` (13 to 15 digits, Luhn, kept only near a payment
word) and ``secret`` (a quoted run of 32 or more key characters, confirmed by
its entropy, kept unless it looks regular and no word near speaks of a key).

All patterns run in time linear in the text: runs of digits or word characters
are taken possessively and an address is found from its ``@`` outwards, so a
megabyte of digits costs one pass.

Edge cases: null and empty texts have no spans; repeated rows are scanned
each on its own; a null id stays null; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import arrow_map, pick

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "short_card", "secret")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"""(?<=["'])[A-Za-z0-9+/_=-]{32,}+(?=["'])""")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
#: Characters of an IBAN by country.
_IBAN_LENGTHS = {
    part[:2]: int(part[2:])
    for part in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 "
        "FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
        "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 "
        "SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SEPARATORS = str.maketrans("", "", " -")

#: Score of a span before its context, and words that raise it when near.
_START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "short_card": 0.4, "secret": 0.4}
_CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "short_card": ("card", "amex", "credit", "payment", "pay"),
    "secret": ("key", "token", "secret", "password", "credential", "auth"),
}
#: Bits a character of a secret has at least, and those that need no word near.
_ENTROPY, _SURE_ENTROPY = 2.5, 3.2
_NEAR = 48
_RAISE = 0.2
KEEP_SCORE = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _ibans(text: str):
    """Of the ends at a border of a group that pass mod-97, that of the country's length, else the last.

    The search goes on behind an IBAN, and one character on where none begins.
    """
    at = 0
    while m := _IBAN.search(text, at):
        start, at = m.start(), m.start() + 1
        rest = _IBAN_REST.match(text, m.end())
        passed = {}
        for end in range(rest.end() if rest else 0, m.end(), -1):
            if text[end - 1] == " " or text[end : end + 1] in _ALNUM:
                continue
            compact = text[start:end].replace(" ", "")
            if len(compact) >= 15 and mod97(compact):
                passed[len(compact)] = end
        if passed:
            at = passed.get(_IBAN_LENGTHS.get(text[start : start + 2]), max(passed.values()))
            yield start, at


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        after = at + 1
        if domain := _DOMAIN.match(text, after):
            before = text[done:at]
            start = done + len(before.rstrip(_LOCAL))
            if start < at:
                yield start, domain.end()
                done = after = domain.end()
            else:
                done = after
        else:
            done = after
        at = text.find("@", after)


def entropy(text: str) -> float:
    """Bits a character, by the characters' own shares."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values())


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _near(text: str, kind: str, start: int, end: int) -> bool:
    window = f"{text[max(0, start - _NEAR) : start]} {text[end : end + _NEAR]}".lower()
    return any(w in _CONTEXT[kind] for w in re.findall(r"[a-z]+", window))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start, in code points, end exclusive."""
    text = text or ""
    found: list[tuple[str, int, int]] = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    short = []
    for m in _DIGITS.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].translate(_SEPARATORS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                (found if len(digits) >= 16 else short).append(
                    ("card" if len(digits) >= 16 else "short_card", *m.span())
                )
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    found += [("iban", *span) for span in _ibans(text)]
    bits = {m.span(): entropy(m[0]) for m in _SECRET.finditer(text) if any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0]))}
    short += [("secret", *span) for span, e in bits.items() if e >= _ENTROPY]
    out = []
    for kind, a, b in found + short:
        sure = kind == "secret" and bits[a, b] >= _SURE_ENTROPY
        score = round(min(1.0, _START[kind] + _RAISE * (_near(text, kind, a, b) + sure)), 2)
        if kind in BASE_KINDS or score >= KEEP_SCORE:
            out.append((kind, a, b, score))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``spans`` array<struct<kind,start,end,score>>."""

    def rows(cols):
        return {
            "id": cols["id"],
            "spans": [
                [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t)]
                for t in cols["text"]
            ],
        }

    source = pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    return arrow_map(source, rows, schema).withColumnRenamed("id", id_col)


def _ordered(found: list[tuple], kinds: tuple[str, ...]) -> list[tuple]:
    order = {k: i for i, k in enumerate(kinds)}
    return sorted((s for s in found if s[0] in order), key=lambda s: (order[s[0]], s[1], s[2]))


def joined(found: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in found)


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest, spans and scores per document, from one pass over each text.

    base_sha256 digests the base kinds' spans; spans and scores list all kinds
    in one order; n_spans counts them.
    """

    def rows(cols):
        names = (*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "scores", "n_spans")
        out = {k: [] for k in names}
        for text in cols["text"]:
            found = spans(text)
            base, every = _ordered(found, BASE_KINDS), _ordered(found, KINDS)
            counts = Counter(s[0] for s in base)
            row = (*(counts[k] for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), ",".join(f"{s[3]:.2f}" for s in every), len(every))
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        return {"id": cols["id"], **out}

    source = pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores string, n_spans bigint"
    return arrow_map(source, rows, schema).withColumnRenamed("id", id_col)
