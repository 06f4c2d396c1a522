"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Kinds: ``email``, ``ip``, ``card`` (Luhn), ``phone``, and with a score from their surroundings
``iban`` (remainder 97) and ``ssn``. The first four are confirmed by their own rules alone and are
never dropped for a low score; ``iban`` and ``ssn`` must reach ``threshold``: a valid checksum and
words such as "account" near by raise the score, words such as "order" or "example" lower it.

Scale: one narrow pass (``mapInArrow``), whole texts, every pattern linear in the text.
Cases: null or empty text has no spans; null ids stay null; repeated rows give repeated results;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.text import blocks

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
SPAN = "struct<kind:string,start:int,end:int,score:double>"
SCHEMA = f"doc_id long, spans array<{SPAN}>, masked string"

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_SIGN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile(r"[0-9]")
# possessive digits and the look-behind change no match: a run of digits is taken whole or not at all
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
#: what follows the first four signs of a number of so many signs
IBAN_REST = {
    n: re.compile(rf"(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"\b") for n in range(34, 14, -1)
}
IBAN_LENGTHS = {
    code[:2]: int(code[2:])
    for code in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 "
        "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
        "LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 "
        "SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

CONTEXT = 48
NEAR = {
    "email": r"e-?mail|contact|write|reach",
    "ip": r"\bip\b|host|server|address",
    "card": r"card|visa|credit|payment",
    "phone": r"phone|call|tel\b|mobile|fax",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security",
}
AGAINST = r"order|invoice|serial|version|isbn|example|sample"
NEAR_WORDS = {k: re.compile(v, re.I) for k, v in NEAR.items()}
AGAINST_WORDS = re.compile(AGAINST, re.I)
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.6, "ssn": 0.3}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, walking from one @ to the next: a match is the longest run of local signs before it."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL_SIGN:
            start -= 1
        if start < at and (hit := DOMAIN.match(text, at + 1)):
            yield start, hit.end()
            past = hit.end()
        else:
            past = at + 1  # a run before a later @ cannot reach back over this one
        at = text.find("@", past)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans whose checksum holds: of the length of their country, else the longest; any length, longest first, for other countries."""
    hit = IBAN.search(text)
    while hit:
        start, past = hit.start(), hit.start() + 1
        own = IBAN_LENGTHS.get(text[start : start + 2])
        ends = {n: rest.end() for n, pattern in IBAN_REST.items() if (rest := pattern.match(text, hit.end()))}
        order = [n for n in (own, max(ends, default=None)) if n in ends] if own else ends
        for n in order:
            if mod97(text[start : ends[n]].replace(" ", "")):
                yield start, ends[n]
                past = ends[n]
                break
        hit = IBAN.search(text, past)


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """kind, start, end and whether a checksum confirmed it, before context is weighed."""
    for start, end in emails(text):
        yield "email", start, end, False
    if not DIGIT.search(text):
        return
    for hit in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in hit[0].split(".")):
            yield "ip", *hit.span(), False
    for hit in CARD.finditer(text):
        if hit.end() - hit.start() <= 37 and 12 <= len(d := only_digits(hit[0])) <= 19 and luhn(d):
            yield "card", *hit.span(), True
    if "+" in text:
        for hit in PHONE.finditer(text):
            if 9 <= len(only_digits(hit[0])) <= 15:
                yield "phone", *hit.span(), False
    for start, end in ibans(text):
        yield "iban", start, end, True
    for hit in SSN.finditer(text):
        if hit[0][:3] not in ("000", "666") and hit[0][0] != "9" and hit[0][4:6] != "00" and hit[0][7:] != "0000":
            yield "ssn", *hit.span(), False


def score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    around = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    value = PRIOR[kind] + 0.2 * confirmed
    value += 0.3 * bool(NEAR_WORDS[kind].search(around)) - 0.25 * bool(AGAINST_WORDS.search(around))
    return round(min(1.0, max(0.0, value)), 3)


def find_spans(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans by start, then kind in the order of KINDS, then end."""
    found = []
    for kind, start, end, confirmed in proposals(text or ""):
        value = score(text, kind, start, end, confirmed)
        if kind in BASE or value >= threshold:
            found.append((kind, start, end, value))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def mask(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with every span replaced by its kind; spans that overlap become one."""
    if not spans:
        return text
    parts, past, n = [], 0, 0
    while n < len(spans):
        kind, start, end, _ = spans[n]
        n += 1
        while n < len(spans) and spans[n][1] < end:
            end = max(end, spans[n][2])
            n += 1
        parts += [text[past:start], f"[{kind.upper()}]"]
        past = end
    return "".join(parts) + text[past:]


def find_pii(
    docs: DataFrame, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text", masked: bool = True
) -> DataFrame:
    """doc_id, spans (kind, start, end, score; code points, end exclusive) and the masked text."""

    def run(batches):
        for block in blocks(batches):
            spans, texts = [], []
            for text in block.column("text").to_pylist():
                found = find_spans(text, threshold)
                spans.append([dict(zip(("kind", "start", "end", "score"), s)) for s in found])
                texts.append(mask(text, found) if masked else None)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(spans, kind), pa.array(texts, pa.string())], ["doc_id", "spans", "masked"]
            )

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)


def mask_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The table ``docs`` with personal data in ``text`` replaced by its kind; all columns are kept as they are."""
    schema, names = docs.schema, docs.columns
    place = names.index("text")

    def run(batches):
        for block in blocks(batches):
            texts = [mask(t, find_spans(t, threshold)) for t in block.column(place).to_pylist()]
            columns = list(block.columns)
            columns[place] = pa.array(texts, block.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op8_pii(spark, sf):
    """Contract query: counts, digest of the four base kinds and all spans of every document."""
    found = find_pii(spark.read.parquet(f"{sf}/documents.parquet"), masked=False)

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
