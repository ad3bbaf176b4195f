"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Base kinds (email, ip, card, phone) are found leftmost and non-overlapping within each kind;
a match that its validator refuses is dropped without another try, and a confirmed base span
always stays. The method adds IBANs (confirmed by mod 97), dashed national numbers and
credentials, which stay if pattern, checksum and nearby words together reach `min_score`.

Cases: a null or empty text has no spans; offsets are code points, ends exclusive; repeated
rows are searched one by one; an empty table gives an empty result; long texts are read whole,
and no pattern takes more than linear time in them. Numbers may have however many digits: parts of an
ip are compared as digits, not as numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, column

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: How many characters an IBAN has in each country that issues them.
_IBAN_SIZES = dict(
    x.split(":") for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30".split()
)
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|password=[^\s]+)")

#: Words that raise the score of a kind when one stands, as a whole word, within `reach` code points.
CONTEXT = {
    "email": "mail email e-mail contact write courriel correo kontakt",
    "ip": "address server host ip adresse serveur servidor",
    "card": "card visa credit payment carte tarjeta karte kreditkarte",
    "phone": "phone call tel mobile telephone telefon teléfono téléphone",
    "iban": "iban bank account konto banque banco compte cuenta",
    "national": "ssn social security national",
    "secret": "key secret password login token",
}
_CONTEXT = {k: re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(w) for w in words.split())})s?(?!\w)") for k, words in CONTEXT.items()}
#: What a pattern is worth alone, and with a checksum that holds.
PATTERN_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "national": 0.4, "secret": 0.6}
CHECKSUM_SCORE, CONTEXT_SCORE = 0.4, 0.2


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(text):  # the local part is the longest run before @, after the match before it
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A run of capitals and digits may go on after the number: whole groups are taken off its end until
    the country's length and mod 97 hold, and the search goes on behind the number, or within a refused run."""
    m = _IBAN.search(text)
    while m:
        end, size = m.end(), int(_IBAN_SIZES.get(m[0][:2], 0))
        while len(code := text[m.start() : end].replace(" ", "")) >= 15:
            if size in (0, len(code)) and mod97(code):
                break
            end = max(text.rfind(" ", m.start(), end), m.start())
        found = len(code) >= 15
        if found:
            yield m.start(), end
        m = _IBAN.search(text, end if found else m.start() + 1)


def _proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """kind, start, end and whether a checksum has confirmed it; what a validator refuses is left out."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e, False
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in (x.lstrip("0") for x in m[0].split("."))):
                yield "ip", *m.span(), False
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span(), True
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    yield "phone", *m.span(), False
        for s, e in _ibans(text):
            yield "iban", s, e, True
        if "-" in text:
            for m in _NATIONAL.finditer(text):
                yield "national", *m.span(), False
    if "AKIA" in text or "password=" in text:
        for m in _SECRET.finditer(text):
            yield "secret", *m.span(), False


def find_spans(text: str, min_score: float = 0.6, reach: int = 40) -> list[Span]:
    """All spans of a text, by start, then kind as listed in KINDS."""
    spans = []
    for kind, start, end, confirmed in _proposed(text):
        score = PATTERN_SCORE[kind] + CHECKSUM_SCORE * confirmed
        # one more character on either side shows whether a word at the rim is whole
        before, after = text[max(0, start - reach - 1) : start].lower(), text[end : end + reach + 1].lower()
        score += CONTEXT_SCORE * any(_CONTEXT[kind].search(x) is not None for x in (before, after))
        if kind in BASE or score >= min_score:
            spans.append(Span(kind, start, end, round(min(score, 1.0), 3)))
    return sorted(spans, key=lambda s: (s.start, ORDER[s.kind]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def mask(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for i, s in enumerate(spans):
        if s.end <= at:
            continue
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = s.end
    return "".join([*out, text[at:]])


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    for batch in batches:
        found = [find_spans(x.as_py()) for x in column(batch, "text")]
        rest = batch.drop_columns(["text"])
        spans = pa.array([[s._asdict() for s in x] for x in found], pa.list_(kind))
        sha = pa.array([hashlib.sha256(joined([s for s in x if s.kind in BASE]).encode()).hexdigest() for x in found], pa.string())
        yield pa.RecordBatch.from_arrays([*rest.columns, spans, sha], names=[*rest.schema.names, "found", "base_sha256"])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, found (array of kind, start, end, score) and base_sha256 of every row of docs, in one scan."""
    slim = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("found", T.ArrayType(_SPAN)), T.StructField("base_sha256", T.StringType())])
    return slim.mapInArrow(_found, schema)


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array) -> pa.Array:
    return pa.array((x if x is None else mask(x, find_spans(x)) for x in texts.to_pylist()), pa.string())


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with the spans of each text masked and n_chars, where there is one, counted anew; a null text stays null."""
    masked = bounded(docs).withColumn("text", _masked(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select([F.col(f"`{c}`") for c in docs.columns])
