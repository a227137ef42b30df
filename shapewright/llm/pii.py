"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Each kind has a linear-time pattern, a validator and words that speak for it. The kinds email, ip, card and phone are
the base: a match that passes its check is always a span. The other kinds need a score of `threshold`, which a
checksum or a context word gives.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import per_row, text_str

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "secret")
KINDS = BASE + MORE
ORDER = {k: i for i, k in enumerate(KINDS)}
THRESHOLD = 0.6

# Words near a span that raise its score.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "debit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "secret": ("token", "key", "secret", "password", "api", "credential"),
}
WINDOW = 40

# '@' is found first; the local part is the run of its characters that ends there
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is tried from its start only: if that fails, the rest of the run fails too
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|[0-9a-f]{40})(?![A-Za-z0-9])")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
NOT_DIGIT = re.compile("[^0-9]")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str):
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def context(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW // 2]
    return 0.35 if any(w.lower() in CONTEXT[kind] for w in WORD.findall(near)) else 0.0


def find(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans by start, then kind. Those of a kind don't overlap."""
    out: list[Span] = []

    def add(kind: str, start: int, end: int, base: float, least: float = 0.0) -> None:
        score = min(1.0, base + context(kind, text, start, end))
        if score >= least:
            out.append(Span(kind, start, end, score))

    if "@" in text:
        for s, e in emails(text):
            add("email", s, e, 0.6)
    if not re.search("[0-9]", text):
        pass
    else:
        for m in IP.finditer(text):
            if all(map(small, m[0].split("."))):
                add("ip", m.start(), m.end(), 0.5)
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                add("card", m.start(), m.end(), 0.6)
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    add("phone", m.start(), m.end(), 0.5)
        for m in IBAN.finditer(text):
            s = m[0].replace(" ", "")
            if 15 <= len(s) <= 34 and mod97(s):
                add("iban", m.start(), m.end(), 0.7, threshold)
        for m in SSN.finditer(text):
            add("ssn", m.start(), m.end(), 0.3, threshold)
        for m in SECRET.finditer(text):
            add("secret", m.start(), m.end(), 0.6 if m[0].startswith(("AKIA", "ghp_")) else 0.3, threshold)
    return sorted(out, key=lambda x: (x.start, ORDER[x.kind]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or group of overlapping spans, replaced by its (first) kind in brackets."""
    out, done = [], 0
    for x in spans:
        if x.start >= done:
            out += [text[done : x.start], f"[{x.kind.upper()}]"]
        done = max(done, x.end)
    return "".join(out) + text[done:] if out else text


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, counts of the base kinds, base_sha256, spans, and the lowest score of a span.

    Null and empty texts have no spans (the digest is that of an empty string; min_score is null). Repeated rows and
    null ids stay as they are; an empty table gives an empty table; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def fn():
        def work(batch):
            found = [find(t, threshold) for t in text_str(batch, text_col)]
            base = [[x for x in f if x.kind in BASE] for f in found]
            return {
                id_col: batch.column(id_col),
                **{f"n_{k}": [sum(x.kind == k for x in f) for f in base] for k in BASE},
                "base_sha256": [hashlib.sha256(written(f).encode()).hexdigest() for f in base],
                "spans": [written(f) for f in found],
                "min_score": [min((x.score for x in f), default=None) for f in found],
            }

        return work

    return per_row(docs, [id_col, text_col], f"`{id_col}` {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, min_score double", fn)


def redacted(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with the spans in text_col replaced; all other columns as they are, whatever their names, also if two share one.

    Null stays null and an empty text empty; repeated rows and null ids stay; an empty table gives an empty table.
    """
    from pyspark.sql import types as T

    text = docs.columns.index(text_col)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            new = [None if t is None else redact(t, find(t, threshold)) for t in b.column(text).to_pylist()]
            yield b.set_column(text, b.schema.field(text), pa.array(new, b.schema.field(text).type))

    return docs.toDF(*plain.names).mapInArrow(run, plain).toDF(*docs.columns)
