"""RDF terms as canonical N-Triples strings ("keys"): equal terms have equal keys, in Python and in DataFrames."""

from __future__ import annotations

import re
from typing import NamedTuple

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
SHNEX = "http://www.w3.org/ns/shacl-node-expr#"
SPARQL = "http://www.w3.org/ns/sparql#"
OWL = "http://www.w3.org/2002/07/owl#"


def iri(text: str) -> str:
    return f"<{text}>"


def rdf(x: str) -> str:
    return f"<{RDF}{x}>"


def rdfs(x: str) -> str:
    return f"<{RDFS}{x}>"


def sh(x: str) -> str:
    return f"<{SH}{x}>"


def shnex(x: str) -> str:
    return f"<{SHNEX}{x}>"


def xsd(x: str) -> str:
    return f"<{XSD}{x}>"


TYPE, FIRST, REST, NIL, REIFIES = rdf("type"), rdf("first"), rdf("rest"), rdf("nil"), rdf("reifies")
SUBCLASS = rdfs("subClassOf")
XSD_STRING, LANG_STRING, DIR_STRING = XSD + "string", RDF + "langString", RDF + "dirLangString"

# Fixed values of N-Triples: what is escaped in a literal.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
UNESCAPES = {v[1]: k for k, v in ESCAPES.items()} | {"'": "'"}
_ESC = re.compile(r'[\\"\n\r\t\x08\x0c]')
_UNESC = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+?)(?:--(ltr|rtl))?)?$', re.S)


def escape(text: str) -> str:
    return _ESC.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _UNESC.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else UNESCAPES.get(m[1], m[1]), text)


def literal(lex: str, dt: str | None = None, lang: str | None = None, direction: str | None = None) -> str:
    body = f'"{escape(lex)}"'
    if lang:
        return f"{body}@{lang.lower()}" + (f"--{direction}" if direction else "")
    return body if not dt or dt == XSD_STRING else f"{body}^^<{dt}>"


def triple_term(s: str, p: str, o: str) -> str:
    return f"<<( {s} {p} {o} )>>"


class Parts(NamedTuple):
    kind: str  # I, B, L or T
    lex: str
    dt: str | None = None
    lang: str | None = None
    dir: str | None = None


def parts(key: str) -> Parts:
    if key.startswith("<<("):
        return Parts("T", key)
    if key.startswith("<"):
        return Parts("I", key[1:-1])
    if key.startswith("_:"):
        return Parts("B", key[2:])
    m = _LITERAL.match(key)
    if not m:
        raise ValueError(f"not a term: {key!r}")
    dt = m[2] or (DIR_STRING if m[4] else LANG_STRING if m[3] else XSD_STRING)
    return Parts("L", unescape(m[1]), dt, m[3], m[4])


def is_iri(key: str) -> bool:
    return key.startswith("<") and not key.startswith("<<(")


def is_blank(key: str) -> bool:
    return key.startswith("_:")


def is_literal(key: str) -> bool:
    return key.startswith('"')


def local(key: str) -> str:
    return re.split(r"[#/]", key.strip("<>"))[-1]


class ShapeError(ValueError):
    """The shapes graph, a path, a query or an expression is malformed."""


class ParseError(ValueError):
    """A document is malformed."""


class Triples:
    """A small in-memory graph, for shapes."""

    def __init__(self, triples=()):
        self.rows: list[tuple[str, str, str]] = []
        self.sp: dict[tuple[str, str], list[str]] = {}
        self.po: dict[tuple[str, str], list[str]] = {}
        self.s: dict[str, list[tuple[str, str]]] = {}
        self.p: dict[str, list[tuple[str, str]]] = {}
        self.set: set[tuple[str, str, str]] = set()
        for t in triples:
            self.add(t)

    def add(self, t: tuple[str, str, str]) -> None:
        if t in self.set:
            return
        self.set.add(t)
        self.rows.append(t)
        s, p, o = t
        self.sp.setdefault((s, p), []).append(o)
        self.po.setdefault((p, o), []).append(s)
        self.s.setdefault(s, []).append((p, o))
        self.p.setdefault(p, []).append((s, o))

    def objects(self, s: str, p: str) -> list[str]:
        return self.sp.get((s, p), [])

    def object(self, s: str, p: str) -> str | None:
        found = self.objects(s, p)
        return found[0] if found else None

    def subjects(self, p: str, o: str) -> list[str]:
        return self.po.get((p, o), [])

    def list(self, head: str) -> list[str] | None:
        """The members of an RDF list; None if it is malformed or cyclic."""
        out, seen = [], set()
        while head != NIL:
            first, rest = self.objects(head, FIRST), self.objects(head, REST)
            if head in seen or len(first) != 1 or len(rest) != 1:
                return None
            seen.add(head)
            out.append(first[0])
            head = rest[0]
        return out

    def __len__(self) -> int:
        return len(self.rows)
