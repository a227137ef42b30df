"""Parsers of RDF text: Turtle, TriG, N-Triples, N-Quads, N3 (its Turtle part), RDF/XML and JSON-LD (a subset).

Each yields triples of keys. Graph names are read and dropped: named graphs flatten into the default one.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from ..terms import FIRST, LANG_STRING, NIL, RDF, REIFIES, REST, TYPE, XSD, ParseError, iri, literal, triple_term, unescape

Triple = tuple[str, str, str]
# File extensions and their syntaxes.
FORMATS = {"ttl": "turtle", "turtle": "turtle", "nt": "ntriples", "nq": "nquads", "trig": "trig", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "jsonld": "jsonld", "json": "jsonld", "n3": "n3"}


def format_of(path: str) -> str | None:
    name = path.lower()
    if name.endswith(".gz"):
        name = name[:-3]
    return FORMATS.get(name.rpartition(".")[2])


def base_of(path: str) -> str:
    return "file://" + urllib.parse.quote(os.path.abspath(path))


TOKEN = re.compile(
    r"""(?P<ws>[ \t\r\n]+|\#[^\n]*)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<open><<\(?)(?=\s|[^<>\s"{}|^`\\]*[\s<_:])
    |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<close>\)?>>)
    |(?P<annot>\{\||\|\})
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[a-z]+)?)
    |(?P<dtype>\^\^)
    |(?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
    |(?P<double>[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+)
    |(?P<decimal>[+-]?[0-9]*\.[0-9]+)
    |(?P<integer>[+-]?[0-9]+)
    |(?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<punct>[.;,\[\](){}~=])""",
    re.X | re.S,
)


class Turtle:
    """Recursive descent over Turtle 1.2 and TriG."""

    def __init__(self, text: str, base: str = "", scope: str = "0", prefixes: dict[str, str] | None = None):
        self.text, self.base, self.scope = text, base, scope
        self.prefixes = dict(prefixes or {})
        self.labels: dict[str, str] = {}
        self.count = 0
        self.out: list[Triple] = []
        self.pos, self.kind, self.value = 0, "", ""
        self.advance()

    def fail(self, what: str) -> None:
        line = self.text.count("\n", 0, self.pos) + 1
        raise ParseError(f"line {line}: {what}, at {self.value[:40]!r}")

    def advance(self) -> None:
        while True:
            if self.pos >= len(self.text):
                self.kind, self.value = "end", ""
                return
            m = TOKEN.match(self.text, self.pos)
            if not m:
                self.value = self.text[self.pos : self.pos + 20]
                self.fail("unreadable text")
            self.pos = m.end()
            if m.lastgroup != "ws":
                self.kind, self.value = m.lastgroup, m[0]
                return

    def take(self, value: str) -> bool:
        if self.value == value and self.kind in ("punct", "annot", "open", "close", "dtype"):
            self.advance()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value!r}")

    def new_blank(self) -> str:
        self.count += 1
        return f"_:{self.scope}b{self.count}"

    def resolve(self, text: str) -> str:
        text = unescape(text)
        return text if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text) else join_iri(self.base, text)

    def emit(self, s: str, p: str, o: str) -> None:
        self.out.append((s, p, o))

    def word(self, *names: str) -> bool:
        if self.kind == "word" and self.value.lower() in names or self.kind == "lang" and self.value[1:].lower() in names:
            return True
        return False

    def document(self) -> list[Triple]:
        while self.kind != "end":
            if self.word("prefix", "base", "version"):
                self.directive()
            else:
                self.block()
        return self.out

    def directive(self) -> None:
        dotted, name = self.kind == "lang", self.value.lstrip("@").lower()
        self.advance()
        if name == "prefix":
            if self.kind != "name" or not self.value.endswith(":"):
                self.fail("expected a prefix")
            prefix = self.value[:-1]
            self.advance()
            self.prefixes[prefix] = self.iri_ref()
        elif name == "base":
            self.base = self.iri_ref()
        else:
            self.advance()
        if dotted:
            self.expect(".")
        else:
            self.take(".")

    def iri_ref(self) -> str:
        if self.kind != "iri":
            self.fail("expected an IRI")
        out = self.resolve(self.value[1:-1])
        self.advance()
        return out

    def block(self) -> None:
        if self.word("graph"):
            self.advance()
            self.subject()
            self.graph()
        elif self.value == "{" and self.kind == "punct":
            self.graph()
        else:
            bare = self.value == "[" and self.kind == "punct"
            reified = self.kind == "open" and self.value == "<<"
            before = len(self.out)
            s = self.subject()
            if self.value == "{" and self.kind == "punct":
                self.graph()
                return
            if not ((bare and len(self.out) > before or reified) and self.value == "."):
                self.predicates(s)
            if self.kind == "iri" or self.kind == "name" or self.kind == "blank":
                self.subject()  # N-Quads: the graph
            self.expect(".")

    def graph(self) -> None:
        self.expect("{")
        while not self.take("}"):
            bare = self.value == "["
            before = len(self.out)
            s = self.subject()
            if not (bare and len(self.out) > before and self.value in (".", "}")):
                self.predicates(s)
            if self.value != "}":
                self.expect(".")
        self.take(".")

    def predicates(self, s: str) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.term()
                self.emit(s, p, o)
                self.annotations(s, p, o)
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.value in (".", "]", "}", "|}") or self.kind == "end":
                return

    def annotations(self, s: str, p: str, o: str) -> None:
        reifier = None
        while True:
            if self.take("~"):
                reifier = self.term() if self.kind in ("iri", "name", "blank") or self.value == "[" else self.new_blank()
                self.emit(reifier, REIFIES, triple_term(s, p, o))
            elif self.take("{|"):
                if reifier is None:
                    reifier = self.new_blank()
                    self.emit(reifier, REIFIES, triple_term(s, p, o))
                self.predicates(reifier)
                self.expect("|}")
                reifier = None
            else:
                return

    def verb(self) -> str:
        if self.kind == "word" and self.value == "a":
            self.advance()
            return TYPE
        if self.kind not in ("iri", "name"):
            self.fail("expected a predicate")
        return self.term()

    def subject(self) -> str:
        if self.kind in ("string", "long", "integer", "decimal", "double"):
            self.fail("a literal can't be a subject")
        return self.term()

    def term(self) -> str:
        kind, value = self.kind, self.value
        if kind == "iri":
            return iri(self.iri_ref())
        if kind == "name":
            self.advance()
            prefix, _, name = value.partition(":")
            if prefix not in self.prefixes:
                self.fail(f"unknown prefix {prefix!r}")
            return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", name))
        if kind == "blank":
            self.advance()
            if value not in self.labels:
                self.labels[value] = self.new_blank()
            return self.labels[value]
        if kind in ("string", "long"):
            self.advance()
            cut = 3 if kind == "long" else 1
            lex = unescape(value[cut:-cut])
            if self.kind == "lang":
                tag, _, direction = self.value[1:].partition("--")
                self.advance()
                return literal(lex, LANG_STRING, tag, direction or None)
            if self.take("^^"):
                return literal(lex, self.term()[1:-1])
            return literal(lex)
        if kind in ("integer", "decimal", "double"):
            self.advance()
            return literal(value, XSD + kind)
        if kind == "word" and value in ("true", "false"):
            self.advance()
            return literal(value, XSD + "boolean")
        if self.take("["):
            node = self.new_blank()
            if not self.take("]"):
                self.predicates(node)
                self.expect("]")
            return node
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.term())
            head = NIL
            for x in reversed(items):
                node = self.new_blank()
                self.emit(node, FIRST, x)
                self.emit(node, REST, head)
                head = node
            return head
        if kind == "open":
            self.advance()
            s, p, o = self.term(), self.verb(), self.term()
            if value == "<<(":
                self.expect(")>>")
                return triple_term(s, p, o)
            reifier = None
            if self.take("~"):
                reifier = self.term() if self.kind in ("iri", "name", "blank") else self.new_blank()
            self.expect(">>")
            reifier = reifier or self.new_blank()
            self.emit(reifier, REIFIES, triple_term(s, p, o))
            return reifier
        self.fail("expected a term")
        raise AssertionError


def join_iri(base: str, ref: str) -> str:
    if not base:
        return ref
    if not ref:
        return base.partition("#")[0]
    if ref.startswith("#"):
        return base.partition("#")[0] + ref
    scheme, sep, rest = base.partition("://")
    if not sep:
        return urllib.parse.urljoin(base, ref)
    # urljoin knows few schemes; http stands in for the base's own
    out = urllib.parse.urljoin("http://" + (rest or "x"), ref)
    return scheme + out[4:] if out.startswith("http://") else out


def parse_rdfxml(text: str, base: str, scope: str) -> list[Triple]:
    out: list[Triple] = []
    labels: dict[str, str] = {}
    count = [0]
    xml = "{http://www.w3.org/XML/1998/namespace}"

    def blank(label: str | None = None) -> str:
        if label is not None and label in labels:
            return labels[label]
        count[0] += 1
        key = f"_:{scope}b{count[0]}"
        if label is not None:
            labels[label] = key
        return key

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def node(e: ET.Element, base: str, lang: str) -> str:
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang)
        a = {k[len(RDF) + 2 :]: v for k, v in e.attrib.items() if k.startswith("{" + RDF + "}")}
        s = iri(join_iri(base, a["about"])) if "about" in a else iri(join_iri(base, "#" + a["ID"])) if "ID" in a else blank(a.get("nodeID"))
        if name(e.tag) != RDF + "Description":
            out.append((s, TYPE, iri(name(e.tag))))
        for k, v in e.attrib.items():
            if not k.startswith(("{" + RDF + "}about", "{" + RDF + "}ID", "{" + RDF + "}nodeID", xml)):
                out.append((s, TYPE, iri(join_iri(base, v))) if name(k) == RDF + "type" else (s, iri(name(k)), literal(v, None, lang or None)))
        n = 0
        for c in e:
            p = name(c.tag)
            if p == RDF + "li":
                n += 1
                p = f"{RDF}_{n}"
            prop(s, iri(p), c, base, lang)
        return s

    def prop(s: str, p: str, e: ET.Element, base: str, lang: str) -> None:
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang)
        a = {k[len(RDF) + 2 :]: v for k, v in e.attrib.items() if k.startswith("{" + RDF + "}")}
        kind = a.get("parseType")
        if kind == "Literal":
            o = literal((e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), RDF + "XMLLiteral")
        elif kind == "Collection":
            o, head = NIL, [node(c, base, lang) for c in e]
            for x in reversed(head):
                b = blank()
                out.extend([(b, FIRST, x), (b, REST, o)])
                o = b
        elif kind == "Resource":
            o = blank()
            for c in e:
                prop(o, iri(name(c.tag)), c, base, lang)
        elif len(e):
            o = node(e[0], base, lang)
        elif "resource" in a or "nodeID" in a:
            o = iri(join_iri(base, a["resource"])) if "resource" in a else blank(a["nodeID"])
        else:
            extra = [(k, v) for k, v in e.attrib.items() if not k.startswith(("{" + RDF + "}", xml))]
            if extra:
                o = blank()
                out.extend((o, iri(name(k)), literal(v, None, lang or None)) for k, v in extra)
            else:
                o = literal(e.text or "", a.get("datatype"), None if "datatype" in a else lang or None)
        out.append((s, p, o))
        if "ID" in a:
            r = iri(join_iri(base, "#" + a["ID"]))
            out.extend([(r, TYPE, iri(RDF + "Statement")), (r, iri(RDF + "subject"), s), (r, iri(RDF + "predicate"), p), (r, iri(RDF + "object"), o)])

    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ParseError(str(e)) from e
    base = root.get(xml + "base", base)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e, base, root.get(xml + "lang", ""))
    return out


def parse_jsonld(text: str, base: str, scope: str) -> list[Triple]:
    """Inline contexts with terms, prefixes, @vocab, @base, @language, @type coercion and containers @list, @set, @language; @graph, @list, @reverse."""
    out: list[Triple] = []
    labels: dict[str, str] = {}
    count = [0]

    def blank(label: str | None = None) -> str:
        if label in labels:
            return labels[label]
        count[0] += 1
        key = f"_:{scope}b{count[0]}"
        if label:
            labels[label] = key
        return key

    def extend(ctx: dict, more) -> dict:
        if isinstance(more, list):
            for m in more:
                ctx = extend(ctx, m)
            return ctx
        if more is None:
            return {"@base": base}
        if isinstance(more, str):
            raise ParseError(f"remote context {more!r}")
        return ctx | more

    def expand(name: str, ctx: dict, vocab: bool, depth: int = 0) -> str:
        if name.startswith("@") or depth > 8:
            return name
        if vocab and name in ctx and ctx[name] is not None:
            d = ctx[name]
            to = d if isinstance(d, str) else d.get("@id", name)
            if to != name:
                return expand(to, ctx, True, depth + 1)
        if ":" in name:
            prefix, _, rest = name.partition(":")
            if prefix == "_" or rest.startswith("//"):
                return name
            d = ctx.get(prefix)
            if d is not None:
                return expand(d if isinstance(d, str) else d.get("@id", prefix), ctx, True, depth + 1) + rest
            return name
        if vocab:
            return ctx["@vocab"] + name if ctx.get("@vocab") else ""
        return join_iri(ctx.get("@base") or base, name)

    def ref(x: str, ctx: dict, vocab: bool = False) -> str:
        x = expand(x, ctx, vocab)
        return blank(x) if x.startswith("_:") else iri(x)

    def value(x, ctx: dict, d: dict) -> str | None:
        kind = d.get("@type")
        if isinstance(x, dict):
            if "@value" in x:
                v, t, lang = x["@value"], x.get("@type"), x.get("@language")
                return plain(v, expand(t, ctx, True) if t else None, lang, x.get("@direction"))
            if "@list" in x:
                return listed(x["@list"], ctx, d)
            if "@set" in x:
                raise ParseError("nested @set")
            return node(x, ctx)
        if x is None:
            return None
        if isinstance(x, str) and kind in ("@id", "@vocab"):
            return ref(x, ctx, kind == "@vocab")
        lang = d["@language"] if "@language" in d else ctx.get("@language")
        return plain(x, expand(kind, ctx, True) if kind and kind != "@none" else None, lang if isinstance(x, str) else None)

    def plain(v, dt: str | None, lang: str | None, direction: str | None = None) -> str:
        if isinstance(v, bool):
            return literal(str(v).lower(), dt or XSD + "boolean")
        if isinstance(v, int):
            return literal(str(v), dt or XSD + "integer")
        if isinstance(v, float):
            if v == int(v) and abs(v) < 1e21 and dt != XSD + "double":
                return literal(str(int(v)), dt or XSD + "integer")
            m, e = f"{v:.15E}".split("E")
            return literal(f"{m.rstrip('0').rstrip('.') + ('.0' if '.' not in m.rstrip('0').rstrip('.') else '')}E{int(e)}", dt or XSD + "double")
        return literal(v, dt, None if dt else lang, direction)

    def listed(items, ctx: dict, d: dict) -> str:
        head = NIL
        for x in reversed(items if isinstance(items, list) else [items]):
            v = value(x, ctx, d)
            if v is not None:
                b = blank()
                out.extend([(b, FIRST, v), (b, REST, head)])
                head = b
        return head

    def node(x: dict, ctx: dict) -> str:
        if "@context" in x:
            ctx = extend(ctx, x["@context"])
        keys = {k: expand(k, ctx, True) for k in x}
        own = next((x[k] for k, v in keys.items() if v == "@id"), None)
        s = ref(own, ctx) if own is not None else blank()
        for k, v in x.items():
            p, d = keys[k], ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            if p == "@type":
                out.extend((s, TYPE, ref(t, ctx, True)) for t in (v if isinstance(v, list) else [v]))
            elif p == "@graph":
                for g in v if isinstance(v, list) else [v]:
                    node(g, ctx)
            elif p == "@reverse":
                for q, os_ in v.items():
                    for o in os_ if isinstance(os_, list) else [os_]:
                        out.append((value(o, ctx, {"@type": "@id"}), iri(expand(q, ctx, True)), s))
            elif p and not p.startswith("@"):
                box = d.get("@container")
                if box == "@list":
                    out.append((s, iri(p), listed(v, ctx, d)))
                elif box == "@language" and isinstance(v, dict):
                    for lang, texts in v.items():
                        out.extend((s, iri(p), literal(t, None, None if lang == "@none" else lang)) for t in (texts if isinstance(texts, list) else [texts]))
                else:
                    for o in v["@set"] if isinstance(v, dict) and "@set" in v else v if isinstance(v, list) else [v]:
                        if (t := value(o, ctx, d)) is not None:
                            out.append((t, iri(p), s) if "@reverse" in d else (s, iri(p), t))
        return s

    try:
        data = json.loads(text)
    except ValueError as e:
        raise ParseError(str(e)) from e
    for x in data if isinstance(data, list) else [data]:
        ctx = extend({"@base": base}, x.get("@context", {}))
        if set(x) <= {"@context", "@graph"}:
            for g in x.get("@graph", []) if isinstance(x.get("@graph"), list) else [x["@graph"]] if "@graph" in x else []:
                node(g, ctx)
        else:
            node(x, ctx)
    return out


def parse(text: str, syntax: str = "turtle", base: str = "", scope: str = "0") -> list[Triple]:
    if syntax in ("turtle", "trig", "ntriples", "nquads", "n3"):
        return Turtle(text, base, scope).document()
    if syntax == "rdfxml":
        return parse_rdfxml(text, base, scope)
    if syntax == "jsonld":
        return parse_jsonld(text, base, scope)
    raise ParseError(f"unknown syntax {syntax!r}")


def read(path: str) -> str:
    with open(path, "rb") as f:
        data = f.read()
    return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8-sig")


def parse_file(path: str, syntax: str | None = None, scope: str = "0") -> list[Triple]:
    syntax = syntax or format_of(path)
    if not syntax:
        raise ParseError(f"{path}: the syntax can't be told from the name")
    return parse(read(path), syntax, base_of(path), scope)


def statements(text: str, parts: int) -> tuple[str, list[str]] | None:
    """(directives, chunks) of a Turtle text cut at ends of statements, if it is safe to parse them apart.

    It is if all directives come first and no blank label or anonymous node is shared (labels would need one scope).
    """
    if "_:" in text:
        return None
    head = re.match(r"(?:\s+|#[^\n]*\n|@prefix[^\n]*\n|@base[^\n]*\n|PREFIX[^\n]*\n|BASE[^\n]*\n)*", text, re.I)
    body = text[head.end() :]
    if re.search(r"^\s*(?:@?prefix|@?base)\s", body, re.I | re.M):
        return None
    cuts, step = [0], max(1, len(body) // parts)
    for m in re.finditer(r"\.[ \t]*\n(?=\S)", body):
        if m.end() - cuts[-1] >= step:
            # an even number of quotes before: not inside a long string
            if body.count('"""', 0, m.end()) % 2 == 0 and body.count("'''", 0, m.end()) % 2 == 0:
                cuts.append(m.end())
    return head[0], [body[a:b] for a, b in zip(cuts, [*cuts[1:], len(body)]) if body[a:b].strip()]


def triples_of(chunks: Iterator[str], prologue: str, base: str, scope: str) -> Iterator[Triple]:
    for i, c in enumerate(chunks):
        yield from Turtle(prologue + c, base, f"{scope}c{i}").document()
