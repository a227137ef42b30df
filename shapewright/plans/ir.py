"""Shapes as data, compiled from a shapes graph."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..terms import NIL, REIFIES, SUBCLASS, TYPE, ShapeError, Triples, is_blank, is_iri, is_literal, local, parts, rdfs, sh, triple_term

# Fixed values of the vocabulary: what makes a node a shape without being declared one.
TARGETS = [sh(x) for x in "targetNode targetClass targetSubjectsOf targetObjectsOf".split()]
SIGNS = [
    sh(x)
    for x in "class datatype nodeKind minCount maxCount minExclusive minInclusive maxExclusive maxInclusive minLength maxLength pattern languageIn uniqueLang equals disjoint lessThan lessThanOrEquals not and or xone node property qualifiedValueShape closed hasValue in sparql rule expression".split()
]
SEVERITIES = [sh(x) for x in "Violation Warning Info Debug Trace".split()]
DISALLOWED = tuple(SEVERITIES[:3])
COUNTED = {"minCount", "maxCount", "minLength", "maxLength", "minListLength", "maxListLength"}
TERMS = {"minExclusive", "minInclusive", "maxExclusive", "maxInclusive", "hasValue", "rootClass"}
PATHS = {"equals", "disjoint", "lessThan", "lessThanOrEquals", "subsetOf"}
SHAPES = {"not", "node", "property", "someValue", "memberShape"}
LISTS = {"and", "or", "xone"}
ANY_OF = {"class", "datatype", "nodeKind"}
SPARQL_AF = ("select", "ask", "construct")


@dataclass(frozen=True)
class Path:
    """op: pred, inv, seq, alt, star, plus, opt."""

    op: str
    args: tuple[Any, ...]

    def text(self) -> str:
        a = self.args
        inner = [f"({x.text()})" if isinstance(x, Path) and x.op in ("seq", "alt") else x.text() if isinstance(x, Path) else x for x in a]
        return {"pred": lambda: a[0], "inv": lambda: f"^{inner[0]}", "seq": lambda: "/".join(inner), "alt": lambda: "|".join(inner), "star": lambda: f"{inner[0]}*", "plus": lambda: f"{inner[0]}+", "opt": lambda: f"{inner[0]}?"}[self.op]()


@dataclass
class Constraint:
    kind: str  # the parameter's local name, or component/sparql
    value: Any
    component: str
    node: str | None = None  # what sh:sourceConstraint names
    severity: str | None = None
    messages: tuple[str, ...] = ()
    extra: dict[str, Any] = field(default_factory=dict)


@dataclass
class Rule:
    kind: str  # triple or sparql
    node: str
    order: float
    conditions: list[str]
    subject: str | None = None
    predicate: str | None = None
    object: str | None = None
    query: str | None = None
    broken: str | None = None


@dataclass
class Shape:
    node: str
    path: Path | None = None
    path_node: str | None = None
    values: str | None = None
    targets: list[tuple[str, Any]] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    severity: str = SEVERITIES[0]
    messages: tuple[str, ...] = ()
    deactivated: bool = False
    order: float = 0.0
    rules: list[Rule] = field(default_factory=list)


class Shapes:
    def __init__(self, graph: Triples):
        self.graph = graph
        self.by_node: dict[str, Shape] = {}
        self.components = {c: [p for p in graph.objects(c, sh("parameter"))] for c in dict.fromkeys(s for s, _ in graph.p.get(sh("parameter"), []))}
        todo = list(dict.fromkeys(self.declared()))
        while todo:
            node = todo.pop(0)
            if node not in self.by_node:
                self.by_node[node] = Shape(node)
                self.compile(self.by_node[node], todo)

    def declared(self):
        g = self.graph
        for kind in ("NodeShape", "PropertyShape", "ShapeClass"):
            yield from g.subjects(TYPE, sh(kind))
        for p in TARGETS + SIGNS + [sh("targetWhere"), sh("target")]:
            yield from (s for s, _ in g.p.get(p, []) if p in TARGETS + SIGNS)
        for params in self.components.values():
            for q in params:
                path = g.object(q, sh("path"))
                yield from (s for s, _ in g.p.get(path, []))

    @property
    def roots(self) -> list[Shape]:
        return [s for s in self.by_node.values() if s.targets]

    def __len__(self) -> int:
        return len(self.by_node)

    def __iter__(self):
        return iter(self.by_node.values())

    def get(self, node: str) -> Shape | None:
        return self.by_node.get(node)

    def path(self, node: str, depth: int = 0) -> Path:
        g = self.graph
        if depth > 64:
            raise ShapeError("path nested too deeply")
        if is_iri(node) and node != NIL:
            return Path("pred", (node,))
        if is_literal(node) or node == NIL:
            raise ShapeError(f"not a path: {node}")
        items = g.list(node)
        if items is not None:
            if len(items) < 2:
                raise ShapeError("a sequence path needs two members")
            return Path("seq", tuple(self.path(x, depth + 1) for x in items))
        for name, op in (("inversePath", "inv"), ("alternativePath", "alt"), ("zeroOrMorePath", "star"), ("oneOrMorePath", "plus"), ("zeroOrOnePath", "opt")):
            x = g.object(node, sh(name))
            if x is None:
                continue
            if op == "alt":
                items = g.list(x)
                if items is None or len(items) < 2:
                    raise ShapeError("an alternative path needs two members")
                return Path("alt", tuple(self.path(i, depth + 1) for i in items))
            return Path(op, (self.path(x, depth + 1),))
        raise ShapeError(f"not a path: {node}")

    def number(self, node: str | None, default: float = 0.0) -> float:
        try:
            return float(parts(node).lex) if node else default
        except ValueError:
            return default

    def true(self, node: str | None) -> bool:
        return node is not None and is_literal(node) and parts(node).lex == "true"

    def notes(self, s: str, p: str, o: str) -> list[str]:
        """Reifiers of a statement."""
        return self.graph.subjects(REIFIES, triple_term(s, p, o))

    def active(self, s: str, p: str) -> list[str]:
        return [o for o in self.graph.objects(s, p) if not any(self.true(self.graph.object(r, sh("deactivated"))) for r in self.notes(s, p, o))]

    def compile(self, shape: Shape, todo: list[str]) -> None:
        g, n = self.graph, shape.node
        path = g.object(n, sh("path"))
        if path is not None:
            shape.path, shape.path_node = self.path(path), path
        shape.values = g.object(n, sh("values"))
        shape.severity = g.object(n, sh("severity")) or SEVERITIES[0]
        shape.messages = tuple(g.objects(n, sh("message")))
        shape.deactivated = self.true(g.object(n, sh("deactivated")))
        shape.order = self.number(g.object(n, sh("order")))
        self.targets(shape, todo)
        self.constraints(shape, todo)
        for r in g.objects(n, sh("rule")):
            rule = self.rule(r, todo)
            if rule:
                shape.rules.append(rule)

    def targets(self, shape: Shape, todo: list[str]) -> None:
        g, n = self.graph, shape.node
        for name in ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf"):
            for o in self.active(n, sh(name)):
                if name == "targetNode" and is_blank(o):
                    if g.object(o, sh("select")):
                        shape.targets.append(("select", o))
                    else:
                        shape.targets.append(("expression", o))
                else:
                    shape.targets.append((name, o))
        for o in g.objects(n, sh("target")):
            if g.object(o, sh("select")):
                shape.targets.append(("select", o))
        for o in g.objects(n, sh("targetWhere")):
            shape.targets.append(("where", o))
            todo.append(o)
        types = g.objects(n, TYPE)
        if is_iri(n) and (sh("ShapeClass") in types or any(t == rdfs("Class") or rdfs("Class") in self.up(t) for t in types)):
            shape.targets.append(("targetClass", n))

    def up(self, c: str) -> set[str]:
        seen, todo = set(), [c]
        while todo:
            for x in self.graph.objects(todo.pop(), SUBCLASS):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def add(self, shape: Shape, kind: str, o: str | None, value: Any, component: str | None = None, **extra) -> Constraint:
        name = component or sh(kind[0].upper() + kind[1:] + "ConstraintComponent")
        c = Constraint(kind, value, name, extra=extra)
        if o is not None:
            for r in self.notes(shape.node, sh(kind), o):
                c.severity = self.graph.object(r, sh("severity")) or c.severity
                c.messages = tuple(self.graph.objects(r, sh("message"))) or c.messages
        shape.constraints.append(c)
        return c

    def constraints(self, shape: Shape, todo: list[str]) -> None:
        g, n = self.graph, shape.node
        for p in dict.fromkeys(q for q, _ in g.s.get(n, [])):
            if not p.startswith(sh("")[:-1]):
                continue
            kind = local(p)
            for o in self.active(n, p) if kind not in ("equals", "disjoint", "lessThan", "lessThanOrEquals", "and", "or", "xone", "sparql") else g.objects(n, p):
                if kind in COUNTED:
                    self.add(shape, kind, o, int(self.number(o)))
                elif kind in TERMS:
                    self.add(shape, kind, o, o)
                elif kind in PATHS:
                    self.add(shape, kind, o, self.path(o))
                elif kind in ANY_OF:
                    items = g.list(o) if is_blank(o) else None
                    self.add(shape, kind, o, items if items is not None else [o])
                elif kind in SHAPES:
                    todo.append(o)
                    self.add(shape, kind, o, o, sh("PropertyConstraintComponent") if kind == "property" else None)
                elif kind in LISTS:
                    items = g.list(o)
                    if items is None:
                        raise ShapeError(f"sh:{kind} needs a list")
                    todo += items
                    self.add(shape, kind, o, items)
                elif kind == "in":
                    items = g.list(o)
                    if items is None:
                        raise ShapeError("sh:in needs a list")
                    self.add(shape, kind, o, items)
                elif kind == "languageIn":
                    self.add(shape, kind, o, [parts(x).lex for x in g.list(o) or []])
                elif kind == "pattern":
                    flags = g.object(n, sh("flags"))
                    self.add(shape, kind, o, java_regex(parts(o).lex, parts(flags).lex if flags else ""))
                elif kind in ("uniqueLang", "singleLine", "uniqueMembers"):
                    if self.true(o):
                        self.add(shape, kind, o, True)
                elif kind == "closed":
                    by = o == sh("ByTypes")
                    if by or self.true(o):
                        allowed = {x for q in g.objects(n, sh("property")) for x in [g.object(q, sh("path"))] if x and is_iri(x)}
                        ignored = g.object(n, sh("ignoredProperties"))
                        allowed |= set(g.list(ignored) or []) if ignored else set()
                        self.add(shape, kind, o, sorted(allowed), by_types=by)
                elif kind == "uniqueValuesFor":
                    items = g.list(o) if is_blank(o) else None
                    self.add(shape, kind, o, [self.path(x) for x in (items if items is not None else [o])])
                elif kind == "qualifiedValueShape":
                    todo.append(o)
                    low, high = g.object(n, sh("qualifiedMinCount")), g.object(n, sh("qualifiedMaxCount"))
                    sib = []
                    if self.true(g.object(n, sh("qualifiedValueShapesDisjoint"))):
                        for parent in g.subjects(sh("property"), n):
                            for other in g.objects(parent, sh("property")):
                                if other != n:
                                    sib += [x for x in g.objects(other, sh("qualifiedValueShape")) if x != o]
                    sib = list(dict.fromkeys(sib))
                    todo += sib
                    if low is not None:
                        self.add(shape, "qualifiedMin", None, o, sh("QualifiedMinCountConstraintComponent"), count=int(self.number(low)), siblings=sib)
                    if high is not None:
                        self.add(shape, "qualifiedMax", None, o, sh("QualifiedMaxCountConstraintComponent"), count=int(self.number(high)), siblings=sib)
                elif kind == "reifierShape":
                    todo.append(o)
                    self.add(shape, kind, o, o, required=False)
                elif kind == "reificationRequired" and self.true(o):
                    self.add(shape, kind, o, True, sh("ReifierShapeConstraintComponent"))
                elif kind == "sparql":
                    if self.true(g.object(o, sh("deactivated"))):
                        continue
                    c = self.add(shape, "sparql", None, self.query(o), sh("SPARQLConstraintComponent"))
                    c.node, c.severity = o, g.object(o, sh("severity"))
                    c.messages = tuple(g.objects(o, sh("message")))
                elif kind in ("expression", "nodeByExpression"):
                    c = self.add(shape, kind, o, o)
                    c.node = o
        self.custom(shape)

    def query(self, node: str) -> tuple[str, str]:
        """(select, ask or construct; text with prefixes)"""
        for form in SPARQL_AF:
            q = self.graph.object(node, sh(form))
            if q is not None:
                return form, self.prefixes(node) + parts(q).lex
        raise ShapeError(f"{node} has no query")

    def prefixes(self, node: str) -> str:
        g = self.graph
        todo, seen, out = list(g.objects(node, sh("prefixes"))) or g.subjects(TYPE, sh("ShapesGraph")), set(), {}
        while todo:
            x = todo.pop(0)
            if x in seen:
                continue
            seen.add(x)
            for d in g.objects(x, sh("declare")):
                prefix, ns = g.object(d, sh("prefix")), g.object(d, sh("namespace"))
                if prefix and ns:
                    out.setdefault(parts(prefix).lex, parts(ns).lex)
            todo += g.objects(x, "<http://www.w3.org/2002/07/owl#imports>")
        return "".join(f"PREFIX {k}: <{v}>\n" for k, v in out.items())

    def custom(self, shape: Shape) -> None:
        g, n = self.graph, shape.node
        for comp, params in self.components.items():
            bound, ok, some = {}, True, False
            for q in params:
                path = g.object(q, sh("path"))
                if path is None or path in SIGNS:
                    ok = ok and path is not None
                    continue
                got = g.object(n, path)
                if got is not None:
                    bound[local(path)] = got
                    some = True
                elif not self.true(g.object(q, sh("optional"))):
                    ok = False
            if not ok or not some:
                continue
            own = sh("propertyValidator") if shape.path else sh("nodeValidator")
            v = g.object(comp, own) or g.object(comp, sh("validator"))
            if v is None:
                continue
            c = self.add(shape, "component", None, self.query(v), comp, params=bound)
            c.messages = tuple(g.objects(v, sh("message")))
            c.extra["validator"] = v

    def rule(self, r: str, todo: list[str]) -> Rule | None:
        g = self.graph
        if self.true(g.object(r, sh("deactivated"))):
            return None
        conditions = g.objects(r, sh("condition"))
        todo += conditions
        order = self.number(g.object(r, sh("order")))
        if g.object(r, sh("construct")) is not None:
            return Rule("sparql", r, order, conditions, query=self.prefixes(r) + parts(g.object(r, sh("construct"))).lex)
        s, p, o = (g.object(r, sh(x)) for x in ("subject", "predicate", "object"))
        return Rule("triple", r, order, conditions, s, p, o, broken=None if s and p and o else f"{r} lacks a subject, predicate or object")


def java_regex(pattern: str, flags: str) -> str:
    """The pattern for Java: search semantics, '.' and '$' as in XPath, Unicode classes."""
    bad = set(flags) - set("ismxq")
    if bad:
        raise ShapeError(f"unknown flags {''.join(sorted(bad))}")
    if "q" in flags:
        return "(?i)" * ("i" in flags) + re.escape(pattern)
    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise ShapeError("look-around and back references aren't allowed")
    out, in_class, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif c == "$" and not in_class and "m" not in flags:
            c = "\\z"
        out.append(c)
        i += 1
    text = f"(?dU{''.join(f for f in 'ismx' if f in flags)})" + "".join(out)
    try:
        re.compile("".join(out).replace("\\z", "\\Z").replace("\\p{", "(?:").replace("\\P{", "(?:") if "\\p" not in pattern.lower() else "")
    except re.error as e:
        raise ShapeError(f"bad pattern {pattern!r}: {e}") from e
    return text


def load_shapes(text: str, syntax: str = "turtle", base: str = "") -> Shapes:
    from ..sources.rdf import parse

    return Shapes(Triples(parse(text, syntax, base, "s")))

