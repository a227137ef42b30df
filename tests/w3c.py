"""Reads conformance documents (data, shapes and expected report in one) and compares results one by one."""

from __future__ import annotations

import os
from collections import Counter

from shapewright.plans.ir import DISALLOWED, ShapeError, Shapes
from shapewright.sources.graph import TripleGraph
from shapewright.sources.rdf import parse_file
from shapewright.terms import TYPE, Triples, is_blank, sh

MF = "http://www.w3.org/2001/sw/DataAccess/tests/test-manifest#"
SHT = "http://www.w3.org/ns/shacl-test#"


def documents(root: str):
    for folder, _, names in sorted(os.walk(root)):
        for n in sorted(names):
            if n.endswith(".ttl") and not n.startswith("manifest") and not n.endswith(("-data.ttl", "-shapes.ttl")):
                yield os.path.join(folder, n)


def key(term: str | None, blanks: bool = True) -> str:
    return "" if term is None else "_" if is_blank(term) and blanks else term


def expected(g: Triples, report: str, shapes: Shapes) -> Counter:
    out = Counter()
    for r in g.objects(report, sh("result")):
        path = g.object(r, sh("resultPath"))
        text = shapes.path(path).text() if path else ""
        one = lambda n: g.object(r, sh(n))
        out[tuple(key(x) for x in (one("focusNode"), one("value"), text or None, one("sourceConstraintComponent"), one("resultSeverity")))] += 1
    return out


def load(path: str):
    """(entry name, data triples, shapes graph, expected report node or None for a failure, whole document)"""
    doc = Triples(parse_file(path))
    for e in doc.subjects(TYPE, f"<{SHT}Validate>"):
        action = doc.object(e, f"<{MF}action>")
        data, shapes = doc.object(action, f"<{SHT}dataGraph>"), doc.object(action, f"<{SHT}shapesGraph>")
        here = "<file://" + os.path.abspath(path) + ">"
        files = {}
        for k, x in (("data", data), ("shapes", shapes)):
            name = x[8:-1]
            files[k] = doc if x == here or os.path.basename(name) == os.path.basename(path) else Triples(parse_file(name, scope=k))
        result = doc.object(e, f"<{MF}result>")
        yield e, files["data"], files["shapes"], None if result == f"<{SHT}Failure>" else result, doc


def run(spark, path: str) -> list[tuple[str, str]]:
    """(entry, what differs) of the entries that fail."""
    from shapewright.operators.validate import validate

    out = []
    for e, data, shapes_graph, report, doc in load(path):
        try:
            shapes = Shapes(shapes_graph)
            rows = validate(TripleGraph.of(spark, data.rows), shapes).collect()
        except ShapeError as err:
            if report is not None:
                out.append((e, f"error {err}"))
            continue
        if report is None:
            out.append((e, "no failure"))
            continue
        got = Counter(tuple(key(x) for x in (r.focus_node, r.value, r.path, r.component, r.severity)) for r in rows)
        want = expected(doc, report, shapes)
        if got != want:
            out.append((e, f"missing {want - got}, extra {got - want}"))
        ok = doc.object(report, sh("conforms")) == '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'
        levels = tuple(doc.objects(report, sh("conformanceDisallows"))) or DISALLOWED
        if ok != (not any(r.severity in levels for r in rows)):
            out.append((e, f"conforms should be {ok}"))
    return out


