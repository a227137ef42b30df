"""Validation reports: as RDF, as text, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.xsd import escaped
from ..plans.ir import DISALLOWED, Path
from ..terms import FIRST, NIL, REST, TYPE, XSD, Triples, is_iri, literal, local, parts, sh
from .validate import conforms

# Severities from mild to grave, as thresholds name them.
LEVELS = ("Trace", "Debug", "Info", "Warning", "Violation")


def disallowed_from(level: str) -> tuple[str, ...]:
    """Severities at a threshold and above it."""
    name = level.capitalize()
    return tuple(sh(x) for x in LEVELS[LEVELS.index(name) :])


def report_triples(results: DataFrame, disallowed: tuple[str, ...] = DISALLOWED, shapes=None) -> DataFrame:
    """(s, p, o keys) of the report, without a look at the driver; equal results are a node each.

    Node names are made of what a result says, so they are the same whenever a part is worked out again. Compound paths
    are written for each result if the shapes are given, as `report_graph` does; details are nodes with sh:detail.
    """
    fields = ["focus_node", "path", "value", "component", "severity", "source_shape", "source_constraint"]
    whole = F.struct(*[F.col(c) for c in results.columns])
    same = results.groupBy(F.sha2(F.to_json(whole), 256).alias("h")).agg(F.first(whole).alias("x"), F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("_:r"), F.substring("h", 1, 32), F.lit("n"), F.col("i").cast("string"))
    rows = same.select("h", "x.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).select(name.alias("node"), *[F.col(c) for c in results.columns])
    templates = {}
    for s in shapes or ():
        if s.path and s.path.op != "pred" and s.path.text() not in templates:
            count = iter(range(1_000_000))
            templates[s.path.text()] = path_triples(s.path, lambda: f"{{}}p{next(count)}")  # noqa: B023  names within a result

    def own(text: str) -> Column:
        return F.concat(F.col("node"), F.lit(text[2:])) if text.startswith("{}") else F.lit(text)

    def triple(s_: Column, p_: str, o: Column) -> Column:
        return F.struct(s_.alias("s"), F.lit(p_).alias("p"), o.cast("string").alias("o"))

    def body(rows: DataFrame, link: str) -> DataFrame:
        """The triples of rows (node, above, fields of a result)."""
        node, get = F.col("node"), lambda c: F.col(c) if c in rows.columns else F.lit(None)
        at = F.when(F.col("path").rlike("^<[^>]*>$"), F.col("path"))
        for text, (head, _) in templates.items():
            at = F.when(F.col("path") == text, own(head)).otherwise(at)
        pairs = [("focusNode", get("focus_node")), ("value", get("value")), ("resultPath", at), ("sourceConstraintComponent", get("component")), ("resultSeverity", get("severity")), ("sourceShape", get("source_shape")), ("sourceConstraint", get("source_constraint"))]
        each = F.array(triple(F.col("above"), link, node), triple(node, TYPE, F.lit(sh("ValidationResult"))), *[triple(node, sh(p_), o) for p_, o in pairs])
        parts_ = [each]
        if "messages" in rows.columns:
            parts_.append(F.transform("messages", lambda m: triple(node, sh("resultMessage"), F.concat(F.lit('"'), escaped(m), F.lit('"')))))
        none = F.array().cast("array<struct<s:string,p:string,o:string>>")
        more = none
        for text, (_, made) in templates.items():
            more = F.when(F.col("path") == text, F.array(*[triple(own(x), p_, own(o)) for x, p_, o in made])).otherwise(more)
        return rows.select(F.explode(F.concat(*[F.coalesce(x, none) for x in (*parts_, more)])).alias("x")).select("x.*").where("o is not null")

    out = body(rows.withColumn("above", F.lit("_:report")), sh("result"))
    if "details" in results.columns:
        inner = rows.select("node", F.posexplode("details").alias("k", "d")).select(F.col("node").alias("above"), F.concat("node", F.lit("d"), F.col("k").cast("string")).alias("node"), *[F.col(f"d.{c}") for c in fields[:5]])
        out = out.unionByName(body(inner, sh("detail")))
    ok = literal(str(conforms(results, disallowed)).lower(), XSD + "boolean")
    head = [("_:report", TYPE, sh("ValidationReport")), ("_:report", sh("conforms"), ok)]
    if tuple(disallowed) != tuple(DISALLOWED):
        head += [("_:report", sh("conformanceDisallows"), x) for x in disallowed]
    return results.sparkSession.createDataFrame(head, "s string, p string, o string").unionByName(out)


def write_report(results: DataFrame, folder: str, disallowed: tuple[str, ...] = DISALLOWED, shapes=None) -> None:
    """The report as N-Triples, written by the tasks: for results that the driver can't hold."""
    report_triples(results, disallowed, shapes).select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.mode("overwrite").text(folder)


def path_triples(path: Path, fresh) -> tuple[str, list[tuple[str, str, str]]]:
    """The node of a path, and the triples that make it."""
    if path.op == "pred":
        return path.args[0], []
    out: list[tuple[str, str, str]] = []

    def many(args) -> str:
        head = NIL
        for x in reversed(args):
            n, more = path_triples(x, fresh)
            out.extend(more)
            b = fresh()
            out.extend([(b, FIRST, n), (b, REST, head)])
            head = b
        return head

    if path.op == "seq":
        return many(path.args), out
    name = {"inv": "inversePath", "alt": "alternativePath", "star": "zeroOrMorePath", "plus": "oneOrMorePath", "opt": "zeroOrOnePath"}[path.op]
    if path.op == "alt":
        target = many(path.args)
    else:
        target, more = path_triples(path.args[0], fresh)
        out.extend(more)
    node = fresh()
    out.append((node, sh(name), target))
    return node, out


def report_graph(results: DataFrame, shapes, disallowed: tuple[str, ...] = DISALLOWED) -> list[tuple[str, str, str]]:
    """The whole report as triples, in order; compound paths are written anew for each result."""
    rows = sorted(results.collect(), key=lambda r: tuple("" if x is None else str(x) for x in r))
    n = 0

    def fresh() -> str:
        nonlocal n
        n += 1
        return f"_:b{n}"

    ok = not any(r.severity in disallowed for r in rows)
    root = fresh()
    out = [(root, TYPE, sh("ValidationReport")), (root, sh("conforms"), literal(str(ok).lower(), XSD + "boolean"))]
    if tuple(disallowed) != tuple(DISALLOWED):
        out += [(root, sh("conformanceDisallows"), x) for x in disallowed]
    paths = {s.path.text(): s.path for s in shapes if s.path}

    def one(r, at: str) -> None:
        out.append((at, TYPE, sh("ValidationResult")))
        get = r.asDict().get
        for name, p in (("focus_node", "focusNode"), ("value", "value"), ("component", "sourceConstraintComponent"), ("severity", "resultSeverity"), ("source_shape", "sourceShape"), ("source_constraint", "sourceConstraint")):
            if get(name):
                out.append((at, sh(p), get(name)))
        if get("path"):
            node, more = path_triples(paths[get("path")], fresh) if get("path") in paths else (get("path"), [])
            out.extend([*more, (at, sh("resultPath"), node)])
        out.extend((at, sh("resultMessage"), literal(m)) for m in get("messages") or [])
        for d in get("details") or []:
            node = fresh()
            out.append((at, sh("detail"), node))
            one(d, node)

    for r in rows:
        at = fresh()
        out.append((root, sh("result"), at))
        one(r, at)
    return out


def serialize(triples: list[tuple[str, str, str]], syntax: str = "turtle") -> str:
    """N-Triples (also read as Turtle, N3, TriG and N-Quads), RDF/XML or JSON-LD; sorted, so the same each time."""
    rows = sorted(set(triples))
    if syntax in ("turtle", "ttl", "ntriples", "nt", "n3", "trig", "nquads"):
        return "".join(f"{s} {p} {o} .\n" for s, p, o in rows)
    if syntax in ("jsonld", "json-ld"):
        import json

        def value(o: str):
            p = parts(o)
            if p.kind != "L":
                return {"@id": o[1:-1] if p.kind == "I" else o}
            return {"@value": p.lex} | ({"@language": p.lang} if p.lang else {"@type": p.dt} if p.dt != XSD + "string" else {})

        nodes: dict[str, dict] = {}
        for s, p, o in rows:
            n = nodes.setdefault(s, {"@id": s[1:-1] if is_iri(s) else s})
            n.setdefault("@type" if p == TYPE else p[1:-1], []).append(o[1:-1] if p == TYPE and is_iri(o) else value(o))
        return json.dumps(list(nodes.values()), indent=1, ensure_ascii=False)
    if syntax in ("rdfxml", "xml"):
        from xml.sax.saxutils import escape, quoteattr

        out = ['<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">']
        for s, p, o in rows:
            ns, name = p[1:-1][: -len(local(p))], local(p)
            about = f"rdf:about={quoteattr(s[1:-1])}" if is_iri(s) else f"rdf:nodeID={quoteattr(s[2:])}"
            t = parts(o)
            if t.kind == "I":
                body = f" rdf:resource={quoteattr(t.lex)}/>"
            elif t.kind == "B":
                body = f" rdf:nodeID={quoteattr(t.lex)}/>"
            else:
                kind = f" xml:lang={quoteattr(t.lang)}" if t.lang else f" rdf:datatype={quoteattr(t.dt)}" if t.dt != XSD + "string" else ""
                body = f"{kind}>{escape(t.lex)}</x:{name}>"
            out.append(f" <rdf:Description {about}><x:{name} xmlns:x={quoteattr(ns)}{body}</rdf:Description>")
        return "\n".join([*out, "</rdf:RDF>\n"])
    raise ValueError(f"unknown syntax {syntax!r}")


def human(results: DataFrame, disallowed: tuple[str, ...] = DISALLOWED) -> str:
    rows = sorted(results.collect(), key=lambda r: tuple("" if x is None else str(x) for x in r))
    out = [f"conforms: {str(not any(r.severity in disallowed for r in rows)).lower()}"]
    for r in rows:
        out.append(f"{local(r.severity)} {local(r.component)} | {r.focus_node} | {r.value or ''} | {r.path or ''}")
        out += [f"    {m}" for m in r.messages or []]
    return "\n".join(out) + "\n"


def read_report(g: Triples) -> dict:
    """A report read back: whether it says it conforms, what it disallows, and its results."""
    root = g.subjects(TYPE, sh("ValidationReport"))[0]
    one = lambda r, n: g.object(r, sh(n))

    def result(r: str) -> dict:
        return {n: one(r, n) for n in ("focusNode", "value", "resultPath", "sourceConstraintComponent", "resultSeverity", "sourceShape", "sourceConstraint")} | {"details": [result(d) for d in g.objects(r, sh("detail"))]}

    said = one(root, "conforms")
    return {"conforms": said is not None and parts(said).lex in ("true", "1"), "disallows": g.objects(root, sh("conformanceDisallows")), "results": [result(r) for r in g.objects(root, sh("result"))]}
