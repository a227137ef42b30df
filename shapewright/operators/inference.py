"""RDFS entailment (rdfs2, 3, 5, 7, 9, 11) and shape rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.xsd import iri_term
from ..plans.ir import Path, Rule, Shapes
from ..sources.graph import Graph, TripleGraph, cut
from ..terms import SUBCLASS, TYPE, ShapeError, rdfs
from .paths import plus
from .validate import Validator

SUBPROPERTY, DOMAIN, RANGE = rdfs("subPropertyOf"), rdfs("domain"), rdfs("range")
CEILING = 50_000_000


class InferenceError(ShapeError):
    """No fixed point within the rounds, or more triples than the ceiling."""


def closed(graph: Graph, p: str) -> DataFrame:
    """(a, b) of the transitive closure of a hierarchy, without the reflexive pairs."""
    rel = graph.rel(p)
    starts = rel.select(F.col("s").alias("a"), F.col("s").alias("node"))
    return plus(graph, starts, ["a"], Path("pred", (p,))).select("a", F.col("o.k").alias("b")).where("a <> b")


def rdfs_closure(graph: Graph, ceiling: int = CEILING) -> TripleGraph:
    """The graph with all it entails. The hierarchies are closed first; each rule is then one join.

    Rounds are repeated only while they add triples of the schema itself.
    """
    now = TripleGraph(graph.triples())
    for _ in range(100):
        sub, cls = closed(now, SUBPROPERTY), closed(now, SUBCLASS)
        base = now.df
        new = [sub.select(F.col("a").alias("s"), F.lit(SUBPROPERTY).alias("p"), iri_term(F.col("b")).alias("o")), cls.select(F.col("a").alias("s"), F.lit(SUBCLASS).alias("p"), iri_term(F.col("b")).alias("o"))]
        inherited = base.join(sub, F.col("p") == F.col("a")).select("s", F.col("b").alias("p"), "o")
        every = base.unionByName(inherited)
        domain = now.rel(DOMAIN).select(F.col("s").alias("dp"), F.col("o").alias("c"))
        range_ = now.rel(RANGE).select(F.col("s").alias("dp"), F.col("o").alias("c"))
        typed = every.join(domain, F.col("p") == F.col("dp")).select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o"))
        typed = typed.unionByName(every.join(range_, F.col("p") == F.col("dp")).select(F.col("o.k").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o")))
        types = every.where(F.col("p") == TYPE).unionByName(typed)
        up = types.join(cls, F.col("o.k") == F.col("a")).select("s", F.lit(TYPE).alias("p"), iri_term(F.col("b")).alias("o"))
        after = cut(reduce(DataFrame.unionByName, [every, typed, up, *new]).distinct())
        n = after.count()
        if n > ceiling:
            raise InferenceError(f"more than {ceiling} triples")
        fresh = after.join(now.df.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o.k").alias("o2")), (F.col("s") == F.col("s2")) & (F.col("p") == F.col("p2")) & (F.col("o.k") == F.col("o2")), "left_anti")
        schema = fresh.where(F.col("p").isin(SUBCLASS, SUBPROPERTY, DOMAIN, RANGE)).isEmpty()
        now = TripleGraph(after)
        if schema:
            return now
    raise InferenceError("the schema didn't settle")


def fire(v: Validator, rule: Rule, focus: DataFrame) -> DataFrame:
    """(s, p, o) that a rule makes for focus nodes (rid, f)."""
    from ..functions.nodeexpr import Expressions

    if rule.broken:
        raise ShapeError(rule.broken)
    if rule.kind == "sparql":
        from ..plans.sparql import Engine, parse, shapes_graph_of

        q = parse(rule.query)
        if q.form != "construct":
            raise ShapeError("a rule needs a CONSTRUCT query")
        return Engine(v.graph, shapes_graph_of(v), focus.select(F.col("f").alias("this"))).construct(q)
    e = Expressions(v)
    df, s = e.array(rule.subject, focus.select("rid", "f"))
    df, p = e.array(rule.predicate, df)
    df, o = e.array(rule.object, df)
    each = df.select(F.explode(s).alias("a"), p.alias("ps"), o.alias("os")).select("a", F.explode("ps").alias("b"), "os").select("a", "b", F.explode("os").alias("o"))
    return each.where("b.kind = 'I'").select(F.col("a.k").alias("s"), F.col("b.k").alias("p"), "o")


def apply_rules(graph: Graph, shapes: Shapes, ceiling: int = CEILING) -> TripleGraph:
    """One pass of all rules, by order of shape and rule. What a level makes is seen from the next level on."""
    work = sorted(((s.order, r.order, s.node, i) for s in shapes.roots if not s.deactivated for i, r in enumerate(s.rules)), key=lambda x: x[:2])
    now = TripleGraph(graph.triples())
    source: Graph = graph
    levels: dict[tuple[float, float], list[tuple[str, int]]] = {}
    for a, b, node, i in work:
        levels.setdefault((a, b), []).append((node, i))
    for level in sorted(levels):
        v = Validator(source, shapes)
        made = []
        for node, i in levels[level]:
            shape = shapes.get(node)
            rule = shape.rules[i]
            frame = v.target(shape)
            if frame is None:
                continue
            focus = frame.df.select("rid", "f")
            for c in rule.conditions:
                focus = focus.join(v.fails(c, focus.select(F.col("f").alias("v")), {}, 0), F.col("rid") == F.col("bad"), "left_anti")
            if rule.broken and focus.isEmpty():
                continue
            made.append(fire(v, rule, focus))
        if made:
            now = TripleGraph(cut(reduce(DataFrame.unionByName, [now.df, *made]).distinct()))
            if now.df.count() > ceiling:
                raise InferenceError(f"more than {ceiling} triples")
            source = now
    return now


def apply_iterated(graph: Graph, shapes: Shapes, max_rounds: int = 10, ceiling: int = CEILING) -> TripleGraph:
    """Passes until nothing is added."""
    now, size = graph, None
    for _ in range(max_rounds):
        new = apply_rules(now, shapes, ceiling)
        n = new.df.count()
        if n == size or size is None and n == graph.triples().count():
            return new
        now, size = new, n
    raise InferenceError(f"no fixed point after {max_rounds} rounds")


def turtle(graph: TripleGraph) -> str:
    """The triples as sorted N-Triples lines (which are Turtle); those with a literal subject are left out."""
    rows = graph.df.where(~F.col("s").startswith('"')).select(F.concat_ws(" ", "s", "p", "o.k", F.lit(".")).alias("line")).orderBy("line")
    return "\n".join(r[0] for r in rows.toLocalIterator()) + "\n"


