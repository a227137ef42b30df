"""Validation: shapes against a graph, whole focus sets at a time.

A frame of focus nodes is (rid, f, m): the root node a row belongs to, the focus term, and how often the row counts (a
nested property shape runs for each pair of focus and value). Values add v. Everything a shape asks of single values
is one filter and one explode over one scan; what it asks of whole rows are aggregates; nested shapes become semi- and
anti-joins with the nodes that fail them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.xsd import DEC, STRINGS, compare, constant, iri_term, language_matches, node_term, term_of_key, well_formed
from ..plans.ir import DISALLOWED, Constraint, Path, Shape, Shapes
from ..sources.graph import Graph, TableGraph, UnionGraph, cut
from ..terms import REIFIES, SUBCLASS, TYPE, ShapeError, is_iri, local, parts, sh
from .paths import walk

DETAIL = "array<struct<focus_node:string,path:string,value:string,component:string,severity:string>>"
RESULT = f"rid string, focus_node string, path string, value string, component string, severity string, source_shape string, source_constraint string, messages array<string>, details {DETAIL}, m long"
COLUMNS = ["focus_node", "path", "value", "component", "severity", "source_shape", "source_constraint", "messages", "details"]
MOST_NESTED = 48
# The kinds of term that each node kind allows.
NODE_KINDS = {"IRI": "I", "BlankNode": "B", "Literal": "L", "BlankNodeOrIRI": "BI", "BlankNodeOrLiteral": "BL", "IRIOrLiteral": "IL", "TripleTerm": "T"}


class NestingError(ShapeError, RecursionError):
    """Shapes ask for conformance to shapes too deeply."""


@dataclass
class Frame:
    df: DataFrame  # rid, f, m
    table: str | None = None  # all rows of this table, each once
    plain: bool = False  # f is the node rid names, each once, with m 1

    def same(self, rid: str, key: str, rid2: str, key2: str) -> Column:
        """Whether two rows are of one focus node of one root."""
        on = F.col(rid) == F.col(rid2)
        return on if self.plain else on & (F.col(key) == F.col(key2))


def union(parts_: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts_)


class Validator:
    def __init__(self, graph: Graph, shapes: Shapes):
        self.graph, self.shapes, self.spark = graph, shapes, graph.spark
        self.below: dict[str, list[str]] = {}
        self.instances_: dict[tuple[str, ...], DataFrame] = {}

    def known(self, names: DataFrame) -> list[str]:
        """The shapes among names (one column) that the data give; of these names only shapes reach the driver."""
        own = self.spark.createDataFrame([(s.node,) for s in self.shapes], "own string")
        return sorted(r[0] for r in names.join(F.broadcast(own), names[0] == F.col("own"), "left_semi").distinct().collect())

    # -- classes and targets

    def subclasses(self, c: str) -> DataFrame:
        """(c) the class and all below it, by the data graph."""
        start = self.spark.createDataFrame([(c,)], "node string")
        if SUBCLASS not in self.graph.predicates():
            return start.select(F.col("node").alias("c"))
        path = Path("star", (Path("inv", (Path("pred", (SUBCLASS,)),)),))
        return cut(walk(self.graph, start, [], path).select(F.col("o.k").alias("c")).distinct())

    def instances(self, classes: list[str]) -> DataFrame:
        """(s) the nodes of any of the classes."""
        key = tuple(sorted(classes))
        if key not in self.instances_:
            rel = self.graph.rel(TYPE)
            if SUBCLASS in self.graph.predicates():
                below = union([self.subclasses(c) for c in classes]).distinct()
                self.instances_[key] = rel.join(below, F.col("o.k") == F.col("c")).select("s").distinct()
            else:
                self.instances_[key] = rel.where(F.col("o.k").isin(*classes)).select("s").distinct()
        return self.instances_[key]

    def target(self, shape: Shape) -> Frame | None:
        """The focus nodes of a shape's targets, each once."""
        out: list[DataFrame] = []
        for kind, x in shape.targets:
            if kind == "targetClass" and len(shape.targets) == 1 and isinstance(self.graph, TableGraph | UnionGraph) and SUBCLASS not in self.graph.predicates() and (t := self.graph.class_table(x)):
                # the rows of a table, as they are: no join, no shuffle
                return Frame(self.graph.subjects(t).select(F.col("s").alias("rid"), iri_term(F.col("s")).alias("f"), F.lit(1).cast("long").alias("m")), t, True)
            out.append(self.nodes_of(kind, x))
        if not out:
            return None
        return Frame(union(out).distinct().select(F.col("o.k").alias("rid"), F.col("o").alias("f"), F.lit(1).cast("long").alias("m")), None, True)

    def nodes_of(self, kind: str, x: str) -> DataFrame:
        g = self.graph
        if kind == "targetNode":
            return self.spark.range(1).select(constant(x).alias("o"))
        if kind == "targetClass":
            return self.instances([x]).select(node_term(F.col("s")).alias("o"))
        if kind == "targetSubjectsOf":
            return g.rel(x).select(node_term(F.col("s")).alias("o"))
        if kind == "targetObjectsOf":
            return g.rel(x).select("o")
        if kind == "where":
            every = g.nodes()
            return every.join(self.fails(x, every.select(F.col("o").alias("v")), {}, 0), F.col("o.k") == F.col("bad"), "left_anti")
        if kind == "select":
            from ..plans.sparql import select

            try:
                rows = select(self, self.shapes.prefixes(x) + parts(self.shapes.graph.object(x, sh("select"))).lex)
            except ShapeError:
                return self.graph.empty().select("o")  # a target that can't be read selects nothing
            name = "this" if "this" in rows.columns else rows.columns[0]
            return rows.where(F.col(name).isNotNull()).select(F.col(name).alias("o"))
        if kind == "expression":
            from ..functions.nodeexpr import Expressions

            seed = self.spark.range(1).select(F.lit("").alias("rid"), constant('""').alias("f"))
            return Expressions(self).sequence(x, seed).select("o")
        raise ShapeError(f"unknown target {kind}")

    # -- frames and values

    def values(self, shape_path: Path, frame: Frame, once: bool = True) -> DataFrame:
        """(rid, f, m, v), each once unless that is all the same."""
        if shape_path.op == "pred" and frame.table and self.graph.table_of(shape_path.args[0]) == frame.table:
            rel = self.graph.rel(shape_path.args[0])
            return rel.select(F.col("s").alias("rid"), iri_term(F.col("s")).alias("f"), F.lit(1).cast("long").alias("m"), F.col("o").alias("v"))
        if frame.table:
            # only keys go through the joins; the term is made of the key again
            out = walk(self.graph, frame.df.select("rid", F.col("rid").alias("node")), ["rid"], shape_path, once)
            return out.select("rid", iri_term(F.col("rid")).alias("f"), F.lit(1).cast("long").alias("m"), F.col("o").alias("v"))
        df = frame.df.select("rid", "f", "m", F.col("f.k").alias("node"))
        return walk(self.graph, df, ["rid", "f", "m"], shape_path, once).withColumnRenamed("o", "v")

    def outer(self, shape_path: Path | None, frame: Frame) -> DataFrame | None:
        """As values, with null v for a focus without any; only for columns of the frame's own table."""
        if shape_path is not None and shape_path.op == "pred" and frame.table and self.graph.table_of(shape_path.args[0]) == frame.table:
            rel = self.graph.outer(shape_path.args[0])
            return rel.select(F.col("s").alias("rid"), iri_term(F.col("s")).alias("f"), F.lit(1).cast("long").alias("m"), F.col("o").alias("v"))
        return None

    # -- results

    def results(self, df: DataFrame, shape: Shape, c: Constraint, value: Column | None = None, path: Column | None = None, messages: Column | None = None, details: Column | None = None) -> DataFrame:
        own = c.messages or shape.messages
        where = path if path is not None else F.lit(shape.path.text()) if shape.path else F.lit(None)
        return df.select(
            "rid",
            F.col("f.k").alias("focus_node"),
            where.cast("string").alias("path"),
            (value if value is not None else F.lit(None)).cast("string").alias("value"),
            F.lit(c.component).alias("component"),
            F.lit(c.severity or shape.severity).alias("severity"),
            F.lit(shape.node).alias("source_shape"),
            F.lit(c.node).cast("string").alias("source_constraint"),
            (messages if messages is not None else F.array(*[F.lit(parts(x).lex) for x in own]).cast("array<string>")).alias("messages"),
            (details if details is not None else F.lit(None)).cast(DETAIL).alias("details"),
            "m",
        )

    def none(self) -> DataFrame:
        return self.spark.createDataFrame([], RESULT)

    # -- evaluation

    def cyclic(self, node: str) -> bool:
        """Whether the shape asks, through others, for itself."""
        seen, todo = set(), list(self.asks(node))
        while todo:
            x = todo.pop()
            if x == node:
                return True
            if x not in seen:
                seen.add(x)
                todo += self.asks(x)
        return False

    def asks(self, node: str) -> list[str]:
        if node not in self.below:
            s = self.shapes.get(node)
            out: list[str] = []
            for c in s.constraints if s else []:
                if c.kind in ("not", "node", "property", "someValue", "memberShape", "qualifiedMin", "qualifiedMax", "reifierShape"):
                    out += [c.value, *c.extra.get("siblings", [])]
                elif c.kind in ("and", "or", "xone"):
                    out += c.value
                elif c.kind in ("expression", "nodeByExpression"):
                    out += self.named_in(c.value)
            self.below[node] = out
        return self.below[node]

    def named_in(self, node: str) -> list[str]:
        """The shapes that a node expression mentions: which of them it will ask for isn't known before."""
        g, out, seen, todo = self.shapes.graph, [], set(), [node]
        while todo:
            x = todo.pop()
            if x in seen or x.startswith('"'):
                continue
            seen.add(x)
            if self.shapes.get(x) is not None:
                out.append(x)
            elif x.startswith("_:"):
                todo += [o for _, o in g.s.get(x, [])]
        return out

    def evaluate(self, shape: Shape, frame: Frame, seen: dict[str, DataFrame], depth: int, root: bool = False) -> list[DataFrame]:
        if shape.deactivated:
            return []
        if depth > MOST_NESTED:
            raise NestingError(f"more than {MOST_NESTED} nested shapes")
        if self.cyclic(shape.node):
            df = frame.df
            if shape.node in seen and not root:
                df = df.join(seen[shape.node], (F.col("rid") == F.col("seen_rid")) & (F.col("f.k") == F.col("seen_f")), "left_anti")
            frame = Frame(cut(df), frame.table if shape.node not in seen else None)
            if frame.df.isEmpty():
                return []
            own = frame.df.select(F.col("rid").alias("seen_rid"), F.col("f.k").alias("seen_f"))
            seen = seen | {shape.node: cut(seen[shape.node].unionByName(own).distinct()) if shape.node in seen else own}
        if shape.values is not None:
            from ..functions.nodeexpr import Expressions

            v = Expressions(self).sequence(shape.values, frame.df.select("rid", "f")).join(frame.df.select(F.col("rid").alias("r2"), F.col("f.k").alias("f2"), "m"), (F.col("rid") == F.col("r2")) & (F.col("f.k") == F.col("f2"))).select("rid", "f", "m", F.col("o").alias("v")).distinct()
        else:
            v = self.values(shape.path, frame) if shape.path else frame.df.withColumn("v", F.col("f"))
        out: list[DataFrame] = []
        single: list[tuple[Constraint, Column]] = []
        for c in shape.constraints:
            bad = self.per_value(c, F.col("v"))
            if bad is not None:
                single.append((c, bad))
            else:
                out += self.other(shape, c, frame, v, seen, depth)
        if single:
            out.append(self.fused(shape, v, single))
        return out

    def fused(self, shape: Shape, v: DataFrame, single: list[tuple[Constraint, Column]]) -> DataFrame:
        """All per-value constraints of a shape in one pass over its values."""
        if len(single) == 1:
            c, bad = single[0]
            return self.results(v.where(bad), shape, c, F.col("v.k"))
        any_bad = reduce(lambda a, b: a | b, [b for _, b in single])
        each = F.explode(F.array(*[F.when(b, F.lit(i)) for i, (_, b) in enumerate(single)])).alias("c")
        hit = v.where(any_bad).select("rid", "f", "m", "v", each).where("c is not null")
        pick = lambda of: reduce(lambda a, x: a.when(F.col("c") == x[0], F.lit(of(x[1]))), list(enumerate(c for c, _ in single))[1:], F.when(F.col("c") == 0, F.lit(of(single[0][0]))))
        if all(c.severity is None and not c.messages for c, _ in single):
            return hit.select(
                "rid", F.col("f.k").alias("focus_node"), F.lit(shape.path.text() if shape.path else None).cast("string").alias("path"), F.col("v.k").alias("value"), pick(lambda c: c.component).alias("component"), F.lit(shape.severity).alias("severity"),
                F.lit(shape.node).alias("source_shape"), F.lit(None).cast("string").alias("source_constraint"), F.array(*[F.lit(parts(x).lex) for x in shape.messages]).cast("array<string>").alias("messages"), F.lit(None).cast(DETAIL).alias("details"), "m",
            )
        return union([self.results(hit.where(F.col("c") == i), shape, c, F.col("v.k")) for i, (c, _) in enumerate(single)])

    def per_value(self, c: Constraint, v: Column) -> Column | None:
        """Whether a value violates a constraint that looks at it alone; None for other constraints."""
        kind, x = c.kind, c.value
        lex, of = v.getField("lex"), v.getField
        if kind == "datatype":
            ok = F.lit(False)
            for d in x:
                dt = parts(d).lex
                ok = ok | ((of("dt") == dt) & (well_formed(lex, dt)))
            return ~F.coalesce(ok, F.lit(False))
        if kind == "nodeKind":
            allowed = sorted({k for n in x for k in NODE_KINDS.get(local(n), "")})
            return ~of("kind").isin(*allowed)
        if kind in ("minExclusive", "minInclusive", "maxExclusive", "maxInclusive"):
            op = {"minE": ">", "minI": ">=", "maxE": "<", "maxI": "<="}[kind[:4]]
            return self.out_of_bounds(v, x, op)
        if kind == "minLength":
            return ~F.coalesce((F.char_length(lex) >= x) & of("kind").isin("I", "L"), F.lit(False)) if x > 0 else ~of("kind").isin("I", "L")
        if kind == "maxLength":
            return ~F.coalesce((F.char_length(lex) <= x) & of("kind").isin("I", "L"), F.lit(False))
        if kind == "pattern":
            return ~F.coalesce(lex.rlike(x) & of("kind").isin("I", "L"), F.lit(False))
        if kind == "languageIn":
            return ~language_matches(of("lang"), x)
        if kind == "in":
            return ~F.coalesce(of("k").isin(*x), F.lit(False)) if x else F.lit(True)
        if kind == "singleLine":
            return F.coalesce(lex.rlike("[\n\r\f\u000b]"), F.lit(False))
        return None

    def out_of_bounds(self, v: Column, bound: str, op: str) -> Column:
        b = constant(bound)
        p = parts(bound)
        if p.dt not in STRINGS and p.lex:
            import math

            from ..functions.xsd import NUMERIC

            if p.dt in NUMERIC:
                # a plain comparison that reaches the scan; exact numbers decide where both have them
                try:
                    n = float(p.lex.replace("INF", "inf"))
                except ValueError:
                    return F.lit(True)
                if math.isnan(n):
                    return F.lit(True)
                num = v.getField("num")
                test = {">": num <= n, ">=": num < n, "<": num >= n, "<=": num > n}[op]
                dec = v.getField("dec")
                try:
                    d = F.lit(p.lex).cast(DEC)
                except ValueError:
                    d = F.lit(None).cast(DEC)
                exact = {">": dec <= d, ">=": dec < d, "<": dec >= d, "<=": dec > d}[op]
                if "e" not in p.lex.lower() and "INF" not in p.lex and p.dt not in (NUMERIC[-1], NUMERIC[-2]):
                    test = F.when(dec.isNotNull(), exact).otherwise(test)
                return num.isNull() | F.isnan(num) | test
        return ~F.coalesce(compare(v, b, op), F.lit(False))

    def counts(self, frame: Frame, v: DataFrame) -> DataFrame:
        """(rid, f, m, n) the number of values of each focus."""
        return self.per_focus(frame, v, [F.count(F.lit(1)).alias("n")], {"n": 0})

    def per_focus(self, frame: Frame, v: DataFrame, aggs: list[Column], default: dict) -> DataFrame:
        got = (v.groupBy("rid") if frame.plain else v.groupBy("rid", F.col("f.k").alias("fk"))).agg(*aggs)
        joined = frame.df.select("rid", "f", "m").join(got.withColumnRenamed("rid", "r2"), frame.same("rid", "f.k", "r2", "fk"), "left")
        return joined.select("rid", "f", "m", *[F.coalesce(F.col(k), F.lit(x)).alias(k) for k, x in default.items()])

    def other(self, shape: Shape, c: Constraint, frame: Frame, v: DataFrame, seen: dict[str, DataFrame], depth: int) -> list[DataFrame]:
        kind, x, R = c.kind, c.value, self.results
        if kind == "class":
            return [R(v.join(self.instances(x), F.col("v.k") == F.col("s"), "left_anti"), shape, c, F.col("v.k"))]
        if kind == "rootClass":
            return [R(v.join(self.subclasses(x), F.col("v.k") == F.col("c"), "left_anti"), shape, c, F.col("v.k"))]
        if kind in ("minCount", "maxCount"):
            outer = self.outer(shape.path, frame) if shape.values is None else None
            if outer is not None:  # a column has one value or none
                n = F.when(F.col("v").isNotNull(), 1).otherwise(0)
                return [R(outer.where(n < x if kind == "minCount" else n > x), shape, c)]
            if kind == "maxCount":
                many = v.groupBy("rid", *([] if frame.plain else ["f", "m"])).agg(*([F.first("f").alias("f"), F.first("m").alias("m")] if frame.plain else []), F.count(F.lit(1)).alias("n")).where(F.col("n") > x)
                if x < 0:
                    many = self.counts(frame, v)
                return [R(many, shape, c)]
            if x <= 0:
                return []
            if x == 1:
                has = v.select(F.col("rid").alias("r2"), F.col("f.k").alias("fk"))
                return [R(frame.df.join(has, frame.same("rid", "f.k", "r2", "fk"), "left_anti"), shape, c)]
            return [R(self.counts(frame, v).where(F.col("n") < x), shape, c)]
        if kind == "hasValue":
            outer = self.outer(shape.path, frame) if shape.values is None else None
            if outer is not None:
                return [R(outer.where(~F.coalesce(F.col("v.k") == x, F.lit(False))), shape, c)]
            has = v.where(F.col("v.k") == x).select(F.col("rid").alias("r2"), F.col("f.k").alias("fk"))
            return [R(frame.df.join(has, frame.same("rid", "f.k", "r2", "fk"), "left_anti"), shape, c)]
        if kind == "uniqueLang":
            tags = v.where("v.lang is not null").groupBy("rid", "f", "m", F.col("v.lang").alias("lang"), F.col("v.dir").alias("dir")).count()
            return [R(tags.where("count > 1"), shape, c)]
        if kind in ("equals", "disjoint", "subsetOf"):
            # sides that are only looked up may repeat values
            w = self.values(x, frame, kind == "equals").select(F.col("rid").alias("r2"), F.col("f.k").alias("f2"), F.col("v.k").alias("v2"), "f", "m", F.col("v").alias("w"))
            same = frame.same("rid", "fk", "r2", "f2") & (F.col("vk") == F.col("v2"))
            left = v.select("rid", "f", "m", "v", F.col("f.k").alias("fk"), F.col("v.k").alias("vk"))
            right = w.select("r2", "f2", "v2")
            if kind == "disjoint":
                return [R(left.join(right, same, "left_semi"), shape, c, F.col("v.k"))]
            out = [R(left.join(right, same, "left_anti"), shape, c, F.col("v.k"))]
            if kind == "equals":
                back = w.join(left.select("rid", "fk", "vk"), same, "left_anti").select(F.col("r2").alias("rid"), "f", "m", F.col("w").alias("v"))
                out.append(R(back, shape, c, F.col("v.k")))
            return out
        if kind in ("lessThan", "lessThanOrEquals"):
            w = self.values(x, frame).select(F.col("rid").alias("r2"), F.col("f.k").alias("f2"), F.col("v").alias("w"))
            ok = F.coalesce(compare(F.col("v"), F.col("w"), "<" if kind == "lessThan" else "<="), F.lit(False))
            if frame.plain:
                return [R(v.join(w, F.col("rid") == F.col("r2")).where(~ok), shape, c, F.col("v.k"))]
            return [R(v.join(w, (F.col("rid") == F.col("r2")) & (F.col("f.k") == F.col("f2"))).where(~ok), shape, c, F.col("v.k"))]
        if kind == "uniqueValuesFor":
            if frame.table and all(p.op == "pred" and self.graph.table_of(p.args[0]) == frame.table for p in x):
                # columns of the frame's own table: one value each, all on the row
                rows, names = self.graph.columns(frame.table, [p.args[0] for p in x]), [f"k{i}" for i in range(len(x))]
                rows = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in names])).select(F.col("s").alias("rid"), *names)
            else:
                rows = frame.df
                for i, p in enumerate(x):
                    got = self.values(p, frame).groupBy(F.col("rid").alias(f"r{i}"), F.col("f.k").alias(f"f{i}")).agg(F.array_sort(F.collect_set("v.k")).alias(f"k{i}"))
                    rows = rows.join(got, frame.same("rid", "f.k", f"r{i}", f"f{i}"))
                names = [f"k{i}" for i in range(len(x))]
                rows = rows.select("rid", "f", "m", *names)
            twice = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias("d" + k) for k in names])
            hit = rows.join(twice, reduce(lambda a, b: a & b, [F.col(k) == F.col("d" + k) for k in names]), "left_semi")
            if "f" not in hit.columns:
                hit = hit.select("rid", iri_term(F.col("rid")).alias("f"), F.lit(1).cast("long").alias("m"))
            return [R(hit, shape, c)]
        if kind == "closed":
            return [self.closed(shape, c, frame, v)]
        if kind in ("not", "node", "and", "or", "xone"):
            return [R(self.logical(kind, x, v, seen, depth), shape, c, F.col("v.k"))]
        if kind == "property":
            return self.nested(x, v, seen, depth, frame if shape.path is None and shape.values is None else None)
        if kind == "someValue":
            good = self.conforming(x, v, seen, depth).select(F.col("rid").alias("r2"), F.col("f.k").alias("fk"))
            return [R(frame.df.join(good, frame.same("rid", "f.k", "r2", "fk"), "left_anti"), shape, c)]
        if kind in ("qualifiedMin", "qualifiedMax"):
            good = self.conforming(x, v, seen, depth)
            for sib in c.extra["siblings"]:
                good = good.join(self.fails(sib, v.select("v"), seen, depth), F.col("v.k") == F.col("bad"), "left_semi")
            n = self.counts(frame, good)
            return [R(n.where(F.col("n") < c.extra["count"] if kind == "qualifiedMin" else F.col("n") > c.extra["count"]), shape, c)]
        if kind in ("minListLength", "maxListLength", "uniqueMembers", "memberShape"):
            return [self.on_lists(shape, c, v, seen, depth)]
        if kind in ("reifierShape", "reificationRequired"):
            return self.reified(shape, c, v, seen, depth)
        if kind in ("sparql", "component"):
            from ..plans.sparql import constraint

            return constraint(self, shape, c, frame.df, v)
        if kind == "expression":
            from ..functions.nodeexpr import Expressions

            first = Expressions(self).first(x, v.select(F.col("v.k").alias("rid"), F.col("v").alias("f")).distinct())
            bad = first.where(~F.coalesce(F.col("o.lex") == "true", F.lit(False))).select(F.col("rid").alias("bad"))
            return [R(v.join(bad, F.col("v.k") == F.col("bad"), "left_semi"), shape, c, F.col("v.k"))]
        if kind == "nodeByExpression":
            from ..functions.nodeexpr import Expressions

            named = cut(Expressions(self).sequence(x, v.select(F.col("v.k").alias("rid"), F.col("v").alias("f")).distinct()).select("rid", F.col("o.k").alias("shape")).distinct())
            out = []
            for name in self.known(named.select("shape")):
                some = v.join(named.where(F.col("shape") == name).select(F.col("rid").alias("r2")), F.col("v.k") == F.col("r2"), "left_semi")
                out.append(R(self.logical("node", name, some, seen, depth), shape, c, F.col("v.k")))
            return out
        raise ShapeError(f"unknown constraint {kind}")

    def fails(self, node: str, values: DataFrame, seen: dict[str, DataFrame], depth: int) -> DataFrame:
        """(bad) those of the values (v) that don't conform to a shape."""
        shape = self.shapes.get(node)
        none = self.spark.createDataFrame([], "bad string")
        if shape is None:
            return none
        cands = values.select("v").distinct().select(F.col("v.k").alias("rid"), F.col("v").alias("f"), F.lit(1).cast("long").alias("m"))
        own = {k: d for k, d in seen.items()}
        if self.cyclic(node) and node in own:
            # nodes of the batch that is being asked about are taken to conform
            batch = own[node].select(F.col("seen_f").alias("sf")).distinct()
            cands = cands.join(batch, F.col("rid") == F.col("sf"), "left_anti")
            own[node] = own[node].select(F.col("seen_f").alias("seen_rid"), "seen_f")
        found = self.evaluate(shape, Frame(cands), own, depth + 1)
        return union([x.select(F.col("rid").alias("bad")) for x in found]).distinct() if found else none

    def conforming(self, node: str, v: DataFrame, seen: dict[str, DataFrame], depth: int) -> DataFrame:
        return v.join(self.fails(node, v.select("v"), seen, depth), F.col("v.k") == F.col("bad"), "left_anti")

    def logical(self, kind: str, x, v: DataFrame, seen: dict[str, DataFrame], depth: int) -> DataFrame:
        """The rows of v that violate not, node, and, or, xone."""
        if kind in ("not", "node"):
            return v.join(self.fails(x, v.select("v"), seen, depth), F.col("v.k") == F.col("bad"), "left_anti" if kind == "not" else "left_semi")
        bad = [self.fails(s, v.select("v"), seen, depth) for s in x]
        if kind == "and":
            return v.join(union(bad).distinct(), F.col("v.k") == F.col("bad"), "left_semi") if bad else v.limit(0)
        if kind == "or":
            for b in bad:
                v = v.join(b, F.col("v.k") == F.col("bad"), "left_semi")
            return v
        failed = union(bad).groupBy("bad").agg(F.count(F.lit(1)).alias("n_bad")) if bad else None
        if failed is None:
            return v
        return v.join(failed, F.col("v.k") == F.col("bad"), "left").where(F.lit(len(bad)) - F.coalesce("n_bad", F.lit(0)) != 1).drop("bad", "n_bad")

    def nested(self, node: str, v: DataFrame, seen: dict[str, DataFrame], depth: int, same: Frame | None = None) -> list[DataFrame]:
        """Results of a property shape at each value, as often as focus nodes have it; the values of a node shape are its own frame."""
        shape = self.shapes.get(node)
        if shape is None:
            return []
        if same is not None:
            return self.evaluate(shape, same, seen, depth)
        frame = v.groupBy("rid", F.col("v").alias("f")).agg(F.sum("m").alias("m"))
        return self.evaluate(shape, Frame(frame), seen, depth)

    def closed(self, shape: Shape, c: Constraint, frame: Frame, v: DataFrame) -> DataFrame:
        g = self.graph
        if not c.extra["by_types"]:
            rest = g.triples(tuple(c.value))
            hit = frame.df.join(rest.select("s", "p", F.col("o").alias("w")), F.col("f.k") == F.col("s"))
            return self.results(hit, shape, c, F.col("w.k"), F.col("p"))
        allowed = self.allowed_by_class()
        ignored = [p for p in c.value if not any(p == q for q in self.own_paths(shape.node))]
        types = walk(g, frame.df.select("rid", "f", "m", F.col("f.k").alias("node")), ["rid", "f", "m"], Path("seq", (Path("pred", (TYPE,)), Path("star", (Path("pred", (SUBCLASS,)),)))))
        pairs = self.spark.createDataFrame(allowed or [("", "")], "c string, ap string")
        may = types.join(F.broadcast(pairs), F.col("o.k") == F.col("c")).select(F.col("rid").alias("r2"), F.col("f.k").alias("f2"), "ap").distinct()
        rest = g.triples(tuple({TYPE, *ignored}))
        hit = frame.df.join(rest.select("s", "p", F.col("o").alias("w")), F.col("f.k") == F.col("s"))
        hit = hit.join(may, (F.col("rid") == F.col("r2")) & (F.col("f.k") == F.col("f2")) & (F.col("p") == F.col("ap")), "left_anti")
        return self.results(hit, shape, c, F.col("w.k"), F.col("p"))

    def own_paths(self, node: str, seen: tuple[str, ...] = ()) -> set[str]:
        """Predicates of a shape's property shapes, also of those it combines."""
        g = self.shapes.graph
        if node in seen:
            return set()
        out = {x for q in g.objects(node, sh("property")) for x in [g.object(q, sh("path"))] if x and is_iri(x)}
        for s in g.objects(node, sh("node")):
            out |= self.own_paths(s, (*seen, node))
        for name in ("and", "or", "xone"):
            for head in g.objects(node, sh(name)):
                for s in g.list(head) or []:
                    out |= self.own_paths(s, (*seen, node))
        return out

    def allowed_by_class(self) -> list[tuple[str, str]]:
        """(class, predicate): what a shape that is the class, or targets it, has properties for."""
        out = set()
        for s in self.shapes:
            for c in {s.node, *(x for k, x in s.targets if k == "targetClass")}:
                out |= {(c, p) for p in self.own_paths(s.node)}
        return sorted(out)

    def on_lists(self, shape: Shape, c: Constraint, v: DataFrame, seen: dict[str, DataFrame], depth: int) -> DataFrame:
        lists = self.graph.lists(v.select(F.col("v.k").alias("k"))).withColumnRenamed("k", "head")
        rows = v.join(lists, F.col("v.k") == F.col("head"))
        n = F.size("members")
        if c.kind in ("minListLength", "maxListLength"):
            ok = n >= c.value if c.kind == "minListLength" else n <= c.value
            return self.results(rows.where(F.col("members").isNull() | ~ok), shape, c, F.col("v.k"))
        detail = lambda focus, value, component: F.struct(focus.alias("focus_node"), F.lit(None).cast("string").alias("path"), value.alias("value"), F.lit(component).alias("component"), F.lit(c.severity or shape.severity).alias("severity"))
        if c.kind == "uniqueMembers":
            keys = F.transform("members", lambda x: x.getField("k"))
            # equal members stand together when sorted
            ordered = F.array_sort(keys)
            twice = F.array_distinct(F.filter(F.transform(ordered, lambda k, i: F.when((i > 0) & (F.get(ordered, i - 1) == k), k)), lambda k: k.isNotNull()))
            rows = rows.withColumn("twice", twice).where(F.col("members").isNull() | (F.size("twice") > 0))
            details = F.transform("twice", lambda k: detail(F.col("v.k"), k, c.component))
            return self.results(rows, shape, c, F.col("v.k"), details=details)
        members = rows.where("members is not null").select(F.col("v.k").alias("head2"), F.explode("members").alias("v")).distinct()
        nested = self.shapes.get(c.value)
        found = self.evaluate(nested, Frame(members.select("v").distinct().select(F.col("v.k").alias("rid"), F.col("v").alias("f"), F.lit(1).cast("long").alias("m"))), seen, depth + 1) if nested else []
        if found:
            each = union(found).select(F.col("rid").alias("bad"), F.struct("focus_node", "path", "value", "component", "severity").alias("d"))
            per = members.join(each, F.col("v.k") == F.col("bad")).groupBy("head2").agg(F.array_sort(F.collect_list("d")).alias("ds"))
        else:
            per = self.spark.createDataFrame([], f"head2 string, ds {DETAIL}")
        rows = rows.join(per, F.col("head") == F.col("head2"), "left").where(F.col("members").isNull() | F.col("ds").isNotNull())
        return self.results(rows, shape, c, F.col("v.k"), details=F.col("ds"))

    def reified(self, shape: Shape, c: Constraint, v: DataFrame, seen: dict[str, DataFrame], depth: int) -> list[DataFrame]:
        if not shape.path or shape.path.op != "pred":
            return []
        claim = F.concat(F.lit("<<( "), F.col("f.k"), F.lit(f" {shape.path.args[0]} "), F.col("v.k"), F.lit(" )>>"))
        rel = self.graph.rel(REIFIES).select(F.col("s").alias("reifier"), F.col("o.k").alias("claim"))
        rows = v.withColumn("own", claim)
        if c.kind == "reificationRequired":
            return [self.results(rows.join(rel, F.col("own") == F.col("claim"), "left_anti"), shape, c, F.col("v.k"))]
        got = rows.join(rel, F.col("own") == F.col("claim")).withColumn("r", node_term(F.col("reifier")))
        bad = self.fails(c.value, got.select(F.col("r").alias("v")), seen, depth)
        # a reifier that fails faults the value whose statement it is of, once
        faulty = got.join(bad, F.col("reifier") == F.col("bad"), "left_semi").select(F.col("claim").alias("faulty"))
        return [self.results(rows.join(faulty, F.col("own") == F.col("faulty"), "left_semi"), shape, c, F.col("v.k"))]


def expand(found: list[DataFrame], validator: Validator) -> DataFrame:
    """All results, each as often as it counts."""
    if not found:
        return validator.none().select(*COLUMNS)
    df = union(found)
    return df.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("_")).drop("_") if any("m" in x.columns for x in found) else df.select(*COLUMNS)


def validate(graph: Graph, shapes: Shapes, max_results: int | None = None, disallowed: tuple[str, ...] = DISALLOWED) -> DataFrame:
    """Results of all shapes with targets, and of those that data nodes name by sh:shape.

    With max_results, shapes are run one after the other until so many results with a disallowed severity are found;
    of the shape that reaches the number, results of other severities that sort after the last of them are cut off, too.
    """
    v = Validator(graph, shapes)

    def frames() -> Iterator[tuple[Shape, Frame]]:
        for shape in shapes.roots:
            if (frame := v.target(shape)) is not None:
                yield shape, frame
        if sh("shape") in graph.predicates():
            named = graph.rel(sh("shape"))
            for name in v.known(named.select("o.k")):
                yield shapes.get(name), Frame(named.where(F.col("o.k") == name).select(F.col("s").alias("rid"), node_term(F.col("s")).alias("f"), F.lit(1).cast("long").alias("m")))

    parts_: list[DataFrame] = []
    blocking = 0
    for shape, frame in frames():
        found = v.evaluate(shape, frame, {}, 0, root=True)
        if not found:
            continue
        df = expand(found, v)
        if max_results is not None:
            df = cut(df)
            order = [F.coalesce(F.col(x), F.lit("")) for x in ("focus_node", "path", "value", "component")]
            counts = F.col("severity").isin(*disallowed)
            rank = cut(df.where(counts).orderBy(*order).limit(max_results - blocking))
            n = rank.count()
            rest = df.where(~counts)
            if blocking + n >= max_results:
                key = F.struct(*[x.alias(f"x{i}") for i, x in enumerate(order)])
                last = rank.agg(F.max(key).alias("last"))
                rest = rest.join(F.broadcast(last), key <= F.col("last"), "left_semi")
            parts_.append(rank.unionByName(rest))
            blocking += n
            if blocking >= max_results:
                break
        else:
            parts_.append(df)
    return union(parts_) if parts_ else v.none().select(*COLUMNS)


def validate_nodes(graph: Graph, shapes: Shapes, work: DataFrame) -> DataFrame:
    """Results for given pairs (shape, node) only, as after a change of the data."""
    v = Validator(graph, shapes)
    out = []
    for shape in shapes:
        nodes = work.where(F.col("shape") == shape.node).select("node").distinct().select(F.col("node").alias("rid"), term_of_key(F.col("node")).alias("f"), F.lit(1).cast("long").alias("m"))
        out += v.evaluate(shape, Frame(nodes), {}, 0, root=True)
    return expand(out, v)


def focus_nodes(graph: Graph, shapes: Shapes, node: str) -> DataFrame:
    """(node) the targets of a shape."""
    frame = Validator(graph, shapes).target(shapes.get(node))
    return frame.df.select(F.col("rid").alias("node")) if frame else graph.empty().select(F.col("s").alias("node"))


def node_conforms(graph: Graph, shapes: Shapes, node: str, key: str) -> bool:
    v = Validator(graph, shapes)
    return v.fails(node, graph.spark.range(1).select(constant(key).alias("v")), {}, 0).isEmpty()


def conforms(results: DataFrame, disallowed: tuple[str, ...] = DISALLOWED) -> bool:
    return results.where(F.col("severity").isin(*disallowed)).limit(1).isEmpty()

