"""Node expressions: each maps a focus node to a sequence of terms, an array column of its row.

Scalar expressions are array functions; those that look at the graph (paths, shapes, queries) join what they find, in
order, to the rows of focus nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import RDF, SPARQL, XSD, ShapeError, is_blank, local, parts, sh, shnex
from .library import FUNCTIONS, boolean, call, integer, numeric
from .xsd import DEC, TERM, constant, node_term

ARRAY = f"array<{TERM.simpleString()}>"
# The operators of the vocabulary, each known by its main property.
OPERATORS = "pathValues count distinct exists if concat sum min max limit offset intersection remove instancesOf orderBy var flatMap conformsToShape filterShape findFirst matchAll nodesMatching".split()


def empty() -> Column:
    return F.array().cast(ARRAY)


class Expressions:
    def __init__(self, validator, scope: dict[str, str] | None = None):
        self.v, self.graph, self.spark = validator, validator.graph, validator.spark
        self.shapes = validator.shapes
        self.g = validator.shapes.graph
        self.scope = {k: constant(x) for k, x in (scope or {}).items()}
        self.n = 0

    def name(self) -> str:
        self.n += 1
        return f"_e{self.n}"

    def sequence(self, node: str, seed: DataFrame) -> DataFrame:
        """(rid, f, o) for a seed (rid, f)."""
        if (terms := self.uniform(node)) is not None:
            return seed.select("rid", "f").crossJoin(terms)
        df, c = self.array(node, seed.select("rid", "f"))
        return df.select("rid", "f", F.explode(c).alias("o"))

    def first(self, node: str, seed: DataFrame) -> DataFrame:
        """(rid, f, o) with the first value, or null."""
        if (terms := self.uniform(node)) is not None:
            df, c = self.beside(self.foremost(terms, 1), seed.select("rid", "f"))
        else:
            df, c = self.array(node, seed.select("rid", "f"))
        return df.select("rid", "f", F.get(c, F.lit(0)).alias("o"))

    def keep(self, df: DataFrame, c: Column) -> tuple[DataFrame, Column]:
        n = self.name()
        return df.withColumn(n, c), F.col(n)

    def joined(self, df: DataFrame, found: DataFrame) -> tuple[DataFrame, Column]:
        """An array column from found (key, arr), joined by the row's own id."""
        n = self.name()
        out = df.join(found.select(F.col("rid").alias("_r"), F.col("arr").alias(n)), F.col("rid") == F.col("_r"), "left").drop("_r")
        return out.withColumn(n, F.coalesce(F.col(n), empty())), F.col(n)

    def array(self, node: str, df: DataFrame, depth: int = 0) -> tuple[DataFrame, Column]:
        if depth > 64:
            raise ShapeError("an expression is nested too deeply")
        if node == sh("this"):
            return df, F.array("f")
        if not is_blank(node):  # rdf:nil too is a constant
            return df, F.array(constant(node))
        g = self.g
        items = g.list(node) if g.objects(node, f"<{RDF}first>") else None
        if items is not None:
            parts_ = []
            for x in items:
                df, c = self.array(x, df, depth + 1)
                parts_.append(c)
            return df, F.concat(*parts_)
        for op in OPERATORS:
            x = g.object(node, shnex(op))
            if x is not None:
                return getattr(self, "do_" + op)(node, x, df, depth)
        for p, o in g.s.get(node, []):
            if p.startswith(f"<{SPARQL}"):
                return self.function(local(p), o, df, depth)
        if (q := g.object(node, sh("select"))) is not None:
            return self.query(self.shapes.prefixes(node) + parts(q).lex, df)
        if (q := g.object(node, sh("sparqlExpr"))) is not None:
            return self.query(self.shapes.prefixes(node) + "SELECT ((" + parts(q).lex + ") AS ?result) WHERE {}", df)
        if g.object(node, sh("path")) is not None:
            df, nodes = self.operand(g.object(node, sh("nodes")), df, depth)
            df, c = self.paths(self.shapes.path(g.object(node, sh("path"))), nodes, df)
            return df, c
        if (s := g.object(node, sh("filterShape"))) is not None:
            nodes = g.object(node, sh("nodes"))
            if nodes is None:
                raise ShapeError("sh:filterShape needs sh:nodes")
            df, c = self.operand(nodes, df, depth)
            df, c = self.conforming(s, c, df)
            return df, F.array_distinct(c)
        for name in ("union", "intersection"):
            if (o := g.object(node, sh(name))) is not None:
                cs = []
                for x in g.list(o) or []:
                    df, c = self.array(x, df, depth + 1)
                    cs.append(c)
                out = cs[0] if cs else empty()
                for c in cs[1:]:
                    out = F.array_union(out, c) if name == "union" else meet(out, c)
                return df, distinct(out)
        if not g.s.get(node):
            return df, empty()
        raise ShapeError(f"unknown expression {g.s[node][0][0]}")

    def operand(self, node: str | None, df: DataFrame, depth: int) -> tuple[DataFrame, Column]:
        return (df, F.array("f")) if node is None else self.array(node, df, depth + 1)

    def nodes(self, node: str, df: DataFrame, depth: int) -> tuple[DataFrame, Column]:
        return self.operand(self.g.object(node, shnex("nodes")), df, depth)

    # -- the graph

    def paths(self, path, nodes: Column, df: DataFrame) -> tuple[DataFrame, Column]:
        from ..operators.paths import walk

        starts = df.select("rid", F.explode(nodes).alias("n")).select("rid", F.col("n.k").alias("node")).distinct()
        got = walk(self.graph, starts, ["rid"], path).distinct().groupBy("rid").agg(F.array_sort(F.collect_list("o"), by_key).alias("arr"))
        return self.joined(df, got)

    def do_pathValues(self, node, x, df, depth):
        df, start = self.operand(self.g.object(node, shnex("focusNode")), df, depth)
        return self.paths(self.shapes.path(x), start, df)

    def conforming(self, shape: str, nodes: Column, df: DataFrame) -> tuple[DataFrame, Column]:
        """Those of the nodes that conform, in order."""
        df, c = self.keep(df, nodes)
        each = df.select("rid", F.posexplode(c).alias("pos", "v"))
        bad = self.v.fails(shape, each.select("v"), {}, 0)
        good = each.join(bad, F.col("v.k") == F.col("bad"), "left_anti").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "v")), lambda a, b: (a.getField("pos") - b.getField("pos")).cast("int")).alias("x"))
        return self.joined(df, good.select("rid", F.transform("x", lambda y: y.getField("v")).alias("arr")))

    def do_filterShape(self, node, x, df, depth):
        df, c = self.nodes(node, df, depth)
        return self.conforming(x, c, df)

    def do_findFirst(self, node, x, df, depth):
        if (terms := self.uniform(self.g.object(node, shnex("nodes")) or "")) is not None:
            bad = self.v.fails(x, terms.select(F.col("o").alias("v")), {}, 0)
            return self.beside(self.foremost(terms.join(bad, F.col("o.k") == F.col("bad"), "left_anti"), 1), df)
        df, c = self.do_filterShape(node, x, df, depth)
        return df, F.slice(c, 1, 1)

    def do_matchAll(self, node, x, df, depth):
        df, c = self.nodes(node, df, depth)
        df, c = self.keep(df, c)
        df, good = self.conforming(x, c, df)
        return df, F.array(boolean(F.size(good) == F.size(c)))

    def do_conformsToShape(self, node, x, df, depth):
        args = self.g.list(x) or []
        df, c = self.array(args[0], df, depth + 1)
        df, c = self.keep(df, F.slice(c, 1, 1))
        shape = args[1]
        df, good = self.conforming(shape, c, df)
        return df, F.when(F.size(c) == 0, empty()).otherwise(F.array(boolean(F.size(good) > 0)))

    def uniform(self, node: str) -> DataFrame | None:
        """(o) the terms, each once, of what asks the whole graph and is the same for every focus; None for other expressions."""
        op = next((op for op in OPERATORS if self.g.object(node, shnex(op)) is not None), None) if is_blank(node) else None
        x = self.g.object(node, shnex(op)) if op else None
        if op == "instancesOf":
            return self.v.instances([x]).select(node_term(F.col("s")).alias("o"))
        if op == "distinct":
            return self.uniform(x)
        terms = self.graph.nodes() if op == "nodesMatching" else None
        if op == "filterShape" and (nodes := self.g.object(node, shnex("nodes"))) is not None:
            terms = self.uniform(nodes)
        if terms is None:
            return None
        return terms.join(self.v.fails(x, terms.select(F.col("o").alias("v")), {}, 0), F.col("o.k") == F.col("bad"), "left_anti")

    def foremost(self, terms: DataFrame, n: int) -> DataFrame:
        """One array of the first terms by key."""
        return terms.orderBy("o.k").limit(n).agg(F.array_sort(F.collect_list("o"), by_key))

    def beside(self, one: DataFrame, df: DataFrame) -> tuple[DataFrame, Column]:
        """The only value of a frame of one row, at every row."""
        n = self.name()
        return df.crossJoin(F.broadcast(one.toDF(n))), F.col(n)

    def do_nodesMatching(self, node, x, df, depth):
        return self.same_for_all(self.uniform(node), df)

    def do_instancesOf(self, node, x, df, depth):
        return self.same_for_all(self.uniform(node), df)

    def same_for_all(self, terms: DataFrame, df: DataFrame) -> tuple[DataFrame, Column]:
        """One sequence for every focus, as an array of its own at each row; what only counts terms or takes the first ones doesn't come here."""
        n = self.name()
        one = terms.agg(F.array_sort(F.collect_list("o"), by_key).alias(n))
        return df.join(one), F.col(n)

    def query(self, text: str, df: DataFrame) -> tuple[DataFrame, Column]:
        from ..plans.sparql import Engine, mentions, parse, shapes_graph_of

        q = parse(text)
        if q.form != "select" or not q.items:
            raise ShapeError("an expression needs a SELECT query with variables")
        seed = df.select(F.col("f").alias("this"), *[c.alias(k) for k, c in self.scope.items() if mentions(q, {k})]).distinct()
        rows = Engine(self.graph, shapes_graph_of(self.v), seed).select(q)
        var = q.items[0][0]
        if "this" not in rows.columns:
            return self.same_for_all(rows.where(F.col(var).isNotNull()).select(F.col(var).alias("o")), df)
        got = rows.where(F.col(var).isNotNull()).select(F.col("this.k").alias("k"), F.struct(F.monotonically_increasing_id().alias("pos"), F.col(var).alias("o")).alias("x"))
        got = got.groupBy("k").agg(F.array_sort(F.collect_list("x"), lambda a, b: (a.getField("pos") - b.getField("pos")).cast("int")).alias("x"))
        n = self.name()
        out = df.join(got.select("k", F.transform("x", lambda y: y.getField("o")).alias(n)), F.col("f.k") == F.col("k"), "left").drop("k")
        return out.withColumn(n, F.coalesce(F.col(n), empty())), F.col(n)

    # -- arrays

    def do_count(self, node, x, df, depth):
        if (terms := self.uniform(x)) is not None:
            return self.beside(terms.agg(F.array(integer(F.count(F.lit(1))))), df)
        df, c = self.array(x, df, depth + 1)
        return df, F.array(integer(F.size(c)))

    def do_distinct(self, node, x, df, depth):
        df, c = self.array(x, df, depth + 1)
        return df, distinct(c)

    def do_exists(self, node, x, df, depth):
        if (terms := self.uniform(x)) is not None:
            return self.beside(terms.limit(1).agg(F.array(boolean(F.count(F.lit(1)) > 0))), df)
        df, c = self.array(x, df, depth + 1)
        return df, F.array(boolean(F.size(c) > 0))

    def do_if(self, node, x, df, depth):
        df, c = self.array(x, df, depth + 1)
        out = []
        for name in ("then", "else"):
            y = self.g.object(node, shnex(name))
            df, b = self.array(y, df, depth + 1) if y is not None else (df, empty())
            out.append(b)
        return df, F.when(F.coalesce(F.get(c, F.lit(0)).getField("lex") == "true", F.lit(False)), out[0]).otherwise(out[1])

    def do_concat(self, node, x, df, depth):
        items = self.g.list(x)
        cs = []
        for y in items if items is not None else [x]:
            df, c = self.array(y, df, depth + 1)
            cs.append(c)
        return df, F.concat(*cs) if cs else empty()

    def do_sum(self, node, x, df, depth):
        df, c = self.array(x, df, depth + 1)
        df, c = self.keep(df, c)
        whole = F.forall(c, lambda t: t.getField("dt") == XSD + "integer")
        total = F.aggregate(c, F.lit(0).cast(DEC), lambda a, t: (a + F.coalesce(t.getField("dec"), t.getField("num").try_cast(DEC), F.lit(0).cast(DEC))).cast(DEC))
        return df, F.array(numeric(F.lit(None).cast("double"), total, F.when(whole, XSD + "integer").otherwise(XSD + "decimal")))

    def extreme(self, x, df, depth, sign: int):
        df, c = self.array(x, df, depth + 1)
        df, c = self.keep(df, c)

        def better(a: Column, b: Column) -> Column:
            u, w = a.getField("num"), b.getField("num")
            return F.coalesce((w < u) if sign < 0 else (w > u), F.lit(False))

        out = F.aggregate(F.slice(c, 2, 2**30), F.get(c, F.lit(0)), lambda a, t: F.when(better(a, t), t).otherwise(a))
        return df, F.when(F.size(c) == 0, empty()).otherwise(F.array(out))

    def do_min(self, node, x, df, depth):
        return self.extreme(x, df, depth, -1)

    def do_max(self, node, x, df, depth):
        return self.extreme(x, df, depth, 1)

    def do_limit(self, node, x, df, depth):
        if (terms := self.uniform(self.g.object(node, shnex("nodes")) or "")) is not None:
            return self.beside(self.foremost(terms, int(parts(x).lex)), df)
        df, c = self.nodes(node, df, depth)
        return df, F.slice(c, 1, int(parts(x).lex))

    def do_offset(self, node, x, df, depth):
        df, c = self.nodes(node, df, depth)
        return df, F.slice(c, int(parts(x).lex) + 1, 2**30)

    def do_intersection(self, node, x, df, depth):
        out = None
        for y in self.g.list(x) or []:
            df, c = self.array(y, df, depth + 1)
            df, c = self.keep(df, c)
            out = c if out is None else meet(out, c)
        return df, distinct(out if out is not None else empty())

    def do_remove(self, node, x, df, depth):
        df, c = self.nodes(node, df, depth)
        df, c = self.keep(df, c)
        df, r = self.array(x, df, depth + 1)
        df, r = self.keep(df, F.transform(r, lambda t: t.getField("k")))
        return df, F.filter(c, lambda t: ~F.array_contains(r, t.getField("k")))

    def do_orderBy(self, node, x, df, depth):
        df, c = self.nodes(node, df, depth)
        df, c = self.keep(df, c)
        down = self.shapes.true(self.g.object(node, shnex("desc")))
        each = df.select("rid", F.posexplode(c).alias("pos", "v"))
        keyed = self.first(x, each.select(F.col("v.k").alias("rid"), F.col("v").alias("f")).distinct()).select(F.col("rid").alias("k"), F.col("o").alias("by"))
        row = F.struct(F.col("by.num").alias("a"), F.col("by.ts").alias("b"), F.col("by.lex").alias("c"), F.col("pos").alias("pos"), F.col("v").alias("v"))

        def order(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for f in ("c", "b", "a"):
                p, q = a.getField(f), b.getField(f)
                sign = F.when(p.isNull() & q.isNull(), 0).when(p.isNull(), -1).when(q.isNull(), 1).when(p < q, -1).when(p > q, 1).otherwise(0)
                out = F.when(sign != 0, sign).otherwise(out)
            out = -out if down else out
            return F.when(out != 0, out).otherwise((a.getField("pos") - b.getField("pos")).cast("int"))

        got = each.join(keyed, F.col("v.k") == F.col("k"), "left").groupBy("rid").agg(F.array_sort(F.collect_list(row), order).alias("x"))
        return self.joined(df, got.select("rid", F.transform("x", lambda y: y.getField("v")).alias("arr")))

    def do_var(self, node, x, df, depth):
        name = parts(x).lex
        if name == "focusNode":
            return df, F.array("f")
        return df, F.array(self.scope[name]) if name in self.scope else empty()

    def do_flatMap(self, node, x, df, depth):
        df, c = self.nodes(node, df, depth)
        df, c = self.keep(df, c)
        each = df.select("rid", F.posexplode(c).alias("pos", "v"))
        inner, arr = self.array(x, each.select(F.col("v.k").alias("rid"), F.col("v").alias("f")).distinct(), depth + 1)
        mapped = inner.select(F.col("rid").alias("k"), arr.alias("arr"))
        got = each.join(mapped, F.col("v.k") == F.col("k")).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "arr")), lambda a, b: (a.getField("pos") - b.getField("pos")).cast("int")).alias("x"))
        return self.joined(df, got.select("rid", F.flatten(F.transform("x", lambda y: y.getField("arr"))).alias("arr")))

    def function(self, name: str, args: str, df: DataFrame, depth: int) -> tuple[DataFrame, Column]:
        items = self.g.list(args) or []
        cs = []
        for x in items:
            df, c = self.array(x, df, depth + 1)
            df, c = self.keep(df, F.get(c, F.lit(0)))
            cs.append(c)
        if name.lower() not in FUNCTIONS:
            raise ShapeError(f"unknown function {name}")
        if name.lower() == "haslang" and len(cs) == 2:
            out = boolean(F.when(cs[0].isNotNull(), F.coalesce((F.lower(cs[0].getField("lang")) == F.lower(cs[1].getField("lex"))) | F.startswith(F.lower(cs[0].getField("lang")), F.concat(F.lower(cs[1].getField("lex")), F.lit("-"))) | (cs[1].getField("lex") == "*") & cs[0].getField("lang").isNotNull(), F.lit(False))))
        else:
            out = call(name, cs)
        if name.lower() not in ("bound", "coalesce", "if"):
            for c in cs:
                out = F.when(c.isNotNull(), out)
        return df, F.filter(F.array(out), lambda t: t.isNotNull())


def by_key(a: Column, b: Column) -> Column:
    x, y = a.getField("k"), b.getField("k")
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def distinct(c: Column) -> Column:
    return F.array_distinct(c)


def meet(a: Column, b: Column) -> Column:
    keys = F.transform(b, lambda t: t.getField("k"))
    return F.filter(a, lambda t: F.array_contains(keys, t.getField("k")))


