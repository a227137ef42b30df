"""SPARQL as DataFrame plans, for whole sets of pre-bound nodes at a time.

A query is parsed into nested tuples. Its solutions are a DataFrame with a term column for each variable. Variables that
a shape binds before ($this, $value, parameters) come in as the columns of a seed frame: each scope that mentions one
starts from the seed and keeps its columns, so grouping, ordering and limits hold for each focus node by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.library import call, ebv, equal, integer, let, numeric, quotient, string, text
from ..functions.xsd import DEC, FIELDS, NUMERIC, TERM, constant
from ..operators.paths import walk
from ..sources.graph import Graph
from ..terms import RDF, TYPE, XSD, ShapeError, is_iri, literal, parts
from .ir import Constraint, Path, Shape

TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<var>[?$]\w+)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[a-z]+)?)
    |(?P<double>(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+)
    |(?P<decimal>[0-9]*\.[0-9]+)
    |(?P<integer>[0-9]+)
    |(?P<blank>_:\w+)
    |(?P<name>(?:[^\W\d_][\w.\-]*)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\.))?)?)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|<<\(|\)>>|<<|>>|[{}()\[\].,;=<>!+\-*/^|?])""",
    re.X | re.S,
)
AGGREGATES = {"count", "sum", "min", "max", "avg", "sample", "group_concat"}
TESTS = {"logical-and", "logical-or", "logical-not", "equals", "not-equals", "less-than", "less-than-or-equal", "greater-than", "greater-than-or-equal", "bound"}


@dataclass
class Query:
    form: str
    where: tuple | None = None
    items: list[tuple[str, tuple]] | None = None  # (variable, expression); None: all
    distinct: bool = False
    template: list[tuple] = field(default_factory=list)
    group: list[tuple[str | None, tuple]] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order: list[tuple[bool, tuple]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Parser:
    def __init__(self, source: str, prefixes: dict[str, str] | None = None):
        self.source = source
        self.tokens: list[tuple[str, str]] = []
        pos = 0
        while pos < len(source):
            m = TOKEN.match(source, pos)
            if not m:
                raise ShapeError(f"unreadable query at {source[pos : pos + 30]!r}")
            pos = m.end()
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
        self.i = 0
        self.prefixes = dict(prefixes or {})
        self.base = ""
        self.fresh = 0

    # -- tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.i += 1
        return t

    def at(self, value: str, ahead: int = 0) -> bool:
        k, v = self.peek(ahead)
        return v == value and k == "op" or k == "word" and v.lower() == value.lower() and value.isalpha()

    def take(self, value: str) -> bool:
        if self.at(value):
            self.i += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise ShapeError(f"expected {value!r} but found {self.peek()[1]!r} in a query")

    def variable(self) -> str:
        self.fresh += 1
        return f"_b{self.fresh}"

    # -- structure

    def query(self) -> Query:
        while self.at("prefix") or self.at("base"):
            if self.next()[1].lower() == "prefix":
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.next()[1][1:-1]
            else:
                self.base = self.next()[1][1:-1]
        q = self.body()
        if self.peek()[0] != "end":
            raise ShapeError(f"unexpected {self.peek()[1]!r} after a query")
        return q

    def body(self) -> Query:
        k, word = self.next()
        form = word.lower()
        q = Query(form)
        if form == "select":
            q.distinct = self.take("distinct") or self.take("reduced")
            if not self.take("*"):
                q.items = []
                while True:
                    if self.peek()[0] == "var":
                        v = self.next()[1][1:]
                        q.items.append((v, ("var", v)))
                    elif self.take("("):
                        e = self.expression()
                        self.expect("as")
                        q.items.append((self.next()[1][1:], e))
                        self.expect(")")
                    else:
                        break
                if not q.items:
                    raise ShapeError("SELECT without variables")
        elif form == "construct":
            if self.take("where"):
                q.template = self.template()
                q.where = ("group", [("bgp", q.template)])
                return self.modifiers(q)
            q.template = self.template()
        elif form != "ask":
            raise ShapeError(f"{word!r} queries aren't run")
        while self.take("from"):
            self.take("named")
            self.next()
        self.take("where")
        q.where = self.group()
        return self.modifiers(q)

    def modifiers(self, q: Query) -> Query:
        if self.take("group"):
            self.expect("by")
            while True:
                if self.peek()[0] == "var":
                    v = self.next()[1][1:]
                    q.group.append((v, ("var", v)))
                elif self.take("("):
                    e = self.expression()
                    name = self.next()[1][1:] if self.take("as") else None
                    self.expect(")")
                    q.group.append((name, e))
                elif self.peek()[0] == "word" and not any(self.at(x) for x in ("having", "order", "limit", "offset", "values")):
                    q.group.append((None, self.primary()))
                else:
                    break
        if self.take("having"):
            while self.at("(") or self.peek()[0] == "word" and not any(self.at(x) for x in ("order", "limit", "offset", "values")):
                q.having.append(self.primary())
        if self.take("order"):
            self.expect("by")
            while True:
                if self.at("asc") or self.at("desc"):
                    down = self.next()[1].lower() == "desc"
                    q.order.append((down, self.primary()))
                elif self.peek()[0] == "var" or self.at("("):
                    q.order.append((False, self.primary()))
                elif self.peek()[0] == "word" and not any(self.at(x) for x in ("limit", "offset", "values")):
                    q.order.append((False, self.primary()))
                else:
                    break
        while self.at("limit") or self.at("offset"):
            w = self.next()[1].lower()
            n = int(self.next()[1])
            if w == "limit":
                q.limit = n
            else:
                q.offset = n
        if self.at("values"):
            raise ShapeError("VALUES isn't allowed")
        return q

    def template(self) -> list[tuple]:
        self.expect("{")
        out: list[tuple] = []
        while not self.take("}"):
            self.triples(out)
            self.take(".")
        return out

    def group(self) -> tuple:
        self.expect("{")
        if self.at("select"):
            q = self.body()
            self.expect("}")
            return ("group", [("sub", q)])
        out: list[tuple] = []
        while not self.take("}"):
            if self.take("filter"):
                out.append(("filter", self.constraint()))
            elif self.take("optional"):
                out.append(("optional", self.group()))
            elif self.take("bind"):
                self.expect("(")
                e = self.expression()
                self.expect("as")
                out.append(("bind", self.next()[1][1:], e))
                self.expect(")")
            elif self.at("minus") or self.at("service") or self.at("values"):
                raise ShapeError(f"{self.peek()[1].upper()} isn't allowed")
            elif self.take("graph"):
                name = self.term_or_var()
                out.append(("graph", name, self.group()))
            elif self.at("{"):
                branches = [self.group()]
                while self.take("union"):
                    branches.append(self.group())
                out.append(("union", branches) if len(branches) > 1 else branches[0])
            elif self.take("."):
                pass
            else:
                rows: list[tuple] = []
                self.triples(rows)
                if out and out[-1][0] == "bgp":
                    out[-1][1].extend(rows)
                else:
                    out.append(("bgp", rows))
        return ("group", out)

    def constraint(self) -> tuple:
        return self.primary()

    def triples(self, out: list[tuple]) -> None:
        s = self.node(out)
        if self.at(".") or self.at("}"):
            return
        self.properties(s, out)

    def properties(self, s: tuple, out: list[tuple]) -> None:
        while True:
            p = ("var", self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                out.append((s, p, self.node(out)))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.at(".") or self.at("}") or self.at("]"):
                return

    def node(self, out: list[tuple]) -> tuple:
        if self.take("["):
            v = ("var", self.variable())
            if not self.take("]"):
                self.properties(v, out)
                self.expect("]")
            return v
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            head: tuple = ("term", f"<{RDF}nil>")
            for x in reversed(items):
                v = ("var", self.variable())
                out += [(v, Path("pred", (f"<{RDF}first>",)), x), (v, Path("pred", (f"<{RDF}rest>",)), head)]
                head = v
            return head
        return self.term_or_var()

    def term_or_var(self) -> tuple:
        k, v = self.peek()
        if k == "var":
            self.i += 1
            return ("var", v[1:])
        if k == "blank":
            self.i += 1
            return ("var", "_l" + v[2:])
        return ("term", self.term())

    def term(self) -> str:
        k, v = self.next()
        if k == "iri":
            return v if v != "<>" else f"<{self.base}>"
        if k == "name":
            prefix, _, name = v.partition(":")
            if prefix not in self.prefixes:
                raise ShapeError(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', name)}>"
        if k in ("string", "long"):
            from ..terms import unescape

            n = 3 if k == "long" else 1
            lex = unescape(v[n:-n])
            if self.peek()[0] == "lang":
                tag, _, d = self.next()[1][1:].partition("--")
                return literal(lex, None, tag, d or None)
            return literal(lex, self.term()[1:-1]) if self.take("^^") else literal(lex)
        if k in ("integer", "decimal", "double"):
            return literal(v, XSD + k)
        if v in ("+", "-") and k == "op":
            t = self.term()
            p = parts(t)
            return literal(("-" if v == "-" else "+") + p.lex, p.dt)
        if k == "word" and v.lower() in ("true", "false"):
            return literal(v.lower(), XSD + "boolean")
        if v == "<<(":
            s, p, o = self.term(), self.term(), self.term()
            self.expect(")>>")
            return f"<<( {s} {p} {o} )>>"
        raise ShapeError(f"expected a term, found {v!r}")

    # -- paths

    def path(self) -> Path:
        alts = [self.sequence()]
        while self.take("|"):
            alts.append(self.sequence())
        return alts[0] if len(alts) == 1 else Path("alt", tuple(alts))

    def sequence(self) -> Path:
        steps = [self.step()]
        while self.take("/"):
            steps.append(self.step())
        return steps[0] if len(steps) == 1 else Path("seq", tuple(steps))

    def step(self) -> Path:
        if self.take("^"):
            return Path("inv", (self.step(),))
        if self.take("!"):
            names, back = [], []
            many = self.take("(")
            while True:
                (back if self.take("^") else names).append(self.verb())
                if not (many and self.take("|")):
                    break
            if many:
                self.expect(")")
            return Path("not", (tuple(names), tuple(back)))
        if self.take("("):
            p = self.path()
            self.expect(")")
        else:
            p = Path("pred", (self.verb(),))
        while True:
            if self.take("*"):
                p = Path("star", (p,))
            elif self.at("+"):
                self.i += 1
                p = Path("plus", (p,))
            elif self.at("?"):
                self.i += 1
                p = Path("opt", (p,))
            else:
                return p

    def verb(self) -> str:
        if self.peek() == ("word", "a"):
            self.i += 1
            return TYPE
        return self.term()

    # -- expressions

    def expression(self) -> tuple:
        e = self.conjunction()
        while self.take("||"):
            e = ("call", "logical-or", [e, self.conjunction()])
        return e

    def conjunction(self) -> tuple:
        e = self.relation()
        while self.take("&&"):
            e = ("call", "logical-and", [e, self.relation()])
        return e

    def relation(self) -> tuple:
        e = self.additive()
        for op, name in (("=", "equals"), ("!=", "not-equals"), ("<=", "less-than-or-equal"), (">=", "greater-than-or-equal"), ("<", "less-than"), (">", "greater-than")):
            if self.take(op):
                return ("call", name, [e, self.additive()])
        invert = self.at("not") and self.at("in", 1)
        if invert:
            self.i += 1
        if self.take("in"):
            self.expect("(")
            items = []
            while not self.take(")"):
                items.append(self.expression())
                self.take(",")
            out = ("in", e, items)
            return ("call", "logical-not", [out]) if invert else out
        return e

    def additive(self) -> tuple:
        e = self.product()
        while True:
            if self.take("+"):
                e = ("call", "plus", [e, self.product()])
            elif self.take("-"):
                e = ("call", "subtract", [e, self.product()])
            else:
                return e

    def product(self) -> tuple:
        e = self.unary()
        while True:
            if self.take("*"):
                e = ("call", "multiply", [e, self.unary()])
            elif self.take("/"):
                e = ("call", "divide", [e, self.unary()])
            else:
                return e

    def unary(self) -> tuple:
        if self.take("!"):
            return ("call", "logical-not", [self.unary()])
        if self.take("-"):
            return ("call", "unary-minus", [self.unary()])
        if self.take("+"):
            return ("call", "unary-plus", [self.unary()])
        return self.primary()

    def primary(self) -> tuple:
        k, v = self.peek()
        if self.take("("):
            e = self.expression()
            self.expect(")")
            return e
        if k == "var":
            self.i += 1
            return ("var", v[1:])
        if k == "word" and v.lower() not in ("true", "false"):
            name = v.lower()
            self.i += 1
            if name == "not":
                self.expect("exists")
                return ("exists", False, self.group())
            if name == "exists":
                return ("exists", True, self.group())
            if name in AGGREGATES:
                return self.aggregate(name)
            return ("call", name, self.arguments())
        t = self.term()
        if is_iri(t) and self.at("("):
            name = t[1:-1]
            return ("call", name if name.startswith(XSD) else re.split("[#/]", name)[-1], self.arguments())
        return ("term", t)

    def arguments(self) -> list[tuple]:
        self.expect("(")
        out = []
        while not self.take(")"):
            self.take("distinct")
            out.append(self.expression())
            self.take(",")
        return out

    def aggregate(self, name: str) -> tuple:
        self.expect("(")
        distinct = self.take("distinct")
        e: tuple | None = None if self.take("*") else self.expression()
        sep = " "
        if self.take(";"):
            self.expect("separator")
            self.expect("=")
            sep = parts(self.term()).lex
        self.expect(")")
        return ("agg", name, distinct, e, sep)


def mentions(x, names: set[str]) -> bool:
    """Whether a part of a query uses one of the variables."""
    if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
        return x[1] in names
    if isinstance(x, Query):
        return any(mentions(y, names) for y in (x.where, x.items or [], x.group, x.having, x.order))
    if isinstance(x, tuple | list):
        return any(mentions(y, names) for y in x)
    return False


def aggregates(e) -> list[tuple]:
    if isinstance(e, tuple) and e and e[0] == "agg":
        return [e]
    if isinstance(e, tuple | list):
        return [a for x in e for a in aggregates(x)]
    return []


VALUES = ("num", "dec", "ts", "tz")  # what a term compares by: of fixed width, so hash aggregates can hold it


def rebuilt(k: Column, values: dict[str, Column]) -> Column:
    """A term from its key and what it compares by."""
    from ..functions.xsd import let, term, term_of_key

    return F.when(k.isNotNull(), let([term_of_key(k)], lambda t: term(*[values[f] if f in values else t[0].getField(f) for f in FIELDS])))


class Solution:
    """Variables and what they are bound to, where there is no frame yet that has them as columns."""

    def __init__(self, bound: dict[str, Column]):
        self.bound, self.columns = bound, list(bound)

    def value(self, name: str) -> Column:
        return self.bound[name]


class Engine:
    def __init__(self, graph: Graph, shapes_graph: Graph | None = None, seed: DataFrame | None = None):
        self.graph, self.shapes_graph, self.seed = graph, shapes_graph, seed
        self.bound = set(seed.columns) if seed is not None else set()
        self.spark = graph.spark
        self.fresh = 0

    @cached_property
    def unit(self) -> DataFrame:
        """A single empty solution."""
        return self.spark.range(1).select(F.lit(1).alias("_one"))

    def start(self, part) -> DataFrame:
        """Where a scope begins: the seed if it uses any of its variables, else a single empty solution."""
        return self.seed if self.seed is not None and mentions(part, self.bound) else self.unit

    # -- patterns

    def group(self, node: tuple, graph: Graph, base: DataFrame | None = None) -> DataFrame:
        df = base if base is not None else self.start(node)
        filters = []
        for part in node[1]:
            kind = part[0]
            if kind == "filter":
                filters.append(part[1])
            elif kind == "bgp":
                df = self.bgp(df, part[1], graph)
            elif kind == "bind":
                if part[1] in df.columns:
                    raise ShapeError(f"?{part[1]} is bound already")
                names = df.columns
                df, e = self.prepared(df, part[2], graph)
                df = df.withColumn(part[1], self.expr(e, df)).select(*[F.col(f"`{c}`") for c in [*names, part[1]]])
            elif kind == "optional":
                df = self.optional(df, part[1], graph)
            elif kind == "union":
                right = None
                for b in part[1]:
                    x = self.group(b, graph)
                    x = x.drop("_one")
                    right = x if right is None else right.unionByName(x, allowMissingColumns=True)
                df = self.join(df, right)
            elif kind == "group":
                df = self.join(df, self.group(part, graph))
            elif kind == "sub":
                df = self.join(df, self.select(part[1], graph))
            elif kind == "graph":
                inner = self.shapes_graph
                df = self.join(df, self.group(part[2], inner)) if inner is not None else df.limit(0)
        for e in filters:
            df = self.filter(df, e, graph)
        return df

    def vars_of(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c != "_one"]

    def join(self, a: DataFrame, b: DataFrame, how: str = "inner", conditions: Sequence[tuple] = ()) -> DataFrame:
        """Joins solutions on the variables of both; an unbound one agrees with anything. Conditions see both sides."""
        if a is self.unit and how == "inner" and not conditions and self.vars_of(b):
            return b.withColumn("_one", F.lit(1)) if "_one" not in b.columns else b
        shared = [c for c in self.vars_of(a) if c in self.vars_of(b)]
        self.fresh += 1
        r = b.drop("_one").select(*[F.col(f"`{c}`").alias(f"{c}__{self.fresh}" if c in shared else c) for c in self.vars_of(b)])
        if not self.vars_of(b):
            # nothing to bind: whether there is a solution at all
            r = b.select(F.lit(1).alias(f"_e{self.fresh}"))
        on = F.lit(True)
        for c in shared:
            x, y = F.col(f"`{c}`.k"), F.col(f"`{c}__{self.fresh}`.k")
            on = on & (x == y if c in self.bound and c in self.sure(a) and c in self.sure(b) or c not in self.maybe else (x == y) | x.isNull() | y.isNull())
        both = {c: F.coalesce(F.col(f"`{c}`"), F.col(f"`{c}__{self.fresh}`")) if c in shared and c in self.maybe else F.col(f"`{c}`") for c in [*a.columns, *[c for c in r.columns if not c.endswith(f"__{self.fresh}")]]}
        for e in conditions:
            on = on & F.coalesce(ebv(self.expr(e, Solution(both))), F.lit(False))
        out = a.join(r, on, how)
        return out.select(*[v.alias(c) for c, v in both.items() if not c.startswith("_e")])

    maybe: set[str] = set()

    def sure(self, df: DataFrame) -> set[str]:
        return set(df.columns) - self.maybe

    def optional(self, df: DataFrame, node: tuple, graph: Graph) -> DataFrame:
        conditions = [p[1] for p in node[1] if p[0] == "filter"]
        inner = ("group", [p for p in node[1] if p[0] != "filter"])
        right = self.group(inner, graph, self.seed if self.seed is not None and mentions(node, self.bound) else None)
        new = [c for c in self.vars_of(right) if c not in self.vars_of(df)]
        for e in conditions:
            if self.exists_in(e):
                right = self.filter(right, e, graph)
        # other filters see both sides: they are conditions of the join
        out = self.join(df, right, "left", [e for e in conditions if not self.exists_in(e)])
        self.maybe = self.maybe | set(new)
        return out

    def exists_in(self, e) -> bool:
        if isinstance(e, tuple) and e and e[0] == "exists":
            return True
        return isinstance(e, tuple | list) and any(self.exists_in(x) for x in e)

    def filter(self, df: DataFrame, e: tuple, graph: Graph) -> DataFrame:
        if e[0] == "call" and e[1] == "logical-and":
            return self.filter(self.filter(df, e[2][0], graph), e[2][1], graph)
        if e[0] == "exists":
            return self.exists(df, e, graph)
        if e[0] == "call" and e[1] == "logical-not" and e[2][0][0] == "exists":
            return self.exists(df, ("exists", not e[2][0][1], e[2][0][2]), graph)
        names = df.columns
        df, e = self.prepared(df, e, graph)
        return df.where(F.coalesce(ebv(self.expr(e, df)), F.lit(False))).select(*[F.col(f"`{c}`") for c in names])

    def exists(self, df: DataFrame, e: tuple, graph: Graph) -> DataFrame:
        right = self.group(e[2], graph)
        shared = [c for c in self.vars_of(df) if c in self.vars_of(right)]
        self.fresh += 1
        r = right.select(*[F.col(f"`{c}`.k").alias(f"{c}__{self.fresh}") for c in shared] or [F.lit(1).alias("_x")])
        on = F.lit(True)
        for c in shared:
            x, y = F.col(f"`{c}`.k"), F.col(f"{c}__{self.fresh}")
            on = on & (x == y if c not in self.maybe else (x == y) | x.isNull() | y.isNull())
        return df.join(r, on, "left_semi" if e[1] else "left_anti")

    def prepared(self, df: DataFrame, e: tuple, graph: Graph) -> tuple[DataFrame, tuple]:
        """Exists inside an expression becomes a column first."""
        if not self.exists_in(e):
            return df, e
        if e[0] == "exists":
            # both answers, each a join by content: no row ids, which may differ when a task is run again
            self.fresh += 1
            flag = f"_flag{self.fresh}"
            answers = [self.exists(df, ("exists", e[1] == yes, e[2]), graph).withColumn(flag, constant(literal(str(yes).lower(), XSD + "boolean"))) for yes in (True, False)]
            return answers[0].unionByName(answers[1]), ("var", flag)
        out = []
        for x in e:
            if isinstance(x, tuple):
                df, x = self.prepared(df, x, graph)
            elif isinstance(x, list):
                ys = []
                for y in x:
                    df, y = self.prepared(df, y, graph)
                    ys.append(y)
                x = ys
            out.append(x)
        return df, tuple(out)

    def bgp(self, df: DataFrame, triples: list[tuple], graph: Graph) -> DataFrame:
        """Triple patterns one after the other, those that touch what is bound first."""
        todo = list(triples)
        while todo:
            have = set(self.vars_of(df))
            free = lambda t: sum(x[0] == "var" and x[1] not in have for x in (t[0], t[2]))
            touches = lambda t: any(x[0] == "var" and x[1] in have for x in (t[0], t[2])) or not have or not any(x[0] == "var" for x in (t[0], t[2]))
            closure = lambda t: isinstance(t[1], Path) and t[1].op in ("star", "plus", "opt")
            t = min(todo, key=lambda t: (not touches(t), closure(t), free(t), todo.index(t)))
            same = self.on_rows(df, t, todo, graph)
            todo = [x for x in todo if x not in same and x is not t]
            df = self.rows(df, same, graph) if len(same) > 1 else self.pattern(df, t, graph)
        return df

    def on_rows(self, df: DataFrame, t: tuple, todo: list[tuple], graph: Graph) -> list[tuple]:
        """Those of the patterns that ask columns of one table of the subject of t, and bind nothing twice."""
        have = self.vars_of(df)
        of = lambda x: graph.table_of(x[1].args[0]) if isinstance(x[1], Path) and x[1].op == "pred" else None
        if t[0][0] != "var" or of(t) is None or t[0][1] in self.maybe or not (t[0][1] in have or df is self.unit):
            return []
        out, names = [], {t[0][1], *have}
        for x in [t, *(x for x in todo if x is not t)]:
            if x[0] == t[0] and of(x) == of(t) and x not in out and (x[2][0] == "term" or x[2][1] not in names):
                out.append(x)
                names |= {x[2][1]} if x[2][0] == "var" else set()
        return out if t in out else []

    def rows(self, df: DataFrame, triples: list[tuple], graph: Graph) -> DataFrame:
        """Patterns that a row of a table answers together: one scan, no join of the table to itself."""
        from ..functions.xsd import node_term

        preds, name = [x[1].args[0] for x in triples], triples[0][0][1]
        rel = graph.row(graph.table_of(preds[0]), preds).withColumnsRenamed({"s": "_s", **{f"o{i}": f"_o{i}" for i in range(len(preds))}})
        add = {} if name in self.vars_of(df) else {name: node_term(F.col("_s"))}
        for i, x in enumerate(triples):
            if x[2][0] == "term":
                rel = rel.where(F.col(f"_o{i}.k") == x[2][1])
            else:
                add[x[2][1]] = F.col(f"_o{i}")
        out = rel.withColumn("_one", F.lit(1)) if df is self.unit else df.join(rel, F.col(f"`{name}`.k") == F.col("_s"))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(c) for c, v in add.items()])

    def pattern(self, df: DataFrame, t: tuple, graph: Graph) -> DataFrame:
        s, p, o = t
        have = self.vars_of(df)
        if isinstance(p, Path) and not (p.op == "pred" or p.op == "inv" and p.args[0].op == "pred" or p.op == "not"):
            return self.path(df, s, p, o, graph)
        if isinstance(p, Path):
            if p.op == "inv":
                s, o, p = o, s, p.args[0]
            if p.op == "not":
                every = graph.triples(tuple(p.args[0]))
                rel = every.select(F.col("s").alias("_s"), F.col("o").alias("_o"))
            else:
                rel = graph.rel(p.args[0]).select(F.col("s").alias("_s"), F.col("o").alias("_o"))
        else:
            rel = graph.triples().select(F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"))
        from ..functions.xsd import iri_term, node_term

        subject = node_term(F.col("_s"))
        on, add = F.lit(True), {}
        for x, key, value in ((s, F.col("_s"), subject), (o, F.col("_o.k"), F.col("_o")), *([(p, F.col("_p"), iri_term(F.col("_p")))] if isinstance(p, tuple) else [])):
            if x[0] == "term":
                rel = rel.where(key == x[1])
            elif x[1] in have:
                c = F.col(f"`{x[1]}`.k")
                on = on & (c == key if x[1] not in self.maybe else (c == key) | c.isNull())
                if x[1] in self.maybe:
                    add[x[1]] = F.coalesce(F.col(f"`{x[1]}`"), value)
            elif x[1] in add:
                on = on & (add[x[1]].getField("k") == key)
            else:
                add[x[1]] = value
        out = rel.withColumn("_one", F.lit(1)) if df is self.unit else df.join(rel, on)
        return out.select(*[add.pop(c).alias(c) if c in add else F.col(f"`{c}`") for c in df.columns], *[v.alias(c) for c, v in list(add.items())])

    def path(self, df: DataFrame, s: tuple, p: Path, o: tuple, graph: Graph) -> DataFrame:
        from ..operators.paths import inverse

        have = self.vars_of(df)
        if not (s[0] == "term" or s[1] in have) and (o[0] == "term" or o[1] in have):
            s, o, p = o, s, inverse(p)
        if s[0] == "term":
            starts = self.spark.range(1).select(F.lit(s[1]).alias("node"))
        elif s[1] in have:
            starts = df.select(F.col(f"`{s[1]}`.k").alias("node")).where("node is not null").distinct()
        else:
            starts = graph.nodes().select(F.col("o.k").alias("node")).distinct()
        pairs = walk(graph, starts.withColumn("_from", F.col("node")), ["_from"], p).withColumnRenamed("o", "_to")
        from ..functions.xsd import term_of_key

        on, add = F.lit(True), {}
        if s[0] == "var":
            if s[1] in have:
                on = on & (F.col(f"`{s[1]}`.k") == F.col("_from"))
            else:
                add[s[1]] = term_of_key(F.col("_from"))
        if o[0] == "term":
            pairs = pairs.where(F.col("_to.k") == o[1])
        elif o[1] in have:
            on = on & (F.col(f"`{o[1]}`.k") == F.col("_to.k"))
        elif o == s:
            pairs = pairs.where(F.col("_to.k") == F.col("_from"))
        else:
            add[o[1]] = F.col("_to")
        out = pairs.withColumn("_one", F.lit(1)) if df is self.unit else df.join(pairs, on)
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(c) for c, v in add.items()])

    # -- expressions

    def expr(self, e: tuple, df: DataFrame | Solution) -> Column:
        kind = e[0]
        if kind == "term":
            return constant(e[1])
        if kind == "var":
            return df.value(e[1]) if isinstance(df, Solution) and e[1] in df.columns else F.col(f"`{e[1]}`") if e[1] in df.columns else F.lit(None).cast(TERM)
        if kind == "in":
            x = self.expr(e[1], df)
            out = F.lit(False)
            for i in e[2]:
                out = out | equal(x, self.expr(i, df))
            from ..functions.library import boolean

            return boolean(out)
        if kind == "col":
            return e[1]
        if kind == "call":
            name = e[1]
            if name in ("plus", "subtract") and any(a[0] == "term" and parts(a[1]).dt in NUMERIC for a in e[2]):
                name += "#"
            args = [self.expr(x, df) for x in e[2]]
            inner = [i for i, x in enumerate(e[2]) if x[0] == "call" and x[1] not in TESTS]

            def outer(values: list[Column]) -> Column:
                return call(name, [values[inner.index(i)] if i in inner else a for i, a in enumerate(args)])

            try:
                return let([args[i] for i in inner], outer)
            except (KeyError, TypeError) as err:
                raise ShapeError(f"unknown function or wrong arguments: {e[1]}") from err
        raise ShapeError(f"{kind} can't stand in an expression here")

    # -- queries

    def grouped(self, q: Query, df: DataFrame, graph: Graph) -> DataFrame:
        carried = [c for c in self.vars_of(df) if c in self.bound]
        keys: dict[str, Column] = {c: F.col(f"`{c}`") for c in carried}
        for n, (name, e) in enumerate(q.group):
            keys[name or f"_g{n}"] = self.expr(e, df)
        found = list({repr(a): a for x in (*[e for _, e in q.items or []], *q.having, *[e for _, e in q.order]) for a in aggregates(x)}.values())
        # only what is grouped by and summed up goes on; a key's text is made of its key again
        for k, v in keys.items():
            df = df.withColumn(k, v)
        aggs, names, ins = [], {}, []
        for n, a in enumerate(found):
            names[repr(a)] = f"_a{n}"
            own, made = self.aggregate(a, df, f"_a{n}")
            ins += own
            aggs += made
        pairs = [F.col(f"`{k}`.k").alias(f"_k{i}") for i, k in enumerate(keys)]
        rest = [F.col(f"`{k}`.{f}").alias(f"_k{i}{f}") for i, k in enumerate(keys) for f in VALUES]
        if not pairs:
            out = df.select(*ins, F.lit(1).alias("_n")).agg(*aggs) if aggs else df.limit(1)
        else:
            out = df.select(*pairs, *rest, *ins).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(*[F.first(f"_k{i}{f}").alias(f"_k{i}{f}") for i in range(len(keys)) for f in VALUES], *(aggs or [F.count(F.lit(1)).alias("_n")]))
            terms = [rebuilt(F.col(f"_k{i}"), {f: F.col(f"_k{i}{f}") for f in VALUES}).alias(k) for i, k in enumerate(keys)]
            out = out.select(*terms, *([f"_a{n}" for n in range(len(found))] or ["_n"]))
        if self.seed is not None and not q.group and carried:
            # a focus without solutions is a group of its own: COUNT is 0
            out = self.join(self.seed.select(*carried).distinct(), out, "left")
        for n, a in enumerate(found):
            out = out.withColumn(f"_a{n}", self.finished(a, f"_a{n}", out))

        def swap(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                return ("var", names[repr(e)])
            if isinstance(e, tuple):
                return tuple(swap(x) for x in e)
            return [swap(x) for x in e] if isinstance(e, list) else e

        for h in q.having:
            out = self.filter(out, swap(h), graph)
        if q.items:
            q.items = [(v, swap(e)) for v, e in q.items]
        q.order = [(d, swap(e)) for d, e in q.order]
        return out

    def aggregate(self, a: tuple, df: DataFrame, name: str) -> tuple[list[Column], list[Column]]:
        """The columns an aggregate needs of each solution, and what sums them up."""
        _, kind, distinct, e, sep = a
        if e is None:
            return [], [F.count(F.lit(1)).alias(name)]
        x = self.expr(e, df)
        k = x.getField("k")
        of = lambda f: F.col(f"{name}{f}")
        if kind == "count":
            return ([k.alias(f"{name}k")], [F.countDistinct(of("k")).alias(name)]) if distinct else ([k.isNotNull().alias(f"{name}k")], [F.count_if(of("k")).alias(name)])
        if kind in ("sum", "avg"):
            dt = x.getField("dt")
            rank = F.when(dt.isin(XSD + "double", XSD + "float"), 3).when(dt == XSD + "decimal", 2).otherwise(1)
            pick = F.sum_distinct if distinct else F.sum
            ins = [x.getField("num").alias(f"{name}num"), x.getField("dec").alias(f"{name}dec"), k.isNotNull().alias(f"{name}k"), rank.alias(f"{name}rank")]
            return ins, [F.struct(pick(of("num")).alias("num"), pick(of("dec")).alias("dec"), F.count_if(of("k")).alias("n"), F.count(of("num")).alias("good"), F.max(of("rank")).alias("rank")).alias(name)]
        if kind in ("min", "max"):
            ins = [x.getField(f).alias(f"{name}{f}") for f in ("k", "lex", *VALUES)]
            order = F.struct(of("num").alias("a"), of("ts").alias("b"), of("lex").alias("c"))
            return ins, [(F.min_by if kind == "min" else F.max_by)(F.struct(*[of(f).alias(f) for f in ("k", *VALUES)]), F.when(of("k").isNotNull(), order)).alias(name)]
        if kind == "sample":
            return [x.alias(f"{name}x")], [F.min_by(of("x"), of("x").getField("k")).alias(name)]
        values = F.collect_set(of("x")) if distinct else F.collect_list(of("x"))
        return [text(x).alias(f"{name}x")], [F.array_join(F.array_sort(values), sep).alias(name)]

    def finished(self, a: tuple, name: str, df: DataFrame) -> Column:
        _, kind, _, e, _ = a
        c = F.col(name)
        if kind == "count":
            return integer(F.coalesce(c, F.lit(0)))
        if kind in ("sum", "avg"):
            n, num, dec, rank = (F.coalesce(c.getField("n"), F.lit(0)), c.getField("num"), c.getField("dec"), c.getField("rank"))
            ok = c.getField("good") == n
            dt = F.when(rank == 3, XSD + "double").when(rank == 2, XSD + "decimal").otherwise(XSD + ("integer" if kind == "sum" else "decimal"))
            if kind == "avg":
                num, dec = num / n, quotient(dec, F.when(n > 0, n).cast(DEC))
            return F.when(n == 0, constant(literal("0", XSD + "integer"))).when(ok, numeric(num, dec.try_cast(DEC), dt))
        if kind == "group_concat":
            return string(F.coalesce(c, F.lit("")))
        return rebuilt(c.getField("k"), {f: c.getField(f) for f in VALUES}) if kind in ("min", "max") else c

    def select(self, q: Query, graph: Graph | None = None) -> DataFrame:
        graph = graph or self.graph
        df = self.group(q.where, graph, self.seed if self.seed is not None and mentions(q, self.bound) else None)
        if q.group or any(aggregates(e) for _, e in q.items or []) or q.having:
            df = self.grouped(q, df, graph)
        if q.items is not None:
            for v, e in q.items:
                if e != ("var", v):
                    if v in df.columns:
                        raise ShapeError(f"?{v} is bound already")
                    df, e = self.prepared(df, e, graph)
                    df = df.withColumn(v, self.expr(e, df))
        carried = [c for c in self.vars_of(df) if c in self.bound]
        names = list(dict.fromkeys([*carried, *([v for v, _ in q.items] if q.items is not None else [c for c in self.vars_of(df) if not c.startswith("_")])]))
        for v in names:
            if v not in df.columns:
                df = df.withColumn(v, F.lit(None).cast(TERM))
        order, keys = [], []
        for down, e in q.order:
            x = self.expr(e, df)
            for f in ("num", "ts", "lex"):
                y = x.getField(f)
                keys.append(y)
                order.append(y.desc_nulls_last() if down else y.asc_nulls_first())
        if q.distinct and not order:
            df = df.select(*[F.col(f"`{v}`") for v in names]).distinct()
        elif q.distinct:
            # a solution stands where the first of its equals would
            named = [(f"_o{i}", y, q.order[i // 3][0]) for i, y in enumerate(keys)]
            df = df.select(*[F.col(f"`{v}`") for v in names], *[y.alias(n) for n, y, _ in named])
            df = df.groupBy(*[F.col(f"`{v}`") for v in names]).agg(*[(F.max if down else F.min)(n).alias(n) for n, _, down in named])
            order = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, _, down in named]
        if q.limit is not None or q.offset:
            order = order or [F.lit(0)]
            w = Window.partitionBy(*([F.col(f"`{c}`.k") for c in carried] or [F.lit(0)])).orderBy(*order)
            df = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > q.offset)
            if q.limit is not None:
                df = df.where(F.col("_rn") <= q.offset + q.limit)
        elif order and not carried:
            df = df.orderBy(*order)
        return df.select(*[F.col(f"`{v}`") for v in names])

    def construct(self, q: Query) -> DataFrame:
        """(s, p, o) that the template makes of the solutions; rows that aren't triples are dropped."""
        df = self.select(Query("select", q.where, None, order=q.order, limit=q.limit, offset=q.offset))
        out = None
        for s, p, o in q.template:
            if isinstance(p, Path):
                p = ("term", p.args[0])
            a, b, c = (self.expr(x, df) if x[0] == "term" or x[1] in df.columns else term_blank(x[1], df) for x in (s, p, o))
            rows = df.select(a.alias("a"), b.alias("b"), c.alias("c")).where((F.col("b.kind") == "I") & F.col("a.kind").isin("I", "B") & F.col("c.k").isNotNull()).select(F.col("a.k").alias("s"), F.col("b.k").alias("p"), F.col("c").alias("o"))
            out = rows if out is None else out.unionByName(rows)
        return (out if out is not None else self.graph.triples().limit(0)).distinct()


def term_blank(name: str, df: DataFrame) -> Column:
    """A blank node of a template: one for each solution."""
    from ..functions.xsd import node_term

    keys = [F.coalesce(F.col(f"`{c}`.k"), F.lit("")) for c in df.columns]
    return node_term(F.concat(F.lit("_:c"), F.md5(F.concat_ws("\t", F.lit(name), *keys))))


def parse(query: str) -> Query:
    return Parser(query).query()


def check_prebound(q: Query, names: set[str]) -> None:
    """A pre-bound variable can't be bound again, and a subquery that uses one must project it."""

    def look(x) -> None:
        if isinstance(x, Query):
            used = {n for n in names if mentions(x.where, {n})}
            if x is not q and x.items is not None and used - {v for v, _ in x.items}:
                raise ShapeError("a subquery uses a pre-bound variable without projecting it")
            for v, e in x.items or []:
                if e != ("var", v) and v in names:
                    raise ShapeError(f"?{v} is pre-bound")
            look(x.where)
        elif isinstance(x, tuple) and x and x[0] == "bind" and x[1] in names:
            raise ShapeError(f"?{x[1]} is pre-bound")
        elif isinstance(x, tuple | list):
            for y in x:
                look(y)

    look(q)


def select(validator, query: str, seed: DataFrame | None = None) -> DataFrame:
    q = parse(query)
    if q.form != "select":
        raise ShapeError("a SELECT query is asked for")
    return Engine(validator.graph, shapes_graph_of(validator), seed).select(q)


def shapes_graph_of(validator) -> Graph | None:
    from ..sources.graph import TripleGraph

    if getattr(validator, "shapes", None) is None:
        return None
    if not hasattr(validator, "_shapes_graph"):
        validator._shapes_graph = TripleGraph.of(validator.spark, validator.shapes.graph.rows)
    return validator._shapes_graph


def message(text_: str, columns: dict[str, Column]) -> Column:
    """A message with {?x} and {$x} replaced by what x is bound to."""
    out, last = [], 0
    for m in re.finditer(r"\{[?$](\w+)\}", text_):
        out.append(F.lit(text_[last : m.start()]))
        c = columns.get(m[1])
        out.append(F.coalesce(c.getField("lex"), F.lit(m[0])) if c is not None else F.lit(m[0]))
        last = m.end()
    return F.concat(*out, F.lit(text_[last:]))


def constraint(validator, shape: Shape, c: Constraint, frame: DataFrame, v: DataFrame) -> list[DataFrame]:
    """Results of a SPARQL constraint, or of a constraint component, for all focus nodes at once."""
    form, source = c.value
    if "$PATH" in source and shape.path:
        source = source.replace("$PATH", shape.path.text()).replace("?PATH", shape.path.text())
    q = parse(source)
    fixed = {"currentShape": shape.node, "shapesGraph": "<urn:x-shacl:shapes-graph>"} | c.extra.get("params", {})
    custom = c.kind == "component"
    check_prebound(q, {"this", *fixed, *(["value"] if custom and form == "ask" else [])})
    if custom:
        seed = v.select(F.col("f").alias("this"), F.col("v").alias("value")).distinct()
    else:
        seed = frame.select(F.col("f").alias("this")).distinct()
    extra = {n: constant(k) for n, k in fixed.items() if mentions(q, {n})}
    if not (custom and (form == "ask" or mentions(q, {"value"}))) and "value" in seed.columns:
        seed = seed.select("this").distinct()
    seed = seed.select("*", *[x.alias(n) for n, x in extra.items()])
    engine = Engine(validator.graph, shapes_graph_of(validator), seed)
    rows = engine.group(q.where, validator.graph, seed) if form == "ask" else engine.select(q)
    if "this" not in rows.columns:
        rows = rows.crossJoin(seed.select("this")) if not rows.columns else rows.join(seed.select("this"))
    own = c.messages or shape.messages
    by_value = custom
    base = v if by_value else frame.withColumn("v", F.col("f"))
    params = {n: constant(k) for n, k in c.extra.get("params", {}).items()}

    def texts(columns: dict[str, Column]) -> Column:
        return F.array(*[message(parts(m).lex, columns) for m in own]).cast("array<string>")

    columns = {"this": F.col("f"), "value": F.col("v"), "currentShape": constant(shape.node), **params}
    if form == "ask":
        keys = [F.col("this.k").alias("_t")] + ([F.col("value.k").alias("_v")] if "value" in rows.columns and by_value else [])
        hit = rows.select(*keys).distinct()
        on = F.col("f.k") == F.col("_t")
        if len(keys) > 1:
            on = on & (F.col("v.k") == F.col("_v"))
        return [validator.results(base.join(hit, on, "left_anti"), shape, c, F.col("v.k"), messages=texts(columns))]
    if by_value:
        keys = [F.col("this.k").alias("_t")] + ([F.col("value.k").alias("_v")] if "value" in rows.columns else [])
        hit = rows.select(*keys).distinct()
        on = F.col("f.k") == F.col("_t")
        if len(keys) > 1:
            on = on & (F.col("v.k") == F.col("_v"))
        return [validator.results(base.join(hit, on, "left_semi"), shape, c, F.col("v.k"), messages=texts(columns))]
    rows = rows.select(*[F.col(f"`{x}`").alias(f"q_{x}") for x in rows.columns])
    joined = frame.join(rows, F.col("f.k") == F.col("q_this.k"))
    value = F.coalesce(F.col("q_value.k"), F.col("f.k")) if "q_value" in rows.columns else F.col("f.k") if not shape.path else F.lit(None)
    value = F.col("q_value.k") if "q_value" in rows.columns and shape.path else value
    where = F.coalesce(F.when(F.col("q_path.kind") == "I", F.col("q_path.k")), F.lit(shape.path.text() if shape.path else None)) if "q_path" in rows.columns else None
    columns = {x[2:]: F.col(x) for x in rows.columns} | {"currentShape": constant(shape.node)}
    columns.setdefault("value", F.col("f"))
    return [validator.results(joined, shape, c, value, where, texts(columns))]

