"""Graphs as catalogs of predicate relations: predicate -> DataFrame(s: key, o: term).

A graph is backed by Parquet tables through a mapping (nothing is copied: a predicate is a projection of a scan), by a
DataFrame of triples, or by several of these.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.xsd import TERM, iri_term, lang_term, literal_term, node_term, term_of_key, term_row
from ..terms import FIRST, NIL, REST, TYPE, XSD, ParseError, iri
from .rdf import base_of, format_of, parse, read, statements

EMPTY = "s string, o " + TERM.simpleString()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint(eager=True)


class Graph:
    spark: SparkSession

    def predicates(self) -> list[str]:
        raise NotImplementedError

    def rel(self, p: str) -> DataFrame:
        """(s, o) of a predicate; each row once."""
        raise NotImplementedError

    def table_of(self, p: str) -> str | None:
        """The table whose rows are the subjects of a predicate with one value at most, if there is one."""
        return None

    def outer(self, p: str) -> DataFrame | None:
        """(s, o) with a null o for rows of the table without a value; only if table_of(p)."""
        return None

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], EMPTY)

    def triples(self, without: tuple[str, ...] = ()) -> DataFrame:
        """(s, p, o) of all predicates but some."""
        rels = [self.rel(p).select("s", F.lit(p).alias("p"), "o") for p in self.predicates() if p not in without]
        return reduce(DataFrame.unionByName, rels) if rels else self.empty().select("s", F.lit("").alias("p"), "o")

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """(s, p, o) of the triples with the given terms; all others are free."""
        df = self.rel(p).select("s", F.lit(p).alias("p"), "o") if p else self.triples()
        if s:
            df = df.where(F.col("s") == s)
        return df.where(F.col("o.k") == o) if o else df

    def nodes(self) -> DataFrame:
        """(o) the terms that are a subject or an object of a triple."""
        t = self.triples()
        return t.select(node_term(F.col("s")).alias("o")).unionByName(t.select("o")).distinct()

    def lists(self, heads: DataFrame) -> DataFrame:
        """(k, members) for heads (k): the terms of each list; null if it is malformed, cyclic or not one."""
        first, rest = self.rel(FIRST), self.rel(REST)
        one = first.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.first("o").alias("o")).where("n = 1").select(F.col("s").alias("fs"), "o")
        nxt = rest.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.first("o.k").alias("to")).where("n = 1").select(F.col("s").alias("rs"), "to")
        cells = cut(one.join(nxt, F.col("fs") == F.col("rs")).where(F.col("fs") != NIL).select(F.col("fs").alias("cell"), "o", "to"))
        # jumps[i]: the cell 2^i after a cell, where there is one; only keys, and fewer from one to the next
        jumps = [cut(cells.select("cell", "to").join(cells.select(F.col("cell").alias("to")), "to", "left_semi").select("cell", "to"))]
        n = jumps[0].count()
        while n:
            far = cut(jumps[-1].join(jumps[-1].select(F.col("cell").alias("to"), F.col("to").alias("then")), "to").select("cell", F.col("then").alias("to")))
            before, n = n, far.count()
            if n == before:
                break  # a list that ended would have a cell that just reaches its end: the rest go in circles
            jumps.append(far)
        circles = jumps.pop()
        k = cut(heads.select("k").distinct())
        at = k.join(cells.select("cell"), F.col("k") == F.col("cell"), "left_semi").join(circles, F.col("k") == F.col("cell"), "left_anti").select("k", F.lit(0).cast("long").alias("pos"), F.col("k").alias("cell"))
        # each place of a list is a sum of jumps, the longest first
        for i in reversed(range(len(jumps))):
            at = cut(at.unionByName(at.join(jumps[i], "cell").select("k", (F.col("pos") + 2**i).alias("pos"), F.col("to").alias("cell"))))
        whole = at.join(cells, "cell").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "o"))).alias("members"), F.max(F.col("to") == NIL).alias("ends")).where("ends")
        found = whole.select("k", F.transform("members", lambda x: x.getField("o")).alias("members"))
        return k.join(found.unionByName(k.where(F.col("k") == NIL).select("k", F.array().cast(f"array<{TERM.simpleString()}>").alias("members"))), "k", "left")

    def list_heads(self) -> bool:
        return FIRST in self.predicates()


@dataclass
class TableMap:
    """How a table's rows are nodes: subject template, class, and columns as predicates.

    A column is (datatype IRI), ("ref", template) or ("lang", column of the tag); a class can be a column's value.
    """

    name: str
    df: DataFrame
    subject: tuple[str, ...]  # IRI prefix and key columns
    class_iri: str | None = None
    columns: dict[str, tuple[str, object]] = field(default_factory=dict)  # predicate IRI -> (column, kind)
    class_column: tuple[str, str] | None = None  # prefix, column
    lists: dict[str, tuple[str, str]] = field(default_factory=dict)  # predicate -> (array column, datatype)

    def key(self) -> Column:
        cols = []
        for i, c in enumerate(self.subject[1:]):
            cols += ([F.lit("-")] if i else []) + [F.col(c).cast("string")]
        return F.concat(F.lit("<" + self.subject[0]), *cols, F.lit(">"))

    def object(self, p: str) -> Column:
        column, kind = self.columns[p]
        c = F.col(column)
        if isinstance(kind, tuple) and kind[0] == "ref":
            return iri_term(F.concat(F.lit("<" + kind[1]), c.cast("string"), F.lit(">")))
        if isinstance(kind, tuple) and kind[0] == "lang":
            return lang_term(c, F.col(kind[1]))
        t = self.df.schema[column].dataType.typeName()
        if t in ("timestamp", "timestamp_ntz"):
            return literal_term(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), kind, c.cast("timestamp"))
        return literal_term(c.cast("string"), kind, c if t in ("integer", "long", "double", "float", "short", "byte", "decimal") else None)


class TableGraph(Graph):
    def __init__(self, spark: SparkSession, tables: list[TableMap]):
        self.spark, self.tables = spark, {t.name: t for t in tables}
        self.by: dict[str, list[TableMap]] = {}
        for t in tables:
            for p in t.columns:
                self.by.setdefault(p, []).append(t)

    def predicates(self) -> list[str]:
        typed = any(t.class_iri or t.class_column for t in self.tables.values())
        return [TYPE] * typed + list(self.by)

    def types(self, t: TableMap) -> list[DataFrame]:
        out = []
        if t.class_iri:
            out.append(t.df.select(t.key().alias("s"), iri_term(F.lit(iri(t.class_iri))).alias("o")))
        if t.class_column:
            prefix, c = t.class_column
            out.append(t.df.select(t.key().alias("s"), iri_term(F.concat(F.lit("<" + prefix), F.col(c), F.lit(">"))).alias("o")))
        return out

    def rel(self, p: str) -> DataFrame:
        if p == TYPE:
            rels = [x for t in self.tables.values() for x in self.types(t)]
        else:
            rels = [t.df.where(F.col(t.columns[p][0]).isNotNull()).select(t.key().alias("s"), t.object(p).alias("o")) for t in self.by.get(p, [])]
        return reduce(DataFrame.unionByName, rels) if rels else self.empty()

    def table_of(self, p: str) -> str | None:
        found = self.by.get(p, [])
        return found[0].name if len(found) == 1 else None

    def outer(self, p: str) -> DataFrame | None:
        t = self.by[p][0]
        return t.df.select(t.key().alias("s"), F.when(F.col(t.columns[p][0]).isNotNull(), t.object(p)).alias("o"))

    def columns(self, table: str, predicates: list[str]) -> DataFrame:
        """(s, k0, k1, ...) the keys of the values of some columns of a table, null where there is none."""
        t = self.tables[table]
        return t.df.select(t.key().alias("s"), *[F.when(F.col(t.columns[p][0]).isNotNull(), t.object(p).getField("k")).alias(f"k{i}") for i, p in enumerate(predicates)])

    def row(self, table: str, predicates: list[str]) -> DataFrame:
        """(s, o0, o1, ...) the values of some columns of a table, of rows that have them all."""
        t = self.tables[table]
        rows = t.df.where(reduce(lambda a, b: a & b, [F.col(t.columns[p][0]).isNotNull() for p in predicates]))
        return rows.select(t.key().alias("s"), *[t.object(p).alias(f"o{i}") for i, p in enumerate(predicates)])

    def class_table(self, c: str) -> str | None:
        """The table whose rows are all the instances of a class, if no other row is."""
        if any(t.class_column for t in self.tables.values()):
            own = [t for t in self.tables.values() if t.class_iri and iri(t.class_iri) == c]
            other = [t for t in self.tables.values() if t.class_column and c.startswith("<" + t.class_column[0])]
            return own[0].name if len(own) == 1 and not other else None
        own = [t for t in self.tables.values() if t.class_iri and iri(t.class_iri) == c]
        return own[0].name if len(own) == 1 else None

    def subjects(self, table: str) -> DataFrame:
        t = self.tables[table]
        return t.df.select(t.key().alias("s"))

    def list_heads(self) -> bool:
        return any(t.lists for t in self.tables.values())

    def lists(self, heads: DataFrame) -> DataFrame:
        """A list is an array column; its head is the subject of its row."""
        out = None
        for t in self.tables.values():
            for _, (column, dt) in t.lists.items():
                x = t.df.select(t.key().alias("h"), F.transform(column, lambda x: literal_term(x.cast("string"), dt)).alias("members"))
                out = x if out is None else out.unionByName(x)
        k = heads.select("k").distinct()
        if out is None:
            return k.select("k", F.lit(None).cast(f"array<{TERM.simpleString()}>").alias("members"))
        return k.join(out, F.col("k") == F.col("h"), "left").select("k", "members")


class TripleGraph(Graph):
    """Triples (s, p, o) in a DataFrame; with `names`, the predicates need no look at the data."""

    def __init__(self, df: DataFrame, names: list[str] | None = None):
        self.df, self.spark, self._names = df, df.sparkSession, names

    @classmethod
    def of(cls, spark: SparkSession, triples) -> TripleGraph:
        rows = list(dict.fromkeys(triples))
        df = spark.createDataFrame([(s, p, term_row(o)) for s, p, o in rows], f"s string, p string, o {TERM.simpleString()}").coalesce(1 + len(rows) // 50_000)
        return cls(df, list(dict.fromkeys(p for _, p, _ in rows)))

    @classmethod
    def keys(cls, df: DataFrame) -> TripleGraph:
        """From keys (s, p, k)."""
        return cls(df.select("s", "p", term_of_key(F.col("k")).alias("o")).distinct())

    def predicates(self) -> list[str]:
        if self._names is None:
            self._names = sorted(r[0] for r in self.df.select("p").distinct().collect())
        return self._names

    def rel(self, p: str) -> DataFrame:
        return self.df.where(F.col("p") == p).select("s", "o")

    def triples(self, without: tuple[str, ...] = ()) -> DataFrame:
        return self.df.where(~F.col("p").isin(*without)) if without else self.df

    def count(self) -> int:
        return self.df.count()


class UnionGraph(Graph):
    def __init__(self, graphs: list[Graph]):
        self.graphs, self.spark = graphs, graphs[0].spark

    def predicates(self) -> list[str]:
        return list(dict.fromkeys(p for g in self.graphs for p in g.predicates()))

    def rel(self, p: str) -> DataFrame:
        rels = [g.rel(p) for g in self.graphs if p in g.predicates()]
        return self.empty() if not rels else rels[0] if len(rels) == 1 else reduce(DataFrame.unionByName, rels).distinct()

    def table_of(self, p: str) -> str | None:
        own = [g for g in self.graphs if p in g.predicates()]
        return own[0].table_of(p) if len(own) == 1 else None

    def outer(self, p: str) -> DataFrame | None:
        return next(g for g in self.graphs if p in g.predicates()).outer(p)

    def class_table(self, c: str) -> str | None:
        own = [g for g in self.graphs if TYPE in g.predicates()]
        return own[0].class_table(c) if len(own) == 1 and isinstance(own[0], TableGraph) else None

    def columns(self, table: str, predicates: list[str]) -> DataFrame:
        return next(g for g in self.graphs if isinstance(g, TableGraph) and table in g.tables).columns(table, predicates)

    def row(self, table: str, predicates: list[str]) -> DataFrame:
        return next(g for g in self.graphs if isinstance(g, TableGraph) and table in g.tables).row(table, predicates)

    def subjects(self, table: str) -> DataFrame:
        return next(g for g in self.graphs if isinstance(g, TableGraph) and table in g.tables).subjects(table)

    def list_heads(self) -> bool:
        return any(g.list_heads() for g in self.graphs)

    def lists(self, heads: DataFrame) -> DataFrame:
        own = [g for g in self.graphs if g.list_heads()]
        return (own[0] if own else self.graphs[0]).lists(heads)


BAD_LINE = "not an N-Triples or N-Quads statement"
NT = r"^\s*(<[^>]*>|_:[^\s]+)\s+(<[^>]*>)\s+(<<\(.*\)>>|<[^>]*>|_:[^\s]+|\"(?:[^\"\\]|\\.)*\"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(?:<[^>]*>|_:[^\s]+)?\s*\.\s*(?:#.*)?$"


def read_lines(spark: SparkSession, path: str | list[str]) -> TripleGraph:
    """N-Triples or N-Quads, one statement a line, read in parallel; .gz too. Blank labels are kept apart by file.

    A line that is neither a statement nor a comment nor blank fails the job that reads it.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    good = F.col("value").rlike(NT)
    lines = lines.select(F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit(BAD_LINE + ": "), F.substring("value", 1, 200)))).alias("value"), F.input_file_name().alias("file"))
    scope = F.substring(F.sha2("file", 256), 1, 8)
    own = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("_:"), scope, F.substring(c, F.lit(3), F.length(c)))).otherwise(c)
    s, p, o = (F.regexp_extract("value", NT, i) for i in (1, 2, 3))
    o = F.when(o.endswith(f"^^<{XSD}string>"), F.regexp_replace(o, r"\^\^<[^>]*>$", "")).otherwise(o)
    return TripleGraph.keys(lines.select(own(s).alias("s"), p.alias("p"), own(o).alias("k")))


def read_documents(spark: SparkSession, paths: list[str], syntax: str | None = None, large: int = 1 << 20) -> TripleGraph:
    """One graph of many documents of any syntax; large Turtle is cut at statements, a megabyte a part, and parsed by many tasks.

    "-" is the standard input, once; its syntax has to be given.
    """
    from .rdf import Turtle

    out: list[DataFrame] = []
    small: list[tuple[str, str, str]] = []
    if paths.count("-") > 1:
        raise ParseError("the standard input can be read once")
    for i, path in enumerate(paths):
        if path == "-" and not syntax:
            raise ParseError("the syntax of the standard input has to be given")
        kind = syntax or format_of(path)
        if path == "-":
            small += parse(sys.stdin.read(), kind, "", f"d{i}")
            continue
        if kind in ("ntriples", "nquads"):
            out.append(read_lines(spark, path).df)
            continue
        text = read(path)
        cuts = statements(text, len(text) // large + 1) if kind == "turtle" and len(text) >= large else None
        if not cuts:
            small += parse(text, kind or "", base_of(path), f"d{i}")
            continue
        prologue, chunks = cuts
        base = base_of(path)
        rdd = spark.createDataFrame([(n, c) for n, c in enumerate(chunks)], "n int, text string").repartition(len(chunks), "n")

        def run(batches, prologue=prologue, base=base, i=i):
            import pyarrow as pa

            for b in batches:
                for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    t = Turtle(prologue + text, base, f"d{i}c{n}").document()
                    yield pa.RecordBatch.from_pydict({"s": [x[0] for x in t], "p": [x[1] for x in t], "k": [x[2] for x in t]})

        out.append(TripleGraph.keys(rdd.mapInArrow(run, "s string, p string, k string")).df)
    if small or not out:
        out.append(TripleGraph.of(spark, small).df)
    return TripleGraph(reduce(DataFrame.unionByName, out).distinct())


def cached(spark: SparkSession, path: str, cache: str) -> TripleGraph:
    """The graph of a document through a Parquet copy, partitioned by predicate, that is made anew when the document changes."""
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    note = os.path.join(cache, "digest.json")
    try:
        with open(note) as f:
            fresh = json.load(f)["sha256"] == digest
    except (OSError, ValueError, KeyError):
        fresh = False
    if not fresh:
        write(read_documents(spark, [path]), os.path.join(cache, "triples"))
        with open(note, "w") as f:
            json.dump({"sha256": digest}, f)
    return stored(spark, os.path.join(cache, "triples"))


def write(graph: Graph, path: str) -> None:
    graph.triples().write.mode("overwrite").partitionBy("p").parquet(path)


def stored(spark: SparkSession, path: str) -> TripleGraph:
    """A graph written with write(): a predicate reads its own folder alone."""
    return TripleGraph(spark.read.schema(f"s string, o {TERM.simpleString()}, p string").parquet(path).select("s", "p", "o"))
