"""The library's front door: shapes from text or files, validation of files and graphs, reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import inference, report
from .operators.validate import validate as run
from .plans import ir
from .sources.graph import Graph, TripleGraph, read_documents
from .sources.rdf import parse, parse_file
from .terms import ShapeError, Triples, sh

MODES = ("none", "rdfs", "rules", "rules-iterated")


@dataclass
class Report:
    results_df: DataFrame
    shapes: ir.Shapes
    disallowed: tuple[str, ...] = ir.DISALLOWED
    _rows: list = field(default_factory=list)

    @property
    def conforms(self) -> bool:
        from .operators.validate import conforms

        return conforms(self.results_df, self.disallowed)

    @property
    def results(self) -> list:
        return self.results_df.collect()

    def root_shape(self, node: str) -> str | None:
        """The nearest shape with an IRI above a property shape."""
        g = self.shapes.graph
        for _ in range(16):
            if not node.startswith("_:"):
                return node
            up = g.subjects(sh("property"), node)
            if not up:
                return None
            node = up[0]
        return None

    def serialize(self, syntax: str = "turtle") -> str:
        return report.serialize(report.report_graph(self.results_df, self.shapes, self.disallowed), syntax)

    @property
    def turtle(self) -> str:
        return self.serialize("turtle")

    @property
    def text(self) -> str:
        return report.human(self.results_df, self.disallowed)

    def __bool__(self) -> bool:
        return self.conforms

    def __len__(self) -> int:
        return self.results_df.count()


class Shapes:
    def __init__(self, spark: SparkSession, compiled: ir.Shapes):
        self.spark, self.compiled = spark, compiled

    @classmethod
    def from_text(cls, spark: SparkSession, text: str, syntax: str = "turtle", base: str = "") -> Shapes:
        return cls(spark, ir.Shapes(Triples(parse(text, syntax, base, "s"))))

    @classmethod
    def from_turtle(cls, spark: SparkSession, text: str) -> Shapes:
        return cls.from_text(spark, text)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, syntax: str | None = None) -> Shapes:
        return cls(spark, ir.Shapes(Triples(parse_file(path, syntax, "s"))))

    @classmethod
    def from_files(cls, spark: SparkSession, paths: list[str], syntax: str | None = None) -> Shapes:
        """The shapes of several documents as one graph; blank nodes are kept apart."""
        return cls(spark, ir.Shapes(Triples([t for i, path in enumerate(paths) for t in parse_file(path, syntax, f"s{i}")])))

    def __len__(self) -> int:
        return len(self.compiled)

    def flaws(self) -> Report:
        """What shapes about shapes find in the shapes graph."""
        from .plans.meta import META

        return Shapes.from_turtle(self.spark, META).validate(TripleGraph.of(self.spark, self.compiled.graph.rows))

    def validate(self, graph: Graph, mode: str = "none", max_results: int | None = None, allow_warnings: bool = False, allow_infos: bool = False) -> Report:
        if mode not in MODES:
            raise ValueError(f"inference is one of {', '.join(MODES)}")
        if mode == "rdfs":
            graph = inference.rdfs_closure(graph)
        elif mode == "rules":
            graph = inference.apply_rules(graph, self.compiled)
        elif mode == "rules-iterated":
            graph = inference.apply_iterated(graph, self.compiled)
        levels = ir.DISALLOWED[:1] if allow_warnings else ir.DISALLOWED[:2] if allow_infos else ir.DISALLOWED
        return Report(run(graph, self.compiled, max_results, levels), self.compiled, levels)

    def validate_file(self, path: str | list[str], syntax: str | None = None, **options) -> Report:
        return self.validate(read_documents(self.spark, [path] if isinstance(path, str) else path, syntax), **options)

    def validate_text(self, text: str, syntax: str = "turtle", **options) -> Report:
        return self.validate(TripleGraph.of(self.spark, parse(text, syntax)), **options)

    def validate_turtle(self, text: str, **options) -> Report:
        return self.validate_text(text, **options)


def validate(spark: SparkSession, data: str, shapes: str, **options) -> Report:
    """One call for two Turtle texts; refuses shapes that are none."""
    s = Shapes.from_turtle(spark, shapes)
    if not len(s):
        raise ShapeError("the shapes graph has no shapes")
    return s.validate_turtle(data, **options)


def rdfs_closure(spark: SparkSession, data: str) -> str:
    return inference.turtle(inference.rdfs_closure(TripleGraph.of(spark, parse(data))))
