"""Command line: validate data files against shapes. Exit code 0: conforms, 1: doesn't, 2: error."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .api import MODES, Shapes
from .operators.report import disallowed_from
from .plans.ir import DISALLOWED
from .sources.graph import BAD_LINE, UnionGraph, cached, read_documents
from .terms import ParseError, ShapeError


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shapewright")
    p.add_argument("-d", "--data", action="append", required=True)
    p.add_argument("-s", "--shapes", action="append")
    p.add_argument("-df", "--data-format")
    p.add_argument("-sf", "--shapes-format")
    p.add_argument("--build-index", metavar="FOLDER", help="keep a Parquet copy of the data there")
    p.add_argument("-m", "--meta", action="store_true", help="validate the shapes themselves first")
    p.add_argument("--allow-no-shapes", action="store_true")
    p.add_argument("-o", "--output")
    p.add_argument("--abort", action="store_true", help="stop at the first result that counts")
    p.add_argument("--max-results", type=int)
    p.add_argument("-i", "--inference", choices=MODES, default="none")
    p.add_argument("--advanced", action="store_true", help="run the rules of the shapes first")
    p.add_argument("--iterate-rules", action="store_true")
    p.add_argument("--allow-warnings", action="store_true")
    p.add_argument("--allow-infos", action="store_true")
    p.add_argument("-f", "--format", default="human", choices=["human", "turtle", "ntriples", "rdfxml", "jsonld"])
    p.add_argument("--min-severity", choices=["trace", "debug", "info", "warning", "violation"])
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--timing", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    began = time.time()
    try:
        graph = cached(spark, a.data[0], a.build_index) if a.build_index and len(a.data) == 1 else read_documents(spark, a.data, a.data_format)
        graph = graph if not isinstance(graph, list) else UnionGraph(graph)
        shapes = Shapes.from_files(spark, a.shapes or [x for x in a.data if x != "-"], a.shapes_format or (None if a.shapes else a.data_format))
        if a.meta:
            flaws = shapes.flaws()
            if not flaws.conforms:
                print(flaws.text, end="", file=sys.stderr)
                return 2
        if not len(shapes) and not a.allow_no_shapes:
            raise ShapeError("the shapes graph has no shapes")
        mode = "rules-iterated" if a.iterate_rules else "rules" if a.advanced else a.inference
        report = shapes.validate(graph, mode, 1 if a.abort else a.max_results, a.allow_warnings, a.allow_infos)
        if a.min_severity:
            report.disallowed = disallowed_from(a.min_severity)
        elif not (a.allow_warnings or a.allow_infos):
            report.disallowed = DISALLOWED
        text = report.text if a.format == "human" else report.serialize(a.format)
        if a.output:
            with open(a.output, "w") as f:
                f.write(text)
        elif not a.quiet:
            print(text, end="")
        if a.timing:
            print(f"{time.time() - began:.2f} s", file=sys.stderr)
        return 0 if report.conforms else 1
    except (ShapeError, ParseError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except PySparkException as e:
        if BAD_LINE not in str(e):
            raise
        print(f"error: {str(e)[str(e).index(BAD_LINE):].splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
