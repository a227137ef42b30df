import pytest
from pyspark.sql import functions as F

from shapewright.api import Shapes, rdfs_closure, validate
from shapewright.functions.xsd import term_of_key
from shapewright.plans.ir import ShapeError, java_regex
from shapewright.sources.graph import TripleGraph

PRE = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix : <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"


def test_one_shot(spark):
    r = validate(spark, PRE + ":a a :P ; :height 412 . :b a :P ; :height 171 .", PRE + ":S a sh:NodeShape ; sh:targetClass :P ; sh:property [ sh:path :height ; sh:maxInclusive 260 ; sh:message 'too tall' ] .")
    assert not r.conforms and len(r) == 1
    row = r.results[0]
    assert row.focus_node == "<http://e/a>" and row.messages == ["too tall"]
    assert "sh" not in r.text.split("\n")[0] and "conforms: false" in r.text
    for syntax in ("turtle", "rdfxml", "jsonld"):
        assert "http://e/a" in r.serialize(syntax)


def test_refuses_no_shapes(spark):
    with pytest.raises(ShapeError):
        validate(spark, PRE + ":a :b :c .", PRE + ":x :y :z .")


def test_subclasses_lists_and_recursion(spark):
    data = PRE + ":A rdfs:subClassOf :B . :x a :A ; :l ( 1 2 2 ) ; :next :y . :y a :A ; :l ( 1 ) ; :next :x ."
    s = Shapes.from_turtle(spark, PRE + ":S a sh:NodeShape ; sh:targetClass :B ; sh:property [ sh:path :l ; sh:uniqueMembers true ; sh:minListLength 2 ] ; sh:property [ sh:path :next ; sh:node :S ] .")
    found = sorted((r.focus_node, r.component.rpartition("#")[2]) for r in s.validate_turtle(data).results)
    assert ("<http://e/x>", "UniqueMembersConstraintComponent") in [(f, c.strip(">")) for f, c in found]
    assert ("<http://e/y>", "MinListLengthConstraintComponent") in [(f, c.strip(">")) for f, c in found]


def test_closure(spark):
    out = rdfs_closure(spark, PRE + ":A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :x a :A . :p rdfs:domain :D . :y :p 5 .")
    for t in ("<http://e/x> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/C>", "<http://e/y> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/D>"):
        assert t in out


def test_regex_translation():
    assert java_regex("a$", "") == "(?dU)a\\z" and java_regex("[$]", "i") == "(?dUi)[$]"
    with pytest.raises(ShapeError):
        java_regex("(?=a)", "")
    with pytest.raises(ShapeError):
        java_regex("a", "z")


NAMED = PRE + ":S a sh:NodeShape ; sh:property [ sh:path :age ; sh:maxInclusive 150 ] ."


def test_shapes_named_by_data_count_under_max_results(spark):
    s = Shapes.from_turtle(spark, NAMED + " :T a sh:NodeShape ; sh:targetClass :P ; sh:property [ sh:path :age ; sh:minCount 1 ] .")
    r = s.validate_turtle(PRE + ":a sh:shape :S ; :age 200 . :c sh:shape :S ; :age 300 . :b a :P ; :age 7 .", max_results=1)
    assert not r.conforms and len(r) == 1


def test_many_names_in_data(spark):
    s = Shapes.from_turtle(spark, PRE + "".join(f":S{i} a sh:NodeShape ; sh:property [ sh:path :age ; sh:maxInclusive 150 ] ." for i in range(12)))
    data = TripleGraph(
        spark.range(30_000).select(F.concat(F.lit("<http://e/n"), "id", F.lit(">")).alias("s"), F.lit(f"<{PRE.split('<')[1].split('>')[0]}shape>").alias("p"), F.concat(F.lit("<http://e/S"), F.when(F.col("id") % 2500 == 0, F.col("id") / 2500).otherwise(F.col("id") + 100).cast("long"), F.lit(">")).alias("k"))
        .union(spark.range(30_000).select(F.concat(F.lit("<http://e/n"), "id", F.lit(">")), F.lit("<http://e/age>"), F.lit('"200"^^<http://www.w3.org/2001/XMLSchema#integer>')))
        .select("s", "p", term_of_key(F.col("k")).alias("o"))
    )
    assert sorted(r.focus_node for r in s.validate(data).results) == sorted(f"<http://e/n{2500 * i}>" for i in range(12))


def test_all_predicates(spark):
    g = TripleGraph(spark.range(100_001).select(F.lit("<http://e/s>").alias("s"), F.concat(F.lit("<http://e/p"), "id", F.lit(">")).alias("p"), term_of_key(F.lit("<http://e/o>")).alias("o")))
    assert len(g.predicates()) == 100_001


def test_malformed_lines_fail(spark, tmp_path):
    from shapewright.__main__ import main

    p = tmp_path / "d.nt"
    p.write_text("<http://e/a> <http://e/p> <http://e/b> .\n# a comment\n\nthis is no statement\n")
    shapes = tmp_path / "s.ttl"
    shapes.write_text(PRE + ":S a sh:NodeShape ; sh:targetSubjectsOf :p ; sh:nodeKind sh:IRI .")
    assert main(["-d", str(p), "-s", str(shapes), "-q"]) == 2
    p.write_text("<http://e/a> <http://e/p> <http://e/b> .\n# a comment\n")
    assert main(["-d", str(p), "-s", str(shapes), "-q"]) == 0


def test_several_shapes_files_and_meta_shapes(spark, tmp_path):
    from shapewright.__main__ import main

    files = {}
    for name, text in (
        ("data", ":a :p 5 ; :q 7 ."),
        ("one", ":S a sh:NodeShape ; sh:targetSubjectsOf :p ; sh:property [ sh:path :p ; sh:maxInclusive 9 ] ."),
        ("two", ":T a sh:NodeShape ; sh:targetSubjectsOf :q ; sh:property [ sh:path :q ; sh:maxInclusive 6 ] ."),
        ("flawed", ":U a sh:NodeShape ; sh:targetSubjectsOf :q ; sh:property [ sh:minCount 'x' ] ."),
    ):
        f = tmp_path / f"{name}.ttl"
        f.write_text(PRE + text)
        files[name] = str(f)
    assert main(["-d", files["data"], "-s", files["one"], "-q", "-m"]) == 0
    assert main(["-d", files["data"], "-s", files["one"], "-s", files["two"], "-q"]) == 1
    assert main(["-d", files["data"], "-s", files["flawed"], "-q", "-m"]) == 2


def test_standard_input(spark, tmp_path, monkeypatch):
    import io

    from shapewright.__main__ import main

    shapes = tmp_path / "s.ttl"
    shapes.write_text(PRE + ":S a sh:NodeShape ; sh:targetSubjectsOf :p ; sh:property [ sh:path :p ; sh:maxInclusive 9 ] .")
    monkeypatch.setattr("sys.stdin", io.StringIO(PRE + ":a :p 12 ."))
    assert main(["-d", "-", "-df", "turtle", "-s", str(shapes), "-q"]) == 1
    assert main(["-d", "-", "-s", str(shapes), "-q"]) == 2


def test_report_as_triples(spark):
    s = Shapes.from_turtle(spark, PRE + ":S a sh:NodeShape ; sh:targetSubjectsOf :p ; sh:property [ sh:path ( :p :q ) ; sh:maxInclusive 9 ; sh:message 'say \"hi\"\\nnow' ] .")
    r = s.validate_turtle(PRE + ":a :p :b . :b :q 10 , 11 .")
    from shapewright.operators.report import report_triples

    rows = {(x.s, x.p, x.o) for x in report_triples(r.results_df, shapes=s.compiled).collect()}
    sh = "<http://www.w3.org/ns/shacl#"
    assert sum(o == '"say \\"hi\\"\\nnow"' for _, _, o in rows) == 2
    heads = [o for _, p, o in rows if p == sh + "resultPath>"]
    assert len(heads) == 2 and all(any(x == h and p.endswith("#first>") for x, p, _ in rows) for h in heads)


def test_max_results_cuts_past_the_last(spark):
    data = PRE + " ".join(f":n{i} :p {i} ." for i in range(10))
    s = Shapes.from_turtle(spark, PRE + ":S a sh:NodeShape ; sh:targetSubjectsOf :p ; sh:property [ sh:path :p ; sh:maxInclusive 100 ; sh:minInclusive 50 ] ; sh:property [ sh:path :p ; sh:minInclusive 60 ; sh:severity sh:Debug ] .")
    rows = s.validate_turtle(data, max_results=3).results
    assert sorted(r.focus_node for r in rows if r.severity.endswith("Violation>")) == ["<http://e/n0>", "<http://e/n1>", "<http://e/n2>"]
    assert {r.focus_node for r in rows} == {"<http://e/n0>", "<http://e/n1>", "<http://e/n2>"}


def test_lists_grow_by_keys_only(spark, monkeypatch):
    """What is written on the way holds a row a place, no arrays; circles, shared ends and broken lists too."""
    from shapewright.sources import graph
    from shapewright.terms import FIRST, NIL, REST

    cell = "<http://e/{}>".format
    after = {**{f"a{i}": f"a{i + 1}" for i in range(1, 9)}, "a9": NIL, "b1": "a4", "c1": "c2", "c2": "c3", "c3": "c1", "d1": "c2", "e1": "e2", "e2": "gap"}
    rows = [t for x, y in after.items() for t in ((cell(x), FIRST, f'"{x}"'), (cell(x), REST, y if y == NIL else cell(y)))]
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: written.append(df) or f(df))
    heads = spark.createDataFrame([(x if x == NIL else cell(x),) for x in ("a1", "a9", "b1", "c1", "d1", "e1", "none", NIL, "a1")], "k string")
    got = {r.k: r.members and [m.lex for m in r.members] for r in TripleGraph.of(spark, rows).lists(heads).collect()}
    whole = [f"a{i}" for i in range(1, 10)]
    assert {k: v for k, v in got.items() if v} == {cell("a1"): whole, cell("a9"): ["a9"], cell("b1"): ["b1", *whole[3:]]}
    assert got[NIL] == [] and len(got) == 8
    assert written and not any(f.dataType.typeName() == "array" for df in written for f in df.schema)


def test_whole_graph_expressions(spark):
    from shapewright.functions.nodeexpr import Expressions
    from shapewright.operators.validate import Validator
    from shapewright.plans.ir import load_shapes

    g = TripleGraph.of(spark, [t for i in range(4) for t in ((f"<http://e/n{i}>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://e/P>"), (f"<http://e/n{i}>", "<http://e/v>", f'"{i}"^^<http://www.w3.org/2001/XMLSchema#integer>'))])
    every, big = "[ nex:instancesOf :P ]", ":Big a sh:NodeShape ; sh:property [ sh:path :v ; sh:minInclusive 2 ] . "
    want = {
        f"[ nex:count {every} ]": "4", "[ nex:count [ nex:instancesOf :None ] ]": "0", f"[ nex:exists {every} ]": "true", "[ nex:exists [ nex:instancesOf :None ] ]": "false",
        f"[ nex:limit 2 ; nex:nodes {every} ]": "http://e/n0|http://e/n1", f"[ nex:findFirst :Big ; nex:nodes {every} ]": "http://e/n2", f"[ nex:count [ nex:filterShape :Big ; nex:nodes {every} ] ]": "2",
    }
    for text, value in want.items():
        s = load_shapes(PRE + "@prefix nex: <http://www.w3.org/ns/shacl-node-expr#> . " + big + f":E :expr {text} .")
        seed = g.rel("<http://e/v>").select(F.col("s").alias("rid"), term_of_key(F.col("s")).alias("f"))
        df, c = Expressions(Validator(g, s)).array(s.graph.object("<http://e/E>", "<http://e/expr>"), seed)
        assert [r.x for r in df.select(F.array_join(F.transform(c, lambda t: t.lex), "|").alias("x")).collect()] == [value] * 4


def test_whole_operands(spark):
    """Whole operands take a short way, with the same 18 places."""
    from decimal import ROUND_HALF_EVEN, Decimal, localcontext

    from shapewright.functions.library import product, quotient, whole_quotient

    rows = [(Decimal(a), Decimal(b)) for a in ("-610799941.174276988115423312", "9223372036854775807", "1", "-7", "0", "5") for b in ("6827858363", "9000000000", "0.000000000000000001", "3", "0", "-64")]
    df = spark.createDataFrame(rows, "x decimal(38,18), y decimal(38,18)")
    with localcontext(prec=100):
        for r in df.select("x", "y", product(F.col("x"), F.col("y")).alias("p"), quotient(F.col("x"), F.col("y")).alias("q"), whole_quotient(F.col("x"), F.col("y")).alias("w")).collect():
            exact = (r.x * r.y).quantize(Decimal("1e-18"), ROUND_HALF_EVEN)
            assert r.p == exact or r.p is None and abs(exact) >= 10**19
            ratio = (r.x / r.y).quantize(Decimal("1e-18"), ROUND_HALF_EVEN) if r.y else None
            assert r.q == ratio or r.q is None and abs(ratio) >= 10**19
            if r.x % 1 == r.y % 1 == 0 < r.y <= 9 * 10**9:
                assert r.w == abs(ratio)


def test_escaped_backslash_before_a_letter(spark):
    from shapewright.functions.xsd import escaped

    texts = ["a\\nb", "\\", "\\\\n\n", "x\\\"", "end\\", "t\\\t"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", term_of_key(F.concat(F.lit('"'), escaped(F.col("t")), F.lit('"'))).alias("o")).collect()
    assert [r.o.lex for r in rows] == texts == [r.t for r in rows]
