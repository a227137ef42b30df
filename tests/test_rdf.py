import pytest

from shapewright.sources.rdf import format_of, parse, statements
from shapewright.terms import NIL, ParseError, Triples, escape, literal, parts, triple_term, unescape

EX = "PREFIX : <http://e/> "


def test_terms_round_trip():
    for key in ("<http://e/a>", "_:0b1", '"a\\"b\\n"', '"x"@en', '"x"@ar--rtl', '"5"^^<http://www.w3.org/2001/XMLSchema#integer>', "<<( <a:b> <a:c> \"d\" )>>"):
        p = parts(key)
        if p.kind == "L":
            assert literal(p.lex, p.dt, p.lang, p.dir) == key
    assert unescape(escape('a\\"\n\t')) == 'a\\"\n\t'


def test_turtle():
    g = Triples(parse(EX + ':a :p 1, 2.5, 1e3, true, "x"@EN, """long "text" """ ; a :C . [ :q ( :x [] ) ] :r <b> .', base="http://e/"))
    assert len(g) == 13
    assert g.objects("<http://e/a>", "<http://e/p>")[4] == '"x"@en'
    head = [o for s, p, o in g.rows if p == "<http://e/q>"][0]
    assert len(g.list(head)) == 2
    assert g.list(NIL) == []


def test_annotations_and_triple_terms():
    t = parse(EX + ":s :p :o {| :q 1 |} . :x :y <<( :s :p :o )>> .")
    claim = triple_term("<http://e/s>", "<http://e/p>", "<http://e/o>")
    assert sum(o == claim for _, _, o in t) == 2


def test_graphs_are_flattened():
    assert len(parse(EX + "GRAPH :g { :a :b :c } :d { :a :b :e . } :f :b :c .", "trig")) == 3
    assert len(parse("<a:a> <a:b> <a:c> <a:g> .\n_:x <a:b> \"y\" .\n", "nquads")) == 2


def test_rdfxml_and_jsonld_agree_with_turtle():
    x = parse('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:C rdf:about="http://e/a"><e:p xml:lang="en">t</e:p><e:q rdf:resource="http://e/b"/></e:C></rdf:RDF>', "rdfxml")
    j = parse('{"@context": {"@vocab": "http://e/", "q": {"@type": "@id"}}, "@id": "http://e/a", "@type": "C", "p": {"@value": "t", "@language": "en"}, "q": "http://e/b"}', "jsonld")
    t = parse(EX + ':a a :C ; :p "t"@en ; :q :b .')
    assert set(x) == set(j) == set(t)


def test_errors_and_formats():
    with pytest.raises(ParseError):
        parse(":a :b :c .")
    assert format_of("a/b.ttl.gz") == "turtle" and format_of("x.unknown") is None


def test_chunks_parse_to_the_same():
    text = "@prefix : <http://e/> .\n" + "".join(f":a{i} :p {i} ;\n  :q :b .\n" for i in range(100))
    prologue, chunks = statements(text, 4)
    assert len(chunks) > 2
    assert {t for c in chunks for t in parse(prologue + c)} == set(parse(text))
    assert statements("@prefix : <http://e/> .\n_:a :p 1 .\n", 2) is None
