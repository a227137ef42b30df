"""Shapes about shapes: what a shapes graph has to look like before it is run.

Made of a few tables by rule. A node is taken for a shape if it is typed as one, has a target or a property, or is what
a shape-valued property points to.
"""

from __future__ import annotations

from ..terms import RDF, SH, XSD

# Properties of shapes, by what their values have to be.
SHAPE_VALUED = "property node not qualifiedValueShape someValue memberShape reifierShape".split()
SHAPE_LISTS = "and or xone".split()
LISTS = "in languageIn ignoredProperties".split()
INTEGERS = "minCount maxCount minLength maxLength qualifiedMinCount qualifiedMaxCount minListLength maxListLength".split()
BOOLEANS = "deactivated uniqueLang singleLine uniqueMembers qualifiedValueShapesDisjoint reificationRequired".split()
LITERALS = "minExclusive minInclusive maxExclusive maxInclusive".split()
IRIS = "targetSubjectsOf targetObjectsOf severity".split()
ONCE = "path minCount maxCount severity".split()
ONLY_WITH_PATH = "minCount maxCount uniqueLang qualifiedValueShape lessThan lessThanOrEquals group".split()


def made() -> str:
    """The meta-shapes as Turtle: one for the nodes, and one for the values of all properties of a kind."""
    names = lambda of: " , ".join(f"sh:{p}" for p in of)
    once = " ; ".join(f"sh:property [ sh:path sh:{p} ; sh:maxCount 1 ]" for p in ONCE)
    values = [
        (SHAPE_VALUED, "sh:nodeKind sh:BlankNodeOrIRI"),
        (SHAPE_LISTS, "sh:memberShape [ sh:nodeKind sh:BlankNodeOrIRI ]"),
        (["in"], "sh:minListLength 0"),
        (["languageIn"], "sh:memberShape [ sh:datatype xsd:string ]"),
        (["ignoredProperties"], "sh:memberShape [ sh:nodeKind sh:IRI ]"),
        (INTEGERS, "sh:datatype xsd:integer ; sh:minInclusive 0"),
        (BOOLEANS, "sh:datatype xsd:boolean"),
        (LITERALS, "sh:nodeKind sh:Literal"),
        ([*IRIS, "targetClass"], "sh:nodeKind sh:IRI"),
        (["pattern", "flags"], "sh:datatype xsd:string"),
        (["message"], "sh:datatype ( xsd:string rdf:langString rdf:dirLangString )"),
        (["order"], "sh:datatype ( xsd:integer xsd:decimal xsd:double )"),
        (["path"], "sh:nodeKind sh:BlankNodeOrIRI"),
    ]
    return "\n".join(
        [
            f"@prefix sh: <{SH}> . @prefix xsd: <{XSD}> . @prefix rdf: <{RDF}> . @prefix m: <urn:meta-shapes:> .",
            f"m:Shape a sh:NodeShape ; sh:targetClass {names(['NodeShape', 'PropertyShape', 'Shape'])} ; sh:targetSubjectsOf {names(['targetClass', 'targetNode', 'targetSubjectsOf', 'targetObjectsOf', 'property'])} ; sh:targetObjectsOf {names(SHAPE_VALUED)} ; {once} .",
            *(f"m:V{i} a sh:NodeShape ; sh:targetObjectsOf {names(of)} ; {text} ." for i, (of, text) in enumerate(values)),
            # what only makes sense for the values of a path
            f"m:WithPath a sh:NodeShape ; sh:targetClass sh:PropertyShape ; sh:targetObjectsOf sh:property ; sh:targetSubjectsOf {names(ONLY_WITH_PATH)} ; sh:property [ sh:path sh:path ; sh:minCount 1 ] .",
        ]
    )


META = made()
