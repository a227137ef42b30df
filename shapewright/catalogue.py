"""Queries over the driver's tables, one an operator, with the same in SQL.

Shapes are Turtle text, compiled and validated like any other. The results' columns are focus_node, path, value and
component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.validate import validate
from .plans.ir import Path, load_shapes
from .sources.graph import Graph, TripleGraph, UnionGraph
from .sources.tables import EX, graph, lists_of_roles
from .terms import RDF, RDFS, SH, XSD, rdfs

PREFIXES = f"""@prefix sh: <{SH}> . @prefix ex: <{EX}> . @prefix xsd: <{XSD}> . @prefix rdf: <{RDF}> . @prefix rdfs: <{RDFS}> .
@prefix shnex: <http://www.w3.org/ns/shacl-node-expr#> . @prefix sparql: <http://www.w3.org/ns/sparql#> .
ex: sh:declare [ sh:prefix "ex" ; sh:namespace "{EX}"^^xsd:anyURI ] . ex: a sh:ShapesGraph .
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def brief(results: DataFrame) -> DataFrame:
    return results.select("focus_node", "path", "value", F.regexp_extract("component", "#(.*)ConstraintComponent", 1).alias("component"))


def add(name: str, tables: str | Callable[[SparkSession, str], Graph], shapes: str, sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir, *tables.split()) if isinstance(tables, str) else tables(spark, sf_dir)
        return brief(validate(g, load_shapes(PREFIXES + shapes)))

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def node(table: str, key: str) -> str:
    return f"'<{EX}{table}/' || {key} || '>'"


def lit(column: str, dt: str | None = None) -> str:
    return f"'\"' || {column} || '\"'" if dt is None else f"'\"' || {column} || '\"^^<{XSD}{dt}>'"


def num(column: str, dt: str = "double") -> str:
    return lit(f"CAST({column} AS VARCHAR)", dt)


def rows(focus: str, path: str | None, value: str | None, component: str, rest: str) -> str:
    p = f"'<{EX}{path}>'" if path and "<" not in path else f"'{path}'" if path else "CAST(NULL AS VARCHAR)"
    return f"SELECT {focus} AS focus_node, {p} AS path, {value or 'CAST(NULL AS VARCHAR)'} AS value, '{component}' AS component {rest}"


O, C, S, N, P, D = (node(*x) for x in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("part", "p_partkey"), ("documents", "doc_id")))
NREF = node("nation", "c_nationkey")
TOTAL = num("o_totalprice")
LKEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), strftime(l_shipdate, '%Y%m%d'), CAST(round(l_extendedprice * 100) AS BIGINT))"
L = node("lineitem", LKEY)
DATE = lit("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", "dateTime")

# per-value constraints
add("pv_min_inclusive", "orders", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:total ; sh:minInclusive 5000 ] .", rows(O, "total", TOTAL, "MinInclusive", "FROM orders WHERE o_totalprice < 5000"))
add("pv_min_exclusive", "lineitem", "ex:S a sh:NodeShape ; sh:targetClass ex:Lineitem ; sh:property [ sh:path ex:quantity ; sh:minExclusive 1.0 ] .", rows(L, "quantity", num("l_quantity"), "MinExclusive", "FROM lineitem WHERE l_quantity <= 1"))
add("pv_max_inclusive", "customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:acctbal ; sh:maxInclusive 9500.5e0 ] .", rows(C, "acctbal", num("c_acctbal"), "MaxInclusive", "FROM customer WHERE c_acctbal > 9500.5"))
add("pv_max_exclusive", "part", "ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:property [ sh:path ex:size ; sh:maxExclusive 50 ] .", rows(P, "size", num("p_size", "int"), "MaxExclusive", "FROM part WHERE p_size >= 50"))
add("pv_datetime_bound", "orders", 'ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:date ; sh:minInclusive "1993-01-01T00:00:00"^^xsd:dateTime ] .', rows(O, "date", DATE, "MinInclusive", "FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'"))
add("pv_datatype", "orders", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:priority ; sh:datatype xsd:integer ] .", rows(O, "priority", lit("o_orderpriority"), "Datatype", "FROM orders"))
add("pv_datatype_list", "part", "ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:property [ sh:path [ sh:alternativePath ( ex:size ex:brand ) ] ; sh:datatype ( xsd:int xsd:double ) ] .", rows(P, "<http://ex/size>|<http://ex/brand>", lit("p_brand"), "Datatype", "FROM part"))
add("pv_node_kind", "orders", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:customer ; sh:nodeKind sh:Literal ] .", rows(O, "customer", node("customer", "o_custkey"), "NodeKind", "FROM orders"))
add("pv_min_length", "documents", "ex:S a sh:NodeShape ; sh:targetClass ex:Document ; sh:property [ sh:path ex:source ; sh:minLength 5 ] .", rows(D, "source", lit("source"), "MinLength", "FROM documents WHERE length(source) < 5"))
add("pv_max_length", "part", "ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:property [ sh:path ex:ptype ; sh:maxLength 5 ] .", rows(P, "ptype", lit("p_type"), "MaxLength", "FROM part WHERE length(p_type) > 5"))
add("pv_pattern", "customer", 'ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:name ; sh:pattern "[0-4]$" ] .', rows(C, "name", lit("c_name"), "Pattern", "FROM customer WHERE NOT regexp_matches(c_name, '[0-4]$')"))
add("pv_pattern_flags", "customer", 'ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:segment ; sh:pattern "^b.*g$" ; sh:flags "i" ] .', rows(C, "segment", lit("c_mktsegment"), "Pattern", "FROM customer WHERE NOT regexp_matches(c_mktsegment, '^b.*g$', 'i')"))
add("pv_language_in", "documents", 'ex:S a sh:NodeShape ; sh:targetClass ex:Document ; sh:property [ sh:path ex:text ; sh:languageIn ( "en" "fr" ) ] .', rows(D, "text", r"""'"' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"@' || lang""", "LanguageIn", "FROM documents WHERE lang NOT IN ('en', 'fr')"))
add("pv_in", "orders", 'ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:status ; sh:in ( "F" "O" ) ] .', rows(O, "status", lit("o_orderstatus"), "In", "FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"))
add("pv_single_line", "documents", "ex:S a sh:NodeShape ; sh:targetClass ex:Document ; sh:property [ sh:path ex:source ; sh:singleLine true ] ; sh:property [ sh:path ex:text ; sh:singleLine true ] .", rows(D, "text", r"""'"' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"@' || lang""", "SingleLine", "FROM documents WHERE contains(text, chr(10))"))
add("pv_has_value", "customer nation", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:nation ; sh:hasValue <http://ex/nation/3> ] .", rows(C, "nation", None, "HasValue", "FROM customer WHERE c_nationkey <> 3"))
add("pv_class", "orders customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path [ sh:alternativePath ( ex:customer ex:status ) ] ; sh:class ex:Customer ] .", rows(O, "<http://ex/customer>|<http://ex/status>", lit("o_orderstatus"), "Class", "FROM orders"))
add("pv_fused", "orders", 'ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:total ; sh:minInclusive 5000 ; sh:maxInclusive 400000 ; sh:datatype xsd:double ; sh:nodeKind sh:Literal ] .', rows(O, "total", TOTAL, "MinInclusive", "FROM orders WHERE o_totalprice < 5000") + " UNION ALL " + rows(O, "total", TOTAL, "MaxInclusive", "FROM orders WHERE o_totalprice > 400000"))


def class_tree(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations and regions, with regions as classes below ex:World."""
    tree = [(f"<{EX}region/{i}>", rdfs("subClassOf"), f"<{EX}World>") for i in range(3)]
    return UnionGraph([graph(spark, sf_dir, "nation", "region"), TripleGraph.of(spark, tree)])


add("pv_root_class", class_tree, "ex:S a sh:NodeShape ; sh:targetClass ex:Nation ; sh:property [ sh:path ex:region ; sh:rootClass ex:World ] .", rows(N, "region", node("region", "n_regionkey"), "RootClass", "FROM nation WHERE n_regionkey NOT IN (0, 1, 2)"))

# per-focus constraints
add("ag_min_count", "orders customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path [ sh:inversePath ex:customer ] ; sh:minCount 8 ] .", rows(C, "^<http://ex/customer>", None, "MinCount", "FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) < 8"))
add("ag_max_count", "orders customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path [ sh:inversePath ex:customer ] ; sh:maxCount 12 ] .", rows(C, "^<http://ex/customer>", None, "MaxCount", "FROM customer JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n > 12"))
add("ag_min_count_column", "orders", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:total ; sh:minCount 2 ] .", rows(O, "total", None, "MinCount", "FROM orders"))


def sayings(spark: SparkSession, sf_dir: str) -> Graph:
    """What is said in a conversation, tagged by the role that says it: a conversation has a few turns."""
    from .functions.xsd import lang_term
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.concat(F.lit(f"<{EX}talk/"), F.col("conv_id").cast("string"), F.lit(">"))
    said = t.select(key.alias("s"), F.lit(f"<{EX}says>").alias("p"), lang_term(F.concat(F.col("turn").cast("string"), F.lit("/"), F.char_length("text").cast("string")), F.col("role")).alias("o"))
    return TripleGraph(said.distinct(), [f"<{EX}says>"])


add("ag_unique_lang", sayings, "ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:says ; sh:property [ sh:path ex:says ; sh:uniqueLang true ] .", rows(node("talk", "conv_id"), "says", None, "UniqueLang", "FROM (SELECT DISTINCT conv_id, lower(role) AS role, turn, length(text) AS n FROM conversations) GROUP BY conv_id, role HAVING count(*) > 1"))
add("ag_qualified_min", "orders customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path [ sh:inversePath ex:customer ] ; sh:qualifiedValueShape [ sh:property [ sh:path ex:total ; sh:minInclusive 200000 ] ] ; sh:qualifiedMinCount 3 ] .", rows(C, "^<http://ex/customer>", None, "QualifiedMinCount", "FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders WHERE o_totalprice >= 200000 GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) < 3"))
add("ag_qualified_max", "orders customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path [ sh:inversePath ex:customer ] ; sh:qualifiedValueShape [ sh:property [ sh:path ex:total ; sh:minInclusive 200000 ] ] ; sh:qualifiedMaxCount 6 ] .", rows(C, "^<http://ex/customer>", None, "QualifiedMaxCount", "FROM customer JOIN (SELECT o_custkey, count(*) n FROM orders WHERE o_totalprice >= 200000 GROUP BY 1) ON o_custkey = c_custkey WHERE n > 6"))
add("ag_qualified_disjoint", "orders customer", 'ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property ex:P1 , ex:P2 . ex:P1 sh:path [ sh:inversePath ex:customer ] ; sh:qualifiedValueShape [ sh:property [ sh:path ex:total ; sh:minInclusive 200000 ] ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 3 . ex:P2 sh:path [ sh:inversePath ex:customer ] ; sh:qualifiedValueShape [ sh:property [ sh:path ex:status ; sh:hasValue "F" ] ] ; sh:qualifiedMinCount 0 .', rows(C, "^<http://ex/customer>", None, "QualifiedMinCount", "FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F' GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) < 3"))
add("ag_some_value", "orders customer", 'ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path [ sh:inversePath ex:customer ] ; sh:someValue [ sh:property [ sh:path ex:status ; sh:hasValue "P" ] ] ] .', rows(C, "^<http://ex/customer>", None, "SomeValue", "FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"))
add("ag_unique_values_for", "orders", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:uniqueValuesFor ( ex:customer ex:date ) .", rows(O, None, None, "UniqueValuesFor", "FROM orders JOIN (SELECT o_custkey c, o_orderdate d FROM orders GROUP BY 1, 2 HAVING count(*) > 1) ON o_custkey = c AND o_orderdate = d"))

# pairs of properties, joins
VN = "(SELECT DISTINCT c_custkey, s_nationkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)"
SUPPLIED = "( [ sh:inversePath ex:customer ] [ sh:inversePath ex:order ] ex:supplier ex:nation )"
SUPPLIED_TEXT = "^<http://ex/customer>/^<http://ex/order>/<http://ex/supplier>/<http://ex/nation>"
JOINED = "customer orders lineitem supplier nation"
add("jn_equals", JOINED, f"ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:nation ; sh:equals {SUPPLIED} ] .", rows(C, "nation", NREF, "Equals", f"FROM customer WHERE NOT EXISTS (SELECT 1 FROM {VN} v WHERE v.c_custkey = customer.c_custkey AND v.s_nationkey = c_nationkey)") + " UNION ALL " + rows(node("customer", "v.c_custkey"), "nation", node("nation", "s_nationkey"), "Equals", f"FROM {VN} v JOIN customer c ON c.c_custkey = v.c_custkey WHERE s_nationkey <> c_nationkey"))
add("jn_disjoint", JOINED, f"ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:nation ; sh:disjoint {SUPPLIED} ] .", rows(C, "nation", NREF, "Disjoint", f"FROM customer WHERE EXISTS (SELECT 1 FROM {VN} v WHERE v.c_custkey = customer.c_custkey AND v.s_nationkey = c_nationkey)"))
add("jn_subset_of", JOINED, f"ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:nation ; sh:subsetOf {SUPPLIED} ] .", rows(C, "nation", NREF, "SubsetOf", f"FROM customer WHERE NOT EXISTS (SELECT 1 FROM {VN} v WHERE v.c_custkey = customer.c_custkey AND v.s_nationkey = c_nationkey)"))
add("jn_less_than", "orders lineitem", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:date ; sh:lessThan ( [ sh:inversePath ex:order ] ex:shipdate ) ] .", rows(O, "date", DATE, "LessThan", "FROM orders JOIN (SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem) ON l_orderkey = o_orderkey WHERE NOT o_orderdate < l_shipdate"))
add("jn_less_than_or_equals", "part", "ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:property [ sh:path ex:price ; sh:lessThanOrEquals ex:size ] .", rows(P, "price", num("p_retailprice"), "LessThanOrEquals", "FROM part WHERE NOT p_retailprice <= p_size"))
add("jn_inverse_step", "orders customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ( [ sh:inversePath ex:customer ] ex:total ) ; sh:maxInclusive 450000 ] .", rows(C, "^<http://ex/customer>/<http://ex/total>", TOTAL, "MaxInclusive", "FROM (SELECT DISTINCT o_custkey AS c_custkey, o_totalprice FROM orders WHERE o_totalprice > 450000)"))
add("jn_closed", "customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:closed true ; sh:ignoredProperties ( rdf:type ex:segment ) ; sh:property [ sh:path ex:name ] ; sh:property [ sh:path ex:nation ] .", rows(C, "acctbal", num("c_acctbal"), "Closed", "FROM customer"))
add("jn_closed_by_types", "customer", "ex:Customer a sh:NodeShape , rdfs:Class ; sh:closed sh:ByTypes ; sh:ignoredProperties ( ex:acctbal ) ; sh:property [ sh:path ex:name ] ; sh:property [ sh:path ex:nation ] .", rows(C, "segment", lit("c_mktsegment"), "Closed", "FROM customer"))

# logic and nested shapes
CHEAP, OPEN = "[ sh:property [ sh:path ex:total ; sh:maxInclusive 50000 ] ]", '[ sh:property [ sh:path ex:status ; sh:hasValue "O" ] ]'
A, B = "o_totalprice <= 50000", "o_orderstatus = 'O'"
for name, text, test in (
    ("not", f"sh:not {CHEAP}", A),
    ("and", f"sh:and ( {CHEAP} {OPEN} )", f"NOT ({A} AND {B})"),
    ("or", f"sh:or ( {CHEAP} {OPEN} )", f"NOT ({A} OR {B})"),
    ("xone", f"sh:xone ( {CHEAP} {OPEN} )", f"({A}) = ({B})"),
    ("node", f"sh:node {CHEAP}", f"NOT {A}"),
):
    add(f"lg_{name}", "orders", f"ex:S a sh:NodeShape ; sh:targetClass ex:Order ; {text} .", rows(O, None, O, name.capitalize(), f"FROM orders WHERE {test}"))
add("lg_property_nested", "orders customer nation", "ex:S a sh:NodeShape ; sh:targetClass ex:Nation ; sh:property [ sh:path [ sh:inversePath ex:nation ] ; sh:property [ sh:path [ sh:inversePath ex:customer ] ; sh:property [ sh:path ex:total ; sh:minInclusive 10000 ] ] ] .", rows(O, "total", TOTAL, "MinInclusive", "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice < 10000"))
add("lg_property_multiplicity", "orders customer", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:customer ; sh:property [ sh:path ex:acctbal ; sh:minInclusive 0 ] ] .", rows(C, "acctbal", num("c_acctbal"), "MinInclusive", "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0"))
add("lg_deactivated", "orders", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:total ; sh:minInclusive 5000 ] ; sh:property [ sh:path ex:total ; sh:maxInclusive 1 ; sh:deactivated true ] .", rows(O, "total", TOTAL, "MinInclusive", "FROM orders WHERE o_totalprice < 5000"))


def chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns of conversations, each with the one after it."""
    g = graph(spark, sf_dir, "conversations")
    t = g.tables["conversations"]
    t.df = t.df.drop("_next").withColumn("_next", F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + 1).cast("string")))
    t.columns[f"<{EX}next>"] = ("_next", ("ref", EX + "conversations/"))
    g.by[f"<{EX}next>"] = [t]
    return g


# turns are consecutive in a conversation; a turn fails if its own role, or that of one that follows it, isn't allowed
CHAIN_SQL = (
    "WITH RECURSIVE t AS (SELECT conv_id, turn, min(role) AS role, max(role) AS most FROM conversations GROUP BY 1, 2), "
    "bad(conv_id, turn) AS (SELECT conv_id, turn FROM t WHERE role NOT IN ('user', 'assistant') OR most NOT IN ('user', 'assistant') UNION SELECT t.conv_id, t.turn FROM t JOIN bad ON t.conv_id = bad.conv_id AND t.turn + 1 = bad.turn) "
    + rows(node("conversations", "conv_id || '-' || turn"), "role", lit("r"), "In", "FROM (SELECT DISTINCT conv_id, turn, role AS r FROM conversations) WHERE r NOT IN ('user', 'assistant')")
    + " UNION ALL " + rows(node("conversations", "t.conv_id || '-' || t.turn"), "next", node("conversations", "t.conv_id || '-' || (t.turn + 1)"), "Node", "FROM t JOIN bad ON t.conv_id = bad.conv_id AND t.turn + 1 = bad.turn")
)
add("lg_recursive", chain, 'ex:S a sh:NodeShape ; sh:targetClass ex:Conversation ; sh:property ex:R . ex:R sh:path ex:next ; sh:property [ sh:path ex:role ; sh:hasValue "user" ] ; sh:node ex:T . ex:T sh:property [ sh:path ex:said ; sh:maxLength 2000 ] .', None)
add("lg_recursive_chain", chain, 'ex:S a sh:NodeShape ; sh:targetClass ex:Conversation ; sh:property [ sh:path ex:next ; sh:node ex:S ; sh:name "all that follow" ] ; sh:property [ sh:path ex:role ; sh:in ( "user" "assistant" ) ] .', CHAIN_SQL)

# targets
add("tg_node", "orders", "ex:S a sh:NodeShape ; sh:targetNode <http://ex/orders/1> , <http://ex/orders/2> , 7 ; sh:nodeKind sh:BlankNode .", " UNION ALL ".join(rows(f"'{x}'", None, f"'{x}'", "NodeKind", "") for x in ("<http://ex/orders/1>", "<http://ex/orders/2>", f'"7"^^<{XSD}integer>')))
add("tg_class", class_tree, "ex:S a sh:NodeShape ; sh:targetClass ex:Region ; sh:nodeKind sh:Literal .", rows(node("region", "r_regionkey"), None, node("region", "r_regionkey"), "NodeKind", "FROM region"))
add("tg_implicit_class", "nation", "ex:Nation a sh:NodeShape , rdfs:Class ; sh:property [ sh:path ex:name ; sh:minLength 6 ] .", rows(N, "name", lit("n_name"), "MinLength", "FROM nation WHERE length(n_name) < 6"))
add("tg_subjects_of", "nation supplier", 'ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:acctbal ; sh:property [ sh:path ex:name ; sh:pattern "9$" ] .', rows(S, "name", lit("s_name"), "Pattern", "FROM supplier WHERE s_name NOT LIKE '%9'"))
add("tg_objects_of", "nation", "ex:S a sh:NodeShape ; sh:targetObjectsOf ex:region ; sh:in ( <http://ex/region/0> ) .", rows(node("region", "k"), None, node("region", "k"), "In", "FROM (SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_regionkey <> 0)"))
add("tg_where", "nation region", "ex:S a sh:NodeShape ; sh:targetWhere [ sh:property [ sh:path ex:region ; sh:minCount 1 ] ] ; sh:property [ sh:path ex:region ; sh:hasValue <http://ex/region/1> ] .", rows(N, "region", None, "HasValue", "FROM nation WHERE n_regionkey <> 1"))


def nominated(spark: SparkSession, sf_dir: str) -> Graph:
    return UnionGraph([graph(spark, sf_dir, "nation"), TripleGraph.of(spark, [(f"<{EX}nation/{i}>", f"<{SH}shape>", f"<{EX}S>") for i in (2, 3)])])


add("tg_shape", nominated, "ex:S a sh:NodeShape ; sh:property [ sh:path ex:name ; sh:minCount 2 ] .", rows(N, "name", None, "MinCount", "FROM nation WHERE n_nationkey IN (2, 3)"))


# paths: every pair of a start and what it reaches
def reach(name: str, tables, path: Path | str, start: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators.paths import walk

        g = graph(spark, sf_dir, *tables.split()) if isinstance(tables, str) else tables(spark, sf_dir)
        shapes = load_shapes(PREFIXES + f"ex:P a sh:PropertyShape ; sh:path {path} .")
        p = shapes.get(f"<{EX}P>").path
        frame = g.subjects(start).select("s", F.col("s").alias("node")) if not isinstance(g, UnionGraph) else g.rel(start).select("s", F.col("s").alias("node")).distinct()
        return walk(g, frame.withColumnRenamed("s", "focus_node"), ["focus_node"], p).select("focus_node", F.col("o.k").alias("value"))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


R_ = node("region", "n_regionkey")
reach("pa_predicate", "nation", "ex:region", "nation", f"SELECT {N} AS focus_node, {R_} AS value FROM nation")
reach("pa_inverse", "customer nation", "[ sh:inversePath ex:nation ]", "nation", f"SELECT {NREF} AS focus_node, {C} AS value FROM customer")
reach("pa_sequence", "supplier nation region", "( ex:nation ex:region ex:name )", "supplier", f"SELECT {S} AS focus_node, {lit('r_name')} AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
reach("pa_alternative", "customer", "[ sh:alternativePath ( ex:name ex:segment ) ]", "customer", f"SELECT {C} AS focus_node, {lit('c_name')} AS value FROM customer UNION SELECT {C}, {lit('c_mktsegment')} FROM customer")
reach("pa_zero_or_one", "nation region", "[ sh:zeroOrOnePath ex:region ]", "nation", f"SELECT {N} AS focus_node, {N} AS value FROM nation UNION SELECT {N}, {R_} FROM nation")
NEXT = node("conversations", "b.conv_id || '-' || b.turn")
reach("pa_one_or_more", chain, "[ sh:oneOrMorePath ex:next ]", "conversations", f"SELECT {node('conversations', chr(97) + '.conv_id || ' + repr('-') + ' || a.turn')} AS focus_node, {NEXT} AS value FROM conversations a JOIN (SELECT conv_id, turn FROM conversations UNION SELECT conv_id, turn + 1 FROM conversations) b ON a.conv_id = b.conv_id AND b.turn > a.turn")
reach("pa_zero_or_more", chain, "[ sh:zeroOrMorePath ex:next ]", "conversations", f"SELECT {node('conversations', chr(97) + '.conv_id || ' + repr('-') + ' || a.turn')} AS focus_node, {NEXT} AS value FROM conversations a JOIN (SELECT conv_id, turn FROM conversations UNION SELECT conv_id, turn + 1 FROM conversations) b ON a.conv_id = b.conv_id AND b.turn >= a.turn")
reach("pa_complex", "customer orders nation region", "( [ sh:inversePath ( ex:customer ex:nation ) ] ex:priority )", "nation", f"SELECT DISTINCT {NREF} AS focus_node, {lit('o_orderpriority')} AS value FROM customer JOIN orders ON o_custkey = c_custkey")


# lists
def talks(spark: SparkSession, sf_dir: str) -> Graph:
    from .sources.graph import TableGraph

    return TableGraph(spark, [lists_of_roles(spark, sf_dir)])


K = node("talk", "conv_id")
SIZES = "(SELECT conv_id, count(*) n, count(DISTINCT role) d, count(*) FILTER (role = 'system') sys FROM conversations GROUP BY 1)"
add("ls_min_length", talks, "ex:S a sh:NodeShape ; sh:targetClass ex:Talk ; sh:minListLength 5 .", rows(K, None, K, "MinListLength", f"FROM {SIZES} WHERE n < 5"))
add("ls_max_length", talks, "ex:S a sh:NodeShape ; sh:targetClass ex:Talk ; sh:maxListLength 4 .", rows(K, None, K, "MaxListLength", f"FROM {SIZES} WHERE n > 4"))
add("ls_unique_members", talks, "ex:S a sh:NodeShape ; sh:targetClass ex:Talk ; sh:uniqueMembers true .", rows(K, None, K, "UniqueMembers", f"FROM {SIZES} WHERE n > d"))
add("ls_member_shape", talks, 'ex:S a sh:NodeShape ; sh:targetClass ex:Talk ; sh:memberShape [ sh:not [ sh:hasValue "system" ] ] .', rows(K, None, K, "MemberShape", f"FROM {SIZES} WHERE sys > 0"))

