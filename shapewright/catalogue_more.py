"""More queries over the driver's tables: SPARQL, node expressions, functions, rules, entailment and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalogue import ORACLE_SQL, PREFIXES, QUERIES, C, N, O, P, S, add, brief, lit, node, num, rows
from .functions.library import call
from .functions.nodeexpr import Expressions
from .functions.xsd import constant, iri_term, term_of_key
from .operators import inference, report
from .operators.validate import Validator, conforms, validate, validate_nodes
from .plans.ir import load_shapes
from .plans.sparql import Engine
from .plans.sparql import parse as parse_query
from .sources.graph import Graph, TripleGraph, UnionGraph
from .sources.tables import EX, graph
from .terms import FIRST, NIL, REIFIES, REST, SUBCLASS, TYPE, XSD, literal, rdfs

TOTAL = num("o_totalprice")


# -- SPARQL queries by themselves
def sparql(name: str, tables: str, query: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Engine(graph(spark, sf_dir, *tables.split())).select(parse_query(f"PREFIX ex: <{EX}> PREFIX xsd: <{XSD}> " + query))
        return out.select(*[F.col(f"{c}.lex").alias(c) for c in out.columns])

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def url(table: str, key: str) -> str:
    return f"'{EX}{table}/' || {key}"


OU, CU, NU, SU = url("orders", "o_orderkey"), url("customer", "c_custkey"), url("nation", "n_nationkey"), url("supplier", "s_suppkey")
V = "CAST({} AS VARCHAR)".format
# the mean of sizes to 18 places, by hand
AVG18 = "(sum(p_size)::HUGEINT // count(*))::VARCHAR || '.' || CASE WHEN sum(p_size)::HUGEINT % count(*) = 0 THEN '0' ELSE regexp_replace(lpad((((sum(p_size)::HUGEINT % count(*)) * 1000000000000000000 * 2 + count(*)) // (2 * count(*)))::VARCHAR, 18, '0'), '0+$', '') END"
sparql("sq_select", "orders", "SELECT ?o ?t WHERE { ?o ex:total ?t ; ex:status 'P' FILTER(?t > 300000) }", f"SELECT {OU} AS o, {V('o_totalprice')} AS t FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000")
sparql("sq_join", "customer nation", "SELECT ?c ?n WHERE { ?c ex:nation ?x . ?x ex:name ?n . ?c ex:acctbal ?b FILTER(?b < 0) }", f"SELECT {CU} AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0")
sparql("sq_optional", "customer orders", "SELECT ?c ?o WHERE { ?c ex:segment 'BUILDING' OPTIONAL { ?o ex:customer ?c ; ex:total ?t FILTER(?t > 400000) } }", f"SELECT {CU} AS c, {OU} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE c_mktsegment = 'BUILDING'")
sparql("sq_union", "customer supplier", "SELECT ?x WHERE { { ?x a ex:Customer ; ex:acctbal ?b FILTER(?b > 9000) } UNION { ?x a ex:Supplier ; ex:acctbal ?b FILTER(?b < 0) } }", f"SELECT {CU} AS x FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT {SU} FROM supplier WHERE s_acctbal < 0")
sparql("sq_exists", "customer orders", "SELECT ?c WHERE { ?c a ex:Customer FILTER EXISTS { ?o ex:customer ?c ; ex:status 'P' } }", f"SELECT {CU} AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
sparql("sq_not_exists", "customer orders", "SELECT ?c WHERE { ?c a ex:Customer FILTER NOT EXISTS { ?o ex:customer ?c ; ex:status 'P' } }", f"SELECT {CU} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
sparql("sq_group", "orders", "SELECT ?s (COUNT(?o) AS ?n) (MAX(?t) AS ?m) WHERE { ?o ex:status ?s ; ex:total ?t } GROUP BY ?s HAVING(COUNT(?o) > 1)", f"SELECT o_orderstatus AS s, {V('count(*)')} AS n, {V('max(o_totalprice)')} AS m FROM orders GROUP BY 1 HAVING count(*) > 1")
sparql("sq_aggregates", "part", "SELECT ?b (SUM(?s) AS ?total) (MIN(?s) AS ?least) (COUNT(DISTINCT ?s) AS ?kinds) WHERE { ?p ex:brand ?b ; ex:size ?s } GROUP BY ?b", f"SELECT p_brand AS b, {V('sum(p_size)')} AS total, {V('min(p_size)')} AS least, {V('count(DISTINCT p_size)')} AS kinds FROM part GROUP BY 1")
sparql("sq_bind", "part", "SELECT ?p ?d WHERE { ?p ex:size ?s BIND(?s * 2 + 1 AS ?d) FILTER(?s IN (1, 2, 3)) }", f"SELECT {url('part', 'p_partkey')} AS p, {V('p_size * 2 + 1')} AS d FROM part WHERE p_size IN (1, 2, 3)")
sparql("sq_path", "supplier nation region", "SELECT ?s ?r WHERE { ?s ex:nation/ex:region/ex:name ?r }", f"SELECT {SU} AS s, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("sq_subselect", "customer orders", "SELECT ?c ?n WHERE { ?c ex:segment 'MACHINERY' { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o ex:customer ?c } GROUP BY ?c } }", f"SELECT {CU} AS c, {V('count(*)')} AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY c_custkey")
sparql("sq_order_limit", "orders", "SELECT ?o WHERE { ?o ex:total ?t } ORDER BY DESC(?t) ?o LIMIT 10 OFFSET 2", f"SELECT {OU} AS o FROM orders ORDER BY o_totalprice DESC, {OU} LIMIT 10 OFFSET 2")
sparql("sq_distinct", "orders", "SELECT DISTINCT ?p WHERE { ?o ex:priority ?p }", "SELECT DISTINCT o_orderpriority AS p FROM orders")
sparql("sq_distinct_order", "orders", "SELECT DISTINCT ?p WHERE { ?o ex:priority ?p ; ex:total ?t } ORDER BY DESC(?t) ?p", "SELECT DISTINCT o_orderpriority AS p FROM orders")
sparql("sq_distinct_order_limit", "orders", "SELECT DISTINCT ?p WHERE { ?o ex:priority ?p } ORDER BY ?p LIMIT 3", "SELECT DISTINCT o_orderpriority AS p FROM orders ORDER BY 1 LIMIT 3")
sparql("sq_exists_bound", "customer orders", "SELECT ?c ?x WHERE { ?c ex:segment 'BUILDING' BIND(EXISTS { ?o ex:customer ?c ; ex:status 'P' } AS ?x) }", f"SELECT {CU} AS c, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'true' ELSE 'false' END AS x FROM customer WHERE c_mktsegment = 'BUILDING'")
sparql("sq_optional_filter_both", "customer orders", "SELECT ?c ?o WHERE { ?c ex:acctbal ?b OPTIONAL { ?o ex:customer ?c ; ex:total ?t FILTER(?t > ?b + 300000) } }", f"SELECT {CU} AS c, {OU} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal + 300000")
sparql("sq_avg", "part", "SELECT ?b (AVG(?s) AS ?x) WHERE { ?p ex:brand ?b ; ex:size ?s } GROUP BY ?b", f"SELECT p_brand AS b, {AVG18} AS x FROM part GROUP BY 1")
sparql("fx_error_unbound", "part", "SELECT ?p WHERE { ?p ex:size ?s FILTER(?none > 1 || ?s > 40) }", f"SELECT {url('part', 'p_partkey')} AS p FROM part WHERE p_size > 40")
sparql("fx_now", "region", "SELECT ?r WHERE { ?r a ex:Region FILTER(NOW() > '2000-01-01T00:00:00'^^xsd:dateTime) }", f"SELECT {url('region', 'r_regionkey')} AS r FROM region")
sparql("fx_date_duration", "orders", "SELECT ?o (?d + 'P1DT2H'^^xsd:dayTimeDuration AS ?x) (?d - 'P1Y2M'^^xsd:yearMonthDuration AS ?y) WHERE { ?o ex:date ?d }", f"SELECT {OU} AS o, strftime(o_orderdate + INTERVAL 26 HOUR, '%Y-%m-%dT%H:%M:%S') AS x, strftime(o_orderdate - INTERVAL 14 MONTH, '%Y-%m-%dT%H:%M:%S') AS y FROM orders")
sparql("sq_predicate_variable", "nation", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", "SELECT x AS p, CAST(n AS VARCHAR) AS n FROM (SELECT count(*) n FROM nation), (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type'), ('http://ex/name'), ('http://ex/region')) t(x)")
sparql("sq_if_coalesce", "supplier", "SELECT ?s (IF(?b < 0, 'debt', 'fine') AS ?x) (COALESCE(?none, 'gap') AS ?y) WHERE { ?s ex:acctbal ?b }", f"SELECT {SU} AS s, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'fine' END AS x, 'gap' AS y FROM supplier")

# -- SPARQL in shapes
SPARQL_SHAPE = "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:sparql [ sh:prefixes ex: ; {} ] ."
add("sq_constraint_select", "orders customer", SPARQL_SHAPE.format('sh:select """SELECT $this ?value WHERE { $this ex:customer ?c . ?c ex:acctbal ?value FILTER(?value < -900) }"""'), rows(O, None, num("c_acctbal"), "SPARQL", "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < -900"))
add("sq_constraint_ask", "orders", SPARQL_SHAPE.format('sh:ask """ASK { $this ex:total ?t FILTER(?t >= 5000) }"""'), rows(O, None, O, "SPARQL", "FROM orders WHERE NOT o_totalprice >= 5000"))
add("sq_constraint_per_focus", "customer orders", 'ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:sparql [ sh:prefixes ex: ; sh:select """SELECT $this (COUNT(?o) AS ?value) WHERE { ?o ex:customer $this } GROUP BY $this HAVING(COUNT(?o) > 12)""" ] .', rows(C, None, num("n", "integer"), "SPARQL", "FROM customer JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n > 12"))
add("tg_sparql", "supplier", 'ex:S a sh:NodeShape ; sh:target [ sh:prefixes ex: ; sh:select """SELECT ?this WHERE { ?this ex:acctbal ?b FILTER(?b < 0) }""" ] ; sh:nodeKind sh:Literal .', rows(S, None, S, "NodeKind", "FROM supplier WHERE s_acctbal < 0"))
add(
    "sq_component",
    "part",
    'ex:Even a sh:ConstraintComponent ; sh:parameter [ sh:path ex:dividedBy ] ; sh:validator [ a sh:SPARQLAskValidator ; sh:prefixes ex: ; sh:ask "ASK { FILTER(FLOOR($value / $dividedBy) * $dividedBy = $value) }" ] . ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:property [ sh:path ex:size ; ex:dividedBy 2 ] .',
    None,
)


# -- node expressions
def expression(name: str, tables: str, cls: str, text: str, sql: str, extra: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shapes = load_shapes(PREFIXES + extra + f"ex:E ex:expr {text} .")
        g = graph(spark, sf_dir, *tables.split())
        v = Validator(g, shapes)
        seed = g.subjects(cls).select(F.col("s").alias("rid"), iri_term(F.col("s")).alias("f"))
        df, c = Expressions(v).array(shapes.graph.object(f"<{EX}E>", f"<{EX}expr>"), seed)
        return df.select(F.col("rid").alias("focus_node"), F.concat_ws("|", F.transform(c, lambda t: t.getField("lex"))).alias("value"))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def ne(value: str, rest: str, focus: str = P) -> str:
    return f"SELECT {focus} AS focus_node, {value} AS value {rest}"


PV = "[ shnex:pathValues ex:{} ]".format
OF = "[ shnex:pathValues [ sh:inversePath ex:{} ] ]".format
expression("ne_constant", "part", "part", "'x'", ne("'x'", "FROM part"))
expression("ne_this", "part", "part", "sh:this", ne(url("part", "p_partkey"), "FROM part"))
expression("ne_path_values", "part", "part", PV("brand"), ne("p_brand", "FROM part"))
expression("ne_count", "nation region", "region", f"[ shnex:count {OF('region')} ]", ne(V("count(n_nationkey)"), "FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey", node("region", "r_regionkey")))
expression("ne_distinct", "part", "part", "[ shnex:distinct ( 'a' 'b' 'a' ) ]", ne("'a|b'", "FROM part"))
expression("ne_exists", "customer nation", "nation", f"[ shnex:exists {OF('nation')} ]", ne("CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 'true' ELSE 'false' END", "FROM nation", N))
expression("ne_if", "part", "part", f"[ shnex:if [ sparql:less-than ( {PV('size')} 25 ) ] ; shnex:then 'small' ; shnex:else 'large' ]", ne("CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END", "FROM part"))
expression("ne_concat", "part", "part", f"[ shnex:concat ( {PV('brand')} 'x' {PV('ptype')} ) ]", ne("p_brand || '|x|' || p_type", "FROM part"))
expression("ne_sum", "part", "part", f"[ shnex:sum ( 1 2 3 ) ]", ne("'6'", "FROM part"))
expression("ne_min", "part", "part", f"[ shnex:min ( {PV('size')} 25 ) ]", ne(V("least(p_size, 25)"), "FROM part"))
expression("ne_max", "part", "part", f"[ shnex:max ( {PV('size')} 25 ) ]", ne(V("greatest(p_size, 25)"), "FROM part"))
expression("ne_limit", "part", "part", "[ shnex:limit 2 ; shnex:nodes ( 'a' 'b' 'c' ) ]", ne("'a|b'", "FROM part"))
expression("ne_offset", "part", "part", "[ shnex:offset 2 ; shnex:nodes ( 'a' 'b' 'c' ) ]", ne("'c'", "FROM part"))
expression("ne_intersection", "part", "part", f"[ shnex:intersection ( ( {PV('ptype')} 'z' ) ( 'PROMO' 'z' ) ) ]", ne("CASE WHEN p_type = 'PROMO' THEN 'PROMO|z' ELSE 'z' END", "FROM part"))
expression("ne_remove", "part", "part", f"[ shnex:remove ( 'PROMO' ) ; shnex:nodes ( {PV('ptype')} 'z' 'z' ) ]", ne("CASE WHEN p_type = 'PROMO' THEN 'z|z' ELSE p_type || '|z|z' END", "FROM part"))
expression("ne_instances_of", "nation region", "nation", "[ shnex:count [ shnex:instancesOf ex:Region ] ]", ne(V("(SELECT count(*) FROM region)"), "FROM nation", N))
expression("ne_order_by", "nation region", "region", f"[ shnex:limit 2 ; shnex:nodes [ shnex:orderBy {PV('name')} ; shnex:desc true ; shnex:nodes {OF('region')} ] ]", ne(f"string_agg({url('nation', 'n_nationkey')}, '|' ORDER BY n_name DESC)", "FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) rn FROM nation) WHERE rn <= 2 GROUP BY n_regionkey", node("region", "n_regionkey")))
expression("ne_flat_map", "nation region", "nation", f"[ shnex:flatMap {PV('name')} ; shnex:nodes {PV('region')} ]", ne("r_name", "FROM nation JOIN region ON n_regionkey = r_regionkey", N))
BIG = "ex:Big a sh:NodeShape ; sh:property [ sh:path ex:acctbal ; sh:minInclusive 0 ] . "
expression("ne_conforms_to_shape", "supplier", "supplier", "[ shnex:conformsToShape ( sh:this ex:Big ) ]", ne("CASE WHEN s_acctbal >= 0 THEN 'true' ELSE 'false' END", "FROM supplier", S), BIG)
expression("ne_filter_shape", "supplier nation", "nation", f"[ shnex:count [ shnex:filterShape ex:Big ; shnex:nodes {OF('nation')} ] ]", ne(V("count(s_suppkey)"), "FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal >= 0 GROUP BY n_nationkey", N), BIG)
expression("ne_find_first", "supplier nation", "nation", f"[ shnex:count [ shnex:findFirst ex:Big ; shnex:nodes {OF('nation')} ] ]", ne("CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal >= 0) THEN '1' ELSE '0' END", "FROM nation", N), BIG)
expression("ne_match_all", "supplier nation", "nation", f"[ shnex:matchAll ex:Big ; shnex:nodes {OF('nation')} ]", ne("CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) THEN 'false' ELSE 'true' END", "FROM nation", N), BIG)
expression("ne_nodes_matching", "supplier", "supplier", "[ shnex:count [ shnex:nodesMatching ex:Debt ] ]", ne(V("(SELECT count(*) FROM supplier WHERE s_acctbal < 0)"), "FROM supplier", S), "ex:Debt a sh:NodeShape ; sh:property [ sh:path ex:acctbal ; sh:minCount 1 ; sh:maxExclusive 0 ] . ")
expression("ne_list", "part", "part", f"( 'a' {PV('brand')} )", ne("'a|' || p_brand", "FROM part"))
expression("ne_select", "nation region", "nation", '[ sh:prefixes ex: ; sh:select "SELECT ?n WHERE { $this ex:region ?r . ?r ex:name ?n }" ]', ne("r_name", "FROM nation JOIN region ON n_regionkey = r_regionkey", N))
expression("ne_union", "part", "part", f"[ sh:union ( ( 'a' {PV('ptype')} ) ( 'a' 'b' ) ) ]", ne("'a|' || p_type || '|b'", "FROM part"))
expression("ne_af_path", "nation region", "nation", "[ sh:path ex:name ; sh:nodes [ sh:path ex:region ; sh:nodes sh:this ] ]", ne("r_name", "FROM nation JOIN region ON n_regionkey = r_regionkey", N))
add("ne_values", "nation region", f"ex:S a sh:NodeShape ; sh:targetClass ex:Nation ; sh:property [ sh:path ex:regionName ; sh:values [ shnex:flatMap {PV('name')} ; shnex:nodes {PV('region')} ] ; sh:in ( 'ASIA' 'AFRICA' ) ] .", rows(N, "regionName", lit("r_name"), "In", "FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'AFRICA')"))
add("lg_expression", "part", f"ex:S a sh:NodeShape ; sh:targetClass ex:Part ; sh:expression [ sparql:less-than ( {PV('size')} 40 ) ] .", rows(P, None, P, "Expression", "FROM part WHERE NOT p_size < 40"))
add("lg_node_by_expression", "supplier", f"{BIG} ex:S a sh:NodeShape ; sh:targetClass ex:Supplier ; sh:nodeByExpression ex:Big .", rows(S, None, S, "NodeByExpression", "FROM supplier WHERE s_acctbal < 0"))


# -- functions: name, arguments (a column's predicate or a constant), SQL of the result's text
def function(name: str, table: str, args: list[str], sql: str, key: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = graph(spark, sf_dir, table).tables[table]
        made = [t.object(f"<{EX}{a[1:]}>") if a.startswith("?") else constant(a) for a in args]
        df = t.df.select(t.key().alias("focus_node"), *[c.alias(f"a{i}") for i, c in enumerate(made)])
        return df.select("focus_node", call(name, [F.col(f"a{i}") for i in range(len(made))]).getField("lex").alias("value"))

    QUERIES["fn_" + name.replace("-", "_").lower()] = run
    ORACLE_SQL["fn_" + name.replace("-", "_").lower()] = f"SELECT {node(table, key)} AS focus_node, {sql} AS value FROM {table}"


def b(test: str) -> str:
    return f"CASE WHEN {test} THEN 'true' ELSE 'false' END"


def i(x: int) -> str:
    return literal(str(x), XSD + "integer")


TEN = i(10)
for _name, _sql in (("abs", "abs(p_size)"), ("ceil", "p_size"), ("floor", "p_size"), ("round", "p_size"), ("unary-minus", "-p_size"), ("unary-plus", "p_size")):
    function(_name, "part", ["?size"], V(_sql), "p_partkey")
for _name, _sql in (("plus", "p_size + 10"), ("subtract", "p_size - 10"), ("multiply", "p_size * 10")):
    function(_name, "part", ["?size", TEN], V(_sql), "p_partkey")
function("divide", "part", ["?size", literal("4", XSD + "integer")], "CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR || '.0' WHEN p_size % 2 = 0 THEN (p_size // 4)::VARCHAR || '.5' ELSE (p_size // 4)::VARCHAR || CASE WHEN p_size % 4 = 1 THEN '.25' ELSE '.75' END END", "p_partkey")
for _name, _op in (("less-than", "<"), ("less-than-or-equal", "<="), ("greater-than", ">"), ("greater-than-or-equal", ">="), ("equals", "="), ("not-equals", "<>")):
    function(_name, "part", ["?size", TEN], b(f"p_size {_op} 10"), "p_partkey")
TRUE = literal("true", XSD + "boolean")
function("logical-and", "part", ["?size", TRUE], b("p_size <> 0"), "p_partkey")
function("logical-or", "part", ["?size", TRUE], b("TRUE"), "p_partkey")
function("logical-not", "part", ["?size"], b("p_size = 0"), "p_partkey")
function("if", "part", [TRUE, "?brand", "?ptype"], "p_brand", "p_partkey")
function("coalesce", "part", ["?brand", "?ptype"], "p_brand", "p_partkey")
function("bound", "part", ["?brand"], b("TRUE"), "p_partkey")
function("sameTerm", "part", ["?ptype", '"PROMO"'], b("p_type = 'PROMO'"), "p_partkey")
function("sameValue", "part", ["?ptype", '"PROMO"'], b("p_type = 'PROMO'"), "p_partkey")
for _name, _sql in (("isIRI", b("FALSE")), ("isURI", b("FALSE")), ("isBlank", b("FALSE")), ("isLiteral", b("TRUE")), ("isTriple", b("FALSE"))):
    function(_name, "part", ["?brand"], _sql, "p_partkey")
function("isNumeric", "part", ["?size"], b("TRUE"), "p_partkey")
function("str", "part", ["?size"], V("p_size"), "p_partkey")
function("lang", "documents", ["?text"], "lang", "doc_id")
function("langdir", "documents", ["?text"], "''", "doc_id")
function("hasLang", "documents", ["?text"], b("TRUE"), "doc_id")
function("hasLangdir", "documents", ["?text"], b("FALSE"), "doc_id")
function("langMatches", "documents", ['"en-GB"', '"en"'], b("TRUE"), "doc_id")
function("datatype", "part", ["?size"], f"'{XSD}int'", "p_partkey")
function("iri", "part", ["?brand"], "p_brand", "p_partkey")
function("uri", "part", ["?brand"], "p_brand", "p_partkey")
function("strdt", "part", ["?brand", f"<{EX}t>"], "p_brand", "p_partkey")
function("strlang", "part", ["?brand", '"en"'], "p_brand", "p_partkey")
function("strlangdir", "part", ["?brand", '"en"', '"ltr"'], "p_brand", "p_partkey")
function("strlen", "part", ["?name"], V("length(p_name)"), "p_partkey")
function("ucase", "part", ["?name"], "upper(p_name)", "p_partkey")
function("lcase", "part", ["?brand"], "lower(p_brand)", "p_partkey")
function("contains", "part", ["?name", '"1"'], b("contains(p_name, '1')"), "p_partkey")
function("strstarts", "part", ["?brand", '"Brand#1"'], b("starts_with(p_brand, 'Brand#1')"), "p_partkey")
function("strends", "part", ["?brand", '"1"'], b("ends_with(p_brand, '1')"), "p_partkey")
function("strbefore", "part", ["?brand", '"#"'], "CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END", "p_partkey")
function("strafter", "part", ["?brand", '"#"'], "CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 2) ELSE '' END", "p_partkey")
function("substr", "part", ["?brand", i(2), i(3)], "substring(p_brand, 2, 3)", "p_partkey")
function("concat", "part", ["?brand", '"-"', "?ptype"], "p_brand || '-' || p_type", "p_partkey")
function("encode", "part", ["?brand"], "replace(p_brand, '#', '%23')", "p_partkey")
function("regex", "part", ["?brand", '"[12]$"'], b("regexp_matches(p_brand, '[12]$')"), "p_partkey")
function("replace", "part", ["?brand", '"[0-9]"', '"_"'], "regexp_replace(p_brand, '[0-9]', '_', 'g')", "p_partkey")
function("md5", "part", ["?brand"], "md5(p_brand)", "p_partkey")
function("sha1", "part", ["?brand"], "sha1(p_brand)", "p_partkey")
function("sha256", "part", ["?brand"], "sha256(p_brand)", "p_partkey")
for _name, _sql in (("year", "year(o_orderdate)"), ("month", "month(o_orderdate)"), ("day", "day(o_orderdate)"), ("hours", "hour(o_orderdate)"), ("minutes", "minute(o_orderdate)"), ("seconds", "second(o_orderdate)")):
    function(_name, "orders", ["?date"], V(_sql), "o_orderkey")
function("tz", "orders", ["?date"], "''", "o_orderkey")
function("timezone", "orders", ["?date"], "CAST(NULL AS VARCHAR)", "o_orderkey")
for _name, _sql in (("triple", "'<<( <http://ex/s> <http://ex/p> \"' || p_brand || '\" )>>'"),):
    function(_name, "part", [f"<{EX}s>", f"<{EX}p>", "?brand"], _sql, "p_partkey")
for _name, _sql in (("subject", "'http://ex/s'"), ("predicate", "'http://ex/p'"), ("object", "'x'")):
    function(_name, "part", [f'<<( <{EX}s> <{EX}p> "x" )>>'], _sql, "p_partkey")


# -- functions whose inputs reach the hard cases: values made from columns
def computed(name: str, fn_name: str, table: str, key: str, args: list, sql: str) -> None:
    """args: columns of the table as SQL expressions of term keys, or constants."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = graph(spark, sf_dir, table).tables[table]
        df = t.df.select(t.key().alias("focus_node"), *[(F.expr(a[1]) if isinstance(a, tuple) else F.lit(a)).alias(f"x{n}") for n, a in enumerate(args)])
        df = df.select("focus_node", *[term_of_key(F.col(f"x{n}")).alias(f"a{n}") for n in range(len(args))])
        return df.select("focus_node", call(fn_name, [F.col(f"a{n}") for n in range(len(args))]).getField("lex").alias("value"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {node(table, key)} AS focus_node, {sql} AS value FROM {table}"


def made_of(expression: str, dt: str) -> tuple[str, str]:
    return ("", f"concat('\"', cast({expression} as string), '\"^^<{XSD}{dt}>')")


HALF = made_of("cast((p_size - 25) as decimal(10,1)) / 2", "decimal")
for _name, _sql in (("abs", "abs(p_size - 25) / 2.0"), ("ceil", "ceil((p_size - 25) / 2.0)"), ("floor", "floor((p_size - 25) / 2.0)"), ("round", "floor((p_size - 25) / 2.0 + 0.5)")):
    computed(f"fn_{_name}_halves", _name, "part", "p_partkey", [HALF], f"replace(printf('%.1f', {_sql}), '-0.0', '0.0')")
# long division by hand: 18 places of p_size / 7, the last rounded
for _n in (3, 7):
    computed(f"fn_divide_by_{_n}", "divide", "part", "p_partkey", [made_of("p_size", "integer"), i(_n)], f"(p_size // {_n})::VARCHAR || '.' || CASE WHEN p_size % {_n} = 0 THEN '0' ELSE lpad((((p_size % {_n})::HUGEINT * 1000000000000000000 * 2 + {_n}) // {2 * _n})::VARCHAR, 18, '0') END")
computed("fn_multiply_places", "multiply", "part", "p_partkey", [made_of("p_size", "decimal"), literal("0.000000000000000001", XSD + "decimal")], "'0.' || CASE WHEN p_size = 0 THEN '0' ELSE regexp_replace(lpad(p_size::VARCHAR, 18, '0'), '0+$', '') END")
computed("fn_divide_long", "divide", "region", "r_regionkey", [literal("1000", XSD + "decimal"), literal("31.583333333333333333", XSD + "decimal")], "'31.662269129287598945'")
computed("fn_multiply_long", "multiply", "region", "r_regionkey", [literal("1.3", XSD + "decimal"), literal("31.583333333333333333", XSD + "decimal")], "'41.058333333333333333'")
# kinds of terms by row: an IRI, a blank node, a triple term, a literal with or without a language
MIXED = ("", f"CASE o_orderkey % 5 WHEN 0 THEN '<{EX}a>' WHEN 1 THEN '_:b' WHEN 2 THEN '<<( <{EX}s> <{EX}p> \"x\" )>>' WHEN 3 THEN '\"w\"@en-gb' ELSE '\"w\"@ar--rtl' END")
for _name, _when in (("isIRI", "= 0"), ("isURI", "= 0"), ("isBlank", "= 1"), ("isTriple", "= 2"), ("isLiteral", "> 2"), ("hasLang", "> 2"), ("hasLangdir", "= 4")):
    computed(f"fn_{_name.lower()}_mixed", _name, "orders", "o_orderkey", [MIXED], b(f"o_orderkey % 5 {_when}"))
TAGS = ("", "CASE o_orderkey % 3 WHEN 0 THEN '\"en-GB\"' WHEN 1 THEN '\"fr\"' ELSE '\"\"' END")
computed("fn_langmatches_tags", "langMatches", "orders", "o_orderkey", [TAGS, '"en"'], b("o_orderkey % 3 = 0"))
computed("fn_langmatches_any", "langMatches", "orders", "o_orderkey", [TAGS, '"*"'], b("o_orderkey % 3 < 2"))
computed("fn_if_rows", "if", "orders", "o_orderkey", [made_of("o_orderkey % 2 = 0", "boolean"), '"even"', '"odd"'], "CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END")
computed("fn_logical_or_rows", "logical-or", "orders", "o_orderkey", [made_of("o_orderkey % 2 = 0", "boolean"), made_of("o_orderkey % 3 = 0", "boolean")], b("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"))
computed("fn_bound_rows", "bound", "orders", "o_orderkey", [("", "CASE WHEN o_orderkey % 2 = 0 THEN '\"x\"' END")], b("o_orderkey % 2 = 0"))
ZONED = ("", f"concat('\"2001-02-03T', lpad(cast(o_orderkey % 24 as string), 2, '0'), ':', lpad(cast(o_orderkey % 60 as string), 2, '0'), ':07.25', CASE o_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '-05:30' ELSE '' END, '\"^^<{XSD}dateTime>')")
for _name, _sql in (("hours", "(o_orderkey % 24)::VARCHAR"), ("minutes", "(o_orderkey % 60)::VARCHAR"), ("seconds", "'7.25'"), ("tz", "CASE o_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '-05:30' ELSE '' END"), ("timezone", "CASE o_orderkey % 3 WHEN 0 THEN 'PT0S' WHEN 1 THEN '-PT5H30M' END")):
    computed(f"fn_{_name}_zoned", _name, "orders", "o_orderkey", [ZONED], _sql)
TRIPLED = ("", f"concat('<<( <{EX}s', o_orderkey, '> <{EX}p', o_orderkey, '> \"x', o_orderkey, '\" )>>')")
for _name, _sql in (("subject", f"'{EX}s' || o_orderkey"), ("predicate", f"'{EX}p' || o_orderkey"), ("object", "'x' || o_orderkey")):
    computed(f"fn_{_name}_rows", _name, "orders", "o_orderkey", [TRIPLED], _sql)
computed("fn_bound_null", "coalesce", "orders", "o_orderkey", [("", "CASE WHEN o_orderkey % 2 = 0 THEN '\"x\"' END"), '"gap"'], "CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'gap' END")


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the long digests, and whether different brands have different ones."""
    t = graph(spark, sf_dir, "part").tables["part"]
    df = t.df.select(t.object(f"<{EX}brand>").alias("a")).select(F.col("a.lex").alias("b"), *[call(n, [F.col("a")]).getField("lex").alias(n) for n in ("sha384", "sha512")])
    return df.groupBy().agg(F.countDistinct("b").alias("brands"), *[x for n in ("sha384", "sha512") for x in (F.countDistinct(n).alias(f"{n}_kinds"), F.max(F.length(n)).alias(f"{n}_length"))])


QUERIES["fn_sha384_sha512"] = digests
ORACLE_SQL["fn_sha384_sha512"] = "SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_brand) AS sha384_kinds, 96 AS sha384_length, count(DISTINCT p_brand) AS sha512_kinds, 128 AS sha512_length FROM part"
sparql("fn_bnode_uuid_struuid", "nation", "SELECT ?n (isBlank(BNODE()) AS ?b) (REGEX(STR(UUID()), '^urn:uuid:[0-9a-f-]{36}$') AS ?u) (STRLEN(STRUUID()) AS ?l) WHERE { ?n a ex:Nation }", f"SELECT {NU} AS n, 'true' AS b, 'true' AS u, '36' AS l FROM nation")

# -- expressions over several values of a row
expression("ne_sum_values", "part", "part", f"[ shnex:sum ( {PV('size')} 2 {PV('size')} ) ]", ne(V("p_size * 2 + 2") + " || '.0'", "FROM part"))
expression("ne_distinct_values", "part", "part", f"[ shnex:distinct ( {PV('brand')} 'x' {PV('brand')} {PV('ptype')} ) ]", ne("p_brand || '|x|' || p_type", "FROM part"))
expression("ne_limit_values", "part", "part", f"[ shnex:limit 2 ; shnex:nodes ( {PV('ptype')} {PV('brand')} 'c' ) ]", ne("p_type || '|' || p_brand", "FROM part"))
expression("ne_offset_values", "part", "part", f"[ shnex:offset 1 ; shnex:nodes ( 'a' {PV('brand')} {PV('ptype')} ) ]", ne("p_brand || '|' || p_type", "FROM part"))
expression("ne_sparql_expr", "part", "part", '[ sh:prefixes ex: ; sh:sparqlExpr "STRLEN(STR($this)) > 22" ]', ne(b(f"length({url('part', 'p_partkey')}) > 22"), "FROM part"))
expression("ne_af_filter_shape", "supplier nation", "nation", f"[ shnex:count [ sh:filterShape ex:Big ; sh:nodes [ sh:path [ sh:inversePath ex:nation ] ; sh:nodes sh:this ] ] ]", ne(V("count(s_suppkey)"), "FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal >= 0 GROUP BY n_nationkey", N), BIG)
expression("ne_af_intersection", "part", "part", f"[ sh:intersection ( ( {PV('ptype')} 'z' ) ( 'PROMO' 'z' ) ) ]", ne("CASE WHEN p_type = 'PROMO' THEN 'PROMO|z' ELSE 'z' END", "FROM part"))
expression("ne_empty", "part", "part", "( 'a' [] )", ne("'a'", "FROM part"))


# -- rules and entailment
def made(g: Graph, out: TripleGraph) -> DataFrame:
    """The triples that were not there before."""
    old = g.triples().select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o.k").alias("o2"))
    return out.df.join(old, (F.col("s") == F.col("s2")) & (F.col("p") == F.col("p2")) & (F.col("o.k") == F.col("o2")), "left_anti").select("s", "p", F.col("o.k").alias("o"))


def rule(name: str, tables: str, shapes: str, sql: str, rounds: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir, *tables.split())
        s = load_shapes(PREFIXES + shapes)
        return made(g, inference.apply_iterated(g, s, rounds) if rounds else inference.apply_rules(g, s))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def spo(s: str, p: str, o: str, rest: str) -> str:
    return f"SELECT {s} AS s, '{p}' AS p, {o} AS o {rest}"


rule("ru_triple", "nation", f"ex:R a sh:NodeShape ; sh:targetClass ex:Nation ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate ex:label ; sh:object {PV('name')} ] .", spo(N, f"<{EX}label>", lit("n_name"), "FROM nation"))
rule("ru_sparql", "nation region", 'ex:R a sh:NodeShape ; sh:targetClass ex:Nation ; sh:rule [ a sh:SPARQLRule ; sh:prefixes ex: ; sh:construct "CONSTRUCT { $this ex:regionName ?n } WHERE { $this ex:region ?r . ?r ex:name ?n }" ] .', spo(N, f"<{EX}regionName>", lit("r_name"), "FROM nation JOIN region ON n_regionkey = r_regionkey"))
rule("ru_condition", "supplier", f"{BIG} ex:R a sh:NodeShape ; sh:targetClass ex:Supplier ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate rdf:type ; sh:object ex:Sound ; sh:condition ex:Big ] .", spo(S, TYPE, f"'<{EX}Sound>'", "FROM supplier WHERE s_acctbal >= 0"))
ORDERED = "ex:R a sh:NodeShape ; sh:targetClass ex:Nation ; sh:rule [ a sh:TripleRule ; sh:order 1 ; sh:subject sh:this ; sh:predicate ex:a ; sh:object 'x' ] , [ a sh:TripleRule ; sh:order {} ; sh:subject sh:this ; sh:predicate ex:b ; sh:object [ shnex:pathValues ex:a ] ] ."
rule("ru_order", "nation", ORDERED.format(2), spo(N, f"<{EX}a>", "'\"x\"'", "FROM nation") + " UNION ALL " + spo(N, f"<{EX}b>", "'\"x\"'", "FROM nation"))
rule("ru_level_snapshot", "nation", ORDERED.format(1), spo(N, f"<{EX}a>", "'\"x\"'", "FROM nation"))
rule("ru_iterated", "nation", ORDERED.format(0), spo(N, f"<{EX}a>", "'\"x\"'", "FROM nation") + " UNION ALL " + spo(N, f"<{EX}b>", "'\"x\"'", "FROM nation"), 5)


def entail(name: str, schema: list[tuple[str, str, str]], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = UnionGraph([graph(spark, sf_dir, "nation"), TripleGraph.of(spark, [(f"<{EX}{s}>", p, f"<{EX}{o}>") for s, p, o in schema])])
        return made(g, inference.rdfs_closure(g))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


REG = node("region", "n_regionkey")
SUBP = rdfs("subPropertyOf")
entail("in_rdfs2", [("region", rdfs("domain"), "Placed")], spo(N, TYPE, f"'<{EX}Placed>'", "FROM nation"))
entail("in_rdfs3", [("region", rdfs("range"), "Place")], f"SELECT DISTINCT {REG} AS s, '{TYPE}' AS p, '<{EX}Place>' AS o FROM nation")
entail("in_rdfs5", [("a", SUBP, "b"), ("b", SUBP, "c")], f"SELECT '<{EX}a>' AS s, '{SUBP}' AS p, '<{EX}c>' AS o")
entail("in_rdfs7", [("region", SUBP, "partOf")], spo(N, f"<{EX}partOf>", REG, "FROM nation"))
entail("in_rdfs9", [("Nation", SUBCLASS, "Country")], spo(N, TYPE, f"'<{EX}Country>'", "FROM nation"))
entail("in_rdfs11", [("A", SUBCLASS, "B"), ("B", SUBCLASS, "C")], f"SELECT '<{EX}A>' AS s, '{SUBCLASS}' AS p, '<{EX}C>' AS o")

# -- results and reports
TWO = "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:total ; sh:minInclusive 5000 ; sh:severity sh:Warning ] ; sh:property [ sh:path ex:total ; sh:maxInclusive 400000 ] ."


def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = validate(graph(spark, sf_dir, "orders"), load_shapes(PREFIXES + TWO))
    return brief(r.where(F.col("severity").isin(*report.disallowed_from("violation"))))


def agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = validate(graph(spark, sf_dir, "orders"), load_shapes(PREFIXES + TWO))
    return spark.createDataFrame([(conforms(r),)], "conforms boolean")


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brief(validate(graph(spark, sf_dir, "orders"), load_shapes(PREFIXES + TWO), max_results=10)).groupBy().count()


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = validate(graph(spark, sf_dir, "orders"), load_shapes(PREFIXES + TWO))
    return report.report_triples(r).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def some_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = spark.range(1, 200).select(F.lit(f"<{EX}S>").alias("shape"), F.concat(F.lit(f"<{EX}orders/"), F.col("id"), F.lit(">")).alias("node"))
    return brief(validate_nodes(graph(spark, sf_dir, "orders"), load_shapes(PREFIXES + TWO), work))


QUERIES["rs_severity"] = severity
ORACLE_SQL["rs_severity"] = rows(O, "total", TOTAL, "MaxInclusive", "FROM orders WHERE o_totalprice > 400000")
QUERIES["rs_conforms"] = agrees
ORACLE_SQL["rs_conforms"] = "SELECT count(*) = 0 AS conforms FROM orders WHERE o_totalprice > 400000 OR o_totalprice < 5000"
QUERIES["rs_max_results"] = capped
ORACLE_SQL["rs_max_results"] = "SELECT least(count(*), 10) AS count FROM orders WHERE o_totalprice > 400000 OR o_totalprice < 5000"
QUERIES["rs_validate_nodes"] = some_nodes
ORACLE_SQL["rs_validate_nodes"] = rows(O, "total", TOTAL, "MaxInclusive", "FROM orders WHERE o_totalprice > 400000 AND o_orderkey BETWEEN 1 AND 199") + " UNION ALL " + rows(O, "total", TOTAL, "MinInclusive", "FROM orders WHERE o_totalprice < 5000 AND o_orderkey BETWEEN 1 AND 199")
QUERIES["snk_report_triples"] = counted
_BAD = "(SELECT count(*) n FROM orders WHERE o_totalprice > 400000 OR o_totalprice < 5000)"
_P = [report.TYPE, *(report.sh(x) for x in ("conforms", "result", "focusNode", "value", "resultPath", "sourceConstraintComponent", "resultSeverity", "sourceShape"))]
ORACLE_SQL["snk_report_triples"] = f"SELECT p, n + k AS n FROM (SELECT p, k * 1 AS k, m * (SELECT n FROM {_BAD}) AS n FROM (VALUES " + ", ".join(f"('{p}', {1 if p in _P[:2] else 0}, {0 if p == _P[1] else 1})" for p in _P) + ") t(p, k, m))"

# -- sources
QUERIES["src_match"] = lambda spark, sf_dir: graph(spark, sf_dir, "nation").match(p=f"<{EX}region>", o=f"<{EX}region/1>").select("s", "p", F.col("o.k").alias("o"))
ORACLE_SQL["src_match"] = spo(N, f"<{EX}region>", f"'<{EX}region/1>'", "FROM nation WHERE n_regionkey = 1")
QUERIES["src_nodes"] = lambda spark, sf_dir: graph(spark, sf_dir, "nation").nodes().select(F.col("o.k").alias("node"))
ORACLE_SQL["src_nodes"] = f"SELECT {N} AS node FROM nation UNION SELECT {REG} FROM nation UNION SELECT {lit('n_name')} FROM nation UNION SELECT '<{EX}Nation>' FROM nation"


def documented(name: str, syntax: str) -> None:
    """Written in a syntax, read back, the triples are the table's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .sources.rdf import parse

        triples = [tuple(r) for r in graph(spark, sf_dir, "nation").triples().select("s", "p", F.col("o.k").alias("k")).collect()]  # 25 nations at every size
        back = TripleGraph.of(spark, parse(report.serialize(triples, syntax), syntax))
        return back.triples().select("s", "p", F.col("o.k").alias("o"))

    QUERIES[name] = run
    ORACLE_SQL[name] = NATION_TRIPLES


NATION_TRIPLES = spo(N, TYPE, f"'<{EX}Nation>'", "FROM nation") + " UNION ALL " + spo(N, f"<{EX}name>", lit("n_name"), "FROM nation") + " UNION ALL " + spo(N, f"<{EX}region>", REG, "FROM nation")
for _syntax in ("turtle", "ntriples", "rdfxml", "jsonld"):
    documented(f"src_{_syntax}", _syntax)


def report_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples of a report but node names: messages with quotes, compound paths, details."""
    shapes = load_shapes(PREFIXES + """ex:S a sh:NodeShape ; sh:targetClass ex:Nation ; sh:property [ sh:path ( ex:region ex:name ) ; sh:in ( 'ASIA' ) ; sh:message 'say "no"' ] .""")
    t = report.report_triples(validate(graph(spark, sf_dir, "nation", "region"), shapes), shapes=shapes)
    blank = lambda c: F.when(F.col(c).startswith("_:"), "_").otherwise(F.col(c))
    return t.select(blank("s").alias("s"), "p", blank("o").alias("o")).groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"))


QUERIES["snk_report_whole"] = report_whole
_REST = "(SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')"
_ROWS = [
    (TYPE, f"'{report.sh('ValidationReport')}'", "1"), (report.sh("conforms"), f"CASE WHEN n = 0 THEN '\"true\"^^<{XSD}boolean>' ELSE '\"false\"^^<{XSD}boolean>' END", "1"), (report.sh("result"), "'_'", "n"), (TYPE, f"'{report.sh('ValidationResult')}'", "n"),
    (report.sh("sourceConstraintComponent"), f"'{report.sh('InConstraintComponent')}'", "n"), (report.sh("resultSeverity"), f"'{report.sh('Violation')}'", "n"), (report.sh("sourceShape"), "'_'", "n"), (report.sh("resultPath"), "'_'", "n"), (report.sh("resultMessage"), "'\"say \\\"no\\\"\"'", "n"),
    (report.FIRST, f"'<{EX}region>'", "n"), (report.FIRST, f"'<{EX}name>'", "n"), (report.REST, "'_'", "n"), (report.REST, f"'{report.NIL}'", "n"),
]
ORACLE_SQL["snk_report_whole"] = (
    "SELECT s, p, o, CAST(sum(n) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '_' AS s, '{p}' AS p, {o} AS o, {n} AS n FROM {_REST}" for p, o, n in _ROWS)
    + f" UNION ALL SELECT '_', '{report.sh('focusNode')}', {N}, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"
    + f" UNION ALL SELECT '_', '{report.sh('value')}', {lit('r_name')}, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') WHERE n > 0 GROUP BY 1, 2, 3"
)


def reified(spark: SparkSession, sf_dir: str) -> Graph:
    """A reifier for each order's status that says who it is from; every seventh says nobody."""
    g = graph(spark, sf_dir, "orders")
    t = g.tables["orders"]
    claim = F.concat(F.lit("<<( "), t.key(), F.lit(f" <{EX}status> "), t.object(f"<{EX}status>").getField("k"), F.lit(" )>>"))
    r = F.concat(F.lit(f"<{EX}claim/"), F.col("o_orderkey").cast("string"), F.lit(">"))
    says = t.df.where("o_orderkey % 7 <> 0").select(r.alias("s"), F.lit(f"<{EX}from>").alias("p"), F.lit(f"<{EX}clerk>").alias("k"))
    return UnionGraph([g, TripleGraph.keys(t.df.where("o_orderkey % 11 <> 0").select(r.alias("s"), F.lit(REIFIES).alias("p"), claim.alias("k")).unionByName(says))])


add("lg_reifier_shape", reified, "ex:From sh:property [ sh:path ex:from ; sh:minCount 1 ] . ex:From a sh:NodeShape . ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:status ; sh:reifierShape ex:From ] .", rows(O, "status", lit("o_orderstatus"), "ReifierShape", "FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0"))
add("lg_reification_required", reified, "ex:From a sh:NodeShape . ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:status ; sh:reifierShape ex:From ; sh:reificationRequired true ] .", rows(O, "status", lit("o_orderstatus"), "ReifierShape", "FROM orders WHERE o_orderkey % 11 = 0"))


def linked(spark: SparkSession, sf_dir: str) -> Graph:
    """The turns of each conversation as a linked list of roles; that of every fifth conversation goes in a circle."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    w = t.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    last = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    cell = lambda k: F.concat(F.lit(f"<{EX}cell/"), F.col("conv_id").cast("string"), F.lit("-"), k.cast("string"), F.lit(">"))
    w = w.join(last, "conv_id")
    end = F.when(F.col("conv_id") % 5 == 0, cell(F.lit(1))).otherwise(F.lit(NIL))
    rows_ = [(FIRST, F.concat(F.lit('"'), F.col("role"), F.lit('"'))), (REST, F.when(F.col("rank") < F.col("n"), cell(F.col("rank") + 1)).otherwise(end))]
    out = [w.select(cell(F.col("rank")).alias("s"), F.lit(p).alias("p"), k.alias("k")) for p, k in rows_]
    head = last.select(F.concat(F.lit(f"<{EX}talk/"), F.col("conv_id").cast("string"), F.lit(">")).alias("s"), F.lit(f"<{EX}turns>").alias("p"), cell(F.lit(1)).alias("k"))
    return TripleGraph.keys(out[0].unionByName(out[1]).unionByName(head))


add("ls_linked", linked, "ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:turns ; sh:property [ sh:path ex:turns ; sh:minListLength 4 ] .", rows(node("talk", "conv_id"), "turns", f"'<{EX}cell/' || conv_id || '-1>'", "MinListLength", "FROM (SELECT conv_id, count(DISTINCT turn) AS n FROM conversations GROUP BY 1) WHERE n < 4 OR conv_id % 5 = 0"))
add("tg_overlap", "orders", "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:targetSubjectsOf ex:total ; sh:targetNode <http://ex/orders/1> ; sh:nodeKind sh:BlankNode .", rows(O, None, O, "NodeKind", "FROM orders"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = load_shapes(PREFIXES + 'ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:sparql [ sh:prefixes ex: ; sh:message "{?value} of {$this}" ; sh:select """SELECT $this ?value WHERE { $this ex:total ?value FILTER(?value < 3000) }""" ] .')
    return validate(graph(spark, sf_dir, "orders"), shapes).select("focus_node", F.col("messages")[0].alias("message"))


QUERIES["rs_messages"] = messages
ORACLE_SQL["rs_messages"] = f"SELECT {O} AS focus_node, {V('o_totalprice')} || ' of ' || {OU} AS message FROM orders WHERE o_totalprice < 3000"


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities and messages of single constraints, by annotations; an annotated one that is off."""
    shapes = load_shapes(PREFIXES + "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:total ; sh:minInclusive 5000 {| sh:severity sh:Info ; sh:message 'low' |} ; sh:maxInclusive 400000 ; sh:minExclusive 1 {| sh:deactivated true |} ; sh:maxLength 3 {| sh:deactivated true |} ] .")
    r = validate(graph(spark, sf_dir, "orders"), shapes)
    return r.select("focus_node", "severity", F.array_join("messages", "|").alias("message"), F.regexp_extract("component", "#(.*)ConstraintComponent", 1).alias("component"))


QUERIES["rs_annotations"] = annotated
ORACLE_SQL["rs_annotations"] = f"SELECT {O} AS focus_node, '{report.sh('Info')}' AS severity, 'low' AS message, 'MinInclusive' AS component FROM orders WHERE o_totalprice < 5000 UNION ALL SELECT {O}, '{report.sh('Violation')}', '', 'MaxInclusive' FROM orders WHERE o_totalprice > 400000"
rule("ru_untargeted", "nation", "ex:R a sh:NodeShape ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate ex:a ; sh:object 'x' ] . ex:Q a sh:NodeShape ; sh:targetClass ex:Nation ; sh:deactivated true ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate ex:b ; sh:object 'x' ] . ex:T a sh:NodeShape ; sh:targetClass ex:Nation ; sh:rule [ a sh:TripleRule ; sh:deactivated true ; sh:subject sh:this ; sh:predicate ex:c ; sh:object 'x' ] , [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate ex:d ; sh:object 'x' ] .", spo(N, f"<{EX}d>", "'\"x\"'", "FROM nation"))
entail("in_not_reflexive", [("A", SUBCLASS, "B"), ("B", SUBCLASS, "A")], "SELECT CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS p, CAST(NULL AS VARCHAR) AS o WHERE FALSE")
QUERIES["src_objects"] = lambda spark, sf_dir: graph(spark, sf_dir, "nation").match(s=f"<{EX}nation/3>").select("s", "p", F.col("o.k").alias("o"))
ORACLE_SQL["src_objects"] = f"SELECT * FROM ({NATION_TRIPLES}) WHERE s = '<{EX}nation/3>'"
QUERIES["src_subjects"] = lambda spark, sf_dir: graph(spark, sf_dir, "nation").match(o=f"<{EX}region/2>").select("s", "p", F.col("o.k").alias("o"))
ORACLE_SQL["src_subjects"] = f"SELECT * FROM ({NATION_TRIPLES}) WHERE o = '<{EX}region/2>'"
