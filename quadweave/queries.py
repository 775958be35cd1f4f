"""The registered queries of the graph, text and vector engine, each beside the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave import storage
from quadweave.engine import Engine, QuerySpec, aggregate, call, test, value, var
from quadweave.operators import paths, search, stats, update
from quadweave.plans import algebra as A
from quadweave.sources.datasets import TABLES, RelationalDataset, Scope
from quadweave.streaming import changes
from quadweave.terms import Iri, Literal, Variable

Call = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Call] = {}
ORACLES: dict[str, str] = {}
PREFIXES = "PREFIX r: <urn:r:> PREFIX t: <urn:t:> PREFIX g: <urn:g:> " + " ".join(f"PREFIX {t.name}: <urn:c:{t.name}/>" for t in TABLES) + "\n"


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(spark, RelationalDataset(spark=spark, folder=sf_dir, **options))


def quads(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    return RelationalDataset(spark=spark, folder=sf_dir).quads(*tables)


def sparql(name: str, text: str, types: str, sql: str, **options) -> None:
    """types: 'variable:type ...', in the order of the projection."""
    kinds = dict(x.split(":") for x in types.split()) if types else {}
    scope = options.pop("scope", None)
    QUERIES[name] = lambda spark, sf: engine(spark, sf, **options).sparql(PREFIXES + text, kinds, scope)
    ORACLES[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Call], Call]:
    def register(f: Call) -> Call:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# -- scans
sparql("scan_pattern", "SELECT ?s ?name WHERE { ?s nation:n_name ?name }", "s:str name:str", "SELECT 'urn:t:nation/' || n_nationkey AS s, n_name AS name FROM nation")
sparql("scan_graph", "SELECT ?o ?p WHERE { GRAPH g:orders { ?o orders:o_totalprice ?p } }", "o:str p:double", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS p FROM orders")
sparql("scan_graph_variable", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s a ?t } } GROUP BY ?g", "g:str n:int",
       "SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'urn:g:{t.name}' AS g, count(*) AS n FROM {t.name}" for t in TABLES) + ") WHERE n > 0")
sparql("scan_prefix", "SELECT ?c WHERE { ?c customer:c_mktsegment ?m FILTER(STRSTARTS(?m, 'B')) }", "c:str", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE starts_with(c_mktsegment, 'B')")
sparql("scan_in", "SELECT ?n WHERE { ?n nation:n_nationkey ?k FILTER(?k IN (1, 3, 5)) }", "n:str", "SELECT 'urn:t:nation/' || n_nationkey AS n FROM nation WHERE n_nationkey IN (1, 3, 5)")
sparql("scan_not_in", "SELECT ?n WHERE { ?n nation:n_nationkey ?k FILTER(?k NOT IN (1, 3, 5)) }", "n:str", "SELECT 'urn:t:nation/' || n_nationkey AS n FROM nation WHERE n_nationkey NOT IN (1, 3, 5)")
sparql("scan_numeric_range", "SELECT ?l ?q WHERE { ?l lineitem:l_quantity ?q FILTER(?q >= 10 && ?q < 20) }", "l:str q:double",
       "SELECT 'urn:t:lineitem/' || l_orderkey || '-' || l_linenumber AS l, l_quantity AS q FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
sparql("scan_lexical_range", "SELECT ?o ?p WHERE { ?o orders:o_orderpriority ?p FILTER(?p >= '2' && ?p < '4') }", "o:str p:str",
       "SELECT 'urn:t:orders/' || o_orderkey AS o, o_orderpriority AS p FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'")
sparql("scan_date_range", 'SELECT ?o ?d WHERE { ?o orders:o_orderdate ?d FILTER(?d < "1996-03-01T00:00:00Z"^^xsd:dateTime) }', "o:str d:ts",
       "SELECT 'urn:t:orders/' || o_orderkey AS o, o_orderdate AS d FROM orders WHERE o_orderdate < TIMESTAMP '1996-03-01'")
sparql("scan_repeated_var", "SELECT ?s WHERE { ?s nation:n_nationkey ?k ; nation:n_regionkey ?k }", "s:str", "SELECT 'urn:t:nation/' || n_nationkey AS s FROM nation WHERE n_nationkey = n_regionkey")
sparql("scan_source_scope", "SELECT ?t (COUNT(*) AS ?n) WHERE { ?s a ?t } GROUP BY ?t", "t:str n:int",
       "SELECT 'urn:t:nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'urn:t:region', count(*) FROM region", scope=Scope(allowed_sources=("urn:g:nation", "urn:g:region")))
sparql("scan_access_denied", "SELECT ?c ?n WHERE { ?c a t:customer . OPTIONAL { ?c r:c_nationkey ?k . ?k nation:n_name ?n } }", "c:str n:str",
       "SELECT 'urn:t:customer/' || c_custkey AS c, NULL::VARCHAR AS n FROM customer", scope=Scope(denied_graphs=("urn:g:nation",)))
sparql("scan_has_predicate", "SELECT DISTINCT ?p WHERE { <urn:t:nation/3> ?p ?o }", "p:str",
       "SELECT unnest(['urn:c:nation/n_nationkey', 'urn:c:nation/n_name', 'urn:c:nation/n_regionkey', 'urn:r:n_regionkey', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p")

# -- filters
_C, _N = "FROM customer", "FROM nation"
for _name, _filter, _where in [
    ("f_eq", "?m = 'BUILDING'", "c_mktsegment = 'BUILDING'"),
    ("f_ne", "?m != 'BUILDING'", "c_mktsegment <> 'BUILDING'"),
    ("f_cmp", "?b > 5000.5 && ?b <= 8000", "c_acctbal > 5000.5 AND c_acctbal <= 8000"),
    ("f_in", "?m IN ('BUILDING', 'MACHINERY')", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("f_not_in", "?m NOT IN ('BUILDING', 'MACHINERY')", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ("f_contains", "CONTAINS(?m, 'IL')", "contains(c_mktsegment, 'IL')"),
    ("f_starts", "STRSTARTS(?m, 'AUTO')", "starts_with(c_mktsegment, 'AUTO')"),
    ("f_ends", "STRENDS(?m, 'Y')", "ends_with(c_mktsegment, 'Y')"),
    ("f_regex", "REGEX(?m, '^[A-F].*E')", "regexp_matches(c_mktsegment, '^[A-F].*E')"),
    ("f_regex_i", "REGEX(?m, 'furn', 'i')", "regexp_matches(c_mktsegment, '(?i)furn')"),
    ("f_not_regex", "!REGEX(?m, '^B')", "NOT regexp_matches(c_mktsegment, '^B')"),
    ("f_or", "?m = 'BUILDING' || ?b < 0", "c_mktsegment = 'BUILDING' OR c_acctbal < 0"),
    ("f_not", "!(?b < 0)", "NOT c_acctbal < 0"),
    ("f_isnumeric", "isNumeric(?b) && !isNumeric(?m)", "true"),
    ("f_isiri", "isIRI(?c) && isLiteral(?m) && !isBlank(?c)", "true"),
    ("f_strlen", "STRLEN(?m) > 8", "length(c_mktsegment) > 8"),
    ("f_lcase", "LCASE(?m) = 'building'", "lower(c_mktsegment) = 'building'"),
    ("f_datatype", "DATATYPE(?b) = xsd:double && DATATYPE(?m) = xsd:string", "true"),
    ("f_arith", "?b * 2 + 1 > 10000 - ?b / 4", "c_acctbal * 2 + 1 > 10000 - c_acctbal / 4"),
    ("f_incompatible", "?m < 7", "false"),
    ("f_alias", "<http://www.w3.org/2005/xpath-functions#contains>(?m, 'OLD')", "contains(c_mktsegment, 'OLD')"),
]:
    sparql(_name, f"SELECT ?c ?b WHERE {{ ?c customer:c_mktsegment ?m ; customer:c_acctbal ?b FILTER({_filter}) }}", "c:str b:double", f"SELECT 'urn:t:customer/' || c_custkey AS c, c_acctbal AS b {_C} WHERE {_where}")
_OPT = "?n nation:n_name ?name OPTIONAL { ?c r:c_nationkey ?n ; customer:c_acctbal ?b FILTER(?b > 9900) }"
_OPT_SQL = "FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900"
sparql("f_bound", f"SELECT ?name ?b WHERE {{ {_OPT} FILTER(bound(?b)) }}", "name:str b:double", f"SELECT n_name AS name, c_acctbal AS b {_OPT_SQL} WHERE c_acctbal IS NOT NULL")
sparql("f_not_bound", f"SELECT ?name WHERE {{ {_OPT} FILTER(!bound(?c)) }}", "name:str", f"SELECT n_name AS name {_OPT_SQL} WHERE c_custkey IS NULL")
sparql("f_sameterm", "SELECT ?a ?b WHERE { ?a nation:n_regionkey ?x . ?b region:r_regionkey ?y FILTER(sameTerm(?x, ?y)) }", "a:str b:str",
       "SELECT 'urn:t:nation/' || n_nationkey AS a, 'urn:t:region/' || r_regionkey AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
sparql("f_var_var", "SELECT ?o WHERE { ?l lineitem:l_quantity ?q ; lineitem:l_linenumber ?n ; r:l_orderkey ?o FILTER(?q < ?n) }", "o:str", "SELECT 'urn:t:orders/' || l_orderkey AS o FROM lineitem WHERE l_quantity < l_linenumber")
sparql("f_lang", "SELECT ?d WHERE { ?d documents:lang ?l ; documents:n_chars ?n BIND(STRLANG('x', ?l) AS ?t) FILTER(LANG(?t) = 'fr') }", "d:str", "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE lang = 'fr'")
sparql("f_langmatches", "SELECT ?d WHERE { ?d documents:lang ?l BIND(STRLANG('x', CONCAT(?l, '-x')) AS ?t) FILTER(LANGMATCHES(LANG(?t), 'DE')) }", "d:str", "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE lang = 'de'")

# -- joins
sparql("bgp_chain2", "SELECT ?c ?r WHERE { ?c r:c_nationkey ?n . ?n r:n_regionkey ?g . ?g region:r_name ?r }", "c:str r:str",
       "SELECT 'urn:t:customer/' || c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("bgp_star", "SELECT ?o ?s ?p ?d ?pr WHERE { ?o a t:orders ; orders:o_orderstatus ?s ; orders:o_totalprice ?p ; orders:o_orderdate ?d ; orders:o_orderpriority ?pr }", "o:str s:str p:double d:ts pr:str",
       "SELECT 'urn:t:orders/' || o_orderkey AS o, o_orderstatus AS s, o_totalprice AS p, o_orderdate AS d, o_orderpriority AS pr FROM orders")
sparql("bgp_chain4", "SELECT ?name (COUNT(*) AS ?n) WHERE { ?l r:l_orderkey ?o . ?o r:o_custkey ?c . ?c r:c_nationkey ?k . ?k nation:n_name ?name } GROUP BY ?name", "name:str n:int",
       "SELECT n_name AS name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
sparql("revenue_per_region", """SELECT ?region (SUM(?price * (1 - ?disc)) AS ?revenue) (COUNT(*) AS ?n) WHERE {
  ?l lineitem:l_extendedprice ?price ; lineitem:l_discount ?disc ; lineitem:l_quantity ?q ; r:l_orderkey ?o . ?o r:o_custkey ?c .
  ?c r:c_nationkey ?nat . ?nat r:n_regionkey ?reg . ?reg region:r_name ?region FILTER(?q > 10) }
  GROUP BY ?region HAVING(COUNT(*) > 10) ORDER BY DESC(?revenue) LIMIT 3""", "region:str revenue:dec n:int",
       """SELECT r_name AS region, CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(18,2)) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 10
  GROUP BY 1 HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 3""")
sparql("cartesian", "SELECT ?a ?b WHERE { ?x region:r_name ?a . ?y nation:n_name ?b }", "a:str b:str", "SELECT r_name AS a, n_name AS b FROM region, nation")
sparql("values_join", "SELECT ?n ?name WHERE { VALUES ?n { t:never <urn:t:nation/1> <urn:t:nation/1> <urn:t:nation/7> } ?n nation:n_name ?name }", "n:str name:str",
       "SELECT 'urn:t:nation/' || n_nationkey AS n, n_name AS name FROM nation JOIN (VALUES (1), (1), (7)) v(k) ON n_nationkey = k")
sparql("values_undef", "SELECT ?r ?k WHERE { ?r nation:n_regionkey ?x ; nation:n_nationkey ?k . VALUES (?x ?k) { (0 UNDEF) (UNDEF 5) } }", "r:str k:int",
       "SELECT 'urn:t:nation/' || n_nationkey AS r, n_nationkey::BIGINT AS k FROM nation, (VALUES (0, NULL), (NULL, 5)) v(a, b) WHERE (a IS NULL OR n_regionkey = a) AND (b IS NULL OR n_nationkey = b)")
sparql("optional_one", "SELECT ?c ?o WHERE { ?c a t:customer OPTIONAL { ?o r:o_custkey ?c } }", "c:str o:str", "SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
sparql("optional_filter", f"SELECT ?name ?b WHERE {{ {_OPT} }}", "name:str b:double", f"SELECT n_name AS name, c_acctbal AS b {_OPT_SQL}")
sparql("optional_outer_filter", "SELECT ?c ?o WHERE { ?c customer:c_acctbal ?b OPTIONAL { ?o r:o_custkey ?c ; orders:o_totalprice ?p FILTER(?p > ?b * 40) } }", "c:str o:str",
       "SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40")
sparql("optional_nested", "SELECT ?n ?c ?o WHERE { ?n nation:n_name ?x OPTIONAL { ?c r:c_nationkey ?n ; customer:c_acctbal ?b FILTER(?b > 9000) OPTIONAL { ?o r:o_custkey ?c ; orders:o_orderstatus 'P' } } }", "n:str c:str o:str",
       "SELECT 'urn:t:nation/' || n_nationkey AS n, 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || o_orderkey AS o FROM nation LEFT JOIN (SELECT * FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey")
sparql("union_bag", "SELECT ?n WHERE { { ?s nation:n_name ?n } UNION { ?s region:r_name ?n } UNION { ?s region:r_name ?n } }", "n:str", "SELECT n_name AS n FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
sparql("union_unbound", "SELECT ?a ?b WHERE { { ?s region:r_name ?a } UNION { ?s nation:n_name ?b } }", "a:str b:str", "SELECT r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT NULL, n_name FROM nation")
sparql("minus_anti", "SELECT ?c WHERE { ?c a t:customer MINUS { ?o r:o_custkey ?c } }", "c:str", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
sparql("minus_disjoint", "SELECT ?r WHERE { ?r region:r_name ?x MINUS { ?n nation:n_name ?y } }", "r:str", "SELECT 'urn:t:region/' || r_regionkey AS r FROM region")
sparql("exists_semi", "SELECT ?c WHERE { ?c a t:customer FILTER EXISTS { ?o r:o_custkey ?c ; orders:o_totalprice ?p FILTER(?p > 300000) } }", "c:str",
       "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sparql("not_exists_anti", "SELECT ?c WHERE { ?c customer:c_acctbal ?b FILTER NOT EXISTS { ?o r:o_custkey ?c ; orders:o_totalprice ?p FILTER(?p > ?b * 20) } }", "c:str",
       "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)")
sparql("exists_in_or", "SELECT ?c WHERE { ?c customer:c_acctbal ?b FILTER(?b < 0 || EXISTS { ?o r:o_custkey ?c ; orders:o_totalprice ?p FILTER(?p > 400000) }) }", "c:str",
       "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")


@query("compound_join", "SELECT 'urn:g:nation' AS g, 'urn:t:nation/' || n_nationkey AS s, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = stats.compound(quads(spark, sf, "nation"), "s", [F.col("p") == "urn:c:nation/n_name", F.col("p") == "urn:c:nation/n_regionkey"])
    return df.select("g", "s", F.col("o0").alias("name"), F.col("o1").alias("region"))


@query("attribute_map", "SELECT 'urn:t:orders/' || o_orderkey AS s, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = ["urn:c:orders/o_orderstatus", "urn:c:orders/o_orderpriority"]
    df = stats.attributes(RelationalDataset(spark=spark, folder=sf).quads_of(next(t for t in TABLES if t.name == "orders"), set(p)), p)
    return df.select("s", F.col(f"`{p[0]}`")[0].alias("status"), F.col(f"`{p[1]}`")[0].alias("priority"))


@query("tuple_constrained", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    spec = QuerySpec(["o", "p"], [A.Triple(Variable("o"), Iri(f"urn:c:orders/{c}"), Variable(v)) for c, v in (("o_orderstatus", "s"), ("o_orderpriority", "y"), ("o_totalprice", "p"))],
                     values=[A.Values(["s", "y"], [[Literal("O"), Literal("1-URGENT")], [Literal("P"), Literal("5-LOW")]])])
    return engine(spark, sf).query(spec, {"o": "str", "p": "double"})


# -- paths
sparql("path_seq", "SELECT ?c ?name WHERE { ?c r:c_nationkey/r:n_regionkey/region:r_name ?name }", "c:str name:str", "SELECT 'urn:t:customer/' || c_custkey AS c, r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("path_inv", "SELECT ?n ?c WHERE { ?n ^r:c_nationkey ?c }", "n:str c:str", "SELECT 'urn:t:nation/' || c_nationkey AS n, 'urn:t:customer/' || c_custkey AS c FROM customer")
sparql("path_alt", "SELECT ?x ?n WHERE { ?x r:c_nationkey|r:s_nationkey ?n }", "x:str n:str", "SELECT 'urn:t:customer/' || c_custkey AS x, 'urn:t:nation/' || c_nationkey AS n FROM customer UNION ALL SELECT 'urn:t:supplier/' || s_suppkey, 'urn:t:nation/' || s_nationkey FROM supplier")
_EDGES = "e AS (SELECT 'urn:t:customer/' || c_custkey AS a, 'urn:t:nation/' || c_nationkey AS b FROM customer UNION SELECT 'urn:t:nation/' || n_nationkey, 'urn:t:region/' || n_regionkey FROM nation), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a)"
sparql("path_plus", "SELECT ?a ?b WHERE { ?a (r:c_nationkey|r:n_regionkey)+ ?b }", "a:str b:str", f"WITH RECURSIVE {_EDGES} SELECT a, b FROM p")
sparql("path_star", "SELECT ?b WHERE { <urn:t:customer/1> (r:c_nationkey|r:n_regionkey)* ?b }", "b:str", f"WITH RECURSIVE {_EDGES} SELECT b FROM p WHERE a = 'urn:t:customer/1' UNION ALL SELECT 'urn:t:customer/1'")
sparql("path_star_back", "SELECT ?a WHERE { ?a (r:c_nationkey|r:n_regionkey)* <urn:t:region/2> }", "a:str", f"WITH RECURSIVE {_EDGES} SELECT a FROM p WHERE b = 'urn:t:region/2' UNION ALL SELECT 'urn:t:region/2'")
sparql("path_opt", "SELECT ?b WHERE { <urn:t:nation/4> r:n_regionkey? ?b }", "b:str", "SELECT 'urn:t:region/' || n_regionkey AS b FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'urn:t:nation/4'")
sparql("path_negated", "SELECT ?p ?o WHERE { <urn:t:nation/4> !(nation:n_name|rdf:type) ?o . <urn:t:nation/4> nation:n_name ?p }", "p:str o:str",
       "SELECT n_name AS p, unnest([n_nationkey::VARCHAR, n_regionkey::VARCHAR, 'urn:t:region/' || n_regionkey]) AS o FROM nation WHERE n_nationkey = 4")


@query("path_bounded", """WITH RECURSIVE e AS (SELECT 'urn:t:nation/' || n_nationkey AS a, 'urn:t:region/' || n_regionkey AS b FROM nation UNION SELECT 'urn:t:supplier/' || s_suppkey, 'urn:t:nation/' || s_nationkey FROM supplier),
m AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), p AS (SELECT ['urn:t:region/1'] AS nodes UNION ALL SELECT list_append(nodes, b) FROM p JOIN m ON nodes[-1] = m.a WHERE NOT list_contains(nodes, b) AND len(nodes) < 4)
SELECT array_to_string(nodes, ' ') AS path, (len(nodes) - 1)::INT AS length FROM (SELECT * FROM p WHERE len(nodes) > 1 ORDER BY len(nodes), nodes LIMIT 40)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    q = quads(spark, sf, "nation", "supplier").filter(F.col("p").isin("urn:r:n_regionkey", "urn:r:s_nationkey"))
    found, _ = paths.search_paths(q, "urn:t:region/1", direction="both", depth=3, most=40)
    return found.select(F.array_join("nodes", " ").alias("path"), F.col("length").cast("int").alias("length"))


# -- binds and functions
_FN = "SELECT ?c ?x WHERE { ?c customer:c_mktsegment ?m ; customer:c_acctbal ?b ; customer:c_name ?n ; customer:c_custkey ?k BIND(%s AS ?x) }"
for _name, _expr, _type, _sql in [
    ("bind_arith", "?b * 2 + 1", "double", "c_acctbal * 2 + 1"),
    ("bind_divide", "?k / (?k - 1)", "double", "CASE WHEN c_custkey <> 1 THEN c_custkey / (c_custkey - 1) END"),
    ("bind_concat", "CONCAT(?m, '-', ?n)", "str", "c_mktsegment || '-' || c_name"),
    ("bind_substr", "SUBSTR(?m, 2, 3)", "str", "substr(c_mktsegment, 2, 3)"),
    ("bind_if", "IF(?b < 0, 'debt', 'fine')", "str", "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END"),
    ("bind_coalesce", "COALESCE(?nothing, 1 / 0, ?m)", "str", "c_mktsegment"),
    ("bind_ucase", "UCASE(LCASE(?m))", "str", "upper(lower(c_mktsegment))"),
    ("bind_strdt_strlang", "CONCAT(LANG(STRLANG(?m, 'EN')), STR(STRDT('5', xsd:integer)))", "str", "'en5'"),
    ("bind_iri", "STR(IRI(CONCAT('urn:x:', ?m)))", "str", "'urn:x:' || c_mktsegment"),
    ("bind_numbers", "ABS(?b) + CEIL(?b) + FLOOR(?b) + ROUND(?b)", "double", "abs(c_acctbal) + ceil(c_acctbal) + floor(c_acctbal) + floor(c_acctbal + 0.5)"),
    ("bind_strings", "CONCAT(STRBEFORE(?n, '#'), '|', STRAFTER(?n, '#'), '|', REPLACE(?m, '[AEIOU]', '*'))", "str",
     "CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) ELSE '' END || '|' || CASE WHEN contains(c_name, '#') THEN substr(c_name, strpos(c_name, '#') + 1) ELSE '' END || '|' || regexp_replace(c_mktsegment, '[AEIOU]', '*', 'g')"),
    ("bind_hash", "CONCAT(MD5(?n), SHA256(?m))", "str", "md5(c_name) || sha256(c_mktsegment)"),
    ("bind_encode", "ENCODE_FOR_URI(CONCAT(?m, ' /~'))", "str", "c_mktsegment || '%20%2F~'"),
    ("bind_cast", "xsd:integer(?b) + xsd:integer('7')", "double", "trunc(c_acctbal) + 7"),
    ("bind_logic", "STR(?b > 0 && (?m = 'BUILDING' || !(?k > 10)))", "str", "(c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR NOT c_custkey > 10))::VARCHAR"),
]:
    sparql(_name, _FN % _expr, f"c:str x:{_type}", f"SELECT 'urn:t:customer/' || c_custkey AS c, {_sql} AS x FROM customer")
sparql("bind_dates", "SELECT ?o ?x WHERE { ?o orders:o_orderdate ?d BIND(YEAR(?d) * 10000 + MONTH(?d) * 100 + DAY(?d) AS ?x) }", "o:str x:int",
       "SELECT 'urn:t:orders/' || o_orderkey AS o, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::BIGINT AS x FROM orders")

# -- aggregates
sparql("agg_count", "SELECT (COUNT(*) AS ?n) (COUNT(?l) AS ?m) WHERE { ?l lineitem:l_quantity ?q }", "n:int m:int", "SELECT count(*) AS n, count(*) AS m FROM lineitem")
sparql("agg_count_distinct", "SELECT (COUNT(DISTINCT ?o) AS ?n) (COUNT(DISTINCT ?q) AS ?m) WHERE { ?l r:l_orderkey ?o ; lineitem:l_quantity ?q }", "n:int m:int", "SELECT count(DISTINCT l_orderkey) AS n, count(DISTINCT l_quantity) AS m FROM lineitem")
sparql("agg_count_distinct_star", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { { ?s orders:o_orderstatus ?x BIND(1 AS ?s2) } { SELECT ?x WHERE { ?o orders:o_orderstatus ?x } GROUP BY ?x } }", "n:int", "SELECT count(*) AS n FROM orders")
sparql("agg_sum_avg_min_max", "SELECT (SUM(?p) AS ?s) (AVG(?p) AS ?a) (MIN(?p) AS ?i) (MAX(?p) AS ?x) WHERE { ?o orders:o_totalprice ?p }", "s:dec a:dec i:double x:double",
       "SELECT CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS s, CAST(avg(o_totalprice) AS DECIMAL(18,2)) AS a, min(o_totalprice) AS i, max(o_totalprice) AS x FROM orders")
sparql("agg_group", "SELECT ?f ?s (SUM(?q) AS ?sum_qty) (AVG(?d) AS ?avg_disc) (COUNT(*) AS ?n) WHERE { ?l lineitem:l_returnflag ?f ; lineitem:l_linestatus ?s ; lineitem:l_quantity ?q ; lineitem:l_discount ?d } GROUP BY ?f ?s", "f:str s:str sum_qty:dec avg_disc:dec n:int",
       "SELECT l_returnflag AS f, l_linestatus AS s, CAST(sum(l_quantity) AS DECIMAL(18,2)) AS sum_qty, CAST(avg(l_discount) AS DECIMAL(18,2)) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
sparql("agg_group_expr", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o orders:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "y:int n:int", "SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY 1")
sparql("agg_having", "SELECT ?name (COUNT(?c) AS ?n) WHERE { ?c r:c_nationkey ?k . ?k nation:n_name ?name } GROUP BY ?name HAVING(COUNT(?c) > 55 && AVG(?never) > 0 || COUNT(?c) > 60)", "name:str n:int",
       "SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 60")
sparql("agg_distinct", "SELECT ?f (SUM(DISTINCT ?n) AS ?s) (AVG(DISTINCT ?n) AS ?a) WHERE { ?l lineitem:l_returnflag ?f ; lineitem:l_linenumber ?n } GROUP BY ?f", "f:str s:int a:double",
       "SELECT l_returnflag AS f, sum(DISTINCT l_linenumber)::BIGINT AS s, avg(DISTINCT l_linenumber)::DOUBLE AS a FROM lineitem GROUP BY 1")
sparql("agg_group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=',') AS ?names) WHERE { ?x r:n_regionkey ?r ; nation:n_name ?n } GROUP BY ?r", "r:str names:str", "SELECT 'urn:t:region/' || n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
sparql("agg_sample", "SELECT ?r (SAMPLE(?n) AS ?one) WHERE { ?x r:n_regionkey ?r ; nation:n_name ?n } GROUP BY ?r", "r:str one:str", "SELECT 'urn:t:region/' || n_regionkey AS r, min(n_name) AS one FROM nation GROUP BY 1")
sparql("agg_empty_sum", "SELECT (SUM(?b) AS ?s) (AVG(?b) AS ?a) (COUNT(*) AS ?n) WHERE { ?c customer:c_acctbal ?b FILTER(?b > 1000000) }", "s:int a:double n:int", "SELECT 0::BIGINT AS s, NULL::DOUBLE AS a, 0::BIGINT AS n")
sparql("agg_empty_group", "SELECT ?m (COUNT(*) AS ?n) WHERE { ?c customer:c_acctbal ?b ; customer:c_mktsegment ?m FILTER(?b > 1000000) } GROUP BY ?m", "m:str n:int", "SELECT '' AS m, 0::BIGINT AS n WHERE false")
sparql("agg_unbound_group", f"SELECT ?b (COUNT(*) AS ?n) WHERE {{ {_OPT} }} GROUP BY ?b", "b:double n:int", f"SELECT c_acctbal AS b, count(*) AS n {_OPT_SQL} GROUP BY 1")

# -- order, slices, forms
sparql("order_desc", "SELECT ?o ?p WHERE { ?o orders:o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 25", "o:str p:double", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC, o LIMIT 25")
sparql("order_mixed", "SELECT ?v WHERE { { ?n nation:n_name ?v } UNION { ?n nation:n_nationkey ?v } UNION { ?x r:n_regionkey ?v } } ORDER BY ?v LIMIT 60", "v:str",
       "SELECT v FROM (SELECT 3 AS k, NULL::DOUBLE AS n, n_name AS v FROM nation UNION ALL SELECT 2, n_nationkey, n_nationkey::VARCHAR FROM nation UNION ALL SELECT 1, NULL, 'urn:t:region/' || n_regionkey FROM nation) ORDER BY k, n, v LIMIT 60")
sparql("order_unbound_first", f"SELECT ?name ?b WHERE {{ {_OPT} }} ORDER BY ?b ?name LIMIT 12", "name:str b:double", f"SELECT n_name AS name, c_acctbal AS b {_OPT_SQL} ORDER BY c_acctbal NULLS FIRST, n_name LIMIT 12")
sparql("topn", "SELECT ?c (SUM(?p) AS ?s) WHERE { ?o r:o_custkey ?c ; orders:o_totalprice ?p } GROUP BY ?c ORDER BY DESC(?s) ?c LIMIT 10", "c:str s:dec",
       "SELECT 'urn:t:customer/' || o_custkey AS c, CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS s FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, c LIMIT 10")
sparql("offset_page", "SELECT ?name WHERE { ?n nation:n_name ?name } ORDER BY ?name LIMIT 5 OFFSET 10", "name:str", "SELECT n_name AS name FROM nation ORDER BY 1 LIMIT 5 OFFSET 10")
sparql("keyset_page", "SELECT ?e ?id WHERE { ?e events:event_id ?id FILTER(?id < 500) } ORDER BY DESC(?id) LIMIT 20", "e:str id:int", "SELECT 'urn:t:events/' || event_id AS e, event_id AS id FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 20")
sparql("distinct", "SELECT DISTINCT ?f ?s WHERE { ?l lineitem:l_returnflag ?f ; lineitem:l_linestatus ?s }", "f:str s:str", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")
sparql("reduced_order", "SELECT DISTINCT ?m WHERE { ?c customer:c_mktsegment ?m } ORDER BY DESC(?m) LIMIT 3", "m:str", "SELECT DISTINCT c_mktsegment AS m FROM customer ORDER BY 1 DESC LIMIT 3")
sparql("ask", "ASK { ?c customer:c_acctbal ?b FILTER(?b > 9990) }", "", "SELECT count(*) > 0 AS boolean FROM customer WHERE c_acctbal > 9990")
sparql("subquery", "SELECT ?c ?p WHERE { ?o r:o_custkey ?c ; orders:o_totalprice ?p . { SELECT (MAX(?x) AS ?p) WHERE { ?y orders:o_totalprice ?x } } }", "c:str p:double", "SELECT 'urn:t:customer/' || o_custkey AS c, o_totalprice AS p FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
sparql("from_named", "SELECT ?g (COUNT(*) AS ?n) FROM NAMED g:nation FROM NAMED g:region WHERE { GRAPH ?g { ?s a ?t } } GROUP BY ?g", "g:str n:int", "SELECT 'urn:g:nation' AS g, count(*) AS n FROM nation UNION ALL SELECT 'urn:g:region', count(*) FROM region")
sparql("from_default", "SELECT (COUNT(*) AS ?n) FROM g:region WHERE { ?s a ?t }", "n:int", "SELECT count(*) AS n FROM region")
_T = "SELECT 'iri' AS sk, 'urn:t:nation/' || n_nationkey AS s, {p} AS p, {k} AS ok, {o} AS o, NULL::VARCHAR AS od, NULL::VARCHAR AS ol FROM nation"
sparql("construct", "CONSTRUCT { ?n <urn:named> ?x . ?n <urn:in> ?r } WHERE { ?n nation:n_name ?x ; r:n_regionkey ?r }", "", _T.format(p="'urn:named'", k="'literal'", o="n_name") + " UNION ALL " + _T.format(p="'urn:in'", k="'iri'", o="'urn:t:region/' || n_regionkey"))
sparql("construct_dedupe", "CONSTRUCT { ?r <urn:has> <urn:nations> . ?name <urn:bad> ?r } WHERE { ?n r:n_regionkey ?r ; nation:n_name ?name }", "", "SELECT DISTINCT 'iri' AS sk, 'urn:t:region/' || n_regionkey AS s, 'urn:has' AS p, 'iri' AS ok, 'urn:nations' AS o, NULL::VARCHAR AS od, NULL::VARCHAR AS ol FROM nation")
sparql("describe", "DESCRIBE <urn:t:region/1>", "", """SELECT 'iri' AS sk, 'urn:t:region/1' AS s, x.p AS p, x.k AS ok, x.o AS o, x.d AS od, NULL::VARCHAR AS ol FROM (SELECT unnest([
  {'p': 'urn:c:region/r_regionkey', 'k': 'literal', 'o': r_regionkey::VARCHAR, 'd': 'http://www.w3.org/2001/XMLSchema#integer'}, {'p': 'urn:c:region/r_name', 'k': 'literal', 'o': r_name, 'd': NULL},
  {'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'k': 'iri', 'o': 'urn:t:region', 'd': NULL}]) AS x FROM region WHERE r_regionkey = 1)""")


# -- updates: the quads of nation or region afterwards
_SHOW = ["g", "s", "p", "o"]
_NATION = """SELECT 'urn:g:nation' AS g, 'urn:t:nation/' || n_nationkey AS s, x.p AS p, x.o AS o FROM (SELECT n_nationkey, unnest([{'p': 'urn:c:nation/n_nationkey', 'o': n_nationkey::VARCHAR}, {'p': 'urn:c:nation/n_name', 'o': n_name},
  {'p': 'urn:c:nation/n_regionkey', 'o': n_regionkey::VARCHAR}, {'p': 'urn:r:n_regionkey', 'o': 'urn:t:region/' || n_regionkey}, {'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'o': 'urn:t:nation'}]) AS x FROM nation)"""


def updating(name: str, text: str, sql: str) -> None:
    @query(name, sql)
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return update.update(spark, quads(spark, sf, "nation"), PREFIXES + text).select(*_SHOW)


updating("upd_insert", 'INSERT DATA { GRAPH g:x { t:a t:b "c"@en , 5 } t:a t:b t:c }', f"{_NATION} UNION ALL SELECT * FROM (VALUES ('urn:g:x', 'urn:t:a', 'urn:t:b', 'c'), ('urn:g:x', 'urn:t:a', 'urn:t:b', '5'), ('', 'urn:t:a', 'urn:t:b', 'urn:t:c'))")
updating("upd_delete_data", "DELETE DATA { GRAPH g:nation { <urn:t:nation/1> a t:nation . <urn:t:nation/1> a t:other } }", f"SELECT * FROM ({_NATION}) WHERE NOT (s = 'urn:t:nation/1' AND o = 'urn:t:nation')")
updating("upd_delete_where", "DELETE WHERE { GRAPH g:nation { ?s nation:n_name ?n } }", f"SELECT * FROM ({_NATION}) WHERE p <> 'urn:c:nation/n_name'")
updating("upd_modify", "WITH g:nation DELETE { ?s nation:n_name ?n } INSERT { ?s <urn:renamed> ?u } WHERE { ?s nation:n_name ?n ; nation:n_nationkey ?k FILTER(?k < 10) BIND(LCASE(?n) AS ?u) }",
         f"SELECT * FROM ({_NATION}) a WHERE NOT (p = 'urn:c:nation/n_name' AND s IN (SELECT 'urn:t:nation/' || n_nationkey FROM nation WHERE n_nationkey < 10)) UNION ALL SELECT 'urn:g:nation', 'urn:t:nation/' || n_nationkey, 'urn:renamed', lower(n_name) FROM nation WHERE n_nationkey < 10")
updating("upd_clear", "CLEAR GRAPH g:nation", f"SELECT * FROM ({_NATION}) WHERE false")
updating("upd_copy", "COPY g:nation TO g:other", f"{_NATION} UNION ALL SELECT 'urn:g:other', s, p, o FROM ({_NATION})")
updating("upd_move", "MOVE g:nation TO DEFAULT", f"SELECT '' AS g, s, p, o FROM ({_NATION})")


@query("upd_term_rewrite", f"SELECT g, replace(s, 'urn:t:nation/', 'urn:land/') AS s, p, CASE WHEN o = 'urn:t:nation' THEN 'urn:land' ELSE o END AS o FROM ({_NATION})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return update.rewrite_terms(quads(spark, sf, "nation"), "urn:t:nation", "urn:land")[0].select(*_SHOW)


@query("upd_replace_source", "SELECT 'urn:g:region' AS g, 'urn:t:region/' || r_regionkey AS s, 'urn:c:region/r_name' AS p, r_name AS o FROM region")
def _(spark: SparkSession, sf: str) -> DataFrame:
    q = quads(spark, sf, "region")
    return update.replace_source(q, "urn:g:region", q.filter("p = 'urn:c:region/r_name'")).select(*_SHOW)


# -- statistics
@query("stat_predicates", "SELECT 'urn:c:orders/o_orderstatus' AS p, count(*) AS quads, count(*) AS subjects, count(DISTINCT o_orderstatus) AS objects, 1::BIGINT AS graphs FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distribution(quads(spark, sf, "orders"), ["p"]).filter("p = 'urn:c:orders/o_orderstatus'")


@query("stat_graphs", "SELECT 'urn:g:nation' AS g, 5 * count(*) AS quads, count(*) AS subjects, 5::BIGINT AS predicates FROM nation UNION ALL SELECT 'urn:g:region', 3 * count(*), count(*), 3 FROM region")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distribution(quads(spark, sf, "nation", "region"), ["g"]).drop("objects")


@query("stat_datatypes", "SELECT 'http://www.w3.org/2001/XMLSchema#double' AS datatype, count(DISTINCT c_acctbal) AS literals, count(*) AS uses FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.datatypes(quads(spark, sf, "customer")).filter("datatype like '%double'")


@query("stat_explorer", "SELECT 'urn:t:customer' AS term, count(*) AS n FROM customer UNION ALL SELECT 'urn:t:nation', count(*) FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.explore(quads(spark, sf, "customer", "nation"), "classes", text="T:")


@query("budget_window", "SELECT item_id, spent::BIGINT AS spent FROM (SELECT item_id, sum(strlen(text)) OVER (ORDER BY item_id DESC ROWS UNBOUNDED PRECEDING) AS spent FROM benchmark) WHERE spent <= 5000")
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.octet_length("text").alias("bytes"))
    return stats.within_budget(b, 5000, "bytes", [F.desc("item_id")]).select("item_id", "spent")


# -- text
def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as chunks; a document's source is its IRI."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("urn:t:documents/"), F.col("doc_id")).alias("source"), "text", F.col("source").alias("heading"))
    return docs.select("source", "heading", F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))


_LINES = "c AS (SELECT 'urn:t:documents/' || doc_id AS source, source AS heading, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS ordinal FROM documents)"
_SCORED = f"{_LINES}, n AS (SELECT *, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS t FROM c), s AS (SELECT source, ordinal, ((length(t) - length(replace(t, 'license', ''))) / 7)::INT AS score FROM n WHERE contains(t, 'license'))"


@query("text_chunk_plain", """WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS b, list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS l FROM documents),
q AS (SELECT doc_id, list_transform(CASE WHEN len(b) > 1 THEN b ELSE l END, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS c FROM p)
SELECT doc_id AS source, (i - 1)::INT AS ordinal, c[i] AS content FROM q, unnest(range(1, len(c) + 1)) AS r(i)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.chunk_plain(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id", "text").select("source", "ordinal", "content")


_TOKENS = "p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')) AS term FROM documents)"


@query("text_terms", f"WITH {_TOKENS} SELECT doc_id, term, count(*) AS occurrences FROM p GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), ["doc_id"], "text")


@query("text_doc_frequency", f"WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS sources, count(DISTINCT doc_id) AS chunks, count(*) AS occurrences FROM p GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.document_frequency(search.postings(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), ["doc_id"], "text"), "doc_id", ["doc_id"])


@query("text_phrase", f"WITH {_SCORED} SELECT * FROM s")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.text_search(_chunks(spark, sf), "License").select("source", "ordinal", "score")


@query("text_heading_boost", f"WITH {_LINES} SELECT source, ordinal, 100 + ((length(lower(content)) - length(replace(lower(content), 'src1', ''))) / 4)::INT AS score FROM c WHERE contains(heading, 'src1')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.text_search(_chunks(spark, sf), "SRC1").select("source", "ordinal", "score")


@query("text_per_source_cap", f"WITH {_SCORED} SELECT source, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, ordinal) AS k FROM s) WHERE k <= 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.text_search(_chunks(spark, sf), "license", per_source=1).select("source", "ordinal", "score")


@query("text_entities", "SELECT 'urn:t:documents/' || doc_id AS source, 1 AS score FROM documents WHERE lang = 'fr' AND source = 'src0'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("urn:t:documents/"), F.col("doc_id")).alias("source"), F.lit(0).alias("ordinal"), F.col("text").alias("content"), F.array("lang", F.col("source")).alias("entities"))
    return search.text_search(docs, "", entities=["fr", "src0"]).select("source", "score")


@query("text_html", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", search.extract_html(F.col("html")).alias("text"))


@query("text_graph_join", f"WITH {_SCORED}, d AS (SELECT 'urn:t:documents/' || doc_id AS source, lang FROM documents) SELECT lang, sum(score)::BIGINT AS total FROM s JOIN d ON s.source = d.source GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    e.text = _chunks(spark, sf)
    spec = QuerySpec(None, [A.Triple(Variable("d"), Iri("urn:c:documents/lang"), Variable("lang"))], searches=[A.TextSearch("license", {"source": "d", "score": "score"})], group_by=["lang"], aggregates={"total": aggregate("SUM", var("score"))})
    return e.query(spec, {"lang": "str", "total": "int"})


# -- vectors
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_DOT, _LEN = "list_dot_product(e, q)", "sqrt(list_dot_product({0}, {0}))"
_V = f"v AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_Q} AS q FROM embeddings)"


def _near(name: str, score: str, sql_tail: str, **options) -> None:
    @query(name, f"WITH {_V}, s AS (SELECT vec_id, {score} AS s FROM v) SELECT vec_id, round(s, 6) AS score FROM s {sql_tail}")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        v = spark.read.parquet(f"{sf}/embeddings.parquet")
        q = [float(x) for x in v.filter("vec_id = 0").first()["embedding"]]
        return search.vector_search(v, q, **options).select("vec_id", F.round("score", 6).alias("score"))


_COS = f"{_DOT} / ({_LEN.format('e')} * {_LEN.format('q')})"
_near("vec_cosine", _COS, "ORDER BY s DESC, vec_id LIMIT 20", limit=20)
_near("vec_dot", _DOT, "ORDER BY s DESC, vec_id LIMIT 20", metric="dot", limit=20)
_near("vec_euclid", "-list_distance(e, q)", "ORDER BY s DESC, vec_id LIMIT 20", metric="euclidean", limit=20)
_near("vec_threshold", _COS, "WHERE s >= 0.2", threshold=0.2)


@query("vec_exclude", f"WITH {_V}, s AS (SELECT vec_id, greatest(0, least(1, 1 - list_distance(e, q) ** 2 / 2)) AS s FROM v WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)) SELECT vec_id, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 15")
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = [float(x) for x in v.filter("vec_id = 0").first()["embedding"]]
    return search.model_search(v, q, 15, exclude=v.filter("label = 3").select("vec_id")).select("vec_id", F.round("score", 6).alias("score"))


@query("vec_model_distribution", "SELECT label, len(embedding)::INT AS dimensions, count(*) AS vectors, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS avg_magnitude FROM embeddings GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = search.model_distribution(spark.read.parquet(f"{sf}/embeddings.parquet"), ["label"])
    return d.select("label", "dimensions", "vectors", F.round("avg_magnitude", 6).alias("avg_magnitude"))


@query("fusion_weighted", f"""WITH {_SCORED}, {_V}, x AS (SELECT source, sum(score) AS ts FROM s GROUP BY 1), y AS (SELECT 'urn:t:documents/' || vec_id AS source, {_COS} AS vs FROM v)
SELECT source, round(ts * 0.55 + vs * 0.45, 6) AS rank_score FROM x JOIN y USING (source) ORDER BY ts * 0.55 + vs * 0.45 DESC, source LIMIT 8""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = [float(x) for x in v.filter("vec_id = 0").first()["embedding"]]
    text = search.text_search(_chunks(spark, sf), "license").groupBy("source").agg(F.sum("score").alias("text_score"))
    near = search.vector_search(v, q).select(F.concat(F.lit("urn:t:documents/"), F.col("vec_id")).alias("source"), F.col("score").alias("vector_score"))
    return search.fuse(text, near, ["source"]).select("source", F.round("rank_score", 6).alias("rank_score"))


# -- structured queries and change feeds
@query("spec_group", "SELECT o_orderstatus AS s, count(*) AS n, CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS total FROM orders WHERE length(o_orderpriority) > 5 GROUP BY 1 HAVING count(*) > 3 ORDER BY n DESC")
def _(spark: SparkSession, sf: str) -> DataFrame:
    triples = [A.Triple(Variable("o"), Iri(f"urn:c:orders/{c}"), Variable(v)) for c, v in (("o_orderstatus", "s"), ("o_totalprice", "p"), ("o_orderpriority", "y"))]
    spec = QuerySpec(None, triples, filters=[test(">", call("STRLEN", var("y")), value(Literal("5", "http://www.w3.org/2001/XMLSchema#integer")))], group_by=["s"],
                     aggregates={"n": aggregate("COUNT"), "total": aggregate("SUM", var("p"))}, having=[test(">", aggregate("COUNT"), value(Literal("3", "http://www.w3.org/2001/XMLSchema#integer")))], order_by=[("n", True)])
    return engine(spark, sf).query(spec, {"s": "str", "n": "int", "total": "dec"})


_CHANGES = "c AS (SELECT user_id, event_type, event_id, ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op FROM events)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", "event_id", "ts", F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"))


@query("change_coalesce", f"WITH {_CHANGES} SELECT user_id, max(event_id) AS last, CASE WHEN bool_or(op = 'delete') THEN 'delete' ELSE 'update' END AS op FROM c GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return changes.coalesced(_events(spark, sf), ["user_id"], ["event_id"]).select("user_id", F.col("event_id").alias("last"), "op")


@query("change_feed_sync", f"WITH {_CHANGES}, g AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id, bool_or(op = 'delete') AS gone FROM c GROUP BY 1) SELECT user_id, event_type, event_id FROM g WHERE NOT gone")
def _(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{str(storage.folder(spark)).rstrip('/')}/sync-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    stream = stream.withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("update"))
    columns = [F.col(c) for c in ("user_id", "event_type", "event_id")]
    changes.sync(stream, f"{folder}/state", f"{folder}/checkpoint", ["user_id"], ["event_id"], columns)
    return changes.state(spark, f"{folder}/state")


from quadweave import queries_retrieval, queries_rules  # noqa: E402, F401  they register more
