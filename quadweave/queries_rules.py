"""Registered queries on rules of terms, merges of graphs and sources, functions, scopes, updates, documents and stored quads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave import storage
from quadweave.engine import Engine, QuerySpec, call, test, value, var
from quadweave.operators import stats, update
from quadweave.plans import algebra as A
from quadweave.queries import _NATION, _OPT, _OPT_SQL, PREFIXES, engine, quads, query, sparql, updating
from quadweave.sources import rdf_io
from quadweave.sources.datasets import TABLES, QuadDataset, Scope, StoredDataset
from quadweave.terms import XSD, Iri, Literal, Variable
from quadweave.views import Views


def over(spark: SparkSession, q: DataFrame, **options) -> Engine:
    """An engine over plain quads, with the real default graph."""
    return Engine(spark, QuadDataset(quads=q, **options))


def asked(name: str, make, text: str, types: str, sql: str, **options) -> None:
    """A SPARQL query over the quads that make(spark, folder) gives."""
    kinds = dict(x.split(":") for x in types.split())

    @query(name, sql)
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return over(spark, make(spark, sf), **options).sparql(PREFIXES + text, kinds)


def facts(df: DataFrame, s, p: str, o, datatype: str | None = None, g: str = "", kind: str = "literal") -> DataFrame:
    t = [F.lit(g).alias("g"), F.lit("iri").alias("sk"), s.alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("ok"), o.cast("string").alias("o")]
    return df.select(*t, F.lit(datatype).cast("string").alias("od"), F.lit(None).cast("string").alias("ol"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("line"))


def order_iri():
    return F.concat(F.lit("urn:t:orders/"), F.col("o_orderkey"))


# -- integers beyond what doubles hold
def _large(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return facts(orders, order_iri(), "urn:big", F.lit(2**53) + F.col("o_orderkey"), XSD + "integer")


asked("int_large_equal", _large, f"SELECT ?s WHERE {{ ?s <urn:big> ?x FILTER(?x = {2**53 + 7}) }}", "s:str", "SELECT 'urn:t:orders/' || o_orderkey AS s FROM orders WHERE o_orderkey = 7")
asked("int_large_range", _large, f"SELECT ?s WHERE {{ ?s <urn:big> ?x FILTER(?x > {2**53 + 100} && ?x <= {2**53 + 201}) }}", "s:str", "SELECT 'urn:t:orders/' || o_orderkey AS s FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 201")
asked("int_large_sum", _large, "SELECT (SUM(?x) AS ?n) (SUM(DISTINCT ?x) AS ?m) WHERE { ?s <urn:big> ?x }", "n:str m:str", f"SELECT sum(o_orderkey::HUGEINT + {2**53})::VARCHAR AS n, sum(DISTINCT o_orderkey::HUGEINT + {2**53})::VARCHAR AS m FROM orders")
asked("int_large_arith", _large, "SELECT ?s ?y WHERE { ?s <urn:big> ?x BIND(?x * 3 + 1 AS ?y) }", "s:str y:str", f"SELECT 'urn:t:orders/' || o_orderkey AS s, ((o_orderkey::HUGEINT + {2**53}) * 3 + 1)::VARCHAR AS y FROM orders")


# -- graphs and sources that hold the same facts
def _twice(column: str, *values: str):
    def make(spark: SparkSession, sf: str) -> DataFrame:
        q = quads(spark, sf, "nation", "region")
        return q.withColumn(column, F.lit(values[0])).union(q.filter("p != 'urn:r:n_regionkey'").withColumn(column, F.lit(values[1])))

    return make


_BOTH = "(5 * (SELECT count(*) FROM nation) + 3 * (SELECT count(*) FROM region))"
asked("from_merge", _twice("g", "urn:g:a", "urn:g:b"), "SELECT (COUNT(*) AS ?n) FROM g:a FROM g:b WHERE { ?s ?p ?o }", "n:int", f"SELECT {_BOTH} AS n")
asked("from_merge_join", _twice("g", "urn:g:a", "urn:g:b"), "SELECT ?x ?r FROM g:a FROM g:b WHERE { ?n nation:n_name ?x ; r:n_regionkey ?g . ?g region:r_name ?r }", "x:str r:str", "SELECT n_name AS x, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
asked("source_merge", _twice("source", "urn:f:1", "urn:f:2"), "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", "g:str n:int", "SELECT 'urn:g:nation' AS g, 5 * count(*) AS n FROM nation UNION ALL SELECT 'urn:g:region', 3 * count(*) FROM region")
asked("union_graph", _twice("g", "urn:g:a", "urn:g:b"), "SELECT ?p (COUNT(?s) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", "p:str n:int",
      "SELECT p, n FROM (SELECT unnest(['urn:c:nation/n_nationkey', 'urn:c:nation/n_name', 'urn:c:nation/n_regionkey', 'urn:r:n_regionkey']) AS p, count(*) AS n FROM nation UNION ALL SELECT unnest(['urn:c:region/r_regionkey', 'urn:c:region/r_name']), count(*) FROM region UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region))", graphs="union")
sparql("scan_graph_prefix", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s a ?t } } GROUP BY ?g", "g:str n:int", "SELECT 'urn:g:' || t AS g, n FROM (SELECT 'part' AS t, count(*) AS n FROM part UNION ALL SELECT 'pages', count(*) FROM pages) WHERE n > 0", scope=Scope(graph_prefix="urn:g:pa"))
sparql("scan_denied_prefix", "SELECT ?t (COUNT(*) AS ?n) WHERE { ?s a ?t } GROUP BY ?t", "t:str n:int", "SELECT 'urn:t:' || t AS t, n FROM (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region) WHERE n > 0",
       scope=Scope(denied_source_prefixes=tuple(f"urn:g:{t.name[:2]}" for t in TABLES if t.name not in ("nation", "region")), denied_sources=("urn:g:nothing",)))
sparql("scan_allowed_none", "SELECT ?s WHERE { ?s a t:region }", "s:str", "SELECT '' AS s WHERE false", scope=Scope(allowed_graphs=()))


# -- filters that part the data
_MIXED = "{ ?s nation:n_name ?v } UNION { ?s nation:n_nationkey ?v } UNION { ?s r:n_regionkey ?v } UNION { ?s orders:o_orderdate ?v }"
_MIXED_SQL = "SELECT 's' AS k, n_name AS v FROM nation UNION ALL SELECT 'n', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'i', 'urn:t:region/' || n_regionkey FROM nation UNION ALL SELECT 'd', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') FROM orders"
for _name, _filter, _kinds in [
    ("mixed_isnumeric", "isNumeric(?v)", "n"), ("mixed_isiri", "isIRI(?v)", "i"), ("mixed_isliteral", "isLiteral(?v)", "snd"), ("mixed_datatype", "DATATYPE(?v) = xsd:string", "s"),
    ("mixed_datatype_date", "DATATYPE(?v) = xsd:dateTime", "d"), ("mixed_not_datatype", "DATATYPE(?v) != xsd:integer", "sd"), ("mixed_isblank", "isBlank(?v)", ""), ("mixed_is_uri", "isURI(?v) || isNumeric(?v)", "in"),
]:
    sparql(_name, f"SELECT ?v WHERE {{ {_MIXED} FILTER({_filter}) }}", "v:str", f"SELECT v FROM ({_MIXED_SQL}) WHERE contains('{_kinds}', k) AND '{_kinds}' <> ''")
sparql("f_str_iri", "SELECT ?n WHERE { ?n nation:n_name ?x FILTER(STRSTARTS(STR(?n), 'urn:t:nation/1')) }", "n:str", "SELECT 'urn:t:nation/' || n_nationkey AS n FROM nation WHERE starts_with(n_nationkey::VARCHAR, '1')")
sparql("f_str_contains", "SELECT ?n ?k WHERE { ?n nation:n_nationkey ?k FILTER(CONTAINS(STR(?k), '2') && STRENDS(STR(?n), '2') || REGEX(STR(?k), '^1[0-3]$')) }", "n:str k:int",
       "SELECT 'urn:t:nation/' || n_nationkey AS n, n_nationkey::BIGINT AS k FROM nation WHERE contains(n_nationkey::VARCHAR, '2') AND ends_with(n_nationkey::VARCHAR, '2') OR regexp_matches(n_nationkey::VARCHAR, '^1[0-3]$')")
sparql("f_lang_not", "SELECT ?d WHERE { ?d documents:lang ?l BIND(STRLANG('x', ?l) AS ?t) FILTER(LANG(?t) != 'fr' && !LANGMATCHES(LANG(?t), 'de')) }", "d:str", "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE lang NOT IN ('fr', 'de')")
sparql("reduced_bag", "SELECT REDUCED ?m WHERE { ?c customer:c_mktsegment ?m }", "m:str", "SELECT c_mktsegment AS m FROM customer")
sparql("select_star", "SELECT * WHERE { ?n nation:n_name ?name ; r:n_regionkey ?r }", "n:str name:str r:str", "SELECT 'urn:t:nation/' || n_nationkey AS n, n_name AS name, 'urn:t:region/' || n_regionkey AS r FROM nation")
sparql("order_expression", "SELECT ?n ?k WHERE { ?n nation:n_nationkey ?k } ORDER BY DESC(?k * ?k - 10 * ?k) ?n LIMIT 7", "n:str k:int", "SELECT 'urn:t:nation/' || n_nationkey AS n, n_nationkey::BIGINT AS k FROM nation ORDER BY k * k - 10 * k DESC, n LIMIT 7")
sparql("optional_bind", f"SELECT ?name ?x WHERE {{ {_OPT} BIND(COALESCE(?b * 2, 0) AS ?x) }}", "name:str x:double", f"SELECT n_name AS name, coalesce(c_acctbal * 2, 0) AS x {_OPT_SQL}")
sparql("optional_shared", "SELECT ?n ?x ?c WHERE { ?n nation:n_name ?y OPTIONAL { ?n nation:n_regionkey ?x FILTER(?x < 2) } ?c nation:n_regionkey ?x }", "n:str x:int c:str",
       "SELECT 'urn:t:nation/' || a.n_nationkey AS n, b.n_regionkey::BIGINT AS x, 'urn:t:nation/' || b.n_nationkey AS c FROM nation a JOIN nation b ON a.n_regionkey >= 2 OR a.n_regionkey = b.n_regionkey")
sparql("agg_min_max_distinct", "SELECT ?f (MIN(DISTINCT ?q) AS ?i) (MAX(DISTINCT ?q) AS ?x) (COUNT(DISTINCT ?q) AS ?n) WHERE { ?l lineitem:l_returnflag ?f ; lineitem:l_quantity ?q } GROUP BY ?f", "f:str i:double x:double n:int", "SELECT l_returnflag AS f, min(l_quantity) AS i, max(l_quantity) AS x, count(DISTINCT l_quantity) AS n FROM lineitem GROUP BY 1")
sparql("max_joined", "SELECT ?c ?p WHERE { ?o r:o_custkey ?c ; orders:o_totalprice ?p . { SELECT ?c (MAX(?x) AS ?p) WHERE { ?y r:o_custkey ?c ; orders:o_totalprice ?x } GROUP BY ?c } }", "c:str p:double",
       "SELECT 'urn:t:customer/' || o_custkey AS c, o_totalprice AS p FROM orders JOIN (SELECT o_custkey AS k, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = k AND o_totalprice = m")
sparql("exists_in_or_repeated", "SELECT ?m WHERE { ?c customer:c_mktsegment ?m ; r:c_nationkey ?n FILTER(EXISTS { ?n nation:n_name 'FRANCE' } || !EXISTS { ?n r:n_regionkey ?g . ?g region:r_name ?x FILTER(?x > 'B') }) }", "m:str",
       "SELECT c_mktsegment AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'FRANCE' OR NOT r_name > 'B'")

# -- functions
_DATE = "SELECT ?o ?x WHERE { ?o orders:o_orderdate ?d BIND(%s AS ?x) }"
_FN = "SELECT ?c ?x WHERE { ?c customer:c_mktsegment ?m ; customer:c_name ?n BIND(%s AS ?x) }"
for _name, _expr, _type, _sql in [
    ("bind_strings_variable", "CONCAT(STRBEFORE(?n, SUBSTR(?n, 9, 2)), '|', STRAFTER(?n, SUBSTR(?n, 9, 1)), '|', STRBEFORE(?m, ?n), '|', STRAFTER(?m, ''))", "str",
     "split_part(c_name, substr(c_name, 9, 2), 1) || '|' || substr(c_name, strpos(c_name, substr(c_name, 9, 1)) + 1) || '||' || c_mktsegment"),
    ("bind_sha", "CONCAT(SHA1(?n), '-', STR(STRLEN(SHA384(?n))), '-', STR(STRLEN(SHA512(?n))))", "str", "sha1(c_name) || '-96-128'"),
    ("bind_uuid", "STR(STRLEN(STRUUID()) = 36 && STRSTARTS(STR(UUID()), 'urn:uuid:') && RAND() < 1 && isBlank(BNODE()) && isBlank(BNODE(?n)) && DATATYPE(NOW()) = xsd:dateTime)", "str", "'true'"),
    ("bind_resolve", "STR(IRI(CONCAT('x/', ?m)))", "str", "NULL::VARCHAR"),
    ("bind_strlang_before", "CONCAT(LANG(STRBEFORE(STRLANG(?m, 'en'), 'I')), '|', LANG(STRBEFORE(STRLANG(?m, 'en'), '~')))", "str", "CASE WHEN contains(c_mktsegment, 'I') THEN 'en|' ELSE '|' END"),
]:
    sparql(_name, _FN % _expr, f"c:str x:{_type}", f"SELECT 'urn:t:customer/' || c_custkey AS c, {_sql} AS x FROM customer")
for _name, _expr, _type, _sql in [
    ("bind_times", "HOURS(?d) * 3600 + MINUTES(?d) * 60 + SECONDS(?d)", "double", "(hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate))::DOUBLE"),
    ("bind_zones", "CONCAT(TZ(?d), '|', STR(TIMEZONE(?d)))", "str", "'Z|PT0S'"),
    ("bind_zone_offset", "CONCAT(TZ(STRDT('2024-05-01T10:00:00-05:30', xsd:dateTime)), STR(TIMEZONE(STRDT('2024-05-01T10:00:00-05:30', xsd:dateTime))), STR(HOURS(?d) >= 0))", "str", "'-05:30-PT5H30Mtrue'"),
]:
    sparql(_name, _DATE % _expr, f"o:str x:{_type}", f"SELECT 'urn:t:orders/' || o_orderkey AS o, {_sql} AS x FROM orders")


# -- structured queries
@query("spec_null_and_string", "SELECT 'urn:t:nation/' || n_nationkey AS n FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AND contains(n_name, 'A')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n, c = Variable("n"), Variable("c")
    customer = A.Group([A.BGP([A.Triple(c, Iri("urn:r:c_nationkey"), n), A.Triple(c, Iri("urn:c:customer/c_acctbal"), Variable("b"))])], [test(">", var("b"), value(Literal("9900", XSD + "integer")))])
    spec = QuerySpec(["n"], [A.Triple(n, Iri("urn:c:nation/n_name"), Variable("x"))], optional=[customer], filters=[test("not", call("BOUND", var("c"))), call("CONTAINS", var("x"), value(Literal("A")))])
    return engine(spark, sf).query(spec, {"n": "str"})


# -- paths
@query("path_chain", "SELECT 'urn:t:nation/' || a.n_nationkey AS a, 'urn:t:nation/' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    iri = lambda k: F.concat(F.lit("urn:t:nation/"), k)
    q = facts(n, iri(F.col("n_nationkey")), "urn:next", iri(F.col("n_nationkey") + 1), kind="iri").filter("o != 'urn:t:nation/25'")
    return over(spark, q).sparql("SELECT ?a ?b WHERE { ?a <urn:next>+ ?b }", {"a": "str", "b": "str"})


sparql("path_search_text", "SELECT ?path ?n WHERE { [] <urn:search:from> <urn:t:region/1> ; <urn:search:via> r:n_regionkey , r:s_nationkey ; <urn:search:direction> 'both' ; <urn:search:depth> 2 ; <urn:search:nodes> ?path ; <urn:search:length> ?n }", "path:str n:int",
       """SELECT 'urn:t:region/1 urn:t:nation/' || n_nationkey AS path, 1::BIGINT AS n FROM nation WHERE n_regionkey = 1
  UNION ALL SELECT 'urn:t:region/1 urn:t:nation/' || n_nationkey || ' urn:t:supplier/' || s_suppkey, 2 FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1""")

# -- updates
_ORDERS = "SELECT 'urn:g:orders' AS g, 'urn:t:orders/' || o_orderkey AS s, x.p AS p, x.o AS o FROM (SELECT o_orderkey, unnest([{'p': 'urn:c:orders/o_orderstatus', 'o': o_orderstatus}, {'p': 'urn:c:orders/o_orderpriority', 'o': o_orderpriority}]) AS x FROM orders)"
updating("upd_add", "ADD g:nation TO g:other", f"{_NATION} UNION ALL SELECT 'urn:g:other', s, p, o FROM ({_NATION})")
updating("upd_create", "CREATE GRAPH g:new", _NATION)
updating("upd_drop", "DROP GRAPH g:nation", f"SELECT * FROM ({_NATION}) WHERE false")
updating("upd_using", "DELETE { GRAPH g:nation { ?s nation:n_name ?n } } INSERT { GRAPH g:new { ?s <urn:was> ?n } } USING g:nation WHERE { ?s nation:n_name ?n FILTER(STRSTARTS(?n, 'I')) }",
         f"SELECT * FROM ({_NATION}) WHERE NOT (p = 'urn:c:nation/n_name' AND starts_with(o, 'I')) UNION ALL SELECT 'urn:g:new', 'urn:t:nation/' || n_nationkey, 'urn:was', n_name FROM nation WHERE starts_with(n_name, 'I')")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return quads(spark, sf, "orders").filter(F.col("p").isin("urn:c:orders/o_orderstatus", "urn:c:orders/o_orderpriority"))


@query("upd_modify_orders", f"SELECT g, s, p, CASE WHEN p = 'urn:c:orders/o_orderstatus' AND o = 'F' THEN 'done' ELSE o END AS o FROM ({_ORDERS})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return update.update(spark, _orders(spark, sf), PREFIXES + "WITH g:orders DELETE { ?o orders:o_orderstatus 'F' } INSERT { ?o orders:o_orderstatus 'done' } WHERE { ?o orders:o_orderstatus 'F' }").select("g", "s", "p", "o")


@query("upd_sources", f"SELECT CASE WHEN g = 'urn:g:nation' THEN 'urn:f:new' ELSE g END AS source, count(*) AS n FROM ({_NATION} UNION ALL {_ORDERS}) WHERE g <> 'urn:g:orders' OR p <> 'urn:c:orders/o_orderstatus' GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    q = _orders(spark, sf).withColumn("source", F.when(F.col("p") == "urn:c:orders/o_orderstatus", "urn:f:gone").otherwise(F.col("source"))).union(quads(spark, sf, "nation"))
    return update.move_source(update.delete_source(q, "urn:f:gone"), "urn:g:nation", "urn:f:new").groupBy("source").agg(F.count("*").alias("n"))


@query("upd_delta", "SELECT op, count(*) AS n FROM (SELECT 'delete' AS op FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'insert' FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from quadweave.plans.parser import parse_update

    u = parse_update(PREFIXES + "WITH g:orders DELETE { ?o orders:o_orderstatus ?x } INSERT { ?o <urn:p> ?x } WHERE { ?o orders:o_orderstatus ?x FILTER(?x = 'P') }")[0]
    return update.delta_of(spark, _orders(spark, sf), u).groupBy("op").agg(F.count("*").alias("n"))


# -- documents in and out
_TRIPLES = "SELECT 'urn:t:nation/' || n_nationkey AS s, n_name AS name, n_regionkey AS r FROM nation"


@query("sink_statements", f"SELECT '<' || s || '> <urn:c:nation/n_name> \"' || name || '\" <urn:g:nation> .' AS value FROM ({_TRIPLES}) UNION ALL SELECT '<' || s || '> <urn:r:n_regionkey> <urn:t:region/' || r || '> <urn:g:nation> .' FROM ({_TRIPLES})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rdf_io.statements(quads(spark, sf, "nation").filter("p in ('urn:c:nation/n_name', 'urn:r:n_regionkey')"))


@query("sink_rdf_xml", f"SELECT '<rdf:Description rdf:about=\"' || s || '\"><x:n_name xmlns:x=\"urn:c:nation/\">' || name || '</x:n_name></rdf:Description>' AS value FROM ({_TRIPLES})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rdf_io.rdf_xml(quads(spark, sf, "nation").filter("p = 'urn:c:nation/n_name'").drop("g"))


@query("sink_json", "SELECT '{\"n\":{\"type\":\"uri\",\"value\":\"urn:t:nation/' || n_nationkey || '\"},\"x\":{\"type\":\"literal\",\"value\":\"' || n_name || '\"}}' AS binding FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rdf_io.json_bindings(engine(spark, sf).solutions(PREFIXES + "SELECT ?n ?x WHERE { ?n nation:n_name ?x }"))


@query("source_turtle", "SELECT 'urn:doc/' || n_nationkey AS g, 'urn:n' || n_nationkey AS s, x.p AS p, x.o AS o, x.d AS od FROM (SELECT n_nationkey, unnest([{'p': 'urn:name', 'o': n_name, 'd': NULL}, {'p': 'urn:key', 'o': n_nationkey::VARCHAR, 'd': 'http://www.w3.org/2001/XMLSchema#integer'}, {'p': 'urn:in', 'o': 'urn:r' || n_regionkey, 'd': NULL}]) AS x FROM nation)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    docs = n.select(F.concat(F.lit("urn:doc/"), F.col("n_nationkey")).alias("source"), F.format_string('@prefix : <urn:> .\n:n%d :name "%s" ; :key %d ;\n  :in :r%d .', "n_nationkey", "n_name", "n_nationkey", "n_regionkey").alias("text"))
    return rdf_io.read_documents(docs).select("g", "s", "p", "o", "od")


# -- stored quads
def _stored(spark: SparkSession, sf: str, *tables: str) -> StoredDataset:
    layout = storage.Layout(spark, f"{str(storage.folder(spark)).rstrip('/')}/quadweave/layout-{uuid.uuid4().hex}")
    layout.load(quads(spark, sf, *tables))
    return StoredDataset(quads=layout.quads(), graphs="union")


@query("layout_scan", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_orderstatus AS s, n_name AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'O'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(spark, _stored(spark, sf, "orders", "customer", "nation"))
    return e.sparql(PREFIXES + "SELECT ?o ?s ?n WHERE { ?o orders:o_orderstatus ?s ; r:o_custkey ?c . ?c r:c_nationkey ?k . ?k nation:n_name ?n FILTER(?s != 'O') }", {"o": "str", "s": "str", "n": "str"})


@query("layout_statistics", "SELECT (8 * (SELECT count(*) FROM orders) + 5 * (SELECT count(*) FROM nation))::BIGINT AS quads, true AS stored")
def _(spark: SparkSession, sf: str) -> DataFrame:
    layout = storage.Layout(spark, f"{str(storage.folder(spark)).rstrip('/')}/quadweave/layout-{uuid.uuid4().hex}")
    q = quads(spark, sf, "orders", "nation")
    layout.load(q.union(q.filter("g = 'urn:g:nation'").withColumn("source", F.lit("urn:other"))))
    return layout.statistics().agg(F.sum("quads").alias("quads"), ((F.sum("bytes") > 0) & (F.sum("files") > 0)).alias("stored"))


@query("stat_all_predicates", "SELECT 'urn:c:nation/' || c AS p, (SELECT count(*) FROM nation) AS quads, n AS objects FROM (SELECT 'n_nationkey' AS c, count(DISTINCT n_nationkey) AS n FROM nation UNION ALL SELECT 'n_name', count(DISTINCT n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(DISTINCT n_regionkey) FROM nation) UNION ALL SELECT 'urn:r:n_regionkey', count(*), count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*), 1 FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distribution(quads(spark, sf, "nation"), ["p"]).select("p", "quads", "objects")


@query("stat_all_classes", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'urn:t:{t.name}' AS term, count(*) AS n FROM {t.name}" for t in TABLES) + ") WHERE n > 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.explore(quads(spark, sf), "classes")


@query("stat_refresh", "SELECT 'urn:g:' || t AS g, p, n FROM (SELECT 'nation' AS t, 'urn:c:nation/n_name' AS p, count(*) AS n FROM nation UNION ALL SELECT 'region', 'urn:c:region/r_name', count(*) FROM region UNION ALL SELECT 'orders', 'urn:c:orders/o_orderstatus', count(*) FROM orders WHERE o_orderstatus = 'F')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    q = quads(spark, sf, "nation", "region", "orders").filter(F.col("p").isin("urn:c:nation/n_name", "urn:c:region/r_name", "urn:c:orders/o_orderstatus"))
    kept = stats.projection(q, ["g", "p"])
    left = q.filter("p != 'urn:c:orders/o_orderstatus' or o = 'F'")
    return stats.refreshed(kept, left, ["g", "p"], spark.createDataFrame([("urn:g:orders",)], "g string")).select("g", "p", F.col("quads").alias("n"))


@query("rows_differ", "SELECT 'less' AS side, 'urn:t:nation/' || n_nationkey AS s FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'more', 'urn:t:nation/' || n_nationkey FROM nation WHERE n_nationkey > 20")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey")
    less, more = stats.same_rows(n.filter("n_nationkey <= 20"), n.filter("n_nationkey >= 3"))
    iri = F.concat(F.lit("urn:t:nation/"), F.col("n_nationkey")).alias("s")
    return less.select(F.lit("less").alias("side"), iri).union(more.select(F.lit("more").alias("side"), iri))


@query("view_read", "SELECT 'urn:t:region/' || r_regionkey AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, f"{str(storage.folder(spark)).rstrip('/')}/quadweave/views-{uuid.uuid4().hex}")
    views.build("per_region", "1", engine(spark, sf).sparql(PREFIXES + "SELECT ?r (COUNT(?n) AS ?n) WHERE { ?n r:n_regionkey ?r } GROUP BY ?r", {"r": "str", "n": "int"}))
    views.activate("per_region", "1")
    return views.read("per_region")
