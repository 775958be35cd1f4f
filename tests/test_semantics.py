"""Term identity and value equality, errors, ordering, algebra, scopes, updates, documents and feeds on small quads."""

import json

import pytest
from pyspark.sql import functions as F

from quadweave.engine import Engine
from quadweave.errors import DisabledFeature, SparqlSyntaxError, UnsupportedQuery
from quadweave.operators import paths, search, update
from quadweave.plans.parser import parse_query
from quadweave.sources import rdf_io
from quadweave.sources.datasets import QUADS, QuadDataset, Scope
from quadweave.streaming import changes
from quadweave.terms import XSD
from quadweave.views import Views

P = "PREFIX : <urn:> "


def store(spark, text, **options):
    docs = spark.createDataFrame([("", "PREFIX : <urn:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> " + text)], "source string, text string")
    return Engine(spark, QuadDataset(quads=rdf_io.read_documents(docs), **options))


def rows(e, q, types=None, **k):
    return [tuple(r) for r in e.sparql(P + q, types, **k).collect()]


def test_equal_values_of_unlike_terms(spark):
    e = store(spark, ':crate :kg "+12"^^xsd:int . :sack :kg 12 . :tub :kg "12.00"^^xsd:decimal . :jar :kg "12"^^xsd:string . :bag :kg 120e-1 .')
    heavy = sorted(rows(e, "SELECT ?w WHERE { ?w :kg ?k FILTER(?k = 12.0) }", {"w": "str"}))
    assert heavy == [("urn:bag",), ("urn:crate",), ("urn:sack",), ("urn:tub",)]  # the jar's is a string
    assert rows(e, "SELECT ?w WHERE { ?w :kg 12 }", {"w": "str"}) == [("urn:sack",)]
    assert rows(e, "SELECT (COUNT(DISTINCT ?k) AS ?n) WHERE { ?w :kg ?k }", {"n": "int"}) == [(5,)]
    assert rows(e, "SELECT ?a ?b WHERE { ?a :kg ?x . ?b :kg ?x FILTER(?a != ?b) }") == []
    assert sorted(rows(e, "SELECT ?w WHERE { ?w :kg ?k FILTER(!sameTerm(?k, 12) && ?k >= 12) }", {"w": "str"})) == [("urn:bag",), ("urn:crate",), ("urn:tub",)]


def test_integers_with_all_their_digits(spark):
    n = 10**17
    e = store(spark, f":a :id {n + 1} . :b :id {n + 2} . :c :id {n + 3} . :d :id {-n - 7} .")
    assert rows(e, f"SELECT ?s WHERE {{ ?s :id ?i FILTER(?i > {n + 1} && ?i < {n + 3}) }}", {"s": "str"}) == [("urn:b",)]
    assert rows(e, "SELECT (SUM(?i) AS ?t) WHERE { ?s :id ?i }", {"t": "str"}) == [(str(2 * n - 1),)]
    assert sorted(rows(e, "SELECT ?y WHERE { ?s :id ?i BIND(-1 * ?i - 1 AS ?y) FILTER(?i > 0) }", {"y": "str"})) == [(str(-n - k),) for k in (2, 3, 4)]
    assert rows(e, f"SELECT ?s WHERE {{ ?s :id ?i FILTER(?i IN ({n}, {n + 3})) }}", {"s": "str"}) == [("urn:c",)]


def test_truth_of_values_and_errors_as_unbound(spark):
    e = store(spark, ':door :open false ; :count 0 ; :name "hall" ; :note "" ; :width 0.9 ; :lock true ; :since "2020-02-29T00:00:00Z"^^xsd:dateTime .')
    assert sorted(rows(e, "SELECT ?p WHERE { :door ?p ?v FILTER(?v) }", {"p": "str"})) == [("urn:lock",), ("urn:name",), ("urn:width",)]
    assert sorted(rows(e, "SELECT ?p WHERE { :door ?p ?v FILTER(!?v) }", {"p": "str"})) == [("urn:count",), ("urn:note",), ("urn:open",)]  # an instant has none
    assert rows(e, "SELECT ?n ?t WHERE { :door :name ?n ; :width ?w BIND(?n * ?w AS ?t) }", {"n": "str", "t": "double"}) == [("hall", None)]
    assert rows(e, "SELECT ?n WHERE { :door :name ?n FILTER(?n > 3 || ?n = 'hall') }", {"n": "str"}) == [("hall",)]
    assert rows(e, "SELECT ?n WHERE { :door :name ?n FILTER(?n > 3 && ?n = 'hall') }") == []
    assert rows(e, "SELECT ?x WHERE { :door :width ?w BIND(?w * 10 + 1 AS ?x) }", {"x": "double"}) == [(10.0,)]


def test_order_of_numbers_and_times(spark):
    e = store(spark, ':m :reading "NaN"^^xsd:float , "-INF"^^xsd:float , 40 , -2.5 , "INF"^^xsd:double . :log :at "2021-06-30T23:30:00-02:00"^^xsd:dateTime , "2021-07-01T01:00:00Z"^^xsd:dateTime .')
    assert [r[0] for r in rows(e, "SELECT ?x WHERE { :m :reading ?x } ORDER BY DESC(?x)", {"x": "str"})] == ["NaN", "INF", "40", "-2.5", "-INF"]
    assert [r[0][:13] for r in rows(e, "SELECT ?t WHERE { :log :at ?t } ORDER BY ?t", {"t": "str"})] == ["2021-07-01T01", "2021-06-30T23"]
    assert len(rows(e, 'SELECT ?t WHERE { :log :at ?t FILTER(?t >= "2021-07-01T01:30:00Z"^^xsd:dateTime) }')) == 1
    assert len(rows(e, "SELECT ?x WHERE { :m :reading ?x FILTER(?x < 100) }")) == 3


def test_language_ranges(spark):
    e = store(spark, ':sign :says "Ausgang"@de , "Usgang"@de-CH-1901 , "sortie"@FR , "EXIT" .')
    assert sorted(rows(e, 'SELECT ?x WHERE { :sign :says ?x FILTER(LANGMATCHES(LANG(?x), "de")) }', {"x": "str"})) == [("Ausgang",), ("Usgang",)]
    assert rows(e, 'SELECT ?x WHERE { :sign :says ?x FILTER(LANGMATCHES(LANG(?x), "de-ch")) }', {"x": "term"}) == [('"Usgang"@de-ch-1901',)]
    assert rows(e, 'SELECT ?x WHERE { :sign :says ?x FILTER(LANG(?x) = "") }', {"x": "str"}) == [("EXIT",)]
    assert rows(e, 'SELECT ?y WHERE { :sign :says ?x BIND(STRBEFORE(?x, "t") AS ?y) FILTER(LANG(?x) = "fr") }', {"y": "term"}) == [('"sor"@fr',)]


def test_groups_joins_and_unbound_variables(spark):
    e = store(spark, ":ann :plays :chess , :go ; :rank 3 . :bo :plays :go . :cy :plays :poker ; :rank 1 ; :left true . :chess :seats 2 . :go :seats 2 .")
    q = "SELECT ?who ?game ?r WHERE { ?who :plays ?game OPTIONAL { ?who :rank ?r } MINUS { ?who :left ?any } FILTER NOT EXISTS { ?game :seats 3 } } ORDER BY ?who ?game"
    assert rows(e, q, {"who": "str", "game": "str", "r": "int"}) == [("urn:ann", "urn:chess", 3), ("urn:ann", "urn:go", 3), ("urn:bo", "urn:go", None)]
    # A variable that OPTIONAL leaves unbound joins with every value, and one that it binds with its own.
    q = "SELECT ?who ?r WHERE { ?who :plays :go OPTIONAL { ?who :rank ?r } VALUES ?r { 1 3 } }"
    assert sorted(rows(e, q, {"who": "str", "r": "int"})) == [("urn:ann", 3), ("urn:bo", 1), ("urn:bo", 3)]
    q = "SELECT ?who ?r ?s WHERE { ?who :plays ?g OPTIONAL { ?who :rank ?r } OPTIONAL { ?g :seats ?s } VALUES (?r ?s) { (UNDEF 2) (1 UNDEF) (5 5) } }"
    got = sorted(rows(e, q, {"who": "str", "r": "int", "s": "int"}), key=str)
    assert got == sorted([("urn:ann", 3, 2), ("urn:ann", 3, 2), ("urn:bo", None, 2), ("urn:bo", 1, 2), ("urn:cy", 1, None), ("urn:cy", 1, 2)], key=str)
    q = "SELECT ?who WHERE { ?who :plays ?g FILTER(?g = :poker || EXISTS { ?who :rank ?r FILTER(?r > 2) }) }"
    assert sorted(rows(e, q, {"who": "str"})) == [("urn:ann",), ("urn:ann",), ("urn:cy",)]


def test_no_nested_loops_for_unbound_variables(spark):
    e = store(spark, ":a :k 1 ; :v 5 . :b :k 2 .")
    for q in ("SELECT * WHERE { ?x :k ?k ; :v ?v . VALUES (?k ?v) { (1 UNDEF) (UNDEF 5) } }", "SELECT * WHERE { ?x :k ?k OPTIONAL { ?x :v ?v } ?y :v ?v ; :k ?k }"):
        df = e.sparql(P + q)
        df.collect()
        assert "BroadcastNestedLoopJoin" not in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_triples_of_several_graphs_and_sources(spark):
    q = spark.createDataFrame([(g, "iri", "urn:s", "urn:p", "literal", v, None, None, f, None) for g, v, f in (("urn:1", "x", "urn:f"), ("urn:1", "x", "urn:h"), ("urn:2", "x", "urn:f"), ("urn:2", "y", None))], QUADS)
    e = Engine(spark, QuadDataset(quads=q))
    t = {"n": "int"}
    assert rows(e, "SELECT (COUNT(*) AS ?n) FROM :1 FROM :2 WHERE { ?s ?p ?o }", t) == [(2,)]
    assert rows(e, "SELECT (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } }", t) == [(3,)]
    assert rows(e, "SELECT (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } }", t, scope=Scope(denied_sources=("urn:f",))) == [(2,)]


def test_searches_in_text(spark):
    e = store(spark, ":d1 :by :ann . :d2 :by :bo . :d3 :by :ann .")
    with pytest.raises(UnsupportedQuery):
        rows(e, "SELECT ?d WHERE { [] <urn:search:text> 'cat' ; <urn:search:source> ?d }")
    e.text = spark.createDataFrame([(f"urn:d{i}", 0, t) for i, t in ((1, "a cat and a cat"), (2, "one cat"), (3, "no dog"))], "source string, ordinal int, content string")
    q = "SELECT ?d ?n WHERE { [] <urn:search:text> 'CAT' ; <urn:search:source> ?d ; <urn:search:score> ?n . ?d :by :ann }"
    assert rows(e, q, {"d": "str", "n": "int"}) == [("urn:d1", 2)]
    for bad in ("?x <urn:search:text> 'cat' . ?x :by ?y", "[] <urn:search:source> ?d", "[] <urn:search:text> 'a' ; <urn:search:vector> '1'", "[] <urn:search:text> 'a' ; <urn:search:odd> 1"):
        with pytest.raises(UnsupportedQuery):
            rows(e, f"SELECT * WHERE {{ {bad} }}")


def test_aggregates_and_pages(spark):
    e = store(spark, ":a :g 'x' ; :s 1 . :b :g 'x' ; :s 2 . :c :g 'y' ; :s 4 . :d :g 'z' ; :s 8 .")
    q = "SELECT ?g (SUM(?s) AS ?t) (COUNT(*) AS ?n) WHERE { ?x :g ?g ; :s ?s } GROUP BY ?g ORDER BY DESC(?t) LIMIT 2 OFFSET 1"
    assert rows(e, q, {"g": "str", "t": "int", "n": "int"}) == [("y", 4, 1), ("x", 3, 2)]
    with pytest.raises(UnsupportedQuery):
        rows(e, "SELECT ?x (COUNT(*) AS ?n) WHERE { ?x :g ?g } GROUP BY ?g")


def test_graphs_and_scopes(spark):
    q = spark.createDataFrame([(g, "iri", "urn:s", "urn:p", "literal", v, None, None, src, None) for g, v, src in (("", "d", None), ("urn:g1", "1", "urn:f1"), ("urn:g2", "2", "urn:f2"))], QUADS)
    e = Engine(spark, QuadDataset(quads=q))
    t = {"x": "str", "g": "str"}
    assert rows(e, "SELECT ?x WHERE { ?s ?p ?x }", t) == [("d",)]
    assert sorted(rows(e, "SELECT ?x ?g WHERE { GRAPH ?g { ?s ?p ?x } }", t)) == [("1", "urn:g1"), ("2", "urn:g2")]
    assert rows(e, "SELECT ?x FROM :g1 WHERE { ?s ?p ?x }", t) == [("1",)]
    assert rows(e, "SELECT ?x FROM NAMED :g1 WHERE { ?s ?p ?x }", t) == []
    assert rows(e, "SELECT ?x WHERE { GRAPH ?g { ?s ?p ?x } }", t, scope=Scope(denied_graphs=("urn:g1",))) == [("2",)]
    assert rows(e, "SELECT ?x WHERE { GRAPH ?g { ?s ?p ?x } }", t, scope=Scope(allowed_sources=())) == []
    assert sorted(rows(e, "SELECT ?x WHERE { { ?s ?p ?x } UNION { GRAPH ?g { ?s ?p ?x } } }", t, scope=Scope(denied_sources=("urn:f1",)))) == [("2",), ("d",)]


def test_paths(spark):
    e = store(spark, ":a :p :b . :b :p :c . :c :p :a . :c :q :d .")
    t = {"x": "str", "y": "str"}
    assert sorted(rows(e, "SELECT ?x WHERE { :a :p+ ?x }", t)) == [("urn:a",), ("urn:b",), ("urn:c",)]
    assert sorted(rows(e, "SELECT ?x WHERE { :a (:p|:q)* ?x }", t)) == [("urn:a",), ("urn:b",), ("urn:c",), ("urn:d",)]
    assert rows(e, "SELECT ?x WHERE { :nothing :p* ?x }", t) == [("urn:nothing",)]
    assert rows(e, "SELECT ?x WHERE { :a :p/:p/^:p ?x }", t) == [("urn:b",)]
    assert rows(e, "SELECT ?x ?y WHERE { ?x !(:p|^:q) ?y }", t) != []
    found, more = paths.search_paths(e.dataset.quads, "urn:a", depth=8, most=2)
    assert [r.length for r in found.collect()] == [1, 2] and more
    assert [r.nodes for r in paths.search_paths(e.dataset.quads, "urn:a", "urn:d")[0].collect()] == [["urn:a", "urn:b", "urn:c", "urn:d"]]


def test_path_search_returns_all_paths(spark):
    e = store(spark, " ".join(f":hub :p :n{i} ." for i in range(600)))
    q = "SELECT ?n WHERE { [] <urn:search:from> :hub ; <urn:search:depth> 1%s ; <urn:search:nodes> ?n }"
    assert sorted(rows(e, q % "", {"n": "str"})) == sorted((f"urn:hub urn:n{i}",) for i in range(600))
    assert [len(rows(e, q % f" ; <urn:search:limit> {n}", {"n": "str"})) for n in (2, 550)] == [2, 550]
    found, more = paths.search_paths(e.dataset.quads, "urn:hub", most=None)
    assert found.count() == 600 and not more


def test_long_paths(spark, monkeypatch):
    monkeypatch.setattr(paths, "LINEAR", 2)  # later rounds double
    monkeypatch.setattr(paths, "MERGED", 3)
    e = store(spark, " ".join(f":n{i} :p :n{i + 1} ." for i in range(19)))
    t = {"x": "str", "y": "str"}
    want = sorted((f"urn:n{i}", f"urn:n{j}") for i in range(20) for j in range(i + 1, 20))
    assert sorted(rows(e, "SELECT ?x ?y WHERE { ?x :p+ ?y }", t)) == want
    assert len(rows(e, "SELECT ?x WHERE { :n0 :p* ?x }", t)) == len(rows(e, "SELECT ?x WHERE { ?x :p* :n19 }", t)) == 20


def test_forms(spark):
    e = store(spark, ":a :p 'x' , 'y' .")
    assert e.ask(P + "ASK { :a :p 'x' }") and not e.ask(P + "ASK { :b ?p ?o }")
    assert e.sparql(P + "CONSTRUCT { ?s :q [ :r ?o ] } WHERE { ?s :p ?o }").count() == 4
    assert e.sparql(P + "DESCRIBE ?s WHERE { ?s :p 'x' }").count() == 2
    assert e.sparql("DESCRIBE <urn:none>").count() == 0
    doc = json.loads(rdf_io.json_results(e.solutions(P + "SELECT ?o ?z WHERE { :a :p ?o } ORDER BY ?o")))
    assert doc["head"]["vars"] == ["o", "z"] and doc["results"]["bindings"][0] == {"o": {"type": "literal", "value": "x"}}
    lines = [r[0] for r in rdf_io.statements(e.sparql("DESCRIBE <urn:a>")).collect()]
    assert sorted(lines) == ['<urn:a> <urn:p> "x" .', '<urn:a> <urn:p> "y" .']
    assert "rdf:about=\"urn:a\"" in rdf_io.rdf_xml(e.sparql("DESCRIBE <urn:a>")).first()[0]


def test_refusals():
    with pytest.raises(DisabledFeature):
        parse_query("SELECT * WHERE { SERVICE <http://x> { ?s ?p ?o } }")
    for bad in ("SELECT WHERE {}", "SELECT ?x { ?x ", "FOO", "SELECT ?x WHERE { ?x nope:y ?z }"):
        with pytest.raises(SparqlSyntaxError):
            parse_query(bad)


def test_updates(spark):
    q = spark.createDataFrame([], QUADS)
    q = update.update(spark, q, P + "INSERT DATA { :a :p 1 , 2 . GRAPH :g { :a :p 3 } }")
    q = update.update(spark, q, P + "INSERT DATA { :a :p 1 }")
    assert q.count() == 3
    q = update.update(spark, q, P + "DELETE { ?s :p ?o } INSERT { GRAPH :h { ?s :q ?o } } WHERE { ?s :p ?o FILTER(?o > 1) }")
    assert sorted((r.g, r.p, r.o) for r in q.collect()) == [("", "urn:p", "1"), ("urn:g", "urn:p", "3"), ("urn:h", "urn:q", "2")]
    assert update.update(spark, q, P + "CLEAR NAMED").count() == 1
    with pytest.raises(UnsupportedQuery):
        update.update(spark, q, P + "CLEAR ALL ; INSERT DATA { :a :b :c }")
    renamed, skipped = update.rewrite_terms(q, "urn:g", "urn:z")
    assert renamed.filter("g = 'urn:z'").count() == 1 and skipped.count() == 0


def test_documents(spark, tmp_path):
    (tmp_path / "a.nq").write_text('<urn:a> <urn:p> "x\\"y"@EN <urn:g> .\n_:b <urn:p> "5"^^<' + XSD + 'integer> .\n# note\n<urn:a> <urn:p> "x\\"y"@EN <urn:g> .\n')
    got = {(r.g, r.sk, r.s, r.o, r.od, r.ol) for r in rdf_io.read_nquads(spark, f"file://{tmp_path}/a.nq").collect()}
    assert got == {("urn:g", "iri", "urn:a", 'x"y', None, "en"), ("", "blank", "b", "5", XSD + "integer", None)}
    quads = list(rdf_io.parse_turtle("@prefix : <urn:> .\n:a a :T ; :p [ :q (1 2) ] .\n"))
    assert len(quads) == 7
    assert set(rdf_io.parse_jsonld('{"@context": {"v": "urn:v#"}, "@id": "urn:a", "@type": "v:T", "v:n": 1, "v:o": {"@id": "urn:b"}}')) == {
        ("", "iri", "urn:a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "iri", "urn:v#T", None, None),
        ("", "iri", "urn:a", "urn:v#n", "literal", "1", XSD + "integer", None),
        ("", "iri", "urn:a", "urn:v#o", "iri", "urn:b", None, None),
    }


def test_rdf_xml_and_files(spark, tmp_path):
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    text = f'''<?xml version="1.0"?><rdf:RDF xmlns:rdf="{rdf}" xmlns="urn:v#" xmlns:v="urn:v#" xml:base="http://e/d" xml:lang="EN">
      <T rdf:about="a" v:note="n"><name>x &amp; y</name><size rdf:datatype="{XSD}integer">5</size><to rdf:resource="#b"/>
        <in rdf:parseType="Resource"><deep xml:lang="">z</deep></in><list rdf:parseType="Collection"><T rdf:nodeID="k"/></list></T>
      <rdf:Seq rdf:ID="s"><rdf:li>1</rdf:li><rdf:li rdf:ID="r">2</rdf:li></rdf:Seq><rdf:Description rdf:nodeID="k"><raw rdf:parseType="Literal">q</raw></rdf:Description>
    </rdf:RDF>'''
    got = {q[1:] for q in rdf_io.parse_rdf_xml(text)}
    a, s, r = ("iri", "http://e/a"), ("iri", "http://e/d#s"), ("iri", "http://e/d#r")
    assert got == {
        (*a, rdf + "type", "iri", "urn:v#T", None, None), (*a, "urn:v#note", "literal", "n", None, "en"), (*a, "urn:v#name", "literal", "x & y", None, "en"),
        (*a, "urn:v#size", "literal", "5", XSD + "integer", None), (*a, "urn:v#to", "iri", "http://e/d#b", None, None),
        (*a, "urn:v#in", "blank", "x1", None, None), ("blank", "x1", "urn:v#deep", "literal", "z", None, None),
        ("blank", "k", rdf + "type", "iri", "urn:v#T", None, None), ("blank", "x2", rdf + "first", "blank", "k", None, None),
        ("blank", "x2", rdf + "rest", "iri", rdf + "nil", None, None), (*a, "urn:v#list", "blank", "x2", None, None),
        (*s, rdf + "type", "iri", rdf + "Seq", None, None), (*s, rdf + "_1", "literal", "1", None, "en"), (*s, rdf + "_2", "literal", "2", None, "en"),
        (*r, rdf + "type", "iri", rdf + "Statement", None, None), (*r, rdf + "subject", *s, None, None),
        (*r, rdf + "predicate", "iri", rdf + "_2", None, None), (*r, rdf + "object", "literal", "2", None, "en"),
        ("blank", "k", "urn:v#raw", "literal", "q", rdf + "XMLLiteral", None),
    }
    assert list(rdf_io.parse_rdf_xml(" ")) == []
    for name in ("one", "two"):
        (tmp_path / f"{name}.rdf").write_text(text)
        (tmp_path / f"{name}.ttl").write_text("<urn:a> <urn:p> [ <urn:q> 1 ] .")
    assert rdf_io.read_files(spark, f"file://{tmp_path}/*.rdf").count() == 2 * len(got)
    turtle = rdf_io.read_files(spark, f"file://{tmp_path}/*.ttl")
    assert turtle.filter("sk = 'blank'").select("s").distinct().count() == 2  # a label holds within its document
    written = rdf_io.rdf_xml(turtle.drop("g")).collect()
    back = [q for (x,) in written for q in rdf_io.parse_rdf_xml(x.replace("<rdf:Description", f'<rdf:Description xmlns:rdf="{rdf}"', 1))]
    assert {q[1:] for q in back} == {(r.sk, r.s, r.p, r.ok, r.o, r.od, r.ol) for r in turtle.collect()}
    with pytest.raises(UnsupportedQuery):
        rdf_io.read_files(spark, "x.csv")


def test_text(spark):
    df = spark.createDataFrame([("a", "One two.\n\nThree one.", "One"), ("b", "first\nsecond", "x"), ("c", None, None)], "source string, content string, heading string")
    got = [tuple(r) for r in search.chunk_plain(df, "source", "content").select("source", "ordinal", "content", "start_offset").orderBy("source", "ordinal").collect()]
    assert got == [("a", 0, "One two.", 0), ("a", 1, "Three one.", 10), ("b", 0, "first", 0), ("b", 1, "second", 6)]
    chunks = df.withColumn("ordinal", df.source.isNull().cast("int"))
    assert [tuple(r) for r in search.text_search(chunks, "ONE").select("source", "score").collect()] == [("a", 102)]
    toks = spark.createDataFrame([("漢字文 ab-1 語",)], "t string").select(search.tokens(search.normalized(F.col("t")))).first()[0]
    assert toks == ["漢字", "字文", "ab", "1", "語"]
    md = spark.createDataFrame([("s", "intro\n# A\ntext\n```\n# no\n```\n## B\nmore")], "source string, text string")
    assert [(r.level, r.heading, r.path) for r in search.chunk_headings(md, "source", "text").collect()] == [(0, None, []), (1, "A", ["A"]), (2, "B", ["A", "B"])]


def test_feed_and_views(spark, tmp_path):
    log = tmp_path / "log"
    spark.createDataFrame([(1, "a", "update", 1), (1, "b", "update", 2), (2, "c", "update", 3)], "k int, v string, op string, n int").write.parquet(f"{log}")

    def run():
        stream = spark.readStream.schema("k int, v string, op string, n int").parquet(f"{log}")
        changes.sync(stream, f"{tmp_path}/state", f"{tmp_path}/cp", ["k"], ["n"], [F.col("k"), F.col("v")])
        return sorted(map(tuple, changes.state(spark, f"{tmp_path}/state").collect()))

    assert run() == [(1, "b"), (2, "c")]
    spark.createDataFrame([(2, "c", "delete", 4), (3, "d", "update", 5)], "k int, v string, op string, n int").write.mode("append").parquet(f"{log}")
    assert run() == [(1, "b"), (3, "d")]
    views = Views(spark, f"file://{tmp_path}/views")
    assert views.build("v", "1", spark.range(5)) == 5
    views.activate("v", "1")
    assert views.read("v").count() == 5
    with pytest.raises(ValueError, match="more than 3"):
        views.build("v", "2", spark.range(5), 3)
    assert views.delete("v")
