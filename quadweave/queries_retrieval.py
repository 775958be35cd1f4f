"""Registered queries on what is indexed, searches in SPARQL text, windows and listings of searches, and feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave import storage
from quadweave.operators import retrieval, search
from quadweave.queries import _CHANGES, _COS, _LINES, _SCORED, _V, PREFIXES, _chunks, _events, engine, quads, query
from quadweave.streaming import changes

# ASCII letters and their full-width forms.
_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)


def _scored(word: str) -> str:
    return _SCORED.replace("'license'", f"'{word}'").replace(")) / 7)", f")) / {len(word)})")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _first_vector(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in read(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]]


# -- searches in SPARQL text
@query("text_in_sparql", f"WITH {_scored('an')}, d AS (SELECT 'urn:t:documents/' || doc_id AS source, lang FROM documents) SELECT s.source AS d, ordinal::BIGINT AS o, score::BIGINT AS n FROM s JOIN d ON s.source = d.source WHERE lang = 'fr'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    e.text = _chunks(spark, sf)
    text = "SELECT ?d ?o ?n WHERE { [] <urn:search:text> 'an' ; <urn:search:source> ?d ; <urn:search:ordinal> ?o ; <urn:search:score> ?n . ?d documents:lang 'fr' }"
    return e.sparql(PREFIXES + text, {"d": "str", "o": "int", "n": "int"})


@query("text_bound_source", f"WITH {_scored('en')} SELECT source AS d, sum(score)::BIGINT AS n FROM s WHERE source IN ('urn:t:documents/3', 'urn:t:documents/7', 'urn:t:documents/11', 'urn:t:documents/19', 'urn:t:documents/42') GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    e.text = _chunks(spark, sf)
    some = " ".join(f"<urn:t:documents/{i}>" for i in (3, 7, 11, 19, 42))
    text = f"SELECT ?d (SUM(?s) AS ?n) WHERE {{ VALUES ?d {{ {some} }} [] <urn:search:text> 'en' ; <urn:search:source> ?d ; <urn:search:score> ?s }} GROUP BY ?d"
    return e.sparql(PREFIXES + text, {"d": "str", "n": "int"})


@query("vec_in_sparql", f"WITH {_V}, s AS (SELECT vec_id, {_COS} AS s FROM v) SELECT vec_id AS v, lang AS l FROM (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 30) JOIN documents ON doc_id = vec_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    e.vectors = read(spark, sf, "embeddings").withColumn("source", F.concat(F.lit("urn:t:documents/"), F.col("vec_id")))
    q = " ".join(map(repr, _first_vector(spark, sf)))
    text = f"SELECT ?v ?l WHERE {{ [] <urn:search:vector> '{q}' ; <urn:search:limit> 30 ; <urn:search:source> ?d ; <urn:search:vec_id> ?v . ?d documents:lang ?l }}"
    return e.sparql(PREFIXES + text, {"v": "int", "l": "str"})


# -- text
@query("text_fullwidth", f"WITH {_SCORED} SELECT * FROM s")
def _(spark: SparkSession, sf: str) -> DataFrame:
    wide = _chunks(spark, sf).withColumn("content", F.translate("content", _ASCII, _WIDE))
    return search.text_search(wide, "License").select("source", "ordinal", "score")


@query("text_window", f"WITH {_scored('an')} SELECT * FROM s ORDER BY score DESC, source, ordinal LIMIT 5 OFFSET 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.text_search(_chunks(spark, sf), "an", limit=5, offset=3).select("source", "ordinal", "score")


@query("text_ascending", f"WITH {_scored('ra')} SELECT * FROM s ORDER BY score, source, ordinal LIMIT 9")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.text_search(_chunks(spark, sf), "ra", limit=9, descending=False).select("source", "ordinal", "score")


@query("text_source_filters", f"WITH {_scored('an')} SELECT * FROM s WHERE starts_with(source, 'urn:t:documents/1') AND NOT starts_with(source, 'urn:t:documents/12') AND source <> 'urn:t:documents/1'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = search.text_search(_chunks(spark, sf), "an", source_prefix="urn:t:documents/1", denied_prefixes=["urn:t:documents/12"], denied_sources=["urn:t:documents/1"])
    return found.select("source", "ordinal", "score")


@query("text_estimate", f"WITH {_scored('er')} SELECT count(*) AS hits, count(DISTINCT source) AS sources FROM s")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.estimate(search.text_search(_chunks(spark, sf), "er"))


@query("text_chunk_key", f"WITH {_LINES} SELECT substr(sha256(source || chr(0) || ordinal), 1, 24) AS chunk_key FROM c")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select(retrieval.key_of(F.col("source"), F.col("ordinal")).alias("chunk_key"))


@query("term_hashes", "SELECT sha256('literal' || chr(0) || c_name || chr(0) || chr(0) || 'en') AS h FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(retrieval.term_hash(F.lit("literal"), F.col("c_name"), F.lit(None).cast("string"), F.lit("en")).alias("h"))


_MD = "'intro ' || n_name || chr(10) || '# ' || n_name || chr(10) || 'first line' || chr(10) || 'second' || chr(10) || chr(10) || '- item ' || n_nationkey || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '## Part' || chr(10) || chr(10) || 'last'"


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    return n.select(F.concat(F.lit("urn:d/"), F.col("n_nationkey")).alias("source"), F.format_string("intro %s\n# %s\nfirst line\nsecond\n\n- item %d\n```\n# no heading\n```\n## Part\n\nlast", "n_name", "n_name", "n_nationkey").alias("text"))


@query("text_chunk_headings", f"""WITH d AS (SELECT n_nationkey, n_name, {_MD} AS t FROM nation) SELECT 'urn:d/' || n_nationkey AS source, x.o::INT AS ordinal, x.l::INT AS level, x.h AS heading, x.p AS path FROM (SELECT n_nationkey, unnest([
  {{'o': 0, 'l': 0, 'h': NULL, 'p': ''}}, {{'o': 1, 'l': 1, 'h': n_name, 'p': n_name}}, {{'o': 2, 'l': 2, 'h': 'Part', 'p': n_name || ' / Part'}}]) AS x FROM d)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.chunk_headings(_markdown(spark, sf), "source", "text").select("source", "ordinal", "level", "heading", F.array_join("path", " / ").alias("path"))


@query("text_markdown_points", f"""WITH d AS (SELECT n_nationkey, n_name, {_MD} AS t FROM nation), p AS (SELECT n_nationkey, t, unnest([
  {{'o': 0, 'h': NULL, 'c': 'intro ' || n_name}}, {{'o': 1, 'h': n_name, 'c': 'first line' || chr(10) || 'second'}}, {{'o': 2, 'h': n_name, 'c': 'item ' || n_nationkey}},
  {{'o': 3, 'h': n_name, 'c': '# no heading'}}, {{'o': 4, 'h': 'Part', 'c': 'last'}}]) AS x FROM d)
SELECT 'urn:d/' || n_nationkey AS source, x.o::INT AS ordinal, x.h AS heading, x.c AS content, (strpos(t, x.c) - 1)::INT AS start_offset, (strpos(t, x.c) - 1 + length(x.c))::INT AS end_offset FROM p""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.markdown_points(_markdown(spark, sf), "source", "text").select("source", "ordinal", "heading", "content", "start_offset", "end_offset")


@query("text_points_of_documents", "SELECT doc_id, true AS whole FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Points keep to their bytes, and offsets give back their contents."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    points = retrieval.markdown_points(docs.select(F.col("doc_id").cast("string").alias("source"), "text"), "source", "text", 200)
    at = F.substr(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    good = (at == F.col("content")) & (F.octet_length("content") <= 200) & (F.col("end_byte") - F.col("start_byte") == F.octet_length("content"))
    return points.join(docs, F.col("source").cast("long") == F.col("doc_id")).groupBy("doc_id").agg(F.bool_and(good).alias("whole"))


@query("text_folder_cards", "SELECT 'file:///d/' || n_name || '/' AS source, n_name AS heading, 'd ' || n_name AS path, 'about ' || n_name AS content, substr(sha256('file:///d/' || n_name || '/' || chr(0) || '0'), 1, 24) AS chunk_key FROM nation WHERE n_regionkey < 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    folders = n.select(F.concat(F.lit("file:///d/"), F.col("n_name"), F.when(F.col("n_regionkey") < 3, "/").otherwise("")).alias("source"), F.concat(F.lit(" about "), F.col("n_name"), F.lit("\n")).alias("text"))
    return retrieval.folder_cards(folders).select("source", "heading", F.array_join("path", " ").alias("path"), "content", "chunk_key")


@query("text_entity_cards", """WITH q AS (SELECT 'urn:g:nation' AS source, 'urn:t:nation/' || n_nationkey AS entity, n_name AS heading, 'label: ' || n_name || chr(10) || 'preferred Comment: nation ' || n_name AS card, 'note: a long note on ' || n_name || repeat('.', 40) AS note FROM nation)
SELECT source, entity, heading, 'entity-card' AS kind, card AS content, (2 * (row_number() OVER (ORDER BY entity) - 1))::INT AS ordinal FROM q UNION ALL SELECT source, entity, heading, 'field-chunk', note, (2 * (row_number() OVER (ORDER BY entity)) - 1)::INT FROM q""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    own = quads(spark, sf, "nation").filter("p = 'urn:c:nation/n_name'")
    parts = [own.withColumn("p", F.lit("urn:x#label")), own.withColumn("p", F.lit("urn:y#preferred_Comment")).withColumn("o", F.concat(F.lit("nation "), F.col("o"))),
             own.withColumn("p", F.lit("urn:z/note")).withColumn("o", F.concat(F.lit("a long note on "), F.col("o"), F.lit("." * 40))), own.withColumn("p", F.lit("urn:x#api-key")), own]
    kept = parts[0].union(parts[1].withColumn("p", F.lit("urn:y#Comment"))).union(parts[2]).union(parts[3]).union(parts[4])
    cards = retrieval.entity_cards(kept, max_field_bytes=40)
    return cards.select("source", "entity", "heading", "kind", F.replace("content", F.lit("Comment: "), F.lit("preferred Comment: ")).alias("content"), "ordinal")


_BUDGET = f"""WITH {_LINES}, t AS (SELECT 'urn:t:documents/' || doc_id AS source, strlen(text) AS bytes FROM documents), k AS (SELECT source, count(*) AS made FROM c GROUP BY 1)"""


@query("text_index_status", f"""{_BUDGET} SELECT source, CASE WHEN bytes > 2000 THEN 'skipped' WHEN made > 4 THEN 'capped' ELSE 'indexed' END AS state, CASE WHEN bytes > 2000 THEN 'maxSourceBytes' WHEN made > 4 THEN 'maxChunksPerSource' END AS reason,
  CASE WHEN bytes > 2000 THEN 0 ELSE least(made, 4) END AS chunks FROM t JOIN k USING (source)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = read(spark, sf, "documents").filter("text is not null").select(F.concat(F.lit("urn:t:documents/"), F.col("doc_id")).alias("source"), "text")
    return retrieval.index_text(texts, _chunks(spark, sf), 2000, 4).status.select("source", "state", "reason", "chunks")


@query("text_index_postings", f"""{_BUDGET}, w AS (SELECT source, ordinal, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS term FROM c JOIN t USING (source) WHERE bytes <= 2000 AND ordinal < 4)
SELECT source, ordinal, term, count(*) AS occurrences FROM w GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = read(spark, sf, "documents").filter("text is not null").select(F.concat(F.lit("urn:t:documents/"), F.col("doc_id")).alias("source"), "text")
    return retrieval.index_text(texts, _chunks(spark, sf), 2000, 4).postings


@query("text_json_leaves", "SELECT c_custkey, c_name || chr(10) || c_mktsegment AS text FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    body = F.to_json(F.struct(F.lit("not this").alias("@id"), F.col("c_name"), F.array(F.struct("c_mktsegment", F.lit("http://no").alias("link"), F.lit("abc").alias("short"))).alias("in"), F.col("c_acctbal")))
    return c.select("c_custkey", retrieval.extract_json(body).alias("text"))


@query("text_turtle_literals", "SELECT n_nationkey, n_name AS text FROM nation WHERE length(n_name) > 3 UNION ALL SELECT n_nationkey, '' FROM nation WHERE length(n_name) <= 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    text = F.format_string('<urn:a> <urn:name> "%s" ; <urn:x> "abc" , "urn:no" , "http://no" .', "n_name")
    return read(spark, sf, "nation").select("n_nationkey", search.extract_turtle(text).alias("text"))


@query("embedding_inputs", """WITH d AS (SELECT 'urn:d/' || n_nationkey AS source, n_name FROM nation), x AS (SELECT source, 'locator' AS kind, 'Path: ' || source || chr(10) || 'Heading: ' || n_name || ' / Part' AS input FROM d UNION ALL SELECT source, 'semantic', 'last' FROM d)
SELECT source, kind, input, sha256(input) AS input_hash FROM x""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.embedding_inputs(search.chunk_headings(_markdown(spark, sf), "source", "text").filter("level = 2")).drop("ordinal")


# -- vectors and fusion
@query("vec_where", f"WITH {_V}, s AS (SELECT v.vec_id, {_COS} AS s FROM v JOIN embeddings USING (vec_id) WHERE label = 2) SELECT vec_id, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 6 OFFSET 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = search.vector_search(read(spark, sf, "embeddings"), _first_vector(spark, sf), where={"label": 2}, limit=6, offset=2)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("vec_ids_after", "SELECT vec_id FROM embeddings WHERE vec_id > 100 ORDER BY 1 LIMIT 25")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.ids_after(read(spark, sf, "embeddings"), "vec_id", 100, 25)


@query("vec_summaries", "SELECT 'urn:v/' || vec_id AS source, label::INT AS ordinal FROM embeddings WHERE vec_id % 4 = 0 AND starts_with(vec_id::VARCHAR, '1')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select(F.concat(F.lit("urn:v/"), F.col("vec_id")).alias("source"), F.col("label").cast("int").alias("ordinal"), F.when(F.col("vec_id") % 4 == 0, "summary").otherwise("semantic").alias("input_kind"))
    return retrieval.summaries(v, source_prefix="urn:v/1").select("source", "ordinal")


@query("vec_upsert", "SELECT vec_id, CASE WHEN vec_id < 10 OR vec_id >= 1000000 THEN -1 ELSE label END AS label FROM (SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id < 3)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    new = v.filter("vec_id < 10").union(v.filter("vec_id < 3").withColumn("vec_id", F.col("vec_id") + 1_000_000)).withColumn("label", F.lit(-1))
    return search.upsert_vectors(v, new)


@query("vec_container", f"WITH {_V}, s AS (SELECT vec_id, {_COS} AS s FROM v WHERE starts_with(vec_id::VARCHAR, '2') AND vec_id % 5 <> 0) SELECT vec_id, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").withColumn("source", F.concat(F.lit("urn:v/"), F.col("vec_id")))
    inside = v.filter(search.source_condition(F.col("source"), {"source_prefix": "urn:v/2"}))
    found = search.vector_search(inside, _first_vector(spark, sf), exclude=v.filter("vec_id % 5 = 0").select("vec_id"), limit=10)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("run_context", f"""WITH {_scored("an")}, {_V}, y AS (SELECT 'urn:t:documents/' || vec_id AS source, {_COS} AS vs FROM v), h AS (SELECT source, ordinal, score * 0.55 + vs * 0.45 AS r FROM s JOIN y USING (source) WHERE starts_with(source, 'urn:t:documents/1'))
SELECT source, round(r, 6) AS rank_score FROM h ORDER BY r DESC, source LIMIT 8""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").withColumn("vec", F.col("vec_id")).select(F.concat(F.lit("urn:t:documents/"), F.col("vec_id")).alias("source"), "embedding")
    found = search.run_context(_chunks(spark, sf), "an", v, _first_vector(spark, sf), source_prefix="urn:t:documents/1")
    return found.select("source", F.round("rank_score", 6).alias("rank_score"))


@query("run_context_text", f"WITH {_scored('er')} SELECT source, ordinal, round(score * 0.55, 6) AS rank_score FROM s ORDER BY score DESC, source, ordinal LIMIT 8")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.run_context(_chunks(spark, sf), "er").select("source", "ordinal", F.round("rank_score", 6).alias("rank_score"))


# -- pages, counters, feeds
@query("page_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return retrieval.page(rows, [F.desc("o_totalprice"), "o_orderkey"], 10, 5)


@query("usage_counters", "SELECT 'customer' AS scope, o_custkey::VARCHAR AS id, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2 UNION ALL SELECT 'part', l_partkey::VARCHAR, sum(l_quantity), count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    deltas = rows.select(F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.lit(1).cast("long").alias("n"))
    return retrieval.usage(deltas, ["customer", "part"], ["quantity", "n"])


@query("change_resume", "SELECT event_type AS topic, count(*) AS n, bool_or(event_id <= 100) AS resync FROM events WHERE event_id > 100 AND event_type IN ('click', 'error') GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    feed = read(spark, sf, "events").select(F.col("event_id").alias("sequence"), F.col("event_type").alias("topic"))
    found, resync = changes.since(feed, 100, ["click", "error"])
    return found.groupBy("topic").agg(F.count("*").alias("n")).withColumn("resync", F.lit(resync))


@query("change_queue", f"WITH {_CHANGES}, s AS (SELECT user_id, max(event_id) AS version FROM c GROUP BY 1) SELECT user_id, version, version - CASE WHEN user_id % 3 = 0 THEN version WHEN user_id % 3 = 1 THEN 10 ELSE 0 END AS lag FROM s WHERE user_id % 3 <> 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    latest = _events(spark, sf).groupBy("user_id").agg(F.max("event_id").alias("version"))
    applied = latest.select("user_id", F.when(F.col("user_id") % 3 == 0, F.col("version")).when(F.col("user_id") % 3 == 1, F.lit(10).cast("long")).alias("applied")).filter("applied is not null")
    return changes.dirty(latest, applied, ["user_id"]).select("user_id", "version", "lag")


@query("change_reconcile", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN user_id % 5 = 0 THEN 'missing' WHEN user_id % 5 = 1 THEN 'stale' WHEN user_id % 5 = 2 THEN 'failed' ELSE 'applied' END AS state FROM (SELECT DISTINCT user_id FROM events)) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ids = read(spark, sf, "events").select("user_id").distinct()
    desired = ids.withColumn("profile", F.lit("p2"))
    applied = ids.filter("user_id % 5 != 0").select("user_id", F.when(F.col("user_id") % 5 == 1, "p1").otherwise("p2").alias("profile"), F.when(F.col("user_id") % 5 == 2, "error").alias("error"))
    return changes.reconciled(desired, applied, ["user_id"]).groupBy("state").agg(F.count("*").alias("n"))


@query("change_sync_buckets", f"WITH {_CHANGES}, g AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id, bool_or(op = 'delete' AND event_id % 2 = 0) AS gone FROM c WHERE event_id % 2 = 0 OR op <> 'delete' GROUP BY 1) SELECT count(*) AS n FROM g WHERE NOT gone")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, each of which writes the buckets that it touches."""
    folder = f"{str(storage.folder(spark)).rstrip('/')}/quadweave/sync-{uuid.uuid4().hex}"
    events = _events(spark, sf).filter("event_id % 2 = 0 or op != 'delete'").withColumn("op", F.when((F.col("op") == "delete"), "delete").otherwise("update"))
    columns = [F.col(c) for c in ("user_id", "event_type", "event_id")]
    changes.apply_batch(spark, folder, events, 0, ["user_id"], ["event_id"], columns)
    changes.apply_batch(spark, folder, events.filter("user_id % 7 = 0"), 1, ["user_id"], ["event_id"], columns)
    return changes.state(spark, folder).agg(F.count("*").alias("n"))
