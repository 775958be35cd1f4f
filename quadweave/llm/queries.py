"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.llm import langid, quality, toxicity, warc
from quadweave.llm.decontam import contamination
from quadweave.llm.exact import exact_groups
from quadweave.llm.lm import Katz
from quadweave.llm.mixing import mixture
from quadweave.llm.near import near_groups
from quadweave.llm.shared import fold, table, written
from quadweave.llm.substring import without_repeats


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max").withColumnRenamed("id", "doc_id")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = Katz(docs.filter(fold("doc_id", 10) != 0).select("text"))
    train_tokens = F.lit(int(model.model.total)).cast("long").alias("train_tokens")
    return model.score(docs).select(F.col("id").alias("doc_id"), (fold("id", 10) == 0).alias("held_out"), "n_tokens", "n_known", train_tokens, F.col("base").alias("base_score"), "score")


def op5_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).taken().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _classified(found: DataFrame, threshold: float) -> DataFrame:
    held = (fold("id", 3) == 1).alias("held_out")
    return found.select(F.col("id").alias("doc_id"), held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fitted = toxicity.fit(docs, labels.filter(fold("doc_id", 3) != 1))
    return _classified(toxicity.score(docs, fitted), toxicity.THRESHOLD)


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica of pages with planted faults: records with a changed byte, lost records, and records too many."""
    c = F.pmod(F.col("page_id") * 7919 + 13, F.lit(100003))
    changed = pages.filter(c % 101 != 0).withColumn("html", F.when(c % 97 == 0, F.concat(F.coalesce("html", F.lit("")), F.lit("~"))).otherwise(F.col("html")))
    return changed.union(pages.filter(c % 103 == 0).withColumn("page_id", F.col("page_id") + 1_000_000_000_000))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ours, theirs = (written(warc.leaves(x), "leaves") for x in (pages, damaged(pages)))
    return warc.audit(ours, theirs).withColumnRenamed("id", "page_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fitted = quality.fit(docs, labels.filter(fold("doc_id", 3) != 1))
    return _classified(quality.score(docs, fitted), quality.THRESHOLD)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs.filter(fold("doc_id", 4) != 2)))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "lang_pred", "score")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""

OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(a[i:i + 4], 'string_agg', ' ') AS g
  FROM w, unnest(range(1, greatest(len(a) - 3, 2))) AS r(i) WHERE len(a) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM e JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""

OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, hash(w[i:i + 34]) AS h, w[i:i + 34] AS g FROM d, unnest(range(1, len(w) - 33)) AS r(i)),
m AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, i, g FROM g SEMI JOIN m ON g.h = m.h),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM c),
k AS (SELECT DISTINCT doc_id, j FROM x, unnest(range(i, i + 35)) AS r(j) WHERE n > 1),
a AS (SELECT doc_id, j, w[j] AS t FROM d, unnest(range(1, len(w) + 1)) AS r(j)),
l AS (SELECT doc_id, string_agg(t, ' ' ORDER BY j) AS t FROM a ANTI JOIN k ON a.doc_id = k.doc_id AND a.j = k.j GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(l.t, '')) AS kept_sha256
FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, w[i:i + least(len(w), 10) - 1] AS g
  FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS r(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM p),
x AS (SELECT doc_id, i, k, w[i:i + k - 1] AS g FROM d, k, unnest(range(1, len(w) - k + 2)) AS r(i)),
m AS (SELECT doc_id, item_id, i, x.k FROM x JOIN p ON x.k = p.k AND x.g = p.g),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM m, unnest(range(i, i + k)) AS r(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH f AS (SELECT page_id, url, html, ((page_id * 7919 + 13) % 100003 + 100003) % 100003 AS c FROM pages),
p AS (
  SELECT 'ours' AS side, page_id, url, html FROM f
  UNION ALL SELECT 'theirs', page_id, url, CASE WHEN c % 97 = 0 THEN coalesce(html, '') || '~' ELSE html END FROM f WHERE c % 101 <> 0
  UNION ALL SELECT 'theirs', page_id + 1000000000000, url, html FROM f WHERE c % 103 = 0),
t AS (
  SELECT side, page_id, replace('WARC/1.0~WARC-Type: response~WARC-Target-URI: ', '~', chr(13) || chr(10)) || coalesce(url, '')
    || replace('~WARC-Record-ID: <urn:record:', '~', chr(13) || chr(10)) || page_id || replace('>~Content-Length: ', '~', chr(13) || chr(10))
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t
  FROM p),
d AS (SELECT side, page_id, sha256(t) AS digest, strlen(t)::BIGINT AS length, page_id // 4096 AS shard FROM t),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY shard ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_byte FROM d WHERE side = 'ours'),
h AS (SELECT * FROM d WHERE side = 'theirs')
SELECT coalesce(o.page_id, h.page_id) AS page_id, coalesce(o.shard, h.shard)::BIGINT AS shard, o.first_byte, o.length,
  CASE WHEN h.page_id IS NULL THEN 'missing' WHEN o.page_id IS NULL THEN 'extra' ELSE 'altered' END AS status,
  o.digest AS our_digest, h.digest AS their_digest
FROM o FULL JOIN h ON o.page_id = h.page_id WHERE o.digest IS DISTINCT FROM h.digest
"""

# The remainder of the CRC-32 of a number's digits: bit by bit, from the lowest of each character.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i::INT) & 1)))),
  lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, lang, {_CRC} % 4 = 2 AS held_out, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, ' ')) AS w FROM d WHERE t <> '') GROUP BY ALL),
v AS (SELECT w, ' ' || w || ' ' AS s FROM (SELECT DISTINCT w FROM w)),
x AS (
  SELECT w, substr(s, i::INT, k::INT) AS g FROM v, unnest(range(1, length(s) + 1)) AS r(i), unnest(range(1, 4)) AS q(k)
  WHERE i + k <= length(s) + 1 AND substr(s, i::INT, k::INT) <> ' '),
p AS (SELECT DISTINCT g, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(g, ''), lambda c: CASE WHEN c = ' ' THEN 1 ELSE unicode(c) + 1 END)), lambda a, b: a * 2097152 + b) AS key FROM x),
c AS (SELECT doc_id, p.key, sum(n) AS n FROM w JOIN x ON w.w = x.w JOIN p ON p.g = x.g GROUP BY ALL),
o AS (SELECT *, key % 1000003 * 7919 % 1000003 AS tie FROM c),
l AS (SELECT lang, key, tie, sum(n) AS n FROM o JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
f AS (SELECT lang, key, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tie, key) - 1 AS rank FROM l QUALIFY rank < 400),
e AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tie, key) - 1 AS rank FROM o QUALIFY rank < 400),
m AS (
  SELECT doc_id, a.lang, sum(coalesce(abs(f.rank - e.rank), 400)) AS away
  FROM e CROSS JOIN (SELECT DISTINCT lang FROM f) a LEFT JOIN f ON f.lang = a.lang AND f.key = e.key GROUP BY ALL),
b AS (SELECT doc_id, lang, away, row_number() OVER (PARTITION BY doc_id ORDER BY away, lang) AS k FROM m)
SELECT d.doc_id, held_out, coalesce(x.lang, 'und') AS lang_pred,
  CASE WHEN x.lang IS NULL OR coalesce(y.away, 1) = 0 THEN 0.0 ELSE greatest(0.0, 1 - x.away::DOUBLE / coalesce(y.away, 1)::DOUBLE) END AS score
FROM d LEFT JOIN b x ON x.doc_id = d.doc_id AND x.k = 1 LEFT JOIN b y ON y.doc_id = d.doc_id AND y.k = 2
"""

QUERIES = {"op1_minhash": op1_minhash, "op2_exact": op2_exact, "op3_substring": op3_substring, "op4_katz": op4_katz, "op5_positional": op5_positional, "op6_mixing": op6_mixing, "op7_toxicity": op7_toxicity, "op8_warc": op8_warc, "op9_quality": op9_quality, "op10_language": op10_language}
ORACLES = {"op1_minhash": OP1_SQL, "op2_exact": OP2_SQL, "op3_substring": OP3_SQL, "op5_positional": OP5_SQL, "op8_warc": OP8_SQL, "op10_language": OP10_SQL}
