"""Points of markdown, pieces of texts, cards, budgets, queues and stored quads on small cases."""

from pyspark.sql import functions as F

from quadweave import storage
from quadweave.engine import Engine
from quadweave.operators import retrieval, search, stats, update
from quadweave.sources.datasets import QUADS, StoredDataset
from quadweave.streaming import changes


def test_blocks_of_markdown():
    text = "Top\n===\n\npara one\nstill one\n* item a\n  more of a\n* item b\n\n---\n~~~py\n# code\n\n~~~\n### Deep #\nend"
    got = [(k, text[a:b]) for k, a, b in retrieval.blocks(text)]
    assert got == [("heading1", "Top\n==="), ("paragraph", "para one\nstill one"), ("item", "* item a\n  more of a"), ("item", "* item b"), ("rule", "---"), ("code", "~~~py\n# code\n\n~~~"), ("heading3", "### Deep #"), ("paragraph", "end")]
    assert list(retrieval.blocks("```\nopen to the end\n")) == [("code", 0, 20)] and list(retrieval.blocks("")) == []


def test_points_keep_to_their_bytes_and_offsets():
    text = "# Über\n\n" + "wörter 漢字 " * 50 + "\n\n" + "x" * 90
    points = list(retrieval.points_of("s", text, 64))
    assert all(len(p[6].encode()) <= 64 and text[p[7] : p[8]] == p[6] and text.encode()[p[9] : p[10]].decode() == p[6] for p in points)
    assert [p[0] for p in points] == list(range(len(points))) and len({p[11] for p in points}) == len(points)
    assert "".join(p[6] for p in points if p[2] == points[0][2]) == ("wörter 漢字 " * 50).strip()
    assert [p[11] for p in retrieval.points_of("s", text + "\n\nmore", 64)][: len(points)] == [p[11] for p in points]
    assert list(retrieval.within_bytes("漢", 1)) == [(0, 1)] and list(retrieval.within_bytes("", 5)) == []


def test_roles_and_labels(spark):
    p = ["urn:x#prefLabel", "http://a/api-key", "http://www.w3.org/ns/auth/acl#agent", "urn:y:createdAt", "urn:z/replyTo", "urn:z/colour", ""]
    df = spark.createDataFrame([(x,) for x in p], "p string").select(retrieval.role_of(F.col("p")).alias("r"), retrieval.label_of(F.col("p")).alias("l"))
    assert [tuple(r) for r in df.collect()] == [("searchableText", "pref Label"), ("sensitiveText", "api key"), ("system", "agent"), ("structured", "created At"), ("relation", "reply To"), ("displayOnlyText", "colour"), ("system", "text")]


def test_candidates_and_normal_forms(spark):
    assert [retrieval.candidate_budget(*x) for x in ((1, 0), (20, 5), (1000, 0))] == [256, 800, 4096]
    texts = ["Ｆｕｌｌ ﬁsh", "été", "plain", None, "½ ㎏", "été"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(search.normalized(F.col("t"))).collect()]
    assert got == ["full fish", "été", "plain", None, "1⁄2 kg", "été"]


def quads(spark, *rows):
    return spark.createDataFrame([(g, "iri", s, p, "literal", o, None, None, f, None) for g, s, p, o, f in rows], QUADS)


def test_layout_holds_quads_once_and_reads_one_group(spark, tmp_path):
    q = quads(spark, *(("urn:g", f"urn:s{i % 50}", f"urn:p{i % 7}", str(i), "urn:f") for i in range(700)), ("urn:g", "urn:s0", "urn:p0", "0", "urn:other"))
    layout = storage.Layout(spark, f"file://{tmp_path}/quads")
    layout.load(q)
    assert layout.quads().count() == 700 and layout.statistics().agg(F.sum("quads")).first()[0] == 700
    e = Engine(spark, StoredDataset(quads=layout.quads()))
    df = e.sparql("SELECT ?s ?o WHERE { GRAPH <urn:g> { ?s <urn:p3> ?o } }", {"s": "str", "o": "str"})
    assert df.count() == 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pg" in plan and "pg#" in plan and "Exchange" not in plan


def test_inserts_and_deltas_replace_rows(spark):
    old = quads(spark, ("", "urn:a", "urn:p", "1", "urn:f1"), ("", "urn:b", "urn:p", "2", "urn:f1"))
    new = update.insert(old, quads(spark, ("", "urn:a", "urn:p", "1", "urn:f2"), ("", "urn:a", "urn:p", "1", "urn:f3"), ("", "urn:c", "urn:p", "3", "urn:f2")))
    assert sorted((r.s, r.source) for r in new.collect()) == [("urn:a", "urn:f2"), ("urn:b", "urn:f1"), ("urn:c", "urn:f2")]
    delta = old.select(F.lit("delete").alias("op"), "*").union(quads(spark, ("", "urn:b", "urn:p", "2", "urn:f9")).select(F.lit("insert").alias("op"), "*"))
    assert [(r.s, r.source) for r in update.apply_delta(old, delta).collect()] == [("urn:b", "urn:f9")]


def test_budget_over_many_ranges(spark):
    entries = spark.range(1000).select(F.col("id"), (F.col("id") % 7 + 1).alias("bytes"))
    got = stats.within_budget(entries.repartition(6), 500, "bytes", [F.desc("id")]).collect()
    spent, want = 0, {}
    for i in range(999, -1, -1):
        spent += i % 7 + 1
        if spent <= 500:
            want[i] = spent
    assert {r.id: r.spent for r in got} == want
    assert stats.within_budget(entries.filter("false"), 500, "bytes", [F.desc("id")]).count() == 0


def test_feeds_resume_and_state_of_touched_buckets(spark, tmp_path):
    feed = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(1, 11)], "sequence long, topic string")
    rows, resync = changes.since(feed, 6, ["a"])
    assert [r.sequence for r in rows.collect()] == [7, 9] and not resync
    assert changes.since(feed, 3, kept=5)[1] and not changes.since(feed, 5, kept=5)[1] and changes.since(feed, 99)[1]
    folder, columns = f"file://{tmp_path}/s", [F.col("k"), F.col("v")]
    batch = lambda *x: spark.createDataFrame(list(x), "k int, v string, op string, n int")
    assert changes.state(spark, folder) is None
    changes.apply_batch(spark, folder, batch(*((i, "x", "update", i) for i in range(100))), 0, ["k"], ["n"], columns)
    for _ in range(2):  # a batch that is run again gives the same
        changes.apply_batch(spark, folder, batch((5, "y", "update", 1), (6, "", "delete", 2), (200, "z", "update", 3)), 1, ["k"], ["n"], columns)
        got = {r.k: r.v for r in changes.state(spark, folder).collect()}
        assert got == {**dict.fromkeys(set(range(100)) - {6}, "x"), 5: "y", 200: "z"}
    written = {p.name for p in (tmp_path / "s" / "v=1").iterdir() if p.name.startswith("bucket=")}
    assert 1 <= len(written) <= 3
    changes.apply_batch(spark, folder, batch(*((i, "", "delete", i) for i in [*range(100), 200])), 2, ["k"], ["n"], columns)
    assert changes.state(spark, folder).count() == 0
