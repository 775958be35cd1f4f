"""The pipeline against a plain version of each stage, on the whole small tables."""

import re
from collections import defaultdict

import corpus_pipeline
from quadweave.llm import mixing, toxicity
from quadweave.llm.shared import fold, table


def lower(t):
    return (t or "").encode().lower().decode()


def brute_exact(docs):
    last = {}
    for r in docs:
        last[lower(r.text)] = max(r.doc_id, last.get(lower(r.text), r.doc_id))
    return [r for r in docs if last[lower(r.text)] == r.doc_id]


def brute_near(docs):
    sets, holders, links = {}, defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in docs:
        w = lower(r.text).encode().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for s in sets[r.doc_id]:
            for other in holders[s]:
                links[r.doc_id][other] += 1
            holders[s].append(r.doc_id)
    over = {i: i for i in sets}

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    for a, near in links.items():
        for b, both in near.items():
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                over[max(x, y)] = min(x, y)
    return [r for r in docs if top(r.doc_id) == r.doc_id]


def brute_decontaminated(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for t in items:
        w = find(t)
        for i in range(max(len(w) - 9, min(len(w), 1))):
            windows[len(w[i : i + 10])].add(tuple(w[i : i + 10]))
    out = []
    for r in docs:
        w = find(r.text)
        if not any(tuple(w[i : i + n]) in known for n, known in windows.items() for i in range(len(w) - n + 1)):
            out.append(r)
    return out


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    fitted = toxicity.fit(docs, table(spark, sf, "labels").filter(fold("doc_id", 3) != 1))
    bad = {r.id for r in toxicity.score(docs, fitted).collect() if r.score >= toxicity.THRESHOLD}
    left = [r for r in docs.collect() if r.doc_id not in bad]
    left = brute_near(brute_exact(left))
    left = brute_decontaminated(left, [r.text for r in table(spark, sf, "benchmark").collect()])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {r.doc_id for r in left}
    size = defaultdict(int)
    for r in left:
        assert got[r.doc_id].size == len((r.text or "").encode().split())
        size[r.source] += got[r.doc_id].size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in got.values():
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 * mixing.BLOCK for s in order)


def test_stages_keep_columns(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_filters_decide_on_rows(spark, sf):
    words = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    passage = next(r.text for r in table(spark, sf, "benchmark").orderBy("item_id").collect() if len((r.text or "").split()) > 12)
    d = "doc_id long, text string"
    exact = spark.createDataFrame([(None, words("a")), (3, words("a")), (3, words("a").upper()), (3, words("b")), (5, words("b")), (None, words("c")), (None, words("c"))], d)
    got = sorted(((r.doc_id, r.text.lower()) for r in corpus_pipeline.drop_exact_copies(spark, exact, sf).collect()), key=str)
    assert got == sorted([(3, words("a")), (5, words("b")), (None, words("c"))], key=str)
    near = spark.createDataFrame([(None, words("a")), (4, words("a") + " x"), (2, words("a") + " y"), (4, words("b")), (None, words("c")), (None, words("c") + " z"), (7, "")], d)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, near, sf).collect()]
    assert len(got) == 4 and {(2, words("a") + " y"), (4, words("b")), (7, "")} < set(got) and sum(i is None for i, _ in got) == 1
    leaks = spark.createDataFrame([(None, passage), (1, passage), (1, words("b")), (None, words("c"))], d)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, leaks, sf).collect()]
    assert sorted(got, key=str) == [(1, words("b")), (None, words("c"))]
    docs = table(spark, sf, "documents")
    fitted = toxicity.fit(docs, table(spark, sf, "labels").filter(fold("doc_id", 3) != 1))
    bad = {r.id for r in toxicity.score(docs, fitted).collect() if r.score >= toxicity.THRESHOLD}
    target = docs.filter(docs.doc_id.isin(list(bad))).drop("doc_id").selectExpr("cast(null as long) doc_id", "*").select(docs.columns)
    left = corpus_pipeline.drop_toxic(spark, docs.union(target), sf)
    assert bad and left.filter("doc_id is null").count() == 0 and left.count() == docs.count() - len(bad)
