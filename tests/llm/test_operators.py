"""The ten operators against brute force on small documents: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns, and a hot group of copies."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadweave.llm import langid, lm, minhash, mixing, quality, toxicity, warc
from quadweave.llm.components import components
from quadweave.llm.decontam import contamination
from quadweave.llm.exact import exact_groups
from quadweave.llm.fmindex import FMIndex, repeated_windows
from quadweave.llm.near import near_groups
from quadweave.llm.substring import without_repeats
from quadweave.llm.words import ALNUM_LOWER, SPACED, chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string"


def words_of(text):
    return (text or "").encode().split()


def corpus():
    """Random texts with copies, near copies, shared passages, a hot group, and the odd rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé漢 "[:8]) for _ in range(rng.randint(1, 6))).strip() or "x" for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(120)
    docs = [text(rng.randint(1, 200)) for _ in range(60)]
    docs += [base] * 15 + [base.upper()] * 3
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append("\n".join(w))
    docs += [text(20) + " " + passage + "\t" + text(20) for _ in range(12)]
    docs += [None, "", " \n", "one", "One", "one two three four", "ONE two three  four", "for " * 90, text(9000)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), len(t or ""), None, "clash") for i, t in enumerate(docs)]
    return rows + [rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


def lower(text):
    return (text or "").encode().lower().decode()


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, keep, weak):
    key = (lambda sha: F.substring(sha, 1, 1)) if weak else None  # a weak hash makes collisions
    got = exact_groups(docs, keep=keep, **({"key": key} if weak else {})).collect()
    groups = collections.defaultdict(list)
    for r in corpus():
        groups[lower(r[1])].append(r[0])
    want = []
    for r in corpus():
        g = groups[lower(r[1])]
        best = (min if keep == "min" else max)(g)
        want.append((r[0], best, len(g), r[0] == best, hashlib.sha256(lower(r[1]).encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


def brute_near():
    sets = {}
    for r in corpus():
        w = words_of(lower(r[1]))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    over = {i: i for i in sets}

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    over[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("tile", [512, 4])
def test_near(docs, tile):
    want = brute_near()
    got = near_groups(docs, tile=tile).collect()
    assert len(got) == docs.count()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:320], rng.integers(0, 2**63, 80).astype(np.uint64)]))
    s = minhash.signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.08
    places = np.arange(1000, dtype=np.uint32)
    assert len(np.unique(minhash.permuted(places))) == 1000


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (7, 7), (None, 3)] + [(200, x) for x in range(201, 230)]
    edges += [(5000, x) for x in range(4000, 4600)] + [(3999, x) for x in range(4300, 4310)]  # hubs at either end
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((50, 75, 100), 50), **dict.fromkeys(range(200, 230), 200), **dict.fromkeys([3999, *range(4000, 4600), 5000], 3999)}


def test_index_counts():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(1, 4, rng.integers(6, 14)) for _ in range(40)]
    copies = rng.integers(1, 3, 40)
    found = repeated_windows(np.concatenate(pieces), np.array([len(p) for p in pieces]), copies, 6)
    count = collections.Counter()
    for p, c in zip(pieces, copies, strict=True):
        for i in range(len(p) - 5):
            count[tuple(p[i : i + 6])] += min(int(c), 2)
    for p, f in zip(pieces, found, strict=True):
        assert f.tolist() == [count[tuple(p[i : i + 6])] > 1 for i in range(len(p) - 5)]
    text = np.array([1, 2, 1, 2, 3, 0, 2, 3, 1, 0])
    index = FMIndex(text, 4)
    lo, hi = np.array([0]), np.array([index.size])
    for c in (3, 2):  # the pattern 2 3, from its end
        lo, hi = index.extend(np.array([c]), lo, hi)
    assert (hi - lo).tolist() == [2]


@pytest.mark.parametrize("settings", [{}, {"often": 2}, {"limit": 0, "shard_words": 50}])
def test_substring(docs, settings):
    seen = collections.Counter()
    for r in corpus():
        w = words_of(r[1])
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for r in corpus():
        w, gone = words_of(r[1]), set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    got = without_repeats(docs, **settings).collect()
    assert sorted((r.id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == sorted(want)
    assert all(sum(x.b - x.a for x in r.removed) == r.n_removed for r in got)


def katz_by_hand(train, texts, k=5):
    """The model in plain Python: unigram and bigram counts, Katz discounts, backoff weights; log10 probabilities."""
    uni, bi = collections.Counter(), collections.defaultdict(collections.Counter)
    for t in train:
        w = [*t, None]
        uni.update(w)
        for a, b in zip(["<s>", *t], w, strict=True):
            bi[a][b] += 1

    def discount(counts):
        n = [0] + [sum(c == r for c in counts) for r in range(1, k + 2)]
        t = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        out = {}
        for r in range(1, k + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - t) / (1 - t) if n[r] and t < 1 else 0
            out[r] = x if 0 < x < 1 else (r - 0.5) / r
        return lambda c: c * out.get(c, 1.0)

    d1, d2 = discount(uni.values()), discount([c for x in bi.values() for c in x.values()])
    total = sum(uni.values())
    kept = sum(map(d1, uni.values()))
    shrink = min(1.0, (total - total / (total + 1)) / kept)
    p1 = lambda w: d1(uni[w]) * shrink / total if w in uni else 1 - kept * shrink / total

    def p(w, v):
        c = bi.get(v)
        if not c:
            return p1(w)
        n = sum(c.values())
        left = max(1 - sum(map(d2, c.values())) / n, 1 / (n + 1))
        if w in c:
            return d2(c[w]) * (1 - left) / sum(map(d2, c.values()))
        return left / (1 - sum(p1(x) for x in c)) * p1(w)

    for v in ["<s>", *list(uni)[:20]]:  # exactly normalised
        assert abs(sum(p(w, v) for w in uni) + p("unknown!", v) - 1) < 1e-9
    return [sum(math.log10(p(w, v)) for v, w in zip(["<s>", *t], [*t, None], strict=True)) for t in texts]


def test_katz(docs, spark):
    rows = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 10]
    words = {r[0]: words_of(lower(r[1])) for r in corpus()}
    want = dict(zip(words, katz_by_hand([words_of(lower(r[1])) for r in rows], words.values()), strict=True))
    model = lm.Katz(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).select("text"))
    got = model.score(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.n_tokens == len(words[r.id]) + 1
        assert abs(r.score - want[r.id]) < 1e-6 * max(1, abs(want[r.id]))
    old, lm.COMMON = lm.COMMON, 3  # most bigrams are looked up in the table
    try:
        few = lm.Katz(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).select("text"), vocabulary=10_000)
        assert max(abs(r.score - want[r.id]) for r in few.score(docs).collect()) < 1e-4 * 9000
    finally:
        lm.COMMON = old
    small = lm.Katz(docs.select("text"), vocabulary=20).score(docs).collect()  # most words in the class of rare ones
    assert all(r.score < 0 for r in small)
    none = lm.Katz(docs.filter("false").select("text")).score(docs).collect()
    assert len(none) == len(got) and all(r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_least_count_keeps_to_its_bound():
    assert lm.least_count({0: 900, 8: 50, 16: 30, 40: 2}, 100) == 8
    assert lm.least_count({0: 900, 8: 50, 16: 30, 40: 2}, 81) == 16
    assert lm.least_count({5: 9}, 8) == 6 and lm.least_count({}, 5) == 1
    assert lm.steps(np.array([1, 2, 3, 4, 1000])).tolist() == [0, 8, 12, 16, 79]


def test_katz_gives_rows_of_ties_repeats_and_null_ids_alike(docs, spark):
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "one two"), (None, "one two"), (5, None)], "doc_id long, text string"))
    got = lm.Katz(docs.select("text"), vocabulary=30).score(odd.repartition(7)).collect()
    assert len(got) == docs.count() + 3 and sum(r.id is None for r in got) == 2
    by_text = {r.id: r.score for r in got}
    assert len({r.score for r in got if r.id is None}) == 1 and math.isclose(by_text[100], by_text[101], rel_tol=1e-12) == (corpus()[100][1] == corpus()[101][1])


def test_katz_of_rare_words(docs):
    rows = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 10]
    words = {r[0]: words_of(lower(r[1])) for r in corpus()}
    want = dict(zip(words, katz_by_hand([words_of(lower(r[1])) for r in rows], words.values()), strict=True))
    training = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).select("text")
    for vocabulary in (0, 20):  # the words beyond have bigrams of their own, too
        for r in lm.Katz(training, vocabulary=vocabulary).score(docs).collect():
            assert abs(r.score - want[r.id]) < 1e-6 * max(1, abs(want[r.id]))


def test_decontamination(spark, docs):
    w = [x for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(corpus()[70][1]))]
    items = [(1, " ".join(w[5:40])), (2, "one two three four"), (3, None), (10, "..!"), (11, "unheard of"), (2, "one two three four"), (12, " ".join(w[50:59]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    window = {}
    for i, t in items:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for j in range(max(len(x) - 9, min(len(x), 1))):
            window.setdefault(tuple(x[j : j + 10]), set()).add(str(i))
    want = []
    for r in corpus():
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r[1]))
        hit, found = set(), set()
        for n in {len(k) for k in window}:
            for i in range(len(x) - n + 1):
                if tuple(x[i : i + n]) in window:
                    hit.update(range(i, i + n))
                    found |= window[tuple(x[i : i + n])]
        want.append((r[0], len(x), len(hit), sorted(found)))
    for settings in ({}, {"block_bytes": 60}):
        got = contamination(docs, bench, **settings).collect()
        assert sorted((r.id, r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(want)
    assert contamination(docs, bench.filter("false")).filter("n_hit > 0").count() == 0
    near = contamination(spark.createDataFrame([(1, "one, so two three four")], "doc_id long, text string"), bench, slop=1).first()
    assert near.n_hit == 0 and near.near_items == ["2"]


def test_decontamination_by_items_without_id(spark):
    docs = spark.createDataFrame([(1, "so one two three"), (2, "four five six"), (3, "one two three four five"), (4, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (None, "three four"), (7, "four five"), (None, None)], "item_id long, text string")
    for settings in ({}, {"block_bytes": 4}):
        got = {r.id: (r.n_hit, list(r["items"])) for r in contamination(docs, bench, **settings).collect()}
        assert got == {1: (3, [None]), 2: (2, ["7"]), 3: (5, ["7", None]), 4: (0, [])}


def test_proximity_in_the_second_document_of_a_shard(spark):
    docs = spark.createDataFrame([(1, "one three four"), (2, "two one three four"), (3, "one three"), (4, "")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(2, "one two three four")], "item_id long, text string")
    got = {r.id: list(r.near_items) for r in contamination(docs, bench, slop=2).collect()}  # "two" is the rarest word
    assert got == {1: [], 2: ["2"], 3: [], 4: []}


def test_mixing(docs):
    m = mixing.mixture(docs, block=8, shard=64)
    got = m.taken().collect()
    assert len(got) == docs.count()
    size = collections.Counter()
    for r in corpus():
        size[r[3]] += len(words_of(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [1, 2, 3, 1][: len(order)])
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == size[r.source]
        assert abs(r.target - want[order.index(r.source)]) < 1e-6
        taken[r.source] += r.taken
    for s, t in zip(order, want, strict=True):
        assert abs(taken[s] - t) <= 24
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs, block=8, shard=64).taken().collect()))
    slots = m.slots.collect()
    assert len({(s.shard, s.slot) for s in slots}) == len(slots)
    assert max(collections.Counter((s.source_key, s.block) for s in slots).values()) <= 3
    assert mixing.mixture(docs.filter("false")).taken().count() == 0
    for n in (1, 2, 7, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))
    assert mixing.targets([10, 100, 0], [3, 1, 2]) == [30.0, 80.0, 0.0]


def test_toxicity(spark):
    rng = random.Random(3)
    plain = lambda n: " ".join("w%d" % rng.randrange(400) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        sentences = [plain(8) for _ in range(rng.randint(1, 8))]
        if bad:
            sentences[rng.randrange(len(sentences))] += " Rotten fool"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "rotten fool " * 3000)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fitted = toxicity.fit(docs, marks.filter("doc_id % 2 = 0"))
    got = {r.id: r for r in toxicity.score(docs, fitted).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all((got[i].score >= toxicity.THRESHOLD) == bool(y) for i, y in labels)
    text = dict(rows)[0].encode()
    assert [text[x.first : x.last].endswith(b"Rotten fool") for x in got[0].offending] == [True]
    assert got[1000].score == got[1001].score == 0 and got[1002].score > 0.9
    assert toxicity.score(docs, toxicity.fit(docs, marks.filter("false"))).filter("score >= 0.7").count() == 0


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        t = " ".join("w%d" % rng.randrange(300) for _ in range(rng.randint(5, 80)))
        good = i % 3 > 0
        rows.append((i, t if good else "!! ".join(t.upper().split()), len(t)))
        labels.append((i, int(good)))
    rows += [(900, None, None), (901, "", 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int")
    fitted = quality.fit(docs, marks.filter("doc_id % 2 = 0"))
    got = {r.id: r.score for r in quality.score(docs, fitted).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels]) > 0.97
    part, found = next(chunks(pa.array(["a b a", "c"]), SPACED))  # the linear-time identity against all pairs
    stats = np.zeros((2, len(quality.STATISTICS)))
    z = quality.Machine(0.1, fitted.w, fitted.v, fitted.mean, fitted.scale)
    for d, logit in enumerate(z.logits(found, stats)):
        x = collections.Counter()
        own = found.hashes[found.at[d] : found.at[d + 1]]
        for h in own:
            x[int(h >> np.uint64(48))] += 1 / math.sqrt(len(own))
        for j, value in enumerate(z.stats(stats)[d]):
            x[quality.WORD_SLOTS + j] = value
        keys = list(x)
        pairs = sum(float(z.v[a].astype(float) @ z.v[b]) * x[a] * x[b] for i, a in enumerate(keys) for b in keys[:i])
        assert abs(logit - (0.1 + sum(float(z.w[a]) * x[a] for a in keys) + pairs)) < 1e-4
    flat = quality.score(docs, quality.fit(docs, marks.filter("quality = 1"))).select("score").distinct().count()
    assert flat == 1


def test_language(spark):
    samples = {"aa": "the cat and the dog that there then this", "bb": "der hund und die katze das dort dann dies", "cc": "ля кот и пес что там тогда это"}
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(t.split()) for _ in range(12)), lang) for i, (lang, t) in enumerate(list(samples.items()) * 20)]
    odd = [(500, None, "aa"), (501, "", None), (502, "12 !! ..", "bb"), (503, "The", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.id: r for r in langid.identify(docs, langid.learn(docs.filter("doc_id % 2 = 0"))).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.identify(docs, langid.learn(docs.filter("false"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_language_ngrams():
    doc, keys, counts = langid.ngrams([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in ("ab c", "", "x", "ab")])
    assert sorted(set(doc.tolist())) == [0, 2, 3] and set(counts.tolist()) == {1}
    grams = collections.Counter()
    for k in keys[doc == 0].tolist():
        out = []
        while k:
            c = (k & (1 << 21) - 1) - 1
            out.append(chr(c) if c else "_")
            k >>= 21
        grams["".join(reversed(out))] += 1
    assert grams == collections.Counter(["a", "b", "c", "_a", "ab", "b_", "_c", "c_", "_ab", "ab_", "_c_"])


def test_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(9000)] + [(None, None, None), (7, "http://h/7", "<p>7</p>" * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    theirs = pages.filter("page_id is null or page_id != 5000").withColumn("html", F.when(F.col("page_id") == 77, "x").otherwise(F.col("html"))).union(spark.createDataFrame([(20000, "u", "h")], "page_id long, url string, html string"))
    ours = warc.leaves(pages)
    got = {(r.id, r.status, r.shard) for r in warc.audit(ours, warc.leaves(theirs)).collect()}
    assert got == {(77, "altered", 0), (5000, "missing", 1), (20000, "extra", 4)}
    assert warc.audit(ours, ours).count() == 0 and warc.audit(ours.filter("false"), ours.filter("false")).count() == 0
    assert [t.filter("shard = 0").count() for t in warc.tree(ours.withColumn("side", F.lit(0)))] == [256, 16, 1]
    records = [r[0] for r in pages.filter("page_id < 20").orderBy("page_id").select(warc.record(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    data = "".join(records).encode()
    parsed = list(warc.parse(data))
    assert len(parsed) == 21 and parsed[3][1] == b"<p>3</p>" * 3 and parsed[3][2] == sum(len(r.encode()) for r in records[:3])
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(data[:-3]))


def test_warc_pairs_records_of_one_id(spark):
    schema = "page_id long, url string, html string, shard string, side string, digest string"
    row = lambda i, body: (i, "u", body, "clash", "clash", "clash")
    long = "x" * 300_000
    left = [row(1, "a"), row(1, "b"), row(1, "same"), row(2, "c"), row(2, "d"), row(2, "e"), row(3, long), row(4, "twice"), row(4, "twice"), row(5, None), row(6, ""), row(-9, "below")]
    right = [row(1, "A"), row(1, "B"), row(1, "same"), row(2, "C"), row(3, long + "y"), row(4, "twice"), row(5, ""), row(6, ""), row(-9, "below")]
    left += [row(None, t) for t in "wxyz"] + [row(None, "kept")] * 2
    right += [row(None, t) for t in "WXYZ"] + [row(None, "kept")] * 2
    ours, theirs = (warc.leaves(spark.createDataFrame(x, schema)) for x in (left, right))
    found = warc.audit(ours, theirs).collect()
    got = collections.Counter((r.id, r.status) for r in found)
    assert got == {(1, "altered"): 2, (2, "altered"): 1, (2, "missing"): 2, (3, "altered"): 1, (4, "altered"): 1, (None, "missing"): 4, (None, "extra"): 4}
    place = lambda t, i: len(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nWARC-Record-ID: <urn:record:{i}>\r\nContent-Length: {len(t)}\r\n\r\n{t}\r\n\r\n")
    assert next(r.length for r in found if r.id == 3) == place(long, 3)
    assert next(r.first_byte for r in found if r.id == 3) == sum(place(t, i) for i, t in [(1, "a"), (1, "b"), (1, "same"), (2, "c"), (2, "d"), (2, "e")])


def test_warc_many_records_of_one_id(spark):
    many = spark.range(3000).selectExpr("cast(if(id < 2000, 7, null) as long) page_id", "'u' url", "cast(id as string) html")
    less = many.filter("html not in ('5', '2500')")
    got = sorted(((r.id, r.status) for r in warc.audit(warc.leaves(many), warc.leaves(less)).collect()), key=str)
    assert got == [(7, "missing"), (None, "missing")]


def test_words():
    texts = ["One two", None, "", "été\x0bDEUX", "x" * 3_000_000 + " y", "a"]
    found = [f for _, f in chunks(pa.array(texts), SPACED)]
    assert sum((f.counts.tolist() for f in found), []) == [len(words_of(t)) for t in texts]
    part, f = next(chunks(pa.array(["Don't-stop É1", "don t STOP"]), ALNUM_LOWER))
    assert f.counts.tolist() == [4, 3] and f.hashes[:3].tolist() == f.hashes[4:].tolist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (exact_groups(docs), near_groups(docs), without_repeats(docs), contamination(docs, bench), toxicity.score(docs, toxicity.fit(docs, labels)), quality.score(docs, quality.fit(docs, labels)), langid.identify(docs, langid.learn(docs)), lm.Katz(docs.select("text")).score(docs)):
        assert out.count() == 0
