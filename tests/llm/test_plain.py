"""Operators without SQL against plain versions of their methods, and all of them on tables with odd rows and column names."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadweave.llm import langid, lm, mixing, quality, shared, toxicity
from quadweave.llm.decontam import contamination
from quadweave.llm.exact import exact_groups
from quadweave.llm.near import near_groups
from quadweave.llm.substring import without_repeats

WORDS = {"aa": "the cat and dog that there then this stone river".split(), "bb": "der hund und die katze das dort dann dies fluß".split(), "cc": "ля кот и пес что там тогда это река".split()}


def texts():
    """(doc_id, text, lang): ties, repeated rows, nulls, empty and very long texts."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS[x]) for _ in range(rng.randint(1, 30))), x) for i in range(90) for x in [rng.choice("abc") * 2]]
    rows += [(200, "a b", "aa"), (201, "b a", "bb"), (202, "a-b. A_B", None), (203, None, "cc"), (204, " \n", None), (205, "1 2 3", "aa"), (206, "the " * 30_000, None)]
    return rows + [rows[4], rows[4], (None, "der hund", "bb"), (None, None, None)]


def grams_of(text):
    out, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            s = f" {word} "
            out.update(g for k in (1, 2, 3) for i in range(len(s) - k + 1) if (g := s[i : i + k]) != " ")
            word = ""
    return out


def ranked(counts):
    key = lambda g: sum((ord(c) + 1 if c != " " else 1) << 21 * i for i, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], key(g) % 1_000_003 * 7919 % 1_000_003, key(g)))


@pytest.mark.parametrize("parts", [1, 7])
def test_language_by_hand(spark, parts):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    size, top = 25, 40
    sums = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and t is not None and i is not None and i % 4 != 2:
            sums[lang].update(grams_of(t))
    profiles = {x: {g: r for r, g in enumerate(ranked(c)[:size])} for x, c in sums.items()}
    want = Counter()
    for i, t, _ in rows:
        own = ranked(grams_of(t))[:top]
        away = sorted((sum(abs(p[g] - r) if g in p else size for r, g in enumerate(own)), x) for x, p in profiles.items())
        want[(i, away[0][1] if own else "und", round(max(0.0, 1 - away[0][0] / away[1][0]) if own else 0.0, 9))] += 1
    learned = langid.learn(docs.filter("doc_id is not null and doc_id % 4 != 2"), size=size)
    assert Counter((r.id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, learned, top=top).collect()) == want


def mixed_by_hand(rows, weights, block, shard, most, seed):
    """Words taken of each (source, id) by draws, slots and permutations in plain loops; ids are unique."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((t or "").encode().split()) for _, t, s in rows if s == x) for x in sources]
    want = mixing.targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], most)
    blocks = [math.ceil(n / block) for n in sizes]
    quota = [min(round(t * b / n), int(most * b)) if n else 0 for t, b, n in zip(want, blocks, sizes, strict=True)]
    total, shards = sum(quota), []
    for j in range(math.ceil(total / shard)):
        draws = np.random.default_rng([seed, j]).multinomial(min(shard, total - j * shard), np.array(quota) / total)
        shards.append(draws.tolist())
    drawn = [sum(d[s] for d in shards) for s in range(len(sources))]
    seen, spare = [0] * len(sources), [k for k, (d, q) in enumerate(zip(drawn, quota, strict=True)) for _ in range(max(0, q - d))]
    used, extra = [Counter() for _ in sources], 0
    over_first = np.cumsum([0] + [max(0, d - q) for d, q in zip(drawn, quota, strict=True)])
    filled = list(drawn)
    for d in shards:
        for s, n in enumerate(d):
            for _ in range(n):
                i, x = seen[s], s
                seen[s] += 1
                if i >= quota[s]:  # a draw too many goes to a source that is short
                    e = int(over_first[s]) + i - quota[s]
                    x = spare[e]
                    i = drawn[x] + sum(1 for y in spare[:e] if y == x)
                    extra += 1
                epoch = i // blocks[x]
                key = mixing.mixed(seed * 1000003 + x * 101 + epoch)
                used[x][int(mixing.permuted(np.array([i % blocks[x]]), blocks[x], key)[0])] += 1
    assert filled and extra == sum(max(0, d - q) for d, q in zip(drawn, quota, strict=True))
    taken = {}
    for x, source in enumerate(sources):
        at = 0
        for i, t, _ in sorted((r for r in rows if r[2] == source), key=lambda r: r[0]):
            n = len((t or "").encode().split())
            taken[i] = sum(used[x][w // block] for w in range(at, at + n))
            at += n
    return dict(zip(sources, want, strict=True)), taken


def test_mixture_by_hand(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(120)] + [(500, None, "a"), (501, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    settings = {"weights": (1, 2, 3), "block": 8, "shard": 16, "most": 3.0, "seed": 7}
    want, taken = mixed_by_hand(rows, **settings)
    mix = mixing.mixture(docs, **settings)
    got = {r.id: r for r in mix.taken().collect()}
    assert {i: r.taken for i, r in got.items()} == taken and len(got) == len(rows)
    assert all(abs(r.target - want[r.source]) < 1e-9 for r in got.values())
    blocks = mix.blocks().groupBy("shard").agg(F.count_distinct("slot").alias("slots"), F.sum("words").alias("words")).collect()
    assert sum(r.words for r in blocks) == sum(taken.values()) and all(r.slots <= 16 for r in blocks)


def test_noisy_or_by_hand(spark):
    """Scores from the fitted weights by plain loops; the sentence with the word that makes a text toxic is found."""
    rng = random.Random(2)
    bad, fine = ["vile", "nasty"], ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(900)]
    rows = []
    for i in range(300):
        lines = [" ".join(rng.choice(fine) for _ in range(6)) for _ in range(rng.randint(1, 5))]
        y = int(i % 3 == 0)
        if y:
            lines[rng.randrange(len(lines))] += " " + rng.choice(bad)
        rows.append((i, ". ".join(lines), y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    weight = dict(zip(model.keys.tolist(), model.weight.tolist(), strict=True))

    def probability(text):
        out = []
        for line in text.split("."):
            found = next(f for _, f in toxicity.chunks(toxicity.pa.array([line]), toxicity.ALNUM_LOWER))
            if len(found.first):
                out.append(1 / (1 + math.exp(-model.bias - sum(weight.get(x, 0.0) for f in toxicity.word_features(found).tolist() for x in f))))
        return 1 - math.prod(1 - p for p in out)

    got = {r.id: r for r in toxicity.score(docs, model).collect()}
    assert all(abs(got[i].score - probability(t)) < 1e-9 for i, t, _ in rows)
    assert all((got[i].score >= 0.5) == bool(y) for i, _, y in rows)
    places = {i: [(s.first, s.last) for s in got[i].offending] for i, _, y in rows if y}
    assert all(len(p) == 1 and any(w in t.encode()[p[0][0] : p[0][1]].decode() for w in bad) for i, t, y in rows if y for p in [places[i]])


def test_factorisation_machine_learns_by_its_gradient():
    """One step of plain gradients moves weights the way that training does, on interactions that no linear model can tell."""
    rng = np.random.default_rng(0)
    slots, y = [], []
    for _ in range(400):  # 1 if exactly one of two words is there
        a, b = rng.integers(0, 2, 2)
        slots.append(np.array([5] * a + [9] * b + [20 + int(rng.integers(0, 3))], np.int32))
        y.append(a ^ b)
    stats = np.zeros((400, len(quality.STATISTICS)))
    m = quality.train(slots, stats, np.array(y, float), steps=300, rate=0.05)

    def logit(s):
        u, c = np.unique(s, return_counts=True)
        x = c / math.sqrt(len(s))
        pairs = sum(float(m.v[u[i]] @ m.v[u[j]]) * x[i] * x[j] for i in range(len(u)) for j in range(i))
        return m.bias + float((m.w[u] * x).sum()) + pairs

    right = sum((logit(s) > 0) == bool(t) for s, t in zip(slots, y, strict=True))
    assert right >= 390
    one = quality.train(slots, stats, np.array([1.0] * 400))
    assert one.bias == 4.0 and not one.w.any()


def test_samples_are_bounded_and_take_one_row_an_id(spark):
    docs = spark.createDataFrame([(i % 10, "x" * i, 0) for i in range(100)] + [(None, "n", 1), (50, None, 1)], "doc_id long, text string, toxic int")
    rows = toxicity.labelled(docs, docs, "toxic", "doc_id", "text", 1000, 1 << 20).collect()
    assert sorted(len(r.text) for r in rows) == [0, *range(90, 100)]
    few = toxicity.labelled(docs, docs, "toxic", "doc_id", "text", 1000, 400).collect()
    assert 3 <= len(few) <= 5 and sum(len(r.text) for r in few) <= 400
    assert toxicity.labelled(docs, docs, "toxic", "doc_id", "text", 4, 1 << 20).count() == 4


CLASHES = ["id", "rid", "label", "__label", "__id", "score", "source_key", "size", "taken", "t", "h", "sha", "n", "bytes", "row", "row_key", "component_id", "shard", "part", "run", "block", "text2", "word", "at", "kept", "y", "i", "x0", "chars", "rank"]


def test_other_columns_change_nothing(spark):
    rows = [(i, t, x or "aa", (x or "n")[0], len(t or ""), (i or 0) % 2, (i or 0) % 2) for i, t, x in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int, quality int").repartition(3)
    clash = docs.select("*", *(F.lit("clash").alias(c) for c in CLASHES))
    items = spark.createDataFrame([(1, "der hund und die katze"), (2, "kot"), (None, "пес что там")], "item_id long, text string")
    clash_items = items.select("*", *(F.lit("clash").alias(c) for c in ("item", "t", "id", "n")))

    def results(d, b):
        yield exact_groups(d)
        yield near_groups(d)
        yield without_repeats(d, window=5, anchor=2)
        yield contamination(d, b)
        yield mixing.mixture(d, block=8).taken().drop("row")
        yield toxicity.score(d, toxicity.fit(d, d))
        yield quality.score(d, quality.fit(d, d))
        yield langid.identify(d, langid.learn(d))
        yield lm.Katz(d.select("text")).score(d)

    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r)
    for a, b in zip(results(docs, items), results(clash, clash_items), strict=True):
        assert a.columns == b.columns
        got = Counter(plain(r) for r in b.collect())
        assert got == Counter(plain(r) for r in a.collect()) and sum(got.values()) == len(rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_filters_keep_all_columns_and_take_empty_tables(spark, sf, n):
    name, stage = corpus_pipeline.STAGES[n]
    rows = [(i, t, x or "aa", "s", 1, "clash", "clash") for i, t, x in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key string, id string")
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns and set(out.collect()) <= set(docs.collect())
    empty = docs.filter("false")
    assert stage(spark, empty, sf).columns == docs.columns and stage(spark, empty, sf).count() == 0


def test_rows_of_files_keep_their_keys(spark, tmp_path):
    docs = spark.range(1000).selectExpr("id % 10 doc_id", "concat('t', id) text", "'clash' row_key", "'clash' _metadata").repartition(7)
    docs.write.parquet(f"file://{tmp_path}/d")
    read = spark.read.parquet(f"file://{tmp_path}/d")
    rows, view, row = corpus_pipeline.keyed(read)
    assert row == "row_key_" and rows.columns == [*read.columns, row] and "row_index" in rows._jdf.queryExecution().analyzed().toString()
    one = {r.text: r.row for r in view.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # other tasks read other ranges
    try:
        assert {r.text: r[row] for r in rows.collect()} == one and len(set(one.values())) == 1000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    again = corpus_pipeline.keyed(read.filter("doc_id < 5"))[0]
    assert again.count() == 500 and again.select(row).distinct().count() == 500


def test_scratch_deletes_what_is_made_inside(spark):
    with shared.scratch(keep="stays"):
        gone, stays = (shared.written(spark.range(3), n) for n in ("goes", "stays"))
        apart = shared.bucketed(spark.range(3), "apart", "id", 2)
    path = lambda d: spark._jvm.org.apache.hadoop.fs.Path(d.shared_path)
    there = lambda d: path(d).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(d))
    assert not there(gone) and not there(apart) and there(stays) and stays.count() == 3
    assert not spark.catalog.tableExists(apart.shared_name)
