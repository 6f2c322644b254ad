"""Decontamination against a brute-force weighted Jaccard of all aligned item-sized windows."""
import math
import random
import re

from fleetscope.llm import decontamination as D


def words(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]


def grams(w):
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    sets = {i: (words(t), grams(words(t))) for i, t in items.items() if len(words(t)) >= 5}
    df, where = {}, {}
    for i, (w, g) in sets.items():
        for x in g:
            df[x] = df.get(x, 0) + 1
        for k in range(len(w) - 4):
            where.setdefault(tuple(w[k:k + 5]), set()).add((len(w), k))
    weight = lambda x: math.log1p(len(sets) / df.get(x, 1))
    out = {}
    for d, t in docs.items():
        w = words(t)
        spans = {(max(p - k, 0), min(p - k + n, len(w))) for p in range(len(w) - 4) for n, k in where.get(tuple(w[p:p + 5]), ())}
        for s, e in spans:
            a = grams(w[s:e])
            for i, (_, b) in sets.items():
                x = sum(map(weight, a & b)) / sum(map(weight, a | b))
                if x >= 0.8 - 1e-12:
                    out[d, i] = max(out.get((d, i), (0, 0)), (round(x, 6), -s))
    return {k: (x, -s) for k, (x, s) in out.items()}


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "q") for i, t in docs.items()], "doc_id long, text string, n int, item_id string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 6), r.start) for r in D.find(d, b).collect()}
    want = brute(docs, items)
    assert got == want, [(k, got.get(k), want.get(k)) for k in set(got) ^ set(want)][:5]
    clean = D.remove(d, b)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == set(docs) - {k[0] for k in want}
    return want


def test_planted_edited_and_clipped(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    items = {i: " ".join(rnd.choices(vocab, k=rnd.randint(15, 60))) for i in range(30)} | {90: "four words of item", 91: None, 92: ""}
    items[31] = items[3] + " one more"
    docs = {0: None, 1: "", 2: "four words of item", 3: items[5].upper(), 4: "  ".join(words(items[6])[3:])}
    for d in range(5, 70):
        w = words(rnd.choice([items[i] for i in range(30)]))
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            k = rnd.randrange(len(w))
            w = rnd.choice([w[:k] + w[k + 1:], w[:k] + ["new"] + w[k:], w[:k] + ["other"] + w[k + 1:]])
        docs[d] = "\n".join([" ".join(rnd.choices(vocab, k=rnd.randint(0, 300))), " ".join(w), " ".join(rnd.choices(vocab, k=50))])
    assert len(check(spark, docs, items)) > 20


def test_empty_null_ids_and_repeats(spark):
    schema, item = "doc_id long, text string", " ".join(f"a{i}" for i in range(20))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(None, item), (2, "x " + item), (2, "x " + item), (3, "clean")], schema)
    assert sorted((r.doc_id or 0, r.start) for r in D.find(df, b).collect()) == [(0, 0), (2, 1)]
    assert [r.doc_id for r in D.remove(df, b).collect()] == [3]
    assert D.find(df, b.limit(0)).count() == 0 and D.find(df.limit(0), b).count() == 0 and D.remove(df, b.limit(0)).count() == 4


def test_whole_table(spark):
    from fleetscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in QUERIES["op4_decontamination"](spark, sf).collect()}
    assert got == brute(docs, items) and len(got) >= 20


def test_short_items(spark):
    long = " ".join(f"a{i}" for i in range(20))
    items = {1: "two  Words", 2: "one", 3: "four words of item", 4: long, 5: None, 6: "", 7: "words two"}
    docs = {1: "see Two\nwords and two words", 2: "x four words of item y " + long, 3: "two other words of item", 4: "", 5: None, 6: "ones"}
    d = spark.createDataFrame(list(docs.items()) + [(None, "One")], "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.start, r.n_words, r.similarity, r.distance) for r in D.find(d, b, short_items=True).collect())
    assert got == [(0, 2, 0, 1, 1.0, 0), (1, 1, 1, 2, 1.0, 0), (2, 3, 1, 4, 1.0, 0), (2, 4, 6, 20, 1.0, 0)]
    assert {r.doc_id for r in D.remove(d, b, short_items=True).collect()} == {3, 4, 5, 6}
    assert D.find(d, b.where("item_id = 4"), short_items=True).count() == 1 and D.find(d, b.limit(0), short_items=True).count() == 0


def all_windows(docs, items):
    """(doc, item) pairs with any window of the item's length, at every start, at similarity 0.8 or more."""
    sets = {i: (len(words(t)), grams(words(t))) for i, t in items.items() if len(words(t)) >= 5}
    df = {}
    for _, g in sets.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    weight = lambda x: math.log1p(len(sets) / df.get(x, 1))
    found = set()
    for d, t in docs.items():
        w = words(t)
        at = [tuple(w[p:p + 5]) for p in range(len(w) - 4)]
        for i, (n, b) in sets.items():
            hits = [p for p, x in enumerate(at) if x in b]
            starts = {s for p in hits for s in range(max(p + 5 - n, 0), min(p, max(len(w) - n, 0)) + 1)}
            for s in starts:
                a = set(at[s:max(s + n - 4, s)])
                if sum(map(weight, a & b)) >= (0.8 - 1e-12) * sum(map(weight, a | b)):
                    found.add((d, i))
                    break
    return found


def test_recall_against_windows_at_every_start(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    items = {i: " ".join(rnd.choices(vocab, k=rnd.randint(16, 59))) for i in range(40)}
    docs = {}
    for d in range(400):
        w = words(items[rnd.randrange(40)])
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3])):
            k = rnd.randrange(len(w))
            w = rnd.choice([w[:k] + w[k + 1:], w[:k] + ["new"] + w[k:], w[:k] + ["other"] + w[k + 1:]])
        docs[d] = " ".join(rnd.choices(vocab, k=rnd.randint(0, 80)) + w + rnd.choices(vocab, k=rnd.randint(0, 80)))
    sf = "/root/testdata/sf0.01"
    whole = ({r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()},
             {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()})
    for texts, bench in ((docs, items), whole):
        d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        b = spark.createDataFrame(list(bench.items()), "item_id long, text string")
        got, want = {(r.doc_id, r.item_id) for r in D.find(d, b).collect()}, all_windows(texts, bench)
        print("windows at every start:", len(want), "found:", len(want & got), "more:", len(got - want))
        assert len(want) >= 20 and len(want & got) >= 0.97 * len(want)
