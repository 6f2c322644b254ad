"""Repeated 400-byte strings against a brute-force count of every string."""
import hashlib
import random

from fleetscope.llm import repeated_passages as R


def brute(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k:k + length]] = seen.get(b[k:k + length], 0) + 1
    out = []
    for t in texts:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                cut[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if cut[k] and (k == 0 or not cut[k - 1]))
        out.append((len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest()))
    return out


def check(spark, texts, length=R.LENGTH, **options):
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, dk long, spans long")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in R.remove_repeats(df.repartition(5), length=length, **options).collect()}
    want = brute(texts, length)
    assert got == dict(enumerate(want)), [(i, got.get(i), w) for i, w in enumerate(want) if got.get(i) != w][:4]


def sample(rnd):
    letters = "abcdefgh éü\n"
    word = lambda n: "".join(rnd.choices(letters, k=n))
    passages = [word(rnd.choice([100, 390, 400, 401, 430, 800, 2500])) for _ in range(12)]
    texts = [None, "", "x", "a" * 399, "a" * 400, "b" * 401, "ab" * 1000, word(20_000)]
    for _ in range(60):
        texts.append("".join(word(rnd.randint(0, 300)) + (rnd.choice(passages)[rnd.randint(0, 40):]) for _ in range(rnd.randint(1, 4))))
    return texts + texts[20:23]


def test_planted_passages(spark):
    check(spark, sample(random.Random(3)))


def test_large_groups_are_split(spark):
    check(spark, sample(random.Random(4)), max_group=2)


def test_other_length(spark):
    check(spark, sample(random.Random(5))[:40], length=64, gram=16)


def test_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert R.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    rnd = random.Random(6)
    t = "".join(rnd.choices("abcdef", k=500))
    df = spark.createDataFrame([(1, t), (1, t), (None, t[:300]), (None, None)], schema)
    assert sorted(r.n_removed for r in R.remove_repeats(df).collect()) == [0, 0, 500, 500]


def test_whole_table(spark):
    from fleetscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_repeated_passages"](spark, sf).collect()}
    assert got == dict(zip([d.doc_id for d in docs], brute([d.text for d in docs], 400)))
