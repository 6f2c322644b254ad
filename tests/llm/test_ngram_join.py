"""N-gram Jaccard join against a brute-force join and component search."""
import random
import re

from fleetscope.llm import ngram_join as J


def grams(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(texts):
    """texts: id -> text. Returns id -> (n, component)."""
    sets = {i: grams(t) for i, t in texts.items()}
    ids, index, root = sorted(sets), {}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in ids:
        cand = set()
        for g in sets[i]:
            cand |= index.get(g, set())
        for j in cand:
            k = len(sets[i] & sets[j])
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            index.setdefault(g, set()).add(i)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, texts, **options):
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in texts.items()],
                               "doc_id long, text string, n long, set_id long, a long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_components(df, **options).collect()}
    want = brute(texts)
    assert got == want, [(i, got[i], want[i]) for i in want if got.get(i) != want[i]][:5]


def test_families_chains_and_edges(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts, k = {}, 0

    def add(t):
        nonlocal k
        texts[k * 7 % 10007] = t
        k += 1
    common = " ".join(rnd.choices(vocab, k=40))
    for _ in range(25):
        base = rnd.choices(vocab, k=rnd.choice([6, 12, 60, 200]))
        add(" ".join(base))
        cur = base
        for _ in range(8):                       # copies, star edits and a drifting chain
            edit = list(base)
            for _ in range(rnd.randint(0, 4)):
                edit[rnd.randrange(len(edit))] = rnd.choice(vocab)
            add(" ".join(edit))
            cur = cur[1:] + [rnd.choice(vocab)]
            add(" \t".join(cur).upper())
        add(common + "\n" + " ".join(rnd.choices(vocab, k=20)))
    for t in (None, "", " \n\t", "a", "A", "a b", "a b c d", "a b c d e", "É b c d e", "é b c d e", "x " * 5000, "x " * 30):
        add(t)
    check(spark, texts)
    check(spark, texts, block=2)                 # every list of more than two sets goes through the block index


def test_whole_table(spark):
    from fleetscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_ngram_join"](spark, sf).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_empty_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert J.near_components(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f g"), (9, "z")], schema)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in J.near_components(df).collect())
    assert [g[:2] for g in got] == [(False, 2), (False, 4), (False, 4), (False, 9), (True, 0)]
    assert J.keep_one(df).count() == 5          # 2 of 3 shared grams: no link; equal ids stay
    same = spark.createDataFrame([(5, "q w e r t y u"), (3, "Q w e r t y u"), (None, "q w e r t y u")], schema)
    assert sorted(r.doc_id or 0 for r in J.keep_one(same).collect()) == [0, 3]


def test_grams_of_odd_texts():
    """Words as the pattern [^\\x20\\x09-\\x0D]+ gives them: NUL and non-ASCII blanks are letters, only A-Z is folded."""
    import re
    texts = ["", " \t\n\x0b\x0c\r ", "a", "A a", "\x00 \x00\x00 \x00a a", "\xa0x É é y", "ab ba aab aba baa b", "x " * 50,
             " lead", "trail ", "B" * 5000 + " " + "b" * 5001, "one two three four five", "ONE two\tthree\x1cfour five six"]
    grams, seen = J.Grams(), {}
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        want = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        got = grams(t.encode())
        assert len(got) == len(want) and list(got) == sorted(set(got.tolist())), t
        assert seen.setdefault(frozenset(want), tuple(got.tolist())) == tuple(got.tolist())
    assert len(set(seen.values())) == len(seen)
