"""Line dedup against a brute-force comparison of all pairs of lines."""
import random

import duckdb
import pandas
import pytest

from fleetscope.llm import line_dedup as L


def within(a, b, k):
    """Within k edits, by the plain recurrence."""
    if abs(len(a) - len(b)) > k:
        return False
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    if a == b or k == 0:
        return a == b
    return within(a[1:], b[1:], k - 1) or within(a[1:], b, k - 1) or within(a, b[1:], k - 1)


def near(a, b, edits):
    return within(a, b, sum(min(len(a), len(b)) >= low for low in edits))


def brute(texts, edits=L.EDITS):
    """Removed lines of every text; lines within k edits share one of k + 1 parts of the shorter line, so only such pairs are compared."""
    first, order, out = {}, [], {}
    for i in sorted(texts):
        for k, line in enumerate((texts[i] or "").split("\n") if texts[i] is not None else []):
            if line.strip(" ") and line not in first:
                first[line] = (i, k)
                order.append(line)
    lengths, close = {}, set()
    for line in order:
        lengths.setdefault(len(line), []).append(line)
    rank = {line: n for n, line in enumerate(order)}
    for a in order:
        n, most = len(a), len(edits)
        pieces = [a[j * n // (most + 1):(j + 1) * n // (most + 1)] for j in range(most + 1)]
        for b in (b for longer in range(most + 1) for b in lengths.get(n + longer, [])):
            if a != b and any(x in b for x in pieces) and near(a, b, edits):
                close.add(max(a, b, key=rank.get))
    for i, t in texts.items():
        out[i] = [k for k, line in enumerate(t.split("\n") if t is not None else []) if line.strip(" ") and (first[line] != (i, k) or line in close)]
    return out


def check(spark, texts, edits=L.EDITS, texts_too=True):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in texts.items()], "doc_id long, text string, n_chars int, line string")
    got = {r.doc_id: r.removed for r in L.summary(df, edits=edits).collect()}
    want = brute(texts, edits)
    assert got == want, [(i, got.get(i), want[i], texts[i]) for i in want if got.get(i) != want[i]][:3]
    if not texts_too:
        return
    new = {r.doc_id: r.text for r in L.rewrite(df, edits=edits).collect()}
    for i, t in texts.items():
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(want[i]))
        assert new[i] == kept


def edited(rnd, letters, lengths):
    texts = {0: None, 1: "", 2: "\n \n\n", 3: "short\nshort\nshorx\nab\nac\nabcd\nabce", 4: "z" * 3000 + "\n" + "z" * 3001 + "\n" + "z" * 3004}
    seeds = ["".join(rnd.choices(letters, k=rnd.choice(lengths))) for _ in range(40)]
    for i in range(5, 90):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            s = rnd.choice(seeds)
            for _ in range(rnd.choice([0, 1, 2, 2, 3, 4])):
                k = rnd.randrange(len(s) + 1)
                s = rnd.choice([s[:k] + s[k + 1:], s[:k] + rnd.choice(letters) + s[k:], s[:k] + rnd.choice(letters) + s[k + 1:]])
            lines.append(s)
            if rnd.random() < 0.2:
                seeds.append(s)
        texts[i] = "\n".join(lines)
    return texts


@pytest.mark.parametrize("edits", [L.EDITS, (20,), (1, 12), (2, 6, 19)])
def test_edits_chains_and_edges(spark, edits):
    check(spark, edited(random.Random(2), "abcde é", [3, 5, 8, 19, 20, 21, 29, 31, 40, 90, 300] if len(edits) < 3 else [3, 7, 18, 20, 25]), edits, texts_too=edits == (20,))


def test_sql_counts_characters(spark):
    texts = edited(random.Random(5), "aé中 𝄞", [4, 6, 28, 30, 33, 60])
    con = duckdb.connect()
    con.register("documents", pandas.DataFrame({"doc_id": list(texts), "text": list(texts.values())}))
    got = {r[0]: list(r[4]) for r in con.sql(L.oracle_sql()).fetchall()}
    assert got == brute(texts)


def test_many_lines_around_one_line(spark):
    """Lines that are all within four edits of each other, by one and two edits from a line that comes last."""
    base = "the very same sentence stands in every copy of it"
    texts = {i: base[:i % 40] + "#" + base[i % 40 + 1:] if i < 40 else base[:i % 39] + "+*" + base[i % 39 + 2:] for i in range(79)}
    check(spark, {**texts, 1000: base}, texts_too=False)


def test_null_ids_repeated_rows_empty_table(spark):
    schema = "doc_id long, text string"
    assert L.summary(spark.createDataFrame([], schema)).count() == 0
    line = "one line that is long enough"
    df = spark.createDataFrame([(7, line), (7, line), (None, line + "!"), (8, line)], schema)
    got = sorted((r.doc_id or 0, r.n_same, r.n_near, r.removed) for r in L.summary(df).collect())
    assert got == [(0, 0, 0, []), (7, 0, 1, [0]), (7, 0, 1, [0]), (8, 0, 1, [0])]
    assert sorted(r.text for r in L.rewrite(df).collect()) == ["", "", "", line + "!"]


def test_marked_variants_are_not_shuffled_and_keys_of_bytes_fit(spark, tmp_path):
    """Settled lines carry a mark into their variants; keys cut from bytes equal those cut from characters."""
    from pyspark.sql import functions as F

    from fleetscope.llm import line_dedup as L
    text = "a line of thirty and more characters"
    spark.createDataFrame([(1, 2, 3, True, text, len(text), 6, 1, 2)], "h1 long, h2 long, first long, open boolean, line string, m int, blocks int, "
                          "c1 int, c2 int").write.parquet(f"{tmp_path}/rows")
    out = L._variants(spark.read.parquet(f"{tmp_path}/rows"), 2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("open").count() == out.count() > 0
    rows = L._measured(spark.createDataFrame([(text,)], "line string"))
    key = L._key(F.lit(len(text)), [], [(F.lit(3), F.lit(7), F.lit(0))])
    assert rows.select(key).first()[0] == rows.withColumn("raw", F.lit(None).cast("binary")).select(key).first()[0]


def test_lines_with_one_other_word_do_not_reach_the_variants(spark, monkeypatch):
    """Lines that differ in one word share keys of two blocks, but are no further cut than to blocks that show the difference."""
    rnd, posts, variants = random.Random(7), [], L._variants
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=8))
    base = [word() for _ in range(20)]
    texts = {i: " ".join(base[:i % 4 * 5] + [word()] + base[i % 4 * 5 + 1:]) for i in range(60)}

    def counted(rows, k):
        out = variants(rows, k)
        posts.append(out.count())
        return out
    monkeypatch.setattr(L, "_variants", counted)
    check(spark, texts, texts_too=False)
    assert sum(posts) <= 10 * len(texts), posts
