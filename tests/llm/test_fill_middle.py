"""Fill-in-the-middle: exact rank index, regex brute force on every document, restoring, odd rows."""
import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm import fill_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text):
    """The contract read literally, with a regular expression over code points."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < 80 else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if h4 % 100 < 80 else "psm", len(pre), len(mid), out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400), st.integers(0, 40))
def test_index_is_exact_and_bounded(steps, error):
    offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
    index = M.RankIndex.fit(offsets, error)
    assert [index(i) for i in range(len(offsets))] == offsets.tolist()
    assert np.abs(index.residual.astype(np.int64)).max() <= error + 1


def test_index_of_even_steps_is_one_segment():
    index = M.RankIndex.fit(np.arange(100_000) * 7, 2)
    assert len(index.first) == 1 and index.residual.dtype == np.int8 and index(99_999) == 699_993


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é😀\t\n\x0b\x0c\r\x85 <P>SM"), max_size=60))
def test_boundaries(text):
    offsets, at, want = M.boundaries(np.frombuffer(text.encode(), np.uint8)), 0, [0]
    for token in TOKEN.findall(text):
        at += len(token.encode())
        want.append(at)
    assert offsets.tolist() == want


def rows_of(df):
    done = M.restore(M.transform(df), text_col="restored")
    return {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text, r.restored) for r in done.collect()}


def test_odd_rows(spark):
    texts = [None, "", " ", "a", " a", "a ", "\t\n", "x" * 50_000, "wé \U0001f600 " * 20_000, "has <P> inside", "<", "a <S", "> b", "same text here", "same text here"]
    rows = [(i, t, "kept", 1, i) for i in range(40) for t in [texts[i % len(texts)]]] + [(None, "no key at all", "kept", 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int, `odd name` int")
    got = rows_of(df.repartition(3))
    for key, text, *_ in rows:
        assert got[key] == (*brute(key, text), text or ""), key
    assert rows_of(df.repartition(1)) == got
    out = M.transform(df)
    assert out.columns == ["doc_id", "text", "odd name", "n", "form", "prefix_chars", "middle_chars", "fim_text"]
    assert M.transform(df, keep_text=False).columns[:2] == ["doc_id", "odd name"]
    assert M.transform(df.limit(0)).count() == 0 and M.index(df.limit(0)).count() == 0


def test_stored_index_rebuilds_every_boundary(spark):
    df = spark.createDataFrame([(1, "one two  three " * 5000), (2, None), (3, "z" * 300 + " y")], "doc_id long, text string")
    for r in M.index(df, max_error=20).collect():
        text = {1: "one two  three " * 5000, 2: "", 3: "z" * 300 + " y"}[r.doc_id]
        index = M.RankIndex(np.array(r["first"]), np.array(r.base), np.array(r.slope), np.frombuffer(r.residuals, f"<i{r.width}"))
        want = M.boundaries(np.frombuffer(text.encode(), np.uint8))
        assert r.n == len(want) - 1 and [index(i) for i in range(len(want))] == want.tolist()


def test_whole_table(spark):
    from fleetscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    forms = set()
    for r in QUERIES["op11_fill_middle"](spark, sf).collect():
        text = docs.pop(r.doc_id) or ""
        n, form, prefix, middle, out = brute(r.doc_id, text)
        forms.add(form)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not docs and forms == {"plain", "psm", "spm"}
