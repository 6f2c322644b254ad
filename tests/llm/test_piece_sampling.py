"""Sampled segmentations: exact round trips, lattice probabilities, reproducibility."""
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm import piece_sampling as P
from fleetscope.llm.common import default_tokenizer

V = P.pieces(default_tokenizer(), 1.0, 1000.0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=4), st.integers(0, 2**40))
def test_round_trip(texts, key):
    for t, ids in zip(texts, P.Sampler(V, 7)([key] * len(texts), texts)):
        assert P.decode_ids(ids.tolist(), V.surface) == t


def test_sampled_shares_equal_lattice_probabilities():
    unit = " theory"

    def paths(i):
        if i == len(unit):
            return {(): 1.0}
        out = {}
        for j in range(i + 1, len(unit) + 1):
            k = V.ids.get(unit[i:j])
            if k is not None:
                for p, w in paths(j).items():
                    out[(k, *p)] = w * np.exp(V.log[k])
        return out
    want = paths(0)
    total = sum(want.values())
    n = 40_000
    got = Counter(tuple(x.tolist()) for x in P.Sampler(V, 3)(range(n), [unit] * n))
    assert set(got) <= set(want)
    for path, w in want.items():
        share = w / total
        assert abs(got[path] / n - share) < 5 * np.sqrt(share / n) + 2e-4, path


def test_same_for_any_partitioning_and_edges(spark):
    rows = [(i, t, [1], "z") for i, t in enumerate([None, "", " ", "a▁b", "tab\tnew\nline  two", "😀é", "x" * 30_000, "word " * 20_000, "same", "same"])]
    df = spark.createDataFrame(rows + [(None, "no key", [1], "z")], "doc_id long, text string, ids array<int>, same string")
    a = {r.doc_id: r.ids for r in P.encode(df.repartition(1)).collect()}
    coded = P.encode(df.repartition(7), check_col="ok")
    b = {r.doc_id: r.ids for r in coded.collect()}
    assert a == b and a[0] is None and a[1] == []
    assert coded.where("ok").count() == len(rows) + 1 and coded.columns == ["doc_id", "text", "ids", "same", "ok"]
    back = {r.doc_id: r.again for r in P.decode(coded, text_col="again").collect()}
    assert back == {r[0]: r[1] for r in rows} | {None: "no key"}
    assert P.encode(df.limit(0)).count() == 0
    assert P.encode(df, seed=1).where("doc_id = 6").first().ids != a[6]


def test_whole_table(spark):
    from fleetscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op2_piece_sampling"](spark, sf).collect():
        assert r.lossless and r.n_pieces == len(r.ids) and P.decode_ids(r.ids, V.surface) == docs.pop(r.doc_id)
    assert not docs
