"""Byte-level BPE against the library that the vocabulary was made for; queue order; round trips."""
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm import byte_bpe as B

V = B.vocabulary(B.default_vocabulary())
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=V.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70_000), st.integers(0, 9)), max_size=200))
def test_queue_pops_by_rank_then_position(entries):
    queue = B.RankQueue(70_001)
    for rank, position in entries:
        queue.push(rank, position)
    got = []
    while queue:
        got.append(queue.pop())
    assert got == sorted(entries) and not any(any(level) for level in queue.levels)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="aeb 'té\U0001f600\n1")), max_size=5))
def test_same_ids_as_the_library(texts):
    got = [x.tolist() for x in V.encode(texts)]
    assert got == [ENC.encode_ordinary(t) for t in texts]
    assert [V.decode(ids) for ids in got] == [t.encode() for t in texts]


def test_short_and_long_pieces_by_both_queues():
    rnd = random.Random(5)
    pieces = {"".join(rnd.choice("aeiourstnAEh") for _ in range(rnd.randrange(2, 60))).encode() for _ in range(3000)} | {b"a" * k for k in range(2, 60)}
    pieces = [p for p in pieces if p not in V.ranks]
    flat, size = V.merge_short(pieces)
    at = 0
    for piece, n in zip(pieces, size.tolist()):
        want = ENC._core_bpe.encode_single_piece(piece)
        assert flat[at:at + n].tolist() == want == V.merge_long(piece).tolist()
        at += n


@pytest.mark.parametrize("text", ["a" * 30_001, "ab" * 9_000, " " * 5_000, "é" * 4_000, "\U0001f600" * 4_000])
def test_very_long_pieces(text):
    assert V.encode([text, "x"])[0].tolist() == ENC.encode_ordinary(text)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(B, "MAX_KEPT", 3)
    monkeypatch.setattr(B, "CHUNK", 50)
    texts = [f"zqx{i} unword{i * 7} again" for i in range(50)]
    for t in texts + texts:
        assert V.encode([t])[0].tolist() == ENC.encode_ordinary(t)


def test_odd_rows(spark):
    texts = [None, "", " ", "same one", "same one", "\x00\x85 ", "word " * 50_000, "y" * 20_000, "\U0001f600é<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "mine", [7]) for i, t in enumerate(texts)] + [(None, "no key", "mine", None)],
                               "doc_id long, text string, `odd name` string, ids array<int>")
    coded = B.encode(df.repartition(4))
    assert coded.columns == ["doc_id", "text", "odd name", "ids"]
    got = {r.doc_id: (r.ids, r.decoded) for r in B.decode(coded).collect()}
    for i, t in [*enumerate(texts), (None, "no key")]:
        ids, back = got[i]
        assert (ids, back) == ((None, None) if t is None else (ENC.encode_ordinary(t), t.encode())), i
    assert B.encode(df.limit(0)).count() == 0 and B.decode(coded.limit(0)).count() == 0
    assert [r.n_tokens for r in B.digests(df.where("text is null")).collect()] == [0]


def test_another_vocabulary(spark):
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = "Zwei Wörter und 中文"
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.vocabulary(file).ranks, special_tokens={})
    df = spark.createDataFrame([(text,)], "text string")
    row = B.decode(B.encode(df, file=file), file=file).first()
    assert row.ids == other.encode_ordinary(text) and row.decoded.decode() == text


def test_whole_table(spark):
    from fleetscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op13_byte_bpe"](spark, sf).collect():
        text = docs.pop(r.doc_id) or ""
        ids = ENC.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not docs
