"""The corpus pipeline against brute-force versions of its stages."""
import corpus_pipeline as C
import test_decontamination
import test_line_dedup
import test_ngram_join

from fleetscope.llm import piece_sampling as P
from fleetscope.llm import toxicity as T
from fleetscope.llm.common import default_tokenizer

SF = "/root/testdata/sf0.01"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = T.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in T.score(docs, chain).where("toxic").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    assert 0 < len(toxic) < 0.2 * (len(texts) + len(toxic))
    gone = test_line_dedup.brute(texts)
    texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[i])) for i, t in texts.items()}
    group = test_ngram_join.brute(texts)
    texts = {i: t for i, t in texts.items() if group[i][1] == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaks = {k[0] for k in test_decontamination.brute(texts, items)}
    texts = {i: t for i, t in texts.items() if i not in leaks}
    got = C.run(spark, SF)
    assert got.columns == [*docs.columns, "ids"]
    rows = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in rows.items()} == texts
    surface = P.pieces(default_tokenizer(), 1.0, 1000.0).surface
    assert all(P.decode_ids(r.ids, surface) == r.text and r.n_chars == len(r.text) for r in rows.values())


def test_stages_keep_columns_and_handle_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, None, "en", "s", None)], docs.schema)
    for name, step in C.STAGES[:-1]:
        for table in (odd, docs.limit(0)):
            out = step(spark, table, SF)
            assert out.columns == docs.columns and out.count() == table.count(), name
    assert C.encode(spark, odd, SF).count() == 3
