"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

Windows: wherever a five-word shingle of a benchmark item occurs in a document, the document's window of the item's length that
puts the shingle at its place in the item (clipped to the document); different places of one item give
different windows. Each window and item has a 64-bit SimHash over its weighted shingles
(weight: log(1 + items / items that hold the shingle); shingles of no item weigh as those of one).
Multi-index: a fingerprint is cut into ``radius + 1`` blocks, so two fingerprints within ``radius`` bits agree in a block; equal blocks
are joined and the Hamming distance is checked. The pairs are verified by the weighted Jaccard similarity of their shingle sets
(>= ``similarity``). At similarity 0.8 the expected distance is about 10 bits, with a deviation of 3; the radius of 20 is
more than three deviations above it.

Words are runs of characters other than space, tab, LF, VT, FF and CR, A-Z lower-cased. Items with fewer than five
words hold no shingle: with ``short_items`` they match the first window of exactly their words (hashes, then the words themselves are
compared; similarity 1, distance 0), without it nothing. Null and empty texts match nothing; null ids are kept in the result and, in ``remove``, their
contaminated rows go as well; repeated rows give one result row; ties of similarity go to the earliest window; an empty table
or benchmark gives no rows; extra columns are kept by ``remove``, helper columns have reserved names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage, words_of

WORDS, RADIUS, SIMILARITY, BITS = 5, 20, 0.8, 64
GRAMS = 1_000_000           # shingles of the benchmark that may be broadcast


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _runs(hashes: str, n: Column) -> Column:
    """The five word hashes of every shingle, in order."""
    return F.arrays_zip(*[F.slice(hashes, i + 1, F.greatest(n - (WORDS - 1), F.lit(0))).alias(f"w{i}") for i in range(WORDS)])


def _gram(run: str) -> Column:
    return F.xxhash64(*[F.col(run)[f"w{i}"] for i in range(WORDS)])


def shingles(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, n, pos, gram) of every five-word shingle."""
    w = rows.select(*keys, _hashes(words_of(F.col(text_col))).alias("__h")).withColumn("n", F.size("__h"))
    x = w.where(F.col("n") >= WORDS).select(*keys, "n", F.posexplode(_runs("__h", F.col("n"))).alias("pos", "g"))
    return x.select(*keys, "n", "pos", _gram("g").alias("gram"))


def _fingerprint(grams: str) -> str:
    """SQL: 64-bit SimHash of array<struct<gram, weight>>."""
    return (f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | if(aggregate({grams}, 0D, (s, x) -> s + "
            f"if((shiftrightunsigned(x.gram, b) & 1L) = 1L, x.weight, -x.weight)) > 0D, shiftleft(1L, b), 0L))")


def _blocks(radius: int) -> Column:
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.expr(
        f"shiftrightunsigned(print, {a}) & {(1 << (b - a)) - 1}L").alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def find(docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
         radius: int = RADIUS, similarity: float = SIMILARITY, short_items: bool = False) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n_words, similarity, distance): the best window per document and item."""
    found = _find_long(docs, bench, id_col, text_col, item_col, item_text_col, radius, similarity)
    if not short_items:
        return found
    # ids of items may repeat with other texts: the best window of an id, as among long items
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"), "n_words")).alias("m")
    return (found.unionByName(find_short(docs, bench, id_col, text_col, item_col, item_text_col))
            .groupBy("doc_id", "text_hash", "item_id").agg(best)
            .select("doc_id", "text_hash", "item_id", (-F.col("m.s")).alias("start"), "m.n_words", "m.similarity",
                    (-F.col("m.d")).alias("distance")))


def find_short(docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
               item_text_col="text") -> DataFrame:
    """The columns of ``find`` for the items of one to ``WORDS - 1`` words: the first place of all their words."""
    items = stage(bench.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
                  .where(F.size("words").between(1, WORDS - 1)).distinct()
                  .select("item_id", "words", F.size("words").alias("n_words"), F.xxhash64("words").alias("run")), "leak-short")
    sizes = [r[0] for r in items.select("n_words").distinct().collect()]          # at most WORDS - 1 numbers
    w = F.col("words")

    def run_at(n):
        return lambda i: F.struct(F.lit(n).alias("n_words"), i.alias("start"), F.xxhash64(F.slice(w, i + 1, F.lit(n))).alias("run"))

    runs = F.concat(F.array().cast("array<struct<n_words:int,start:int,run:bigint>>"), *[
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), run_at(n)) for n in sorted(sizes)])
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    if not sizes:
        d = d.limit(0)
    hits = (d.select("doc_id", "text_hash", F.col("words").alias("text_words"), F.explode(runs).alias("x"))
            .select("doc_id", "text_hash", "x.*", F.slice("text_words", F.col("x.start") + 1, F.col("x.n_words")).alias("found"))
            .join(small(items, GRAMS), ["n_words", "run"]).where(F.col("found") == F.col("words")))
    return hits.groupBy("doc_id", "text_hash", "item_id").agg(F.min(F.struct("start", "n_words")).alias("m")).select(
        "doc_id", "text_hash", "item_id", F.col("m.start").alias("start"), F.col("m.n_words").alias("n_words"),
        F.lit(1.0).alias("similarity"), F.lit(0).alias("distance"))


def _find_long(docs: DataFrame, bench: DataFrame, id_col, text_col, item_col, item_text_col, radius, similarity) -> DataFrame:
    items = bench.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    item_grams = stage(shingles(items.withColumn("item_hash", F.xxhash64("text")), ["item_id", "item_hash"], "text"), "leak-items")
    n_items = item_grams.select("item_id", "item_hash").distinct().count()
    held = item_grams.groupBy("gram").agg(F.count_distinct("item_id", "item_hash").alias("df"))
    weights = stage(held.select("gram", F.log1p(F.lit(float(n_items)) / F.col("df")).alias("weight")), "leak-weights")
    plain = F.lit(math.log1p(float(n_items)))
    prints = stage(item_grams.select("item_id", "item_hash", "gram").distinct().join(weights, "gram")
                   .groupBy("item_id", "item_hash").agg(F.sort_array(F.collect_list(F.struct("gram", "weight"))).alias("grams"))
                   .withColumn("print", F.expr(_fingerprint("grams"))), "leak-prints")

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    hits = (shingles(d, ["doc_id", "text_hash"], "text")
            .join(small(item_grams.select("gram", F.col("pos").alias("at"), F.col("n").alias("size")).distinct(), GRAMS), "gram"))
    start, end = F.greatest(F.col("pos") - F.col("at"), F.lit(0)), F.least(F.col("pos") - F.col("at") + F.col("size"), F.col("n"))
    windows = stage(hits.select("doc_id", "text_hash", start.alias("start"), (end - start).alias("n_words")).distinct()
                    .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n_words")).alias("windows")), "leak-windows")
    w = small(windows).alias("w")
    rows = (d.alias("d").join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")))
            .select("d.doc_id", "d.text_hash", _hashes(words_of(F.col("d.text"))).alias("h"), F.explode("w.windows").alias("x"))
            .select("doc_id", "text_hash", "x.start", "x.n_words", F.slice("h", F.col("x.start") + 1, F.col("x.n_words")).alias("h")))
    key = ["doc_id", "text_hash", "start", "n_words"]
    grams = rows.select(*key, F.explode(_runs("h", F.col("n_words"))).alias("g")).select(*key, _gram("g").alias("gram")).distinct()
    fingers = stage(grams.join(small(weights, GRAMS), "gram", "left").groupBy(*key)
                    .agg(F.sort_array(F.collect_list(F.struct("gram", F.coalesce("weight", plain).alias("weight")))).alias("grams"))
                    .withColumn("print", F.expr(_fingerprint("grams"))), "leak-fingers")
    left = fingers.select(*key, F.col("print").alias("w_print"), F.explode(_blocks(radius)).alias("b")).select(*key, "w_print", "b.block", "b.value")
    right = prints.select("item_id", "item_hash", F.col("print").alias("i_print"), F.explode(_blocks(radius)).alias("b")).select(
        "item_id", "item_hash", "i_print", "b.block", "b.value")
    near = left.join(small(stage(right, "leak-blocks"), GRAMS), ["block", "value"]).withColumn(
        "distance", F.bit_count(F.col("w_print").bitwiseXOR(F.col("i_print"))).cast("int")).where(F.col("distance") <= radius)
    near = near.select(*key, "item_id", "item_hash", "distance").distinct()
    f, p, x = fingers.alias("f"), prints.alias("p"), near.alias("x")
    pairs = (x.join(f, F.col("x.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("x.text_hash") == F.col("f.text_hash"))
                    & (F.col("x.start") == F.col("f.start")) & (F.col("x.n_words") == F.col("f.n_words")))
             .join(p, F.col("x.item_id").eqNullSafe(F.col("p.item_id")) & (F.col("x.item_hash") == F.col("p.item_hash")))
             .select("x.*", F.col("f.grams").alias("a"), F.col("p.grams").alias("b")))
    total = "aggregate({0}, 0D, (s, g) -> s + g.weight)"
    both = F.expr("aggregate(filter(a, g -> array_contains(transform(b, y -> y.gram), g.gram)), 0D, (s, g) -> s + g.weight)")
    pairs = pairs.withColumn("both", both).withColumn("similarity", F.col("both") / (
        F.expr(total.format("a")) + F.expr(total.format("b")) - F.col("both"))).where(F.col("similarity") >= similarity - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"), "n_words")).alias("m")
    return pairs.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", (-F.col("m.s")).alias("start"), "m.n_words", "m.similarity", (-F.col("m.d")).alias("distance"))


def remove(docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage."""
    bad = find(docs, bench, id_col, text_col, **options).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash"))
    return docs.join(bad, on, "left_anti")
