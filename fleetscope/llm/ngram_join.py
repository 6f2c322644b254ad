"""Exact n-gram Jaccard self-join of documents with set-relation skipping.

A document's set holds its distinct word 5-grams (all its words as one gram if it
has fewer; nothing for a document without words). Words are runs of characters
other than space, tab, LF, VT, FF and CR, with A-Z lower-cased. Two documents link
when 100 * |A n B| >= 80 * |A u B| (``threshold`` = 80).

How the work is cut down without losing a link:

* *Equal sets* are one node (set id = 64-bit hash of the sorted gram hashes);
  only one document per set goes on, copies follow its class.
* *Index lists.* Each set posts its first ``n - ceil(t n) + 1`` grams in one global
  order (grams that many documents share last), so similar sets meet in a list.
  Grams seen by one set only are dropped while the sorted lists stream by.
* *Answer-level skipping.* In each list the set with the most shared postings is
  the leader; every set is checked against the leader it meets most often. Sets
  verified against the same leader are connected and need no further pairs; a
  set's overlap with a member ``y`` of leader ``l`` is bounded by
  ``o(x,l) + o(y,l) - |l| <= o(x,y) <= o(x,l) + |y| - o(y,l)``, so many answers are
  derived from the leader's and only the undecided pairs are computed.
* *Index-level skipping.* Lists that still hold several components are cut into
  blocks by size and position; a block is skipped when its size range or the
  position bound ``1 + min(n_x - p_x, n_y - p_y) - 1`` cannot reach the needed overlap.
  Pairs inside a component are never produced. What is left is
  bounded by bucket sketches of the sets before texts are compared.

Overlaps are counted on 64-bit gram hashes of whole texts.

Null or blank texts have an empty set and link with nothing; null ids are given
a component of their own (null); rows repeated with one id share its component;
an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, parts, small, stage

WORDS, THRESHOLD = 5, 80
HOT_GRAMS = 200_000        # size of the table that orders the most frequent grams (the order never changes a result)
LOCAL_GRAMS = 2_000_000    # counted grams that a task holds at most between merges
BLOCK = 128
SKETCH_BITS, FOLDED_BITS = 4096, 256
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_CODES = _mix(np.arange(1, 257, dtype=np.uint64))    # of a byte; A-Z as a-z, the six blanks 0
_CODES[65:91] = _CODES[97:123]
_CODES[[9, 10, 11, 12, 13, 32]] = 0


def _word_hashes(text: bytes) -> np.ndarray:
    """Hash of every word: the sum over its bytes of the byte's code times an odd number for the place, mixed."""
    codes = _CODES[np.frombuffer(text, np.uint8)]
    inside = codes != 0
    starts = np.flatnonzero(inside[1:] > inside[:-1]) + 1
    if len(codes) and inside[0]:
        starts = np.r_[0, starts]
    if not len(starts):
        return np.empty(0, np.uint64)
    codes, starts = codes[starts[0]:], starts - starts[0]
    length = np.diff(starts, append=len(codes))
    place = np.arange(len(codes)) - np.repeat(starts, length)
    odd = _mix(np.arange(1, length.max() + 1, dtype=np.uint64)) | np.uint64(1)
    return _mix(np.add.reduceat(codes * odd[place], starts))


class Grams:
    """Sorted distinct gram hashes of a text (UTF-8 bytes)."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def __call__(self, text: bytes | None) -> np.ndarray:
        h, k = _word_hashes(text or b""), self.words
        if not len(h):
            return h
        if len(h) < k:
            out = _mix(h[:1] + np.uint64(len(h)))
            for x in h[1:]:
                out = _mix(out + x)
            return out
        n = len(h) - k + 1
        out = _mix(h[:n])
        for i in range(1, k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
        out.sort()
        return out[np.r_[True, out[1:] != out[:-1]]]


def _utf8(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def _set_id(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64)))


def _merge(tokens, counts):
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
    return tokens[first], np.add.reduceat(counts, first) if len(first) else counts


def _survey(words: int):
    """kind 0: (doc_id, text_hash, n, set_id) per row; kind 1: (gram, count) of grams that are frequent in the task."""
    def run(batches):
        grams, seen = Grams(words), set()
        held_t, held_c, new, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def fold():
            nonlocal held_t, held_c, new, size
            if new:
                u, c = np.unique(np.concatenate(new), return_counts=True)
                held_t, held_c = _merge(np.concatenate([held_t, u]), np.concatenate([held_c, c]))
                new, size = [], 0
                while len(held_t) > LOCAL_GRAMS:          # lossy counting: the rarest go first
                    keep = held_c > held_c.min()
                    held_t, held_c = held_t[keep], held_c[keep]

        for batch in batches:
            n, ids = [], []
            for text in _utf8(batch.column("text")):
                g = grams(text)
                s = _set_id(g) if len(g) else None
                n.append(len(g))
                ids.append(s)
                if s is not None and s not in seen:
                    seen.add(s)
                    new.append(g)
                    size += len(g)
                    if size > LOCAL_GRAMS:
                        fold()
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(n), pa.int32()), batch.column("doc_id"), batch.column("text_hash"),
                 pa.array(n, pa.int64()), pa.array(ids, pa.int64())], names=["kind", "doc_id", "text_hash", "n", "set_id"])
        fold()
        often = held_c >= 4
        if often.any():
            t, c = held_t[often].view(np.int64), held_c[often]
            null = pa.nulls(len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), np.int32)), null, null, pa.array(c), pa.array(t)],
                                             names=["kind", "doc_id", "text_hash", "n", "set_id"])
    return run


def _first(g: np.ndarray, p: int, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """First ``p`` of the sorted grams ``g`` in the global order: by hash, but those in ``hot`` last, by rank."""
    if not len(hot):
        return g[:p]
    at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
    late = hot[at] == g
    cold = g[~late][:p]
    return cold if len(cold) == p else np.r_[cold, g[late][np.argsort(rank[at[late]])[:p - len(cold)]]]


def _postings(words: int, threshold: int, hot):
    def run(batches):
        grams, seen = Grams(words), set()
        tokens, rank = hot.value
        for batch in batches:
            cols = [[], [], [], []]
            for text in _utf8(batch.column("text")):
                g = grams(text)
                if not len(g):
                    continue
                s = _set_id(g)
                if s in seen:
                    continue
                seen.add(s)
                n = len(g)
                p = n - -(-threshold * n // 100) + 1
                cols[0].append(_first(g, p, tokens, rank).view(np.int64))
                cols[1].append(np.full(p, s, np.int64))
                cols[2].append(np.full(p, n, np.int32))
                cols[3].append(np.arange(p, dtype=np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                                 names=["gram", "set_id", "n", "pos"])
    return run


def _shared(batches):
    """Of rows sorted by (gram, set_id): those whose gram at least two sets have, each once."""
    held, held_shared = None, False

    def out(a, keep):
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in a], names=["gram", "set_id", "n", "pos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "set_id", "n", "pos")]
        if held is not None:
            a = [np.concatenate([h, c]) for h, c in zip(held, a)]
        new = np.r_[True, (a[0][1:] != a[0][:-1]) | (a[1][1:] != a[1][:-1])]
        a = [c[new] for c in a]
        same = a[0][1:] == a[0][:-1]
        shared = np.r_[held_shared, same] | np.r_[same, False]
        held, held_shared = [c[-1:] for c in a], bool(shared[-1])
        if len(a[0]) > 1:
            shared[-1] = False
            yield out(a, shared)
    if held is not None and held_shared:
        yield out(held, np.array([True]))


def _needed(n_x, n_y, threshold):
    """Smallest overlap at which two sets of these sizes link."""
    return -(-threshold * (n_x + n_y) // (100 + threshold))


def _cross_pairs(threshold: int, block: int):
    """Of rows sorted by gram, size and position (with components): pairs of different components that the bounds allow."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32())])

    def ordered(ids, n, sketch, u, v):
        keep = _most(sketch[u], sketch[v], n[u], n[v]) >= _needed(n[u], n[v], threshold)
        u, v = u[keep], v[keep]
        swap = ids[u] > ids[v]
        u, v = np.where(swap, v, u), np.where(swap, u, v)
        return np.stack([ids[u], ids[v], n[u], n[v]])

    def short(gram, ids, n, pos, comp, sketch):
        """All lists of at most block rows at once: each row against the one d rows further."""
        n, pos, ids = n.astype(np.int64), pos.astype(np.int64), ids.astype(np.int64)
        for d in range(1, len(ids)):
            x, y = slice(0, len(ids) - d), slice(d, None)
            same = gram[x] == gram[y]
            if not same.any():
                return
            ok = (same & (n[x] * 100 >= threshold * n[y]) & (comp[x] != comp[y])
                  & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= _needed(n[x], n[y], threshold)))
            u = np.flatnonzero(ok)
            if len(u):
                yield ordered(ids, n, sketch, u, u + d)

    def blocks(ids, n, pos, comp, sketch):
        ids, n, pos, comp = (c.astype(np.int64) for c in (ids, n, pos, comp))
        starts = range(0, len(ids), block)
        lo_n, hi_n = n[::block], [int(n[min(s + block, len(n)) - 1]) for s in starts]
        lo_p = [int(pos[s:s + block].min()) for s in starts]
        one = [int(comp[s]) if (comp[s:s + block] == comp[s]).all() else None for s in starts]
        for i, s in enumerate(starts):
            most = hi_n[i] * 100 // threshold                     # larger partners cannot link
            for j in range(i, bisect.bisect_right(lo_n, most)):
                if one[i] is not None and one[i] == one[j]:
                    continue
                if min(hi_n[i] - lo_p[i], hi_n[j] - lo_p[j]) < _needed(int(lo_n[i]), int(lo_n[j]), threshold):
                    continue
                x, y = slice(s, s + block), slice(j * block, j * block + block)
                left = np.minimum((n[x] - pos[x])[:, None], (n[y] - pos[y])[None, :])
                ok = (left >= _needed(n[x][:, None], n[y][None, :], threshold)) & (comp[x][:, None] != comp[y][None, :])
                if i == j:
                    ok = np.triu(ok, 1)
                u, v = np.nonzero(ok)
                if len(u):
                    yield ordered(ids, n, sketch, u + s, v + j * block)

    def run(batches):
        done, held = [], None

        def flush():
            a = np.unique(np.concatenate(done, axis=1), axis=1)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1]), pa.array(a[2].astype(np.int32)),
                                               pa.array(a[3].astype(np.int32))], schema=schema)

        def lists(a):
            start = np.flatnonzero(np.r_[True, a[0][1:] != a[0][:-1]])
            size = np.diff(np.r_[start, len(a[0])])
            for s, k in zip(start[size > block], size[size > block]):
                yield from blocks(*(c[s:s + k] for c in a[1:]))
            yield from short(*(c[np.repeat(size <= block, size)] for c in a))

        for batch in batches:
            if not batch.num_rows:
                continue
            a = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "set_id", "n", "pos", "comp")]
            a.append(np.frombuffer(b"".join(batch.column("folded").to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            if held is not None:
                a = [np.concatenate([h, c]) for h, c in zip(held, a)]
            last = int(np.searchsorted(a[0], a[0][-1]))
            held = [c[last:] for c in a]
            if last:
                for found in lists([c[:last] for c in a]):
                    done.append(found)
                    if sum(d.shape[1] for d in done) > 500_000:
                        yield flush()
        if held is not None:
            for found in lists(held):
                done.append(found)
                if sum(d.shape[1] for d in done) > 500_000:
                    yield flush()
        if done:
            yield flush()
    return run


def _overlaps(words: int):
    def run(batches):
        grams, last = Grams(words), (None, None)
        for batch in batches:
            out = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), _utf8(batch.column("text_a")), _utf8(batch.column("text_b"))):
                if last[0] != a:
                    last = (a, grams(ta))
                out.append(len(np.intersect1d(last[1], grams(tb), assume_unique=True)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "n_a", "n_b")] + [pa.array(out, pa.int64())],
                                             names=["a", "b", "n_a", "n_b", "overlap"])
    return run


def _sketched(words: int):
    """(set_id, text, sketch, folded): which of SKETCH_BITS (FOLDED_BITS) hash buckets hold a gram of the set."""
    def run(batches):
        grams = Grams(words)
        for batch in batches:
            out = []
            for text in _utf8(batch.column("text")):
                bits = np.zeros(SKETCH_BITS, bool)
                bits[grams(text) & np.uint64(SKETCH_BITS - 1)] = True
                out.append((np.packbits(bits).tobytes(), np.packbits(bits.reshape(-1, FOLDED_BITS).any(axis=0)).tobytes()))
            full, folded = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), batch.column("text"), pa.array(full, pa.binary()), pa.array(folded, pa.binary())],
                                             names=["set_id", "text", "sketch", "folded"])
    return run


def _most(a, b, n_a, n_b):
    """Upper bound of the overlap of sets with these sketches (rows of uint8 or uint64) and sizes."""
    return np.minimum(n_a - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64),
                      n_b - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))


def _possible(threshold: int):
    """Pairs whose sketches allow a link: every bucket that only one set fills holds a gram the other lacks."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_a", "n_b"))
            keep = pa.array(_most(a, b, n_a, n_b) >= _needed(n_a, n_b, threshold))
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(keep)
    return run


def possible(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    sketch = texts.select("set_id", "sketch")
    return (pairs.join(sketch.toDF("b", "sketch_b"), "b").join(sketch.toDF("a", "sketch_a"), "a")
            .select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
            .mapInArrow(_possible(threshold), "a long, b long, n_a int, n_b int"))


def verify(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of set pairs; ``texts``: (set_id, text), one row per set."""
    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    return (pairs.select("a", "b", "n_a", "n_b").join(right, "b").join(left, "a")
            .select("a", "b", "n_a", "n_b", "text_a", "text_b")
            .mapInArrow(_overlaps(words), "a long, b long, n_a int, n_b int, overlap long"))


def linked(threshold: int):
    return 100 * F.col("overlap") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("overlap"))


def _hot(spark, survey: DataFrame):
    """Broadcast (grams, ranks): a table of at most HOT_GRAMS frequent grams, rarest first."""
    top = (survey.where("kind = 1").groupBy("set_id").agg(F.sum("n").alias("c"))
           .orderBy(F.desc("c"), "set_id").limit(HOT_GRAMS).collect())       # a table of fixed size
    tokens = np.array([r.set_id for r in top], np.int64).view(np.uint64)
    rank = len(top) - 1 - np.arange(len(top))
    order = np.argsort(tokens)
    return spark.sparkContext.broadcast((tokens[order], rank[order]))


def _leader_pairs(shared: DataFrame, threshold: int) -> DataFrame:
    """(a = leader, b, n_a, n_b): for each set in shared lists the leader it meets most often."""
    weight = shared.groupBy("set_id").agg(F.count(F.lit(1)).alias("w"))
    s = shared.join(weight, "set_id")
    leader = s.groupBy("gram").agg(F.max(F.struct("w", "set_id", "n", "pos")).alias("l"))
    met = (s.join(leader, "gram").where("set_id <> l.set_id")
           .select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("p_b"),
                   F.col("l.set_id").alias("a"), F.col("l.n").alias("n_a"), F.col("l.pos").alias("p_a"), F.col("l.w").alias("w"))
           .where(F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) * (100 + threshold)
                  >= threshold * (F.col("n_a") + F.col("n_b"))))
    count = met.groupBy("b", "n_b", "a", "n_a").agg(F.count(F.lit(1)).alias("c"), F.max("w").alias("w"))
    best = count.groupBy("b", "n_b").agg(F.max(F.struct("c", "w", "a", "n_a")).alias("x"))
    return best.select(F.col("x.a").alias("a"), "b", F.col("x.n_a").alias("n_a"), "n_b")


def _derive(pairs: DataFrame, checked: DataFrame, threshold: int) -> DataFrame:
    """``pairs`` with ``low`` and ``high`` bounds of the overlap, derived from overlaps with a common leader."""
    best = checked.select("b", "a", "overlap", "n_a")
    x = best.select(F.col("b").alias("a"), F.col("a").alias("l1"), F.col("overlap").alias("o_al"), F.col("n_a").alias("n_l"))
    y = best.select(F.col("b").alias("b"), F.col("a").alias("l2"), F.col("overlap").alias("o_bl"))
    j = pairs.join(x, "a", "left").join(y, "b", "left")
    same = F.col("l1") == F.col("l2")
    low = F.when(same, F.col("o_al") + F.col("o_bl") - F.col("n_l"))
    high = F.when(same, F.least(F.col("o_al") + F.col("n_b") - F.col("o_bl"), F.col("o_bl") + F.col("n_a") - F.col("o_al")))
    return j.select("a", "b", "n_a", "n_b", F.coalesce(low, F.lit(0)).alias("low"),
                    F.coalesce(high, F.least("n_a", "n_b")).alias("high"))


def join_classes(docs: DataFrame, id_col="doc_id", text_col="text", words: int = WORDS,
                 threshold: int = THRESHOLD, block: int = BLOCK) -> dict[str, DataFrame]:
    """``documents`` (doc_id, n, set_id) per row, ``sets`` (set_id, doc_id, n) and ``links`` (a, b, n_a, n_b, overlap) between sets.

    ``links`` spans the components: it holds every link between sets that were
    not connected before it was found, and connects exactly the sets that links connect.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    survey = stage(rows.mapInArrow(_survey(words), "kind int, doc_id long, text_hash long, n long, set_id long"), "ngram-survey")
    hot = _hot(spark, survey)
    post = rows.mapInArrow(_postings(words, threshold, hot), "gram long, set_id long, n int, pos int")
    shared = stage(post.repartition(parts(spark), "gram").sortWithinPartitions("gram", "set_id")
                   .mapInArrow(_shared, "gram long, set_id long, n int, pos int"), "ngram-shared")
    member = survey.where("kind = 0 and set_id is not null")
    rep = (member.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n")).alias("r"))
           .select("set_id", F.col("r.doc_id").alias("doc_id"), F.col("r.text_hash").alias("text_hash"), F.col("r.n").alias("n")))
    wanted = stage(rep.join(shared.select("set_id").distinct(), "set_id", "left_semi"), "ngram-wanted")
    w = small(wanted).alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))
    texts = rows.alias("d").join(w, same).select("w.set_id", "d.text")
    if not member.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["set_id"])                   # rows repeated with id and text
    texts = stage(texts.mapInArrow(_sketched(words), "set_id long, text string, sketch binary, folded binary"), "ngram-texts")
    checked = stage(verify(_leader_pairs(shared, threshold), texts, words), "ngram-leaders")
    links = checked.where(linked(threshold))
    comp = stage(components(links), "ngram-comp")
    rest = shared.join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn(
        "comp", F.coalesce("component_id", "set_id")).drop("component_id")
    mixed = rest.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
    rest = rest.join(mixed, "gram").join(texts.select("set_id", "folded"), "set_id").select("gram", "set_id", "n", "pos", "comp", "folded")
    cross = stage(rest.repartition(parts(spark), "gram").sortWithinPartitions("gram", "n", "pos")
                  .mapInArrow(_cross_pairs(threshold, block), "a long, b long, n_a int, n_b int").distinct(), "ngram-cross")
    both = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    bounds = stage(_derive(cross.join(both, ["a", "b"], "left_anti"), checked, threshold), "ngram-bounds")
    need = F.ceil(F.lit(threshold) * (F.col("n_a") + F.col("n_b")) / (100 + threshold))
    derived = bounds.where(F.col("low") >= need).select("a", "b", "n_a", "n_b", F.col("low").alias("overlap"))
    open_pairs = bounds.where((F.col("low") < need) & (F.col("high") >= need))
    open_pairs = stage(possible(open_pairs.select("a", "b", "n_a", "n_b"), texts, threshold), "ngram-open")
    late = stage(verify(open_pairs, texts, words).where(linked(threshold)), "ngram-late")
    return {"documents": survey.where("kind = 0").select("doc_id", "n", "set_id", "text_hash"), "sets": rep,
            "links": links.unionByName(derived).unionByName(late)}


def near_components(docs: DataFrame, id_col="doc_id", text_col="text", words: int = WORDS,
                    threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id): one row per row of ``docs``."""
    j = join_classes(docs, id_col, text_col, words, threshold, block)
    sets = j["sets"].select("set_id", F.col("doc_id").alias("first"))
    comp = stage(components(j["links"]), "ngram-components")       # by set id
    low = (comp.withColumnRenamed("id", "set_id").join(sets, "set_id").groupBy("component_id")
           .agg(F.min("first").alias("component")))
    by_set = (sets.join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").join(low, "component_id", "left")
              .select("set_id", F.coalesce("component", "first").alias("component_id")))
    return (j["documents"].join(by_set, "set_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
                    "set_id", "text_hash"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """``docs`` without the documents of a group other than that with the smallest id (null ids stay)."""
    near = near_components(docs, id_col, text_col, **options)
    drop = near.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(drop, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left_anti")
