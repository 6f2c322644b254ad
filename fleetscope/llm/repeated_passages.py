"""Removal of byte strings of ``length`` bytes (400) that start anywhere else in the collection.

Every byte covered by a 400-byte string that occurs at least twice (in one
document or in several, overlaps counted) is removed. Strings never cross documents
and are judged on the input.

Method (README: why not column by column over whole documents): *anchors* are the positions whose 32-byte hash is
the smallest of all 32-byte hashes in some 400-byte string, so every 400-byte string holds an anchor that depends on
its bytes alone, and equal strings meet at equal anchors. For an anchor the strings that contain it start 0..368 bytes
before it; they form two ranges. All strings of a range share a core (the key) and lie in a neighbourhood (the context).

1. Keys that occur once are dropped (partial aggregation, then a join that AQE can split).
2. Occurrences with equal contexts repeat all strings of their range.
3. Different contexts with one key are compared string by string, column by column over all starts of the range; the
   strings of a group meet as hashes. Groups of more than ``max_group`` contexts are split first: the range is halved,
   which lengthens the keys and shortens the contexts (equal ones repeat all strings of their half and go on as one),
   until groups are small or the key is the whole string.
4. Covered byte intervals go back to the documents (keyed by id and text) and are cut out.

Keys, contexts and strings are compared by 64-bit hashes of their bytes.

Null texts are empty; texts under 400 bytes lose nothing; rows repeated with id and text count as separate documents,
so they remove each other; null ids keep their row; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, small, stage

LENGTH, GRAM, MAX_GROUP = 400, 32, 50_000
FLUSH = 8000               # contexts compared at once at least (whole groups)
ROWS = "key long, ctx long, dk long, pos int, side int"
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_TABLE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    if len(_POW[0]) < n + 1:
        m = max(n + 1, 2 * len(_POW[0]), 4096)
        for i, base in enumerate((_B, _BINV)):
            _POW[i] = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(m - 1, base, np.uint64)], dtype=np.uint64)
    return _POW


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(data: np.ndarray) -> np.ndarray:
    """p[i]: polynomial hash of the first i bytes; a substring's hash is (p[e] - p[s]) * BINV^s."""
    p = np.empty(len(data) + 1, np.uint64)
    p[0] = 0
    np.cumsum(_TABLE[data] * _powers(len(data))[0][:len(data)], out=p[1:])
    return p


def _sub(p, s, e):
    return (p[e] - p[s]) * _powers(len(p))[1][s]


def _window(op, x: np.ndarray, w: int) -> np.ndarray:
    """op over each window of w values."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.repeat(x[-1:], pad)]) if pad else x
    blocks = y.reshape(-1, w)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n - w + 1], left[w - 1:n])


def anchors(p: np.ndarray, length: int, gram: int) -> np.ndarray:
    n, w = len(p) - 1, length - gram + 1
    at = np.arange(n - gram + 1)
    h = _mix(_sub(p, at, at + gram))
    low = _window(np.minimum, h, w)                        # smallest hash of each string
    pad = np.zeros(w - 1, np.uint64)
    best = _window(np.maximum, np.concatenate([pad, low, pad]), w)      # largest of those of the strings around i
    return np.flatnonzero(best == h)


def _ranges(length: int, gram: int):
    last = length - gram
    return (0, last // 2), (last // 2 + 1, last)


def _occurrences(length: int, gram: int):
    """(key, ctx, dk, pos, side) for every anchor and range with a string inside the document."""
    def run(batches):
        for batch in batches:
            out = []
            for text, dk in zip(batch.column("text").cast(pa.binary()), batch.column("dk").to_pylist()):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
                n = len(data)
                if n < length:
                    continue
                p = _prefix(data)
                pos = anchors(p, length, gram)
                for side, (a, b) in enumerate(_ranges(length, gram)):
                    lo, hi = np.maximum(a, pos + length - n), np.minimum(b, pos)       # starts pos - o, o in lo..hi
                    at = pos[lo <= hi]
                    if not len(at):
                        continue
                    key = _mix(_sub(p, at - a, at + (length - b)) + np.uint64(side))
                    s, e = np.maximum(at - b, 0), np.minimum(at + length - a, n)
                    ctx = _mix(_sub(p, s, e) ^ _mix(key + (at - s).astype(np.uint64) * np.uint64(1 << 32) + (e - at).astype(np.uint64)))
                    out.append((key, ctx, np.full(len(at), dk, np.int64), at.astype(np.int32), np.full(len(at), side, np.int32)))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols],
                                                 names=["key", "ctx", "dk", "pos", "side"])
    return run


def _contexts(length: int, gram: int):
    """Bytes around chosen occurrences: (grp, ctx, a, b, left, bytes); left = bytes before the anchor."""
    schema = pa.schema([("grp", pa.int64()), ("ctx", pa.int64()), ("a", pa.int32()), ("b", pa.int32()),
                        ("left", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist()):
                data = memoryview(text.as_buffer())
                for w in wanted:
                    a, b = _ranges(length, gram)[w["side"]]
                    s = max(w["pos"] - b, 0)
                    rows.append((w["key"], w["ctx"], a, b, w["pos"] - s, bytes(data[s:w["pos"] + length - a])))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def _halves(length: int):
    """Split the range of each context: (grp, sub, ...) with a longer key and the context of the half (sub: its hash)."""
    schema = pa.schema([("grp", pa.int64()), ("ctx", pa.int64()), ("sub", pa.int64()), ("a", pa.int32()), ("b", pa.int32()),
                        ("left", pa.int32()), ("bytes", pa.binary())])

    def hashed(data, *salt):
        h = hashlib.blake2b(data, digest_size=8, key=b"".join((x & (2**64 - 1)).to_bytes(8, "little") for x in salt))
        return int.from_bytes(h.digest(), "little", signed=True)

    def run(batches):
        for batch in batches:
            out = []
            for g, ctx, a, b, left, data in zip(*(batch.column(c).to_pylist() for c in ("grp", "ctx", "a", "b", "left", "bytes"))):
                m = (a + b) // 2
                for lo, hi in ((a, m), (m + 1, b)):
                    if lo > hi or max(lo, left + length - len(data)) > min(hi, left):
                        continue
                    s = max(left - hi, 0)
                    part = data[s:left + length - lo]
                    out.append((hashed(data[left - lo:left + length - hi], g, lo, hi), ctx, hashed(part, left - s), lo, hi, left - s, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def _compare(length: int):
    """Of contexts sorted by group: (ctx, start, end) of repeated strings, relative to the anchor, runs merged."""
    schema = pa.schema([("ctx", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
    top = _powers(length)[0][length - 1]

    def solve(rows):
        group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1].astype(np.uint64)
        n, left = np.array([len(r[5]) for r in rows]), np.array([r[4] for r in rows])
        data = np.zeros((len(rows), n.max()), np.uint8)
        for i, r in enumerate(rows):
            data[i, :n[i]] = np.frombuffer(r[5], np.uint8)
        lo = np.maximum(np.array([r[2] for r in rows]), left + length - n)
        hi = np.minimum(np.array([r[3] for r in rows]), left)
        first, last = int(lo.min()), int(hi.max())
        cover = np.zeros((len(rows), last - first + 1), np.int8)
        h, pw = np.zeros(len(rows), np.uint64), _powers(length)[0][:length]
        for o in range(first, last + 1):                  # one column of starts per round, each one byte further left
            new = np.flatnonzero(lo == o)
            for k in range(0, len(new), 2000):
                r = new[k:k + 2000]
                h[r] = (_TABLE[data[r[:, None], (left[r] - o)[:, None] + np.arange(length)]] * pw).sum(axis=1, dtype=np.uint64)
            r = np.flatnonzero((lo < o) & (o <= hi))
            s = left[r] - o
            h[r] = _TABLE[data[r, s]] + _B * (h[r] - _TABLE[data[r, s + length]] * top)
            r = np.flatnonzero((lo <= o) & (o <= hi))
            key = _mix(h[r] ^ _mix(group[r]))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            cover[r[order[1:][same]], o - first] = 1
            cover[r[order[:-1][same]], o - first] = 1
        edge = np.diff(np.pad(cover, ((0, 0), (1, 1))), axis=1)
        i, start = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        ids = np.array([r[1] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array((-(first + end - 1)).astype(np.int32)),
                                           pa.array((length - (first + start)).astype(np.int32))], schema=schema)

    def run(batches):
        rows, group = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "ctx", "a", "b", "left", "bytes"))):
                if row[0] != group and len(rows) >= FLUSH:
                    yield solve(rows)
                    rows = []
                group = row[0]
                rows.append(row)
        if rows:
            yield solve(rows)
    return run


def _cut(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        for batch in batches:
            out = []
            for i, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("spans")):
                data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                runs = []
                if spans.is_valid and len(spans):
                    lo = spans.values.field("lo").to_numpy(zero_copy_only=False)
                    hi = spans.values.field("hi").to_numpy(zero_copy_only=False)
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                    runs = list(zip(lo[new].tolist(), hi[np.r_[new[1:] - 1, len(hi) - 1]].tolist()))
                sha, at = hashlib.sha256(), 0
                for s, e in runs:
                    sha.update(data[at:s])
                    at = e
                sha.update(data[at:])
                out.append((i, len(data), sum(e - s for s, e in runs), len(runs), sha.hexdigest(),
                            [{"start": s, "end": e} for s, e in runs]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """(dk, spans): repeated byte intervals per different (id, text); ``docs`` has doc_id, text and dk."""
    spark = docs.sparkSession
    occ = docs.select("text", "dk").mapInArrow(_occurrences(length, gram), ROWS)
    keys = stage(occ.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "passage-keys")
    hits = stage(occ.join(small(keys, 2_000_000), "key"), "passage-hits")
    contexts = hits.groupBy("key", "ctx", "side").agg(F.count(F.lit(1)).alias("mult"), F.min(F.struct("dk", "pos")).alias("at"))
    contexts = stage(contexts, "passage-contexts")
    sizes = stage(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "passage-sizes")
    bytes_type = "grp long, ctx long, a int, b int, left int, bytes binary"

    def with_bytes(keys):
        wanted = stage(contexts.join(keys, "key").groupBy("at.dk").agg(
            F.collect_list(F.struct("key", "ctx", "side", F.col("at.pos").alias("pos"))).alias("wanted")), "passage-wanted")
        near = docs.join(small(wanted.select("dk")), "dk", "left_semi")
        return near.join(wanted, "dk").select("text", "wanted").mapInArrow(_contexts(length, gram), bytes_type)

    def compared(rows):
        rows = rows.select("grp", "ctx", "a", "b", "left", "bytes")
        return stage(rows.repartition(parts(spark), "grp").sortWithinPartitions("grp")
                     .mapInArrow(_compare(length), "ctx long, lo int, hi int"), "passage-found")

    part = compared(with_bytes(sizes.where(F.col("c") <= max_group).select("key")))
    large = sizes.where(F.col("c") > max_group).select("key")
    if not large.isEmpty():
        rows = with_bytes(large)
        while True:
            rows = stage(rows.mapInArrow(_halves(length), "grp long, ctx long, sub long, a int, b int, left int, bytes binary"),
                         "passage-halves")
            subs = rows.groupBy("grp", "sub").agg(F.count(F.lit(1)).alias("mult"), F.min("ctx").alias("one"))
            groups = subs.groupBy("grp").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
            whole = rows.join(subs.where("mult > 1").select("grp", "sub"), ["grp", "sub"], "left_semi").select(
                "ctx", (-F.col("b")).alias("lo"), (F.lit(length) - F.col("a")).alias("hi"))
            ones = rows.join(subs.join(groups, "grp").select("grp", "sub", F.col("one").alias("ctx"), "c"), ["grp", "sub", "ctx"])
            part = part.unionByName(stage(whole, "passage-found")).unionByName(compared(ones.where(F.col("c") <= max_group)))
            rows = stage(ones.where(F.col("c") > max_group).select("grp", "ctx", "a", "b", "left", "bytes"), "passage-rows")
            if rows.isEmpty():
                break
    # contexts that occur again repeat all strings of their range
    ends = [F.struct(F.lit(-b).alias("lo"), F.lit(length - a).alias("hi")) for a, b in _ranges(length, gram)]
    full = hits.join(contexts.where("mult > 1").select("ctx"), "ctx", "left_semi").select(
        "dk", "pos", F.when(F.col("side") == 0, ends[0]).otherwise(ends[1]).alias("x"))
    some = hits.join(part, "ctx").select("dk", "pos", F.struct("lo", "hi").alias("x"))
    return (full.unionByName(some).select("dk", F.struct((F.col("pos") + F.col("x.lo")).cast("long").alias("lo"),
                                                         (F.col("pos") + F.col("x.hi")).cast("long").alias("hi")).alias("s"))
            .groupBy("dk").agg(F.collect_set("s").alias("spans")))


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, gram: int = GRAM,
                   max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row; ``spans``: removed byte intervals."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                    F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("dk"))
    spans = stage(covered(d, length, gram, max_group), "passage-spans")
    n = F.octet_length(F.coalesce("text", F.lit("")))
    clip = F.transform("spans", lambda s: F.struct(F.greatest(s["lo"], F.lit(0)).alias("lo"), F.least(s["hi"], n).alias("hi")))
    return (d.join(spans, "dk", "left").select("doc_id", "text", clip.alias("spans"))
            .mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                      "spans array<struct<start:long,end:long>>"))
