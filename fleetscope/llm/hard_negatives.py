"""Hard-negative mining by rotated one-bit codes with stored alignments.

Vectors are scaled and floored to integers. The rotated unit vector's signs (``EXPAND`` bits per component, a tall matrix with orthonormal
columns) are its code; turned back into the space of the vectors they give a unit code vector c. Stored per row: code, length of the vector,
alignment a = <c, o/|o|>, length of the turned-back signs. For a query q, <c, q> comes from population counts of the code against the
``PLANES`` bit planes of the rotated query, with a known rounding error d. With o/|o| = a c + r and r at right angles to c,

    | <q, o>/|o| - a <c, q> |  <=  a d + sqrt(1 - a^2) sqrt(|q|^2 - <c, q>^2)

by Cauchy-Schwarz, always, so rows whose interval cannot reach the present fifth score, or the band of a positive, are
dropped without loss; only the others are scored, as integers. The result is exact.

Rows are packed in blocks per dimension (a stored Parquet table). Anchors go block by block, ``CHUNK`` blocks a pass,
as a broadcast side of bounded size; each task keeps only the best few per anchor, so a pass emits (partitions x anchors x 5)
rows, whatever the sizes of the labels, and pairs are never rows of a plan. Two passes: positives, then negatives within the bands
that the positives' scores set.

Left out: null ids, null labels, null vectors, null or non-finite components. Vectors of different length never meet; zero vectors score 0;
empty vectors meet empty ones with 0. Of rows that share an id the smallest (label, vector) counts. Ties go to the smaller id.
An anchor without a row of its label, and a positive without a row in its band, give no rows. Scores beyond a long are compared
exactly (to 38 digits) and shown as the nearest long. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stage

BLOCK_ROWS, BLOCK_VALUES = 8192, 1 << 21     # most rows and components of a block
CHUNK = 8                    # blocks of anchors in one pass (16 M components)
EXPAND, PLANES = 4, 6
PAIRS = 1 << 20              # intervals worked on at once
LONG = 2**63 - 1
BLOCK = "dim int, block string, n int, ids binary, labels binary, kind string, vectors binary, codes binary, length binary, align binary, turned binary, bands string"


@functools.lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A (bits x dim) matrix with orthonormal columns; bits is a multiple of 64."""
    bits = -(-dim * (EXPAND if dim <= 256 else 1) // 64) * 64
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))[0]


def _codes(vectors: np.ndarray, seed: int):
    """Code words, length, alignment and length of the turned-back signs of every vector."""
    n, dim = vectors.shape
    if not dim:
        return np.zeros((n, 0), np.uint64), np.zeros(n), np.zeros(n), np.ones(n)
    turn = rotation(dim, seed)
    big = np.abs(vectors).max(axis=1)
    unit = vectors / np.where(big > 0, big, 1)[:, None]      # no overflow in the squares
    size = np.sqrt((unit * unit).sum(axis=1))
    unit /= np.where(size > 0, size, 1)[:, None]
    on = unit @ turn.T >= 0
    back = np.where(on, 1.0, -1.0) @ turn
    turned = np.sqrt((back * back).sum(axis=1))
    align = np.clip((unit * back).sum(axis=1) / turned, -1, 1)
    words = np.packbits(on.reshape(n, -1, 64), axis=2, bitorder="little").view(np.uint64).reshape(n, -1)
    return np.ascontiguousarray(words), size * big, align, turned


class Block:
    """Rows of one dimension, sorted by label; the vectors are integers in the narrowest type that holds them."""

    def __init__(self, row: dict):
        self.n, self.dim = row["n"], row["dim"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(self.n, self.dim)
        self.codes = np.frombuffer(row["codes"], np.uint64).reshape(self.n, -1)
        self.length, self.align, self.turned = (np.frombuffer(row[c]) for c in ("length", "align", "turned"))
        bands = json.loads(row["bands"])
        self.bands = np.array(bands, np.int64 if max((abs(x) for b in bands for x in b), default=0) <= LONG else object).reshape(self.n, -1)


def _pack(rows, seed: int) -> dict:
    """A block of (id, label, vector, scores of the positives)."""
    rows.sort(key=lambda r: r[:2][::-1])
    vectors = np.array([r[2] for r in rows], np.float64).reshape(len(rows), -1)
    top = np.abs(vectors).max(initial=0)
    kind = next((k for k in ("int8", "int16", "int32") if top <= np.iinfo(k).max), "float64")
    codes, length, align, turned = _codes(vectors, seed)
    width = max((len(r[3]) for r in rows), default=0)
    bands = [[*map(int, r[3]), *[-1] * (width - len(r[3]))] for r in rows]      # a negative score has an empty band
    return {"dim": vectors.shape[1], "block": f"{rows[0][0]}:{rows[-1][0]}:{len(rows)}", "n": len(rows),
            "ids": np.array([r[0] for r in rows], np.int64).tobytes(), "labels": np.array([r[1] for r in rows], np.int64).tobytes(),
            "kind": kind, "vectors": vectors.astype(kind).tobytes(), "codes": codes.tobytes(), "length": length.tobytes(),
            "align": align.tobytes(), "turned": turned.tobytes(), "bands": json.dumps(bands)}


def blocks(rows: DataFrame, scale: float, seed: int) -> DataFrame:
    """Blocks of rows (``id, label, vector array<double>, scores array<string>``), formed inside the partitions."""
    def run(batches):
        held, values = {}, 0
        for batch in batches:
            for key, label, vector, scores in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))):
                x = np.floor(vector.values.to_numpy(zero_copy_only=False) * scale)
                held.setdefault(len(x), []).append((key, label, x, scores))
                values += len(x) + 1
                if len(held[len(x)]) >= BLOCK_ROWS or values >= BLOCK_VALUES:
                    yield _batch([_pack(r, seed) for r in held.values()])
                    held, values = {}, 0
        if held:
            yield _batch([_pack(r, seed) for r in held.values()])

    return rows.select("id", "label", "vector", "scores").mapInArrow(run, BLOCK)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = {"dim": pa.int32(), "n": pa.int32(), "block": pa.string(), "kind": pa.string(), "bands": pa.string()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in rows[0]})


def intervals(queries: Block, q: slice, rows: Block, r: slice, seed: int):
    """Lowest and highest possible inner product of every query with every row (two matrices)."""
    if not rows.dim:
        return (np.zeros((q.stop - q.start, r.stop - r.start)),) * 2
    big = np.maximum(queries.length[q], 1e-300)
    turned = (queries.vectors[q] / big[:, None]) @ rotation(rows.dim, seed).T          # unit queries
    bottom = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - bottom) / (2**PLANES - 1), 1e-300)
    level = np.rint((turned - bottom[:, None]) / step[:, None]).astype(np.uint8)
    near = level * step[:, None] + bottom[:, None]
    error = np.abs(turned - near).sum(axis=1)
    total = near.sum(axis=1)
    planes = [np.packbits(((level >> b) & 1).reshape(len(level), -1, 64).astype(bool), axis=2, bitorder="little").view(np.uint64)
              .reshape(len(level), -1) for b in range(PLANES)]
    codes = rows.codes[r]
    hits = np.zeros((len(level), len(codes)), np.int32)
    ones = np.zeros(len(codes), np.int32)
    for w in range(codes.shape[1]):
        word = codes[:, w]
        ones += np.bitwise_count(word)
        for b, plane in enumerate(planes):
            hits += np.bitwise_count(plane[:, w, None] & word[None, :]).astype(np.int32) << b
    turned_back, align, length = rows.turned[r], rows.align[r], rows.length[r]
    dot = (2 * (hits * step[:, None] + ones[None, :] * bottom[:, None]) - total[:, None]) / turned_back[None, :]
    d = error[:, None] / turned_back[None, :]
    least = np.maximum(np.abs(dot) - d, 0)
    half = np.abs(align) * d + np.sqrt(np.maximum(1 - align * align, 0)) * np.sqrt(np.maximum(1 - least * least, 0)) + 1e-9
    scale = big[:, None] * length[None, :]
    return (align * dot - half) * scale - 1e-3, (align * dot + half) * scale + 1e-3


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows; Python integers where a long may be too small."""
    if not a.shape[1]:
        return np.zeros(len(a), np.int64)
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if bound < 2.0**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(a.tolist(), b.tolist())], object)


class Best:
    """The ``k`` best (score, id) of every slot."""

    def __init__(self, slots: int, k: int):
        self.k, self.fill = k, np.zeros(slots, np.int64)
        self.score, self.id = np.zeros((slots, k), object), np.zeros((slots, k), np.int64)
        self.bar = np.full(slots, -np.inf)                   # a lower score cannot enter

    def add(self, slot, score, key):
        if not len(slot):
            return
        touched = np.unique(slot)
        at, col = np.nonzero(np.arange(self.k)[None, :] < self.fill[touched][:, None])
        old = touched[at]
        slot, score, key = np.concatenate([slot, old]), np.concatenate([score.astype(object), self.score[old, col]]), np.concatenate([key, self.id[old, col]])
        order = _order(slot, score, key)
        slot, score, key = slot[order], score[order], key[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        ok = place < self.k
        self.score[slot[ok], place[ok]], self.id[slot[ok], place[ok]] = score[ok], key[ok]
        self.fill[touched] = np.minimum(np.diff(np.append(first, len(slot))), self.k)
        full = touched[self.fill[touched] == self.k]
        self.bar[full] = [float(x) * (1 - 1e-15 * np.sign(float(x))) for x in self.score[full, -1]]


def _order(slot, score, key):
    small = len(score) and max(abs(x) for x in (score.min(), score.max())) <= LONG
    if small:
        return np.lexsort((key, -score.astype(np.int64), slot))
    return np.array(sorted(range(len(slot)), key=lambda i: (slot[i], -score[i], key[i])), np.int64)


def _survivors(anchors: Block, q: slice, rows: Block, r: slice, keep):
    """Coordinates and exact scores of the pairs that ``keep`` (of the two interval ends) leaves."""
    i, j = np.nonzero(keep)
    i, j = i + q.start, j + r.start
    parts = [exact(anchors.vectors[i[s:s + 65536]], rows.vectors[j[s:s + 65536]]) for s in range(0, len(i), 65536)]
    return i, j, np.concatenate(parts) if parts else np.empty(0, np.int64)


def _slices(n: int, size: int, start: int = 0):
    return (slice(start + s, start + min(s + size, n)) for s in range(0, n, size))


def positives_of(anchors: Block, rows: Block, best: Best, seed: int):
    """Rows of the anchor's own label, the anchor left out."""
    for label in np.intersect1d(anchors.labels, rows.labels):
        a, b = np.searchsorted(anchors.labels, label), np.searchsorted(anchors.labels, label, "right")
        c, d = np.searchsorted(rows.labels, label), np.searchsorted(rows.labels, label, "right")
        for r in _slices(d - c, 2048, c):
            for q in _slices(b - a, max(1, PAIRS // (r.stop - r.start)), a):
                low, high = intervals(anchors, q, rows, r, seed)
                other = anchors.ids[q][:, None] != rows.ids[r][None, :]
                bar = best.bar[q]
                if r.stop - r.start > best.k:
                    low = np.where(other, low, -np.inf)
                    bar = np.maximum(bar, np.partition(low, -best.k, axis=1)[:, -best.k])
                i, j, score = _survivors(anchors, q, rows, r, other & (high >= bar[:, None]))
                best.add(i, score, rows.ids[j])


def negatives_of(anchors: Block, rows: Block, best: Best, low_pct: int, seed: int):
    """Rows of other labels within the band of a positive; slot = anchor x positive."""
    k = anchors.bands.shape[1]
    top = anchors.bands
    floor = np.where(top >= 0, top.astype(np.float64) * (low_pct / 100) * (1 - 1e-14) - 0.5, np.inf)
    ceiling = top.astype(np.float64) * (1 + 1e-14)
    for r in _slices(rows.n, 2048):
        for q in _slices(anchors.n, max(1, PAIRS // (r.stop - r.start))):
            low, high = intervals(anchors, q, rows, r, seed)
            keep = np.zeros(low.shape, bool)
            bar = best.bar.reshape(-1, k)
            for p in range(k):
                keep |= (high >= np.maximum(floor[q, p], bar[q, p])[:, None]) & (low <= ceiling[q, p][:, None])
            keep &= anchors.labels[q][:, None] != rows.labels[r][None, :]
            i, j, score = _survivors(anchors, q, rows, r, keep)
            for p in range(k):
                ps = top[i, p]
                ok = (low_pct * ps.astype(object) <= 100 * score.astype(object)) & (score <= ps) & (ps >= 0)
                ok = ok.astype(bool)
                best.add(i[ok] * k + p, score[ok], rows.ids[j[ok]])


def _search(table: DataFrame, anchors: DataFrame, k: int, seed: int, low_pct: int | None) -> DataFrame:
    """Best ``k`` rows of every anchor (``low_pct`` None) or of every anchor's band, per partition of ``table``.

    ``anchors`` is a stored table of blocks; it is broadcast ``CHUNK`` blocks at a time and every pass is stored.
    """
    spark, path = table.sparkSession, scratch_path(table.sparkSession, "mined")
    schema = "anchor_id long, place int, id long, score decimal(38,0)"

    def run(batches):
        state = {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(i)[n].as_py() for i, c in enumerate(batch.schema.names)}
                rows = Block({c: row[c] for c in names})
                if row["other_block"] not in state:
                    a = Block({c: row[f"other_{c}"] for c in names if c != "dim"} | {"dim": rows.dim})
                    state[row["other_block"]] = a, Best(a.n * (1 if low_pct is None else a.bands.shape[1]), k)
                a, best = state[row["other_block"]]
                if low_pct is None:
                    positives_of(a, rows, best, seed)
                elif a.bands.shape[1]:
                    negatives_of(a, rows, best, low_pct, seed)
        for a, best in state.values():
            slot, place = np.nonzero(np.arange(k)[None, :] < best.fill[:, None])
            width = len(best.fill) // a.n
            for s in range(0, len(slot), 50_000):
                x, y = slot[s:s + 50_000], place[s:s + 50_000]
                yield pa.RecordBatch.from_pydict({"anchor_id": a.ids[x // width], "place": pa.array(x % width, pa.int32()), "id": best.id[x, y],
                                                  "score": pa.array([_decimal(v) for v in best.score[x, y]], pa.decimal128(38, 0))})

    names = table.columns
    order = [r["block"] for r in anchors.select("dim", "block").orderBy("dim", "block").collect()]     # one short name per block
    for s in range(0, max(len(order), 1), CHUNK):
        part = anchors.where(F.col("block").isin(order[s:s + CHUNK])).select("dim", *[F.col(c).alias(f"other_{c}") for c in names if c != "dim"])
        met = table.join(F.broadcast(part), "dim").select(*names, *[f"other_{c}" for c in names if c != "dim"])
        met.mapInArrow(run, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _decimal(value):
    from decimal import Decimal
    return Decimal(max(-10**38 + 1, min(10**38 - 1, int(value))))


def _long(column: str):
    return F.when(F.col(column) > LONG, LONG).when(F.col(column) < -LONG - 1, -LONG - 1).otherwise(F.col(column)).cast("long")


def mine(rows: DataFrame, anchor, id_col="vec_id", label_col="label", vector_col="embedding", positives: int = 5, negatives: int = 5,
         low_pct: int = 80, scale: float = 256.0, seed: int = 7) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows that satisfy ``anchor`` (a condition on ``id``).

    A negative's score lies between ``low_pct`` percent of the positive's and the positive's.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    good = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.alias("vector"))
    good = (good.where("id is not null and label is not null and vector is not null")
            .where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(x * scale) < float("inf"))))
            .groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
            .select("id", "row.label", "row.vector", F.array().cast("array<string>").alias("scores")))
    good = stage(good, "vectors")
    table = stage(blocks(good, scale, seed), "blocks")
    first = stage(blocks(good.where(anchor), scale, seed), "anchors")
    window = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    near = (_search(table, first, positives, seed, None).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= positives)
            .select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("exact")))
    near = stage(near, "positives")
    scores = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", F.col("exact").cast("string").alias("score")))).alias("x"))
    banded = good.join(scores.select(F.col("anchor_id").alias("id"), F.col("x.score").alias("mine")), "id").select("id", "label", "vector", F.col("mine").alias("scores"))
    second = stage(blocks(banded, scale, seed), "banded")
    found = (_search(table, second, negatives, seed, low_pct).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives))
    return (found.join(near, ["anchor_id", "place"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), _long("exact").alias("positive_score"), _long("score").alias("negative_score")))


def mined(rows: DataFrame) -> DataFrame:
    """The query's rows: every vector whose id is divisible by 100 is an anchor; ids divisible by 7 have their label moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.expr("id % 100 = 0"))


def oracle_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.w, b.w)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.w) = len(b.w)),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""
