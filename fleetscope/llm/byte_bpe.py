"""Byte-level BPE encoding and decoding with a rank queue kept by a hierarchical bitmap.

A text is split by the vocabulary's pattern; each piece that is no vocabulary entry starts as a linked list of its bytes.
Neighbours whose joint bytes are an entry wait in the bucket of that entry's rank. One bit per bucket marks the filled ones, one bit per
64 bits of a level the filled words below it, so three find-first-set steps give the lowest filled rank; its leftmost position
is merged and the pairs with both neighbours are queued again. Entries whose pair has changed since are skipped.
Merged pairs only get longer, so a pair never returns to a rank it had, and one entry per (rank, position) is valid at most.

A long piece (it may be a whole text without blanks) has the queue to itself and takes O(n log n) steps. The short new pieces of
a chunk of texts share one queue: a bucket is taken whole, and the leftmost valid position of every piece in it is merged at once, which is the
order each piece would have alone. Ids of pieces are kept per worker, within ``MAX_KEPT`` pieces and ``CHUNK`` characters.

A row is worked on alone: no shuffle and no state. The vocabulary file is a parameter and read once per worker. Null texts have null
ids, empty texts none; null ids decode to null; repeated rows are encoded alike; an empty table gives no rows; new columns
replace columns of the same name.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections import defaultdict
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 4_000_000            # characters of texts encoded together (one longer text is a chunk of its own)
ROWS = 256                   # rows that go back at once, fewer where they hold MAX_IDS ids
MAX_IDS = 1_000_000
MAX_KEPT = 400_000           # pieces whose ids a worker keeps
SHORT = 64                   # bytes; a longer piece has the queue to itself


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class RankQueue:
    """Positions in buckets by rank, lowest rank first."""

    def __init__(self, ranks: int):
        self.levels, size = [], ranks
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets = {}

    def __bool__(self):
        return bool(self.buckets)

    def _open(self, rank: int) -> list:
        bucket = self.buckets[rank] = []
        for level in self.levels:
            word = rank >> 6
            was, level[word] = level[word], level[word] | 1 << (rank & 63)
            if was:
                break
            rank = word
        return bucket

    def _close(self, rank: int) -> list:
        bucket = self.buckets.pop(rank)
        for level in self.levels:
            level[rank >> 6] &= ~(1 << (rank & 63))
            if level[rank >> 6]:
                break
            rank >>= 6
        return bucket

    def lowest(self) -> int:
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        return rank

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        heappush(self._open(rank) if bucket is None else bucket, position)

    def pop(self) -> tuple[int, int]:
        """Leftmost position of the lowest rank."""
        rank = self.lowest()
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self._close(rank)
        return rank, position

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Unordered; for ``pop_all``."""
        get = self.buckets.get
        if len(ranks) > 1000:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts)):
                bucket = get(rank)
                (self._open(rank) if bucket is None else bucket).extend(part.tolist())
            return
        for rank, position in zip(ranks.tolist(), positions.tolist()):
            bucket = get(rank)
            (self._open(rank) if bucket is None else bucket).append(position)

    def pop_all(self) -> tuple[int, np.ndarray]:
        """All positions of the lowest rank, from left to right."""
        rank = self.lowest()
        positions = np.array(self._close(rank))
        positions.sort()
        return rank, positions


class Vocabulary:
    """Ranks of a vocabulary file; ``encode`` and ``decode`` texts."""

    def __init__(self, file: str):
        import public_tokenizers
        import regex
        with open(file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        get = self.ranks.get
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes[rank] = piece
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((left << 32 | right, rank) for piece, rank in self.ranks.items() for k in range(1, len(piece))
                       if (left := get(piece[:k], -1)) >= 0 and (right := get(piece[k:], -1)) >= 0)
        self.pair, self.pair_rank = (np.array(x, np.int64) for x in zip(*pairs))
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.queue = RankQueue(len(self.bytes))
        self._forget()

    def _forget(self):
        self.kept = defaultdict()                            # piece -> number
        self.kept.default_factory = self.kept.__len__
        self.flat, self.first, self.chars = np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def _joint(self, left, right):
        """Rank of the joint bytes of two tokens, -1 where they are no entry; a token of -1 joins with nothing."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], -1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece that is no entry."""
        n, get, surface, queue = len(piece), self.ranks.get, self.bytes, self.queue
        token = array("i", self.single[np.frombuffer(piece, np.uint8)].tolist())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        waits = array("i", [get(piece[i:i + 2], -1) for i in range(n - 1)] + [-1])      # rank of the pair that starts here
        for i, rank in enumerate(waits):
            if rank >= 0:
                queue.push(rank, i)
        while queue:
            rank, i = queue.pop()
            if waits[i] != rank:
                continue
            j = after[i]
            token[i], after[i] = rank, after[j]
            token[j] = waits[j] = waits[i] = -1
            right, left = after[i], before[i]
            if right < n:
                before[right] = i
                waits[i] = get(surface[rank] + surface[token[right]], -1)
                if waits[i] >= 0:
                    queue.push(waits[i], i)
            if left >= 0:
                waits[left] = get(surface[token[left]] + surface[rank], -1)
                if waits[left] >= 0:
                    queue.push(waits[left], left)
        out = np.frombuffer(token, np.int32)
        return out[out >= 0]

    def merge_short(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces that are no entries, one after the other, and their number per piece."""
        size, queue = np.fromiter(map(len, pieces), np.int64, len(pieces)), self.queue
        n = int(size.sum())
        owner = np.repeat(np.arange(len(pieces)), size)
        token = np.append(self.single[np.frombuffer(b"".join(pieces), np.uint8)], -1)       # slot n: beyond either end
        ends = np.cumsum(size)
        after, before = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n)
        after[ends - 1], before[ends - size] = n, n
        waits = np.append(self._joint(token[:n], token[after[:n]]), -1)
        at = np.flatnonzero(waits >= 0)
        queue.push_all(waits[at], at)
        while queue:
            rank, at = queue.pop_all()
            at = at[waits[at] == rank]
            if len(at) > 1:
                own = owner[at]
                later = np.append(False, own[1:] == own[:-1])
                if later.any():
                    rest = at[later]
                    queue.push_all(np.full(len(rest), rank), rest)
                    at = at[~later]
            if not len(at):
                continue
            gone = after[at]
            right, left = after[gone], before[at]
            token[at], after[at], before[right] = rank, right, at
            token[gone] = waits[gone] = -1
            joint = self._joint(np.concatenate([token[at], token[left]]), np.concatenate([token[right], token[at]]))
            starts = np.concatenate([at, left])
            waits[starts] = joint
            good = joint >= 0
            queue.push_all(joint[good], starts[good])
        alive = token[:n] >= 0
        return token[:n][alive].astype(np.int32), np.bincount(owner[alive], minlength=len(pieces))

    def _learn(self, known: int):
        """Ids of the pieces numbered from ``known`` on."""
        new = [p.encode("utf-8", "surrogatepass") for p in islice(self.kept, known, None)]
        whole = np.fromiter((self.ranks.get(p, -1) for p in new), np.int64, len(new))
        size, long = np.ones(len(new), np.int64), {}
        for k in [k for k, p in enumerate(new) if len(p) > SHORT and whole[k] < 0]:
            long[k] = self.merge_long(new[k])
            size[k] = len(long[k])
        short = whole < 0
        short[list(long)] = False
        if short.any():
            merged, size[short] = self.merge_short([new[k] for k in np.flatnonzero(short)])
        ends = np.cumsum(size)
        flat = np.empty(int(ends[-1]), np.int32)
        flat[(ends - size)[whole >= 0]] = whole[whole >= 0]
        if short.any():
            flat[np.repeat(short, size)] = merged
        for k, ids in long.items():
            flat[ends[k] - size[k]:ends[k]] = ids
        self.flat = np.concatenate([self.flat, flat])
        self.first = np.append(self.first, self.first[-1] + ends)
        self.chars += sum(map(len, new))

    def encode(self, texts: list) -> list:
        """Ids (32-bit) of every text; ``None`` for ``None``."""
        if len(self.kept) > MAX_KEPT or self.chars > CHUNK:
            self._forget()
        known, number = len(self.kept), self.kept.__getitem__
        pieces = [None if t is None else
                  np.array(array("i", map(number, self.split.findall(t) if len(t) <= CHUNK else (m.group() for m in self.split.finditer(t)))), np.int64)
                  for t in texts]
        if len(self.kept) > known:
            self._learn(known)
        return [None if p is None else self._gather(p) for p in pieces]

    def _gather(self, pieces: np.ndarray) -> np.ndarray:
        size = self.first[pieces + 1] - self.first[pieces]
        ends = np.cumsum(size)
        shift = np.repeat(self.first[pieces] - (ends - size), size)
        return self.flat[np.arange(len(shift)) + shift]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


def _packed(ids: list) -> pa.Array:
    """Lists of ids (None: null) as one Arrow column."""
    missing = pa.array([x is None for x in ids])
    sizes = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *[x for x in ids if x is not None]])
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat), mask=missing)


def _chunks(sizes, most: int, rows: int | None = None):
    """Ranges of rows whose sizes (or lengths of texts) sum to at most ``most``; a larger row is a range of its own."""
    if isinstance(sizes, pa.Array):
        sizes = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > most or rows and i - start == rows):
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def encode(docs: DataFrame, text_col="text", ids_col="ids", file: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with the ids of every text; ``keep_text=False`` leaves the texts out."""
    file = file or default_vocabulary()
    kept = [c for c in docs.columns if (keep_text or c != text_col) and c != ids_col]

    def run(batches):
        v = vocabulary(file)
        for batch in batches:
            for at, end in _chunks(batch.column(len(kept)), CHUNK):
                ids = v.encode(batch.column(len(kept)).slice(at, end - at).to_pylist())
                for i, j in _chunks([len(x) if x is not None else 0 for x in ids], MAX_IDS, ROWS):
                    part = batch.slice(at + i, j - i)
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], _packed(ids[i:j])], names=[*kept, ids_col])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"))
    return rows.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ids_col="ids", out_col="decoded", file: str | None = None) -> DataFrame:
    """``rows`` with the bytes of the ids (binary; null for null). An id outside the vocabulary is an error."""
    file = file or default_vocabulary()
    kept = [c for c in rows.columns if c != out_col]

    def run(batches):
        v = vocabulary(file)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = [v.decode(x.values.to_numpy()) if x.is_valid else None for x in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], pa.array(out, pa.binary())], names=[*kept, out_col])

    wide = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))
    return wide.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField(out_col, T.BinaryType())]))


def digests(docs: DataFrame) -> DataFrame:
    """The query's rows: count and digest of the ids, digest of the bytes decoded from them."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decode(encode(texts, keep_text=False))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
