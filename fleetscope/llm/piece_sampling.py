"""Sampled SentencePiece segmentations by forward filtering and backward sampling; decoding is lossless.

A text is cut into units (an optional space and the following run of non-blanks, or one blank). Over each unit lies
the lattice of all vocabulary pieces; characters without a piece of their own become byte pieces. With piece weights
``1 / (rank + offset)`` to the power ``alpha`` (the vocabulary file holds merge ranks, not probabilities), the forward pass
sums the weights of all segmentations up to every position; the backward pass draws, from the end of the unit, the last
piece in proportion to the weight of the segmentations it ends. So each segmentation has its lattice probability (to 2^-28 per draw).
Draws are a hash of (seed, row key, unit number, step): equal keys and texts get equal segmentations however the
rows are partitioned or retried. Forward tables are kept per worker for a bounded number of units; all units of a batch
are sampled together, one step per round.

A space is the vocabulary's U+2581; a U+2581 of the text itself goes through byte pieces, so decoding returns every text
exactly. Null texts have null ids; empty texts have none; null keys count as key 0; repeated rows are
segmented alike; an empty table gives no rows; new columns replace columns of the same name.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import default_tokenizer

UNIT = re.compile(r" ?\S+|\s")
TREE_BITS, DRAW_BITS = 20, 28
MAX_UNITS = 150_000          # forward tables that a worker keeps
ROWS = 256                   # rows segmented and sent back at once
MAX_DRAWS = 250_000        # units sampled at once
_G1, _G2, _G3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """Vocabulary: surface -> id, bytes of every id, weights."""

    def __init__(self, model: str, alpha: float, offset: float):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids, self.byte, self.surface, n = {}, {}, [], sp.vocab_size()
        self.log = [-alpha * math.log(i + offset) for i in range(n)]
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.ids[text] = i
                self.surface.append(text.encode())
        self.log = np.array(self.log)
        states, links = {"": 0}, {}
        for text in self.ids:                           # prefix tree of the pieces
            for k in range(1, len(text) + 1):
                if text[:k] not in states:
                    states[text[:k]] = len(states)
                    links[states[text[:k - 1]] << 21 | ord(text[k - 1])] = states[text[:k]]
        self.link = np.full(1 << TREE_BITS, -1, np.int64)      # open addressing: (state, character) -> state
        self.next = np.zeros(1 << TREE_BITS, np.int64)
        for key, state in links.items():
            at = int(self._slot(np.array([key]))[0])
            while self.link[at] >= 0:
                at = (at + 1) % len(self.link)
            self.link[at], self.next[at] = key, state
        self.piece = np.full(len(states), -1, np.int64)
        for text, i in self.ids.items():
            self.piece[states[text]] = i

    @staticmethod
    def _slot(key):
        return ((key.astype(np.uint64) * _G1) >> np.uint64(64 - TREE_BITS)).astype(np.int64)

    def step(self, state, char):
        """Child states, and which exist."""
        key = state << 21 | char
        at = self._slot(key)
        got = self.link[at]
        retry = np.flatnonzero((got != key) & (got >= 0))
        while len(retry):
            at[retry] = (at[retry] + 1) % len(self.link)
            got[retry] = self.link[at[retry]]
            retry = retry[(got[retry] != key[retry]) & (got[retry] >= 0)]
        found = got == key
        return self.next[at[found]], found


@functools.lru_cache(maxsize=4)
def pieces(model: str, alpha: float, offset: float) -> Pieces:
    return Pieces(model, alpha, offset)


class Sampler:
    """Edges of all units, by end node; ``cum``: running probability within the node, in units of 2^-DRAW_BITS."""

    def __init__(self, vocabulary: Pieces, seed: int):
        self.v, self.seed = vocabulary, np.uint64(seed & (2**64 - 1))
        self.bytes, self.byte_no = [], {}
        self.reset()

    def reset(self):
        self.units, self.nodes = {}, 0
        self.starts, self.ends = np.empty(0, np.int64), np.empty(0, np.int64)
        self.cum, self.prev, self.code, self.first = (np.empty(0, np.int32) for _ in range(4))

    def _byte_codes(self, chars):
        """Code of the byte pieces of characters without a piece, and the weight of the sequence."""
        different, back = np.unique(chars, return_inverse=True)
        code, log = np.empty(len(different), np.int64), np.empty(len(different))
        for k, c in enumerate(different.tolist()):
            ids = tuple(self.v.byte[b] for b in chr(c).encode("utf-8", "surrogatepass"))
            if ids not in self.byte_no:
                self.byte_no[ids] = len(self.bytes)
                self.bytes.append(ids)
            code[k], log[k] = -1 - self.byte_no[ids], self.v.log[list(ids)].sum()
        return code[back], log[back]

    def _add(self, units):
        """Forward pass over new units, all at once: edges by walking the prefix tree, weights position by position."""
        v, size = self.v, np.fromiter(map(len, units), np.int64, len(units))
        char = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(len(units)), size)
        left = np.cumsum(size)[unit] - np.arange(len(char))          # characters to the unit's end
        at, state, k, single, edges = np.arange(len(char)), np.zeros(len(char), np.int64), 0, np.zeros(len(char), bool), []
        while len(at):
            state, found = v.step(state, char[at + k])
            at, k = at[found], k + 1
            ends = v.piece[state] >= 0
            i, code = at[ends], v.piece[state[ends]]
            edges.append((i + unit[i], i + unit[i] + k, code, v.log[code]))
            if k == 1:
                single[i] = True
            more = left[at] > k
            at, state = at[more], state[more]
        i = np.flatnonzero(~single)
        if len(i):
            edges.append((i + unit[i], i + unit[i] + 1, *self._byte_codes(char[i])))
        start, end, code, log = (np.concatenate(c) for c in zip(*edges))
        base = np.concatenate([[0], np.cumsum(size + 1)])
        which = np.searchsorted(base, end, side="right") - 1
        level = end - base[which]
        order = np.lexsort((start, end, level))
        start, end, code, log, level = (c[order] for c in (start, end, code, log, level))
        total, p = np.zeros(base[-1]), np.empty(len(start))
        cut = np.searchsorted(level, np.arange(1, int(size.max()) + 2)) if len(level) else [0]
        for s, e in zip(cut[:-1], cut[1:]):
            w = total[start[s:e]] + log[s:e]
            first = np.flatnonzero(np.concatenate([[True], end[s + 1:e] != end[s:e - 1]]))
            many = np.diff(np.concatenate([first, [e - s]]))
            top = np.maximum.reduceat(w, first)
            x = np.exp(w - np.repeat(top, many))
            mass = np.add.reduceat(x, first)
            total[end[s:e][first]] = top + np.log(mass)
            p[s:e] = x / np.repeat(mass, many)
        order = np.lexsort((start, end))
        start, end, code, p = (c[order] for c in (start, end, code, p))
        first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        many = np.diff(np.concatenate([first, [len(end)]]))
        for r in range(1, int(many.max())):                  # running sums within each node
            i = first[many > r] + r
            p[i] += p[i - 1]
        cum = np.minimum(np.round(p * 2.0**DRAW_BITS), 2.0**DRAW_BITS).astype(np.int32)
        cum[first + many - 1] = 1 << DRAW_BITS
        at = np.zeros(base[-1], np.int32)
        at[end[first]] = first + len(self.cum)
        self.first = np.concatenate([self.first, at])
        self.units.update(zip(units, range(len(self.ends), len(self.ends) + len(units))))
        self.cum = np.concatenate([self.cum, cum])
        self.prev = np.concatenate([self.prev, (start + self.nodes).astype(np.int32)])
        self.code = np.concatenate([self.code, code.astype(np.int32)])
        self.starts = np.concatenate([self.starts, base[:-1] + self.nodes])
        self.ends = np.concatenate([self.ends, base[1:] - 1 + self.nodes])
        self.nodes += int(base[-1])

    def _draw(self, unit_no, row_seed, index):
        starts, ends = self.starts[unit_no], self.ends[unit_no]
        cum, prev, code = self.cum, self.prev, self.code
        node, live, steps, length, step = ends.copy(), np.arange(len(ends)), [], np.zeros(len(ends), np.int64), 0
        base = _mix(row_seed + index * _G1)
        while len(live):
            u = (_mix(base[live] + np.uint64(step * int(_G2) % 2**64)) >> np.uint64(64 - DRAW_BITS)).astype(np.int32)
            e = self.first[node[live]]
            over = np.flatnonzero(cum[e] <= u)
            while len(over):
                e[over] += 1
                over = over[cum[e[over]] <= u[over]]
            steps.append((live, code[e]))
            length[live] += 1
            node[live] = prev[e]
            live = live[prev[e] != starts[live]]
            step += 1
        first = np.concatenate([[0], np.cumsum(length)])
        out = np.empty(first[-1], np.int64)
        for s, (who, c) in enumerate(steps):
            out[first[who] + length[who] - 1 - s] = c
        width = np.ones(len(out), np.int64)
        odd = np.flatnonzero(out < 0)
        if len(odd):
            sizes = np.array([len(b) for b in self.bytes])
            width[odd] = sizes[-1 - out[odd]]
            flat = np.repeat(out, width)
            at = (np.cumsum(width) - width)[odd]
            for a, c in zip(at.tolist(), out[odd].tolist()):
                ids = self.bytes[-1 - c]
                flat[a:a + len(ids)] = ids
            out = flat
        per_unit = np.concatenate([[0], np.cumsum(width)])[first]
        return out.astype(np.int32), per_unit

    def __call__(self, keys, texts):
        """Segmentations of texts: one int32 array (None for None) each."""
        result, chunk, size = [], [], 0
        for key, text in zip(keys, texts):
            units = None if text is None else UNIT.findall(text)
            chunk.append((key, units))
            size += len(units or ())
            if size > MAX_DRAWS:
                result += self._segment(chunk)
                chunk, size = [], 0
        return result + self._segment(chunk)

    def _segment(self, chunk):
        if len(self.units) > MAX_UNITS:
            self.reset()
        new = dict.fromkeys(u for _, units in chunk for u in units or () if u not in self.units)
        if new:
            self._add(list(new))
        lookup = self.units.__getitem__
        n = [len(units or ()) for _, units in chunk]
        no = np.fromiter((lookup(u) for _, units in chunk for u in units or ()), np.int64, sum(n))
        keys = np.array([int(k or 0) & (2**64 - 1) for k, _ in chunk], np.uint64)
        seeds = np.repeat(_mix(_mix(keys * _G3 + self.seed) + _G2), n)
        first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        index = (np.arange(len(no)) - np.repeat(first[:-1], n)).astype(np.uint64)
        ids, per_unit = self._draw(no, seeds, index) if len(no) else (np.empty(0, np.int32), np.zeros(1, np.int64))
        return [None if units is None else ids[per_unit[first[i]]:per_unit[first[i + 1]]] for i, (_, units) in enumerate(chunk)]


def decode_ids(ids, surface) -> str:
    return b"".join([surface[i] for i in ids]).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, id_col="doc_id", text_col="text", model: str | None = None, seed: int = 0, alpha: float = 1.0,
           offset: float = 1000.0, ids_col="ids", check_col: str | None = None) -> DataFrame:
    """``docs`` with the sampled piece ids; ``check_col``: whether they decode to the text."""
    model = model or default_tokenizer()
    new = [c for c in (ids_col, check_col) if c]
    kept = [c for c in docs.columns if c not in new]
    at = kept.index(text_col)

    def run(batches):
        v = pieces(model, alpha, offset)
        sampler = Sampler(v, seed)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):         # small batches go back: ids outweigh the texts
                part = batch.slice(s, ROWS)
                texts = part.column(at).to_pylist()
                ids = sampler(part.column(len(kept)).to_pylist(), texts)
                missing = np.array([i is None for i in ids])
                size = np.concatenate([[0], np.cumsum([0 if i is None else len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate([i for i in ids if i is not None]) if not missing.all() else np.empty(0, np.int32)
                out = [pa.ListArray.from_arrays(pa.array(size), pa.array(flat), mask=pa.array(missing))]
                if check_col:
                    out.append(pa.array([i is None or decode_ids(i.tolist(), v.surface) == t for i, t in zip(ids, texts)]))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], *out], names=[*kept, *new])

    rows = docs.select(*kept, F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("__key"))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    if check_col:
        schema = schema.add(check_col, T.BooleanType())
    return rows.mapInArrow(run, schema).select(*docs.columns, *[c for c in new if c not in docs.columns])


def decode(rows: DataFrame, ids_col="ids", text_col="text", model: str | None = None) -> DataFrame:
    """``rows`` with the text of the ids (null for null)."""
    model = model or default_tokenizer()

    def run(ids):
        surface = pieces(model, 1.0, 1000.0).surface
        return pd.Series([None if i is None else decode_ids(i, surface) for i in ids], dtype=object)
    run.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    return rows.withColumn(text_col, F.pandas_udf(run, "string")(F.col(ids_col)))
