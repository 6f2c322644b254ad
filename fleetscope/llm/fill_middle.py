"""Fill-in-the-middle transformation with a learned rank index over token boundaries.

A text is cut into tokens (leading blanks with the following run of non-blanks; blanks at the end are a token of their
own). The byte offsets of all n + 1 boundaries form a sorted sequence; piecewise-linear segments, grown greedily while some
line through their first point stays within ``max_error`` of every boundary, map a boundary's rank to its offset. The
difference of each boundary from its prediction is stored in the narrowest integer type, so a lookup (find the segment,
predict, add the residual) is exact. Both cuts of a document are looked up in the index; ``index`` returns it as a table,
so the same texts can be cut again without another pass over them.

Cuts and form come from the first four 8-digit groups of the SHA-256 of ``seed:key``. A text that is empty or holds a
sentinel stays plain. A row is worked on alone: no shuffle, no state, memory of a few times one text.

Null texts count as empty; a null key counts as the empty string; repeated rows are cut alike; an empty table gives no
rows; blanks only are one token; new columns replace columns of the same name, other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
ROWS = 256                   # rows that go back at once
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundaries(data: np.ndarray) -> np.ndarray:
    """Byte offsets of the token boundaries of a text in UTF-8, 0 and the end included."""
    blank = BLANK[data]
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1 if len(data) else np.empty(0, np.int64)
    tail = [len(data)] if len(data) and blank[-1] else []
    return np.concatenate([[0], ends, tail]).astype(np.int64)


class RankIndex:
    """Rank -> offset: segments (first rank, offset there, slope) and one small residual per rank."""

    def __init__(self, first, base, slope, residual):
        self.first, self.base, self.slope, self.residual = first, base, slope, residual

    @classmethod
    def fit(cls, offsets: np.ndarray, max_error: int) -> RankIndex:
        first, slope, s, n = [], [], 0, len(offsets)
        while s < n:
            low, high, at, width = -np.inf, np.inf, s + 1, 64
            while at < n:                                    # points enter the cone in growing windows
                run = np.arange(1, min(width, n - at) + 1) + (at - 1 - s)
                rise = offsets[at:at + len(run)] - offsets[s]
                lows = np.maximum(np.maximum.accumulate((rise - max_error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + max_error) / run), high)
                out = np.flatnonzero(lows > highs)
                inside = int(out[0]) if len(out) else len(run)
                if inside:
                    low, high = lows[inside - 1], highs[inside - 1]
                at += inside
                if len(out):
                    break
                width *= 2
            first.append(s)
            slope.append((low + high) / 2 if at > s + 1 else 0.0)
            s = at
        first = np.array(first, np.int64)
        index = cls(first, offsets[first], np.array(slope), np.zeros(n, np.int8))
        gap = offsets - index._predict(np.arange(n))
        worst = int(np.abs(gap).max(initial=0))
        index.residual = gap.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if worst <= np.iinfo(t).max))
        return index

    def _predict(self, rank):
        k = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[k] + np.floor(self.slope[k] * (rank - self.first[k])).astype(np.int64)

    def __call__(self, rank: int) -> int:
        return int(self._predict(np.array([rank]))[0]) + int(self.residual[rank])

    def __len__(self):
        return len(self.residual)


def _bytes(column: pa.Array):
    """The texts of a column as byte arrays; null as empty."""
    for x in column.cast(pa.binary()):
        yield np.frombuffer(x.as_buffer() or b"", np.uint8) if x.is_valid else np.empty(0, np.uint8)


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _draws(seed: int, id_col: str):
    """The first four 8-digit groups of the SHA-256 of ``seed:key`` as longs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, id_col="doc_id", text_col="text", seed: int = 42, rate: int = 50, spm_rate: int = 80,
              max_error: int = 100, out_col="fim_text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``out_col`` (the rearranged text), ``n`` (tokens), ``form``, ``prefix_chars`` and ``middle_chars``.

    ``rate`` percent of the texts are rearranged, ``spm_rate`` percent of these in suffix-first order.
    """
    added = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
             T.StructField("middle_chars", T.LongType()), T.StructField(out_col, T.StringType())]
    names = [f.name for f in added]
    kept = [c for c in docs.columns if (keep_text or c != text_col) and c not in names]
    marks = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def cut(data, h1, h2, h3, h4):
        index = RankIndex.fit(boundaries(data), max_error)
        n, raw = len(index) - 1, data.tobytes()
        if not raw or h3 % 100 >= rate or any(x in raw for x in marks):
            return n, "plain", None, None, raw
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        i, j = index(a), index(b)
        form = "spm" if h4 % 100 < spm_rate else "psm"
        out = b"".join((s, raw[j:], p, raw[:i], m, raw[i:j]) if form == "spm" else (p, raw[:i], s, raw[j:], m, raw[i:j]))
        return n, form, _chars(data[:i]), _chars(data[i:j]), out

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                draws = zip(*(part.column(len(kept) + 1 + k).to_pylist() for k in range(4)))
                rows = [cut(data, *h) for data, h in zip(_bytes(part.column(len(kept))), draws)]
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                new = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], *new], names=[*kept, *names])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"), *_draws(seed, id_col))
    return rows.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], *added]))


def index(docs: DataFrame, id_col="doc_id", text_col="text", max_error: int = 100) -> DataFrame:
    """The index of every text: key, ``n``, segments (``first``, ``base``, ``slope``), ``residuals`` (little-endian, ``width`` bytes each)."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("first", "base")],
                           T.StructField("slope", T.ArrayType(T.DoubleType())), T.StructField("width", T.IntegerType()), T.StructField("residuals", T.BinaryType())])
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                fits = [RankIndex.fit(boundaries(data), max_error) for data in _bytes(part.column(1))]
                rows = [(len(x) - 1, x.first, x.base, x.slope, x.residual.itemsize, x.residual.tobytes()) for x in fits]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]],
                                                 names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def restore(rows: DataFrame, out_col="fim_text", form_col="form", text_col="text") -> DataFrame:
    """``rows`` with the original text, rebuilt from the rearranged one and its form alone.

    A text with a sentinel of its own is plain, and no sentinel can arise where two parts meet, because ``<`` only begins and ``>`` only ends one.
    """
    whole, form = F.col(f"`{out_col}`"), F.col(f"`{form_col}`")

    def after(text, part):               # what follows ``part`` and a sentinel
        return F.substring(text, F.length(part) + F.lit(len(PREFIX) + 1), F.length(text))

    body = F.substring(whole, len(PREFIX) + 1, F.length(whole))
    first = F.when(form == "spm", F.substring_index(body, PREFIX, 1)).otherwise(F.substring_index(body, SUFFIX, 1))
    rest = after(body, first)
    second = F.substring_index(rest, MIDDLE, 1)
    middle = after(rest, second)
    text = (F.when(form == "spm", F.concat(second, middle, first)).when(form == "psm", F.concat(first, middle, second))
            .otherwise(whole))
    return rows.withColumn(text_col, text)


def digests(docs: DataFrame) -> DataFrame:
    """The query's rows: counts, form, and digests of the output and of the text restored from it."""
    done = restore(transform(docs.select("doc_id", "text"), keep_text=False), text_col="restored")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("fim_text").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    token = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    draws = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{token}') AS tok,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
u AS (SELECT doc_id, x, tok, len(tok)::BIGINT AS n, {draws} FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, coalesce(array_to_string(tok[1:a], ''), '') AS pre, coalesce(array_to_string(tok[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(tok[b + 1:n], ''), '') AS suf
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM p
"""
