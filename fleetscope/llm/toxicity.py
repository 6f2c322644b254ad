"""Toxicity by a classifier chain of linear models over word features.

``categories`` are label columns in chain order. Model ``k`` sees the document's different words (hashed; those
that differ between positive and negative training rows) and the log odds of the categories before it.
In training these come from out-of-fold predictions (a model per fold, fitted on the other folds), in scoring from the
models fitted on all training rows, so a later model is not misled by over-confident earlier ones. The decision threshold
of the last category maximises F1 on its out-of-fold predictions.

Training takes at most ``max_fit_rows`` labelled rows, those with the smallest hash of their id (the stated bound; every other
step covers all rows). Folds are fitted as Spark tasks. Scoring reads whole texts.

Null and empty texts have no words (the models' intercepts decide); labels that are null in a category or in the id are not used for
training; repeated label rows count once with the largest label, repeated documents once; ties at the bound go by id;
without positive or negative labels every document gets the same probability, without labels 0; an empty table gives no
rows; all columns of ``docs`` are kept by ``remove_toxic``, and helper columns have reserved names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("quality", "toxic")
MAX_FIT_ROWS, FOLDS, BUCKETS = 20_000, 5, 1 << 18
MIN_DOCS, MIN_Z = 3, 4.0    # training rows that hold a word at least, and its least difference between classes
EDGES = b".,;:!?\"'()[]{}*#%&$|~<>-_"


class _Buckets(dict):
    """Bucket of a raw token (lower-cased bytes, punctuation at its ends ignored)."""

    def __missing__(self, token):
        word = token.strip(EDGES)
        value = self[token] = xxhash.xxh3_64_intdigest(word) % BUCKETS if word else BUCKETS
        return value


def features(text, known: _Buckets) -> np.ndarray:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if len(known) > 500_000:
        known.clear()
    got = np.unique(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
    return got[got < BUCKETS]


def fit(idx, start, extra, y, rounds: int = 400, ridge: float = 1e-5):
    """Weights per bucket (float32), weights of ``extra`` columns and the intercept of one category.

    Words whose shares in positive and negative rows differ by less than MIN_Z standard errors weigh nothing; the rest
    is a logistic regression by accelerated gradient steps (restarted when the loss grows).
    """
    rows, n = np.repeat(np.arange(len(y)), np.diff(start)), max(len(y), 1)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return np.zeros(BUCKETS, np.float32), np.zeros(extra.shape[1]), float(np.log((pos + 0.5) / (neg + 0.5)))
    c1, c0 = np.bincount(idx, y[rows], BUCKETS), np.bincount(idx, 1 - y[rows], BUCKETS)
    share = (c1 + c0 + 1) / (n + 2)
    z = np.abs(c1 / pos - c0 / neg) / np.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    kept = np.flatnonzero((z >= MIN_Z) & (c1 + c0 >= MIN_DOCS))
    column = np.full(BUCKETS, -1)
    column[kept] = np.arange(len(kept))
    use = column[idx] >= 0
    col, row = column[idx[use]], rows[use]
    centre, spread = (extra.mean(axis=0), extra.std(axis=0) + 1e-9) if extra.shape[1] else (np.zeros(0), np.ones(0))
    e = (extra - centre) / spread
    k = len(kept)
    per_row = np.bincount(row, minlength=len(y)) + np.abs(e).sum(axis=1) + 1
    bound = np.concatenate([np.bincount(col, per_row[row], k), np.abs(e).T @ per_row, [per_row.sum()]]) / (4 * n) + ridge
    step = 1 / bound                                       # a separable bound of the curvature
    w = np.zeros(k + e.shape[1] + 1)
    w[-1] = np.log(pos / neg)
    look, t, last = w.copy(), 1.0, np.inf

    def margins(u):
        return np.bincount(row, u[col], len(y)) + e @ u[k:-1] + u[-1]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(margins(look), -30, 30)))
        g = (p - y) / n
        grad = np.concatenate([np.bincount(col, g[row], k), e.T @ g, [g.sum()]])
        grad[:-1] += ridge * look[:-1]
        new = look - step * grad
        m = np.clip(margins(new), -30, 30)
        loss = np.mean(np.logaddexp(0, m) - y * m) + ridge / 2 * (new[:-1] @ new[:-1])
        if loss > last:
            look, t, last = w.copy(), 1.0, np.inf
            continue
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t, last = new + (t - 1) / t1 * (new - w), new, t1, loss
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = w[:k]
    v = w[k:-1] / spread
    return weights, v, float(w[-1] - v @ centre)


def margin(idx, start, extra, model):
    w, v, b = model
    rows = np.repeat(np.arange(len(start) - 1), np.diff(start))
    return np.bincount(rows, w[idx], len(start) - 1) + extra @ v + b


def training_rows(docs: DataFrame, labels: DataFrame, categories, id_col, text_col, max_fit_rows: int):
    """(idx, start, labels, fold) of the bounded sample; this is all that reaches the driver."""
    picked = labels.where(F.col(id_col).isNotNull() & ~F.greatest(*[F.col(c).isNull() for c in categories], F.lit(False)))
    picked = (picked.groupBy(id_col).agg(*[F.max(c).cast("double").alias(f"__y{i}") for i, c in enumerate(categories)])
              .orderBy(F.xxhash64(id_col), id_col).limit(max_fit_rows).withColumnRenamed(id_col, "__id"))

    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Buckets()
        for texts in batches:
            yield pd.Series([features(t, known) for t in texts])
    hashed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
            .join(F.broadcast(picked), "__id")                  # at most max_fit_rows rows
            .dropDuplicates(["__id"])
            .select("__id", *[f"__y{i}" for i in range(len(categories))],
                    F.pandas_udf(hashed, "array<int>")("__text").alias("f"), F.pmod(F.xxhash64(F.lit("fold"), "__id"), F.lit(FOLDS)).alias("fold"))
            .toArrow())                                         # flat buffers, at most max_fit_rows rows
    order = np.argsort(rows.column("__id").to_numpy(), kind="stable")
    f = rows.column("f").combine_chunks()
    offsets, values = f.offsets.to_numpy(), f.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)[order]
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    idx = np.empty(int(start[-1]), np.int32)
    for i, k in enumerate(order):
        idx[start[i]:start[i + 1]] = values[offsets[k]:offsets[k + 1]]
    y = np.column_stack([rows.column(f"__y{i}").to_numpy()[order] for i in range(len(categories))])
    return idx, start, y, rows.column("fold").to_numpy()[order].astype(int)


def _fit_tasks(spark, data, extra, y):
    """Fit FOLDS models on the other folds and one on all rows, one Spark task each."""
    idx, start, _, fold = data
    sent = spark.sparkContext.broadcast((idx, start, extra, y, fold))

    def run(batches):
        idx, start, extra, y, fold = sent.value
        for batch in batches:
            for k in batch["id"]:
                use = np.flatnonzero(fold != k)                     # k = FOLDS: all rows
                part = [idx[start[i]:start[i + 1]] for i in use]
                at = np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int64)
                w, v, b = fit(np.concatenate(part) if part else idx[:0], at, extra[use], y[use])
                yield pd.DataFrame({"k": [k], "w": [w.tobytes()], "v": [v.tobytes()], "b": [b]})
    got = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInPandas(run, "k long, w binary, v binary, b double").collect()
    sent.destroy()
    return {r.k: (np.frombuffer(r.w, np.float32), np.frombuffer(r.v, float), r.b) for r in got}


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, id_col="doc_id", text_col="text",
          max_fit_rows: int = MAX_FIT_ROWS) -> dict:
    """The chain: ``models`` in order, the ``threshold`` of the last one and its out-of-fold ``f1``."""
    data = training_rows(docs, labels, categories, id_col, text_col, max_fit_rows)
    idx, start, ys, fold = data
    extra, models, out = np.zeros((len(ys), 0)), [], np.zeros(0)
    for c in range(len(categories)):
        fitted = _fit_tasks(docs.sparkSession, data, extra, ys[:, c])
        out = np.zeros(len(ys))
        for k in range(FOLDS):
            out[fold == k] = margin(idx, start, extra, fitted[k])[fold == k]
        models.append(fitted[FOLDS])
        extra = np.column_stack([extra, out])
    y = ys[:, -1] if len(ys) else np.zeros(0)
    order = np.argsort(-out)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum()) if len(y) else np.zeros(0)
    threshold, best = 0.5, 0.0
    if len(y) and y.sum():
        k = int(np.argmax(f1))
        below = out[order[k + 1]] if k + 1 < len(y) else out[order[k]] - 1
        best, cut = float(f1[k]), (out[order[k]] + below) / 2
        threshold = float(1 / (1 + np.exp(-cut)))
    return {"categories": tuple(categories), "models": models, "threshold": threshold, "f1": best, "rows": len(ys)}


def _scores(spark, chain: dict):
    sent = spark.sparkContext.broadcast((chain["models"], chain["rows"]))
    names = [f"p_{c}" for c in chain["categories"]]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models, rows = sent.value
        known = _Buckets()
        for texts in batches:
            out = np.zeros((len(texts), len(names)))
            for i, t in enumerate(texts if rows else ()):
                f, before = features(t, known), []
                for c, (w, v, b) in enumerate(models):
                    z = float(w[f].sum()) + sum(a * x for a, x in zip(v, before)) + b
                    before.append(z)
                    out[i, c] = 1 / (1 + np.exp(-min(max(z, -30), 30)))
            yield pd.DataFrame(out, columns=names)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "struct<" + ",".join(f"{n}:double" for n in names) + ">")


def score(docs: DataFrame, chain: dict, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, p_<category>..., toxic) per row."""
    s = docs.select(id_col, _scores(docs.sparkSession, chain)(text_col).alias("s")).select(id_col, "s.*")
    return s.withColumn("toxic", F.col(f"p_{chain['categories'][-1]}") > chain["threshold"])


def remove_toxic(docs: DataFrame, chain: dict, text_col="text") -> DataFrame:
    """``docs`` without the rows the chain rejects."""
    s = _scores(docs.sparkSession, chain)(F.col(text_col))
    return docs.where(~(s[f"p_{chain['categories'][-1]}"] > chain["threshold"]))
