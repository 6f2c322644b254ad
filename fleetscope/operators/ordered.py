"""Ordered per-key scans that stay balanced when one key is huge.

Every per-vehicle computation of the jobs (time gap, session number, running
counts, exponential smoothing) is a scan over a vehicle's readings in time
order. A plain ``Window.partitionBy('ident')`` sends all readings of a vehicle
to one task, so a single vehicle holding a third of the data would become one
giant task. Here the rows are split into *chunks* ``(key, chunk)`` where
``chunk`` is monotone in the scan order (a time bucket, a hash prefix, ...):

1. the row-level window runs per ``(key, chunk)`` — one big exchange, hashed on
   ``(key, chunk)``, shared by every scan of the job;
2. each chunk is summarised (last value, total, affine map, ...) with a plain
   aggregate on the same partitioning (no extra exchange);
3. the chunk summaries — tiny next to the rows — are scanned per key;
4. the carry is joined back on ``(key, chunk)``, again on the same partitioning
   (AQE broadcasts the summary side when it is small).

All helpers keep the input columns and add their outputs; they never collect.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import epoch_seconds

CHUNK = "_chunk"


def add_time_chunk(df: DataFrame, ts_col: str = "timestamp", seconds: int = 3600,
                   name: str = CHUNK) -> DataFrame:
    """Chunk number = time bucket of ``seconds`` (monotone in time order)."""
    return df.withColumn(name, F.floor(epoch_seconds(ts_col) / F.lit(float(seconds))).cast("long"))


def stage_chunks(df: DataFrame, keys: list[str], order: list[str], chunk: str = CHUNK,
                 num_partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Exchange the rows once on ``(keys, chunk)``, sort them in scan order and
    cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    The checkpoint keeps the hash partitioning and the sort order, so every
    later chunk window, chunk aggregate and carry join reads the rows in place:
    the raw input is scanned and shuffled exactly once per job, and a lost
    executor only costs re-reading checkpoint files, not the whole lineage.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = df.repartition(n, *keys, chunk).sortWithinPartitions(*keys, chunk, *order)
    if not checkpoint:
        return staged
    from ..session import materialize
    return materialize(staged, keep_partitioning=True)


def _chunk_window(keys, chunk, order):
    return Window.partitionBy(*keys, chunk).orderBy(*order)


def _carry_window(keys, chunk):
    return Window.partitionBy(*keys).orderBy(chunk)


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                   chunk: str = CHUNK, skip_nulls: bool = False,
                   include_current: bool = False) -> DataFrame:
    """Value of ``value`` at the previous row of the same key (scan order ``order``).

    ``skip_nulls``: previous row where ``value`` is not NULL (a "last known
    value" scan). ``include_current``: the frame ends at the current row.
    Without ``skip_nulls`` ``value`` must never be NULL (wrap it in a struct).
    """
    w = _chunk_window(keys, chunk, order)
    tmp = f"__{name}_tail"
    if skip_nulls:
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        within = F.last(value, ignorenulls=True).over(frame)
    else:
        within = value if include_current else F.lag(value).over(w)
    df1 = df.withColumn(name, within)
    order_key = F.struct(*[F.col(o) for o in order])
    tail = F.max_by(value, F.when(value.isNotNull(), order_key)) if skip_nulls else F.max_by(value, order_key)
    cw = _carry_window(keys, chunk)
    carry_expr = (F.last(F.col(tmp), ignorenulls=True).over(cw.rowsBetween(Window.unboundedPreceding, -1))
                  if skip_nulls else F.lag(F.col(tmp)).over(cw))
    tails = (df1.groupBy(*keys, chunk).agg(tail.alias(tmp))
                .select(*keys, chunk, carry_expr.alias(f"__{name}_carry")))
    return (df1.join(tails, [*keys, chunk], "left")
               .withColumn(name, F.coalesce(F.col(name), F.col(f"__{name}_carry")))
               .drop(f"__{name}_carry"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column],
                chunk: str = CHUNK) -> DataFrame:
    """Inclusive running sums per key in scan order: ``{out_name: value_expr}``.

    Local prefix sums per chunk plus the exclusive prefix of the chunk totals.
    Values should be exact (integers) so the split does not change the sums.
    """
    w = _chunk_window(keys, chunk, order).rowsBetween(Window.unboundedPreceding, 0)
    df1 = df
    for name, v in values.items():
        df1 = df1.withColumn(name, F.sum(v).over(w))
    totals = df1.groupBy(*keys, chunk).agg(*[F.sum(v).alias(f"__{n}_tot") for n, v in values.items()])
    cw = _carry_window(keys, chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, chunk, *[
        F.coalesce(F.sum(f"__{n}_tot").over(cw), F.lit(0)).alias(f"__{n}_off") for n in values])
    out = df1.join(offsets, [*keys, chunk], "left")
    for n in values:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"__{n}_off"), F.lit(0))).drop(f"__{n}_off")
    return out


def previous_and_running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                         sums: dict[str, Column], chunk: str = CHUNK) -> DataFrame:
    """``previous_value`` (NULL-free ``value``) and inclusive ``running_sum``s in
    ONE chunked pass: one chunk summary (last value, totals), one per-key scan
    over the chunks, one join back."""
    w = _chunk_window(keys, chunk, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df1 = df.withColumns({name: F.lag(value).over(w), **{n: F.sum(v).over(run) for n, v in sums.items()}})
    order_key = F.struct(*[F.col(o) for o in order])
    chunks = df1.groupBy(*keys, chunk).agg(F.max_by(value, order_key).alias("__tail"),
                                           *[F.sum(v).alias(f"__{n}_tot") for n, v in sums.items()])
    cw = _carry_window(keys, chunk)
    before = cw.rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*keys, chunk, F.lag("__tail").over(cw).alias("__carry"),
                          *[F.coalesce(F.sum(f"__{n}_tot").over(before), F.lit(0)).alias(f"__{n}_off") for n in sums])
    out = df1.join(carry, [*keys, chunk], "left")
    out = out.withColumns({name: F.coalesce(F.col(name), F.col("__carry")),
                           **{n: F.col(n) + F.coalesce(F.col(f"__{n}_off"), F.lit(0)) for n in sums}})
    return out.drop("__carry", *[f"__{n}_off" for n in sums])


def attach_group_info(rows: DataFrame, groups: DataFrame, keys: list[str], group_col: str,
                      info: list[str], chunk: str = CHUNK, min_chunk: str = "_min_chunk",
                      max_chunk: str = "_max_chunk") -> DataFrame:
    """Bring per-group columns (e.g. session duration) back onto the rows.

    ``groups`` holds one row per ``(keys, group_col)`` with the first and last
    chunk the group touches. Each group is listed in every chunk it spans and
    the lists are joined on ``(keys, chunk)`` — the partitioning the rows
    already have — instead of re-shuffling all rows on the group key.
    A chunk holds only the groups that overlap it, so the lists stay short.
    """
    per_chunk = (groups
                 .select(*keys, F.explode(F.sequence(F.col(min_chunk), F.col(max_chunk))).alias(chunk),
                         F.struct(F.col(group_col).alias("g"), *[F.col(c) for c in info]).alias("s"))
                 .groupBy(*keys, chunk).agg(F.collect_list("s").alias("__groups")))
    j = rows.join(per_chunk, [*keys, chunk], "left")
    pick = F.filter(F.col("__groups"), lambda s: s["g"] == F.col(group_col))[0]
    j = j.withColumn("__g", pick)
    for c in info:
        j = j.withColumn(c, F.col("__g")[c])
    return j.drop("__groups", "__g")


def attach_key_info(rows: DataFrame, table: DataFrame, keys: list[str], cols: list[str],
                    chunk: str = CHUNK) -> DataFrame:
    """Per-key columns (e.g. a vehicle's label) onto rows staged on ``(keys, chunk)``.

    The rows' distinct ``(keys, chunk)`` pairs (an in-place aggregate) are joined
    with the per-key table, and the result joins back on ``(keys, chunk)``: the
    readings keep their partitioning whatever the size of the per-key table.
    Rows whose key is not in the table get NULLs (a left join).
    """
    chunks = rows.select(*keys, chunk).distinct()
    info = chunks.join(table.select(*keys, *cols), keys, "inner")
    return rows.join(info, [*keys, chunk], "left")


def _affine_scan(maps: DataFrame, keys: list[str], idx: str, start: str, fan: int = 256) -> DataFrame:
    """Scan of affine maps s -> a s + l (columns ``__a``, ``__l``) per key in the order of ``idx`` (0, 1, ...).

    Adds ``__sprev``: the state before each map, beginning with ``start`` (the same on all rows of a key).
    Maps are combined ``fan`` at a time; the combined maps are scanned the same way, so no list is longer than
    ``fan`` and the result is exact for every ``a``, whatever the length of the series.
    """
    last = maps.agg(F.max(idx)).first()[0]
    if last is None:
        return maps.withColumn("__sprev", F.lit(None).cast("double"))
    g = maps.withColumn("__g", F.floor(F.col(idx) / fan).cast("long"))
    lists = g.groupBy(*keys, "__g").agg(
        F.array_sort(F.collect_list(F.struct(idx, "__a", "__l"))).alias("__m"), F.first(start).alias(start))
    # prefix[i]: the first i maps of the list as one map
    prefix = F.aggregate(
        "__m", F.array(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("l"))),
        lambda acc, m: F.concat(acc, F.array(F.struct((m["__a"] * F.element_at(acc, -1)["a"]).alias("a"),
                                                      (m["__a"] * F.element_at(acc, -1)["l"] + m["__l"]).alias("l")))))
    lists = lists.withColumn("__p", prefix)
    if last >= fan:
        whole = F.element_at("__p", -1)
        upper = lists.select(*keys, F.col("__g").alias(idx), start, whole["a"].alias("__a"), whole["l"].alias("__l"))
        states = _affine_scan(upper, keys, idx, start, fan).select(*keys, F.col(idx).alias("__g"), F.col("__sprev").alias("__s0"))
        lists = lists.join(states, [*keys, "__g"])
    else:
        lists = lists.withColumn("__s0", F.col(start))
    states = lists.select(*keys, "__s0", F.posexplode("__m").alias("__i", "__x"), "__p")
    states = states.select(*keys, F.col(f"__x.{idx}").alias(idx),
                           (F.col("__p")[F.col("__i")]["a"] * F.col("__s0") + F.col("__p")[F.col("__i")]["l"]).alias("__sprev"))
    return maps.join(states, [*keys, idx])


def ewm(df: DataFrame, keys: list[str], order: list[str], x: str, alpha: float, name: str,
        chunk: str = CHUNK, block: int = 256) -> DataFrame:
    """Exponentially weighted mean with ``adjust=False`` per key in scan order.

    y_0 = x_0, y_t = (1 - alpha) y_{t-1} + alpha x_t. Equivalently the scan
    starts from the state x_0 and every row applies s -> q s + alpha x with
    q = 1 - alpha. Rows are cut into blocks of at most ``block`` rows inside a
    chunk (fewer where q^-block would leave double range); a block is the
    affine map s -> q^m s + L. Block maps are combined in levels of 256, so
    every ``alpha`` is exact and nothing unbounded is gathered.
    """
    q = 1.0 - alpha
    if q <= 0.0:                                       # span 1: no memory
        return df.withColumn(name, F.col(x).cast("double"))
    block = max(1, min(block, int(100 / max(-math.log10(q), 1e-9))))
    w = _chunk_window(keys, chunk, order)
    d = (df.withColumn("__j", F.row_number().over(w) - 1)
           .withColumn("__sb", F.floor(F.col("__j") / block).cast("long"))
           .withColumn("__jl", (F.col("__j") - F.col("__sb") * block).cast("int"))
           .withColumn("__term", F.lit(alpha) * F.col(x) * F.pow(F.lit(q), -F.col("__jl"))))
    # per-block affine maps (plain aggregate on the row partitioning)
    blocks = d.groupBy(*keys, chunk, "__sb").agg(
        F.count(F.lit(1)).alias("__m"),
        F.sum("__term").alias("__S"),
        F.min_by(F.col(x), F.col("__jl")).alias("__xfirst"))
    bw = Window.partitionBy(*keys).orderBy(chunk, "__sb")
    blocks = (blocks
              .withColumn("__l", F.col("__S") * F.pow(F.lit(q), F.col("__m") - 1))
              .withColumn("__a", F.pow(F.lit(q), F.col("__m")))
              .withColumn("__idx", F.row_number().over(bw).cast("long") - 1)
              .withColumn("__x0", F.first("__xfirst").over(bw.rowsBetween(Window.unboundedPreceding, 0)))
              .select(*keys, chunk, "__sb", "__idx", "__a", "__l", "__x0"))
    blocks = _affine_scan(blocks, keys, "__idx", "__x0")
    carry = (blocks.groupBy(*keys, chunk)
                   .agg(F.array_sort(F.collect_list(F.struct("__sb", "__sprev"))).alias("__carry")))
    lw = Window.partitionBy(*keys, chunk, "__sb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__local", F.sum("__term").over(lw))
    out = d.join(carry, [*keys, chunk], "left")
    sprev = F.element_at(F.col("__carry"), (F.col("__sb") + 1).cast("int"))["__sprev"]
    out = out.withColumn(name, F.pow(F.lit(q), F.col("__jl")) * (F.lit(q) * sprev + F.col("__local")))
    return out.drop("__j", "__sb", "__jl", "__term", "__local", "__carry")
