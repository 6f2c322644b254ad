"""Near-duplicate lines by a blocked deletion neighbourhood (DataFrame functions only).

A line that is not blank is removed if the same line, or a line within the edit bound (insertions, deletions and substitutions of a
character), occurs earlier in the order (id, text hash, line number); the earliest stays. Comparisons are with all earlier
lines, removed or not. The bound grows with the length: ``edits[k - 1]`` is the length of the shorter line from which ``k`` edits are
allowed (by default one from 5 characters on, two from 30 on); shorter lines must be equal.

1. Equal lines: partial aggregation on two 64-bit hashes.
2. Two lines within ``k`` edits agree outside ``k`` blocks of the shorter line's even partition, with the text between them
   shifted by the characters gained so far. Each line posts, for every length the shorter line may have, a key of what
   lies outside each choice of blocks and shifts. Only lines that share a key with a different line go on.
3. The earliest line of each key is compared with the key's other lines (``levenshtein``, no further than the bound), which settles most
   of them. A line that is left and shares its key with a third line goes on: every block that was hit is cut into ``FINE``
   blocks, until blocks have at most ``WIDTH`` characters. Of lines with one key, only those go on whose blocks are not all alike:
   lines that differ in one block of several share the key of that block alone as well.
4. The deletion neighbourhood of the remaining blocks: all variants of the line with ``k`` marked edits, as hashed keys. A
   mark is a substituted character (gone from both lines), one that only the longer or one that only the shorter line has. Equal
   keys of the two roles (shorter, other line) mean at most ``k`` edits, so per key only the earliest line of each role is needed:
   no pairs of a group are made. It is verified with ``levenshtein`` on the lines themselves.

The partner named for a removed line is the earliest of those that its first deciding step met.

Null texts have no lines; blank lines always stay; rows repeated with id and text are treated alike and do not remove each other's
lines; a null id comes before all others; an empty table gives no rows; extra columns are kept by ``rewrite``, helper
columns have reserved names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, groupby, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage

EDITS = (5, 30)             # least length of the shorter line for one edit, for two edits
FINE, WIDTH = (2, 4), 2     # blocks that a block is cut into, the first time and later; characters of a block that is cut no more
KEYS = 2_000_000            # shared keys (a long each) that may be broadcast


def lines_of(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text_hash, line_no, line, h1, h2): the lines of all texts that are not blank."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash", "line_no")


def _cut(m: Column, j, blocks) -> Column:
    return F.floor(m.cast("long") * j / blocks).cast("int")


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` with what every key of a line needs: ``len`` in characters, and its bytes ``raw`` if these are its characters."""
    return rows.withColumn("len", F.length("line")).withColumn("raw", F.when(F.octet_length("line") == F.col("len"), F.col("line").cast("binary")))


def _key(m: Column, ids: list, holes: list[tuple]) -> Column:
    """Hash of the line outside ``holes``: (start, end) in the shorter line of length ``m``, and the characters gained there.

    Bytes are cut without a walk over the line's characters; they have the same hash."""
    def cut(line):
        at, shift, parts = F.lit(0), F.lit(0), []
        for start, end, gain in holes:
            parts.append(F.substring(line, at + shift + 1, F.greatest(start - at, F.lit(0))))
            at, shift = end, shift + gain
        return F.xxhash64(m, *ids, *parts, F.substring(line, at + shift + 1, F.greatest(m - at, F.lit(0))))
    return F.when(F.col("raw").isNotNull(), cut(F.col("raw"))).otherwise(cut(F.col("line")))


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """Keys that two different lines have."""
    return stage(rows.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key"), name)


def _gains(holes: int, k: int, total: int) -> list[tuple]:
    """Ways to gain ``total`` characters over the holes by at most ``k`` edits, at least one in each hole (another choice of blocks
    has the edits without an empty hole)."""
    return [g for g in product(range(-k, k + 1), repeat=holes) if sum(g) == total and sum(max(1, abs(x)) for x in g) <= k]


def _coarse(lines: DataFrame, edits: tuple) -> DataFrame:
    """(line position, h1, h2, k, m, t, key): ``t`` are the blocks left out of the key."""
    cuts = []
    for k, low in enumerate(edits, 1):
        blocks = max(3, k + 1)
        for longer, t in product(range(k + 1), combinations(range(blocks), k)):
            runs = [[j for _, j in run] for _, run in groupby(enumerate(t), lambda x: x[1] - x[0])]       # blocks side by side are one hole
            for gains in _gains(len(runs), k, longer):
                holes = [(run[0], run[-1] + 1, g) for run, g in zip(runs, gains)]
                holes += [(holes[-1][1], holes[-1][1], 0)] * (len(edits) - len(holes))                    # empty ones after the last
                cuts.append(F.struct(*[F.lit(v).alias(name) for name, v in (("k", k), ("low", low), ("blocks", blocks), ("longer", longer))],
                                     F.array(*map(F.lit, t)).alias("t"),
                                     *[F.lit(v).alias(f"{name}{i}") for i, hole in enumerate(holes) for name, v in zip("seg", hole)]))
    high = F.when(F.col("x.k") < len(edits), F.element_at(F.array(*map(F.lit, edits)), F.least(F.col("x.k") + 1, F.lit(len(edits)))))
    rows = _measured(lines).withColumn("x", F.explode(F.array(*cuts))).withColumn("m", F.col("len") - F.col("x.longer"))
    rows = rows.where((F.col("m") >= F.col("x.low")) & (high.isNull() | (F.col("m") < high)))
    m, blocks = F.col("m"), F.col("x.blocks")
    holes = [(_cut(m, F.col(f"x.s{i}"), blocks), _cut(m, F.col(f"x.e{i}"), blocks), F.col(f"x.g{i}")) for i in range(len(edits))]
    return rows.select("doc_id", "text_hash", "line_no", "h1", "h2", "x.k", "m", "x.t", _key(m, ["x.k", "x.t"], holes).alias("key"))


def _finer(rows: DataFrame, k: int, fine: int) -> DataFrame:
    """Rows (h1, h2, first, line, open, m, blocks, c1..ck) with the blocks cut anew, the key of what lies outside of them, and what lies in each (w1..wk)."""
    at = range(1, k + 1)
    gains = [F.array(*[F.struct(*[F.lit(g).alias(f"g{i}") for i, g in zip(at, gain)]) for gain in product((-1, 0, 1), repeat=k) if sum(gain) == total])
             for total in range(k + 1)]
    rows = _measured(rows).withColumn("blocks", F.col("blocks") * fine).withColumn("x", F.explode(F.element_at(
        F.array(*gains), F.col("len") - F.col("m") + 1)))
    for i in at:
        rows = rows.withColumn(f"d{i}", F.explode(F.sequence(F.col(f"c{i}") * fine, F.col(f"c{i}") * fine + fine - 1)))
        if i > 1:           # two edits in one block gain by either order: one of them is posted
            rows = rows.where((F.col(f"d{i}") > F.col(f"d{i - 1}")) | ((F.col(f"d{i}") == F.col(f"d{i - 1}")) & (
                (F.col(f"x.g{i - 1}") == 0) | (F.col(f"x.g{i - 1}") == F.col(f"x.g{i}")))))
    m, blocks = F.col("m"), F.col("blocks")
    holes = [(_cut(m, F.col(f"d{i}"), blocks), _cut(m, F.col(f"d{i}") + 1, blocks), F.col(f"x.g{i}")) for i in at]
    inside, shift = [], F.lit(0)
    for i, (start, end, gain) in zip(at, holes):
        alone = reduce(Column.__and__, [F.col(f"d{i}") != F.col(f"d{j}") for j in at if j != i], F.lit(True))
        part = [F.substring(line, start + shift + 1, F.greatest(end - start + gain, F.lit(0))) for line in (F.col("raw"), F.col("line"))]
        part = F.when(F.col("raw").isNotNull(), F.xxhash64(part[0])).otherwise(F.xxhash64(part[1]))
        inside.append(F.when(alone, part).otherwise(F.col("h1")).alias(f"w{i}"))
        shift = shift + gain
    return rows.select("h1", "h2", "first", "open", "m", "blocks", *[F.col(f"d{i}").alias(f"c{i}") for i in at],
                       _key(m, [F.col(f"d{i}") for i in at], holes).alias("key"), *inside)


def _verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(h1, h2, near): the earliest ``least`` of (h1, h2, least) within ``k`` edits."""
    others = texts.select(F.col("first").alias("least"), F.col("line").alias("other"))
    return (pairs.distinct().join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(others, "least")
            .where(F.levenshtein("line", "other", k) >= 0).groupBy("h1", "h2").agg(F.min("least").alias("near")))


def _meet(rows: DataFrame, texts: DataFrame, k: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Lines that the earliest line of one of their keys settles, (h1, h2, near), and the rows that go on: those of keys with a third line."""
    inside = [c for c in rows.columns if c[0] == "w"]           # an edit in each block changes each of them
    keys = rows.groupBy("key").agg(F.min("first").alias("least"), F.max(F.when(F.col("open"), F.col("first"))).alias("last"),
                                   F.count(F.lit(1)).alias("n"), *[f(c).alias(f.__name__ + c) for c in inside for f in (F.min, F.max)])
    keys = keys.where(" and ".join(["n > 1", "last > least", *[f"min{c} < max{c}" for c in inside]]))
    keys = stage(keys.select("key", "least", "last", "n"), f"{name}-keys")
    met = stage(rows.drop(*inside).join(small(keys, KEYS // 8), "key").where("open or first < last"), f"{name}-rows")
    found = stage(_verified(met.where("open and first > least").select("h1", "h2", "least"), texts, k), f"{name}-found")
    return found, met.where("n > 2").drop("key", "least", "last", "n", "open", "first").distinct()


def _marked(texts: DataFrame, settled: DataFrame) -> DataFrame:
    """(h1, h2, first, line, open): the lines, ``open`` unless settled."""
    return texts.join(settled.select("h1", "h2", F.lit(False).alias("no")), ["h1", "h2"], "left").select(
        "h1", "h2", "first", "line", F.coalesce("no", F.lit(True)).alias("open"))


def _variants(rows: DataFrame, k: int) -> DataFrame:
    """(h1, h2, first, open, variant, role): the lines of (h1, h2, first, open, line, m, blocks, c1..ck) with ``k`` marked edits in their blocks.

    Role 0 is the shorter line, role 1 the other one. A mark has a place in the shorter line, the characters that it takes there
    and those that the other line gains: substitution (1, 0), insertion (0, 1), deletion (1, -1)."""
    at = range(1, k + 1)
    marks = F.array(*[F.struct(F.lit(role).alias("role"), *[F.lit(w).alias(f"w{i}") for i, (w, _) in zip(at, kinds)],
                               *[F.lit(g).alias(f"g{i}") for i, (_, g) in zip(at, kinds)])
                      for kinds in product(((1, 0), (0, 1), (1, -1)), repeat=k) if sum(g for _, g in kinds) >= 0 for role in (0, 1)])
    m, longer = F.col("m"), F.col("len") - F.col("m")
    gained = sum(F.col(f"x.g{i}") for i in at)
    rows = _measured(rows).withColumn("x", F.explode(marks)).where(F.when(F.col("x.role") == 0, longer == 0).otherwise(gained == longer))
    for i in at:
        start, end = _cut(m, F.col(f"c{i}"), F.col("blocks")), _cut(m, F.col(f"c{i}") + 1, F.col("blocks"))
        rows = rows.withColumn(f"p{i}", F.explode(F.sequence(start, end))).where(F.col(f"p{i}") + F.col(f"x.w{i}") <= end)
        rows = rows.where(F.col(f"p{i}") >= F.col(f"p{i - 1}") + F.col(f"x.w{i - 1}")) if i > 1 else rows
    holes = [(F.col(f"p{i}"), F.col(f"p{i}") + F.col(f"x.w{i}"), F.col(f"x.g{i}") * F.col("x.role")) for i in at]
    ids = [F.col(f"{c}{i}") for i in at for c in ("p", "x.w", "x.g")]
    return rows.select("h1", "h2", "first", "open", _key(m, ids, holes).alias("variant"), F.col("x.role").alias("role"))


def _nearest(texts: DataFrame, k: int) -> DataFrame:
    """(h1, h2, near): the lines of ``texts`` (h1, h2, first, line, hits) that have an earlier line within ``k`` edits."""
    cells = [f"c{i}" for i in range(1, k + 1)]
    hits = texts.select("h1", "h2", "first", F.lit(True).alias("open"), F.explode("hits").alias("x")).where(F.col("x.k") == k)
    settled, hits = _meet(hits.select("h1", "h2", "first", "open", "x.m", "x.t", "x.key"), texts, k, f"line-{k}")
    for i, c in enumerate(cells):
        hits = hits.withColumn(c, F.explode("t"))
        hits = hits.where(F.col(c) >= F.col(cells[i - 1])) if i else hits
    hits = stage(hits.select("h1", "h2", "m", F.lit(max(3, k + 1)).alias("blocks"), *cells).distinct(), f"line-hits-{k}")
    done, level = [], 0
    while not hits.isEmpty():
        wide = F.col("m") > F.col("blocks") * WIDTH
        done.append(hits.where(~wide))
        level += 1
        found, hits = _meet(_finer(hits.where(wide).join(_marked(texts, settled), ["h1", "h2"]), k, FINE[level > 1]), texts, k, f"line-{k}-{level}")
        settled, hits = stage(settled.unionByName(found), f"line-settled-{k}"), stage(hits, f"line-hits-{k}")
    if not done:
        return settled
    left = reduce(DataFrame.unionByName, done)
    posts = _variants(left.join(_marked(texts, settled), ["h1", "h2"]), k)
    firsts = [F.min(F.when(F.col("role") == r, F.col("first"))).alias(f"least{r}") for r in (0, 1)]
    lasts = [F.max(F.when(F.col("open") & (F.col("role") == r), F.col("first"))).alias(f"last{r}") for r in (0, 1)]
    least = stage(posts.groupBy("variant").agg(*firsts, *lasts).where("least0 < last1 or least1 < last0")
                  .select("variant", "least0", "least1"), f"line-variants-{k}")
    pairs = (posts.where("open").join(small(least, KEYS // 8), "variant")
             .withColumn("least", F.when(F.col("role") == 0, F.col("least1")).otherwise(F.col("least0")))
             .where(F.col("least") < F.col("first")).groupBy("h1", "h2").agg(F.min("least").alias("least")))
    return settled.unionByName(_verified(pairs, texts, k))


def near_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame, edits: tuple = EDITS) -> DataFrame:
    """(h1, h2, near): lines that are within the edit bound of an earlier line, with such a line."""
    long_lines = lines.where(F.length("line") >= edits[0])
    coarse = _coarse(long_lines, edits)
    shared = _shared(coarse, "line-keys")
    hit = coarse.join(small(shared, KEYS), "key").groupBy("h1", "h2").agg(F.collect_set(F.struct("k", "m", "t", "key")).alias("hits"))
    cand = stage(hit.join(firsts, ["h1", "h2"]).select("h1", "h2", F.col("first").alias("place"), "hits"), "line-candidates")
    cand = stage(cand.orderBy("place").withColumn("first", F.monotonically_increasing_id()), "line-numbered")   # a long in the order of the lines
    at = cand.select(F.col("place.doc_id").alias("c_id"), F.col("place.text_hash").alias("c_hash"),
                     F.col("place.line_no").alias("c_no"), "h1", "h2", "first", "hits")
    on = long_lines["doc_id"].eqNullSafe(at["c_id"]) & (long_lines["text_hash"] == at["c_hash"]) & (long_lines["line_no"] == at["c_no"])
    texts = stage(long_lines.select("doc_id", "text_hash", "line_no", "line").join(small(at), on)
                  .select("h1", "h2", "first", "hits", "line").dropDuplicates(["h1", "h2"]), "line-texts")
    near = reduce(DataFrame.unionByName, [_nearest(texts, k) for k in range(1, len(edits) + 1)])
    near = near.groupBy("h1", "h2").agg(F.min("near").alias("number"))
    return near.join(cand.select(F.col("first").alias("number"), F.col("place").alias("near")), "number").select("h1", "h2", "near")


def removals(docs: DataFrame, id_col="doc_id", text_col="text", edits: tuple = EDITS) -> DataFrame:
    """(doc_id, text_hash, line_no, kind, kept_doc_id, kept_line_no) of every removed line; kind: same or near."""
    lines = lines_of(docs, id_col, text_col)
    firsts = stage(lines.groupBy("h1", "h2").agg(F.min(_order()).alias("first")), "line-first")
    near = stage(near_lines(docs, lines, firsts, edits), "line-near")
    every = lines.select("doc_id", "text_hash", "line_no", "h1", "h2", _order().alias("at"))
    told = firsts.join(near, ["h1", "h2"], "left")
    return (every.join(told, ["h1", "h2"]).where((F.col("at") > F.col("first")) | F.col("near").isNotNull())
            .withColumn("kept", F.coalesce("near", "first"))
            .select("doc_id", "text_hash", "line_no", F.when(F.col("near").isNull(), "same").otherwise("near").alias("kind"),
                    F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")).distinct())


def summary(docs: DataFrame, id_col="doc_id", text_col="text", edits: tuple = EDITS) -> DataFrame:
    """(doc_id, n_lines, n_same, n_near, removed): one row per row; ``removed``: line numbers, ascending."""
    gone = removals(docs, id_col, text_col, edits).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list("line_no")).alias("removed"), F.count_if(F.col("kind") == "same").alias("n_same"),
        F.count_if(F.col("kind") == "near").alias("n_near"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                    F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long").alias("n_lines")).alias("d")
    g = gone.alias("g")
    on = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_hash") == F.col("g.text_hash"))
    return d.join(g, on, "left").select(
        "d.doc_id", "n_lines", F.coalesce("n_same", F.lit(0)).alias("n_same"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def rewrite(docs: DataFrame, id_col="doc_id", text_col="text", edits: tuple = EDITS) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text_col`` (and ``n_chars`` counted anew where there is one)."""
    gone = removals(docs, id_col, text_col, edits).groupBy(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list("line_no").alias("__gone"))
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash"))
    parts = F.split(text_col, "\n")
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("__gone", i)), "\n")
    out = docs.join(gone, on, "left").withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def oracle_sql(edits: tuple = EDITS) -> str:
    """DuckDB SQL of ``summary`` over documents with different ids (all pairs of lines of about equal length).

    Lines within k edits share one of k + 1 parts of the shorter line. What is left after the common start must agree after one of the three
    edits; ``spent`` counts them."""
    most = len(edits)
    allowed = "CASE " + " ".join(f"WHEN n >= {low} THEN {k}" for k, low in reversed(list(enumerate(edits, 1)))) + " ELSE 0 END"
    cut = [f"({i} * n // {most + 1})" for i in range(most + 2)]
    shares = " OR ".join(f"contains(t, substr(s, {x} + 1, {y} - {x}))" for x, y in zip(cut, cut[1:]))
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no
  FROM documents WHERE text IS NOT NULL),
f AS (SELECT line, length(line) n, min(doc_id * 1000000 + line_no) AS first FROM l WHERE trim(line, ' ') <> '' GROUP BY line),
p AS (SELECT a.line s, b.line t, a.n, CASE WHEN a.first > b.first THEN a.line ELSE b.line END AS later
  FROM f a JOIN f b ON b.n BETWEEN a.n AND a.n + {most} AND (a.n < b.n OR a.first < b.first) AND a.n >= {edits[0]}),
c AS (SELECT later, s, t, {allowed} AS k FROM p
  WHERE {shares}),
e AS (SELECT DISTINCT later, s, t, k, 0 AS spent FROM c WHERE length(t) - length(s) <= k
  UNION
  SELECT later, substr(s, same + x.ds) AS s, substr(t, same + x.dt) AS t, k, spent + 1
  FROM (SELECT *, 1 + (SELECT coalesce(max(i), 0) FROM range(0, least(length(s), length(t)) + 1) r(i) WHERE left(s, i::BIGINT) = left(t, i::BIGINT)) AS same
        FROM e WHERE spent < k AND s <> t), (VALUES (1, 1), (1, 0), (0, 1)) x(ds, dt)),
near AS (SELECT DISTINCT later AS line FROM e WHERE s = t),
r AS (SELECT l.doc_id, l.line_no, near.line IS NOT NULL near FROM l JOIN f USING (line) LEFT JOIN near USING (line)
  WHERE near.line IS NOT NULL OR l.doc_id * 1000000 + l.line_no > f.first),
g AS (SELECT doc_id, count(*) FILTER (NOT near) n_same, count(*) FILTER (near) n_near, list(line_no::INT ORDER BY line_no) removed
  FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT n_lines, coalesce(n_same, 0) n_same, coalesce(n_near, 0) n_near,
  coalesce(removed, []::INT[]) removed
FROM documents d LEFT JOIN g USING (doc_id)"""
