"""Personal data: base patterns plus information-theoretic disclosure of protected entities (DataFrame functions only).

*Base spans* (code points, end exclusive; leftmost, non-overlapping per kind):
emails, IPv4 addresses, payment cards (Luhn) and phone numbers. Matches that
fail the value check are dropped without another try at their text. The
patterns are written with possessive repeats and start guards so that long
runs of letters or digits cost linear time; they match the same spans.

*Disclosed terms*. Every different base value is a protected entity ``c``, however often it occurs. Its context is
every text that holds it: all terms (runs of at least three letters, lower-cased) of these texts are compared with the
terms' counts over the whole corpus: PMI(c;t) = log2(n_ct N / (n_c n_t)) against IC(c) = log2(N / n_c), where n_ct counts
the term in the texts with the entity and N all terms of the corpus. PMI >= ``alpha`` IC discloses the entity: such
terms outside base spans become spans of kind ``term`` and are generalised to ``[TERM]``; at PMI >= IC (the term occurs in no
text without the entity) they are removed. There is no least count. An entity with n_c >= N has no information to disclose.

Entities with the same set of texts have the same n_ct, so only the one with the largest IC (the fewest occurrences) of each set
is compared: a long list of values in one text counts as one. An entity and a term meet by text, and only if the term's largest count
in a text, times the entity's texts, could reach the bound: a limit on n_ct that leaves out nothing.

Null texts count as empty (no spans); null ids and repeated rows keep a row
each (rows are told apart by id and text, equal rows get equal spans); ties of
start positions are ordered by kind as listed; an empty table gives no rows;
extra columns are not carried. Texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage

KINDS = ("email", "ip", "card", "phone")
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"          # shorter runs cannot pass the length check
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(email=EMAIL, ip=IP, card=CARD, phone=PHONE)
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"\p{L}{3,}+"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(value: str) -> str:
    d = _digits(value)
    digit = f"cast(substr({d}, length({d}) - i + 1, 1) as int)"
    return (f"(length({d}) between 12 and 19 and aggregate(sequence(1, length({d})), 0, (a, i) -> a + "
            f"if(i % 2 = 1, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10 = 0)")


VALID = {"email": "true", "ip": f"x.value rlike '^{BYTE}([.]{BYTE}){{3}}$'", "card": _luhn("x.value"),
         "phone": f"length({_digits('x.value')}) between 9 and 15"}


def matches(text: str, pattern: str) -> str:
    """SQL for array<struct<start, end, value>> of all matches; the gaps between them give the positions."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"""aggregate(
  zip_with(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0), (g, m) -> struct(g, m)),
  struct(0 as pos, cast(array() as array<struct<start:int,end:int,value:string>>) as found),
  (s, x) -> if(x.m is null, s, struct(s.pos + length(x.g) + length(x.m) as pos,
    concat(s.found, array(struct(s.pos + length(x.g) as start, s.pos + length(x.g) + length(x.m) as end,
      x.m as value))) as found)), s -> s.found)"""


def base_spans(text: str) -> Column:
    """array<struct<start, kind_no, end, kind, value>> sorted by start, then kind."""
    found = []
    for no, kind in enumerate(KINDS):
        guard = {"email": f"contains({text}, '@')", "phone": f"contains({text}, '+')"}.get(
            kind, f"{text} rlike '" + PATTERNS[kind].replace("\\", "\\\\") + "'")
        found.append(f"if({guard}, transform(filter({matches(text, PATTERNS[kind])}, x -> {VALID[kind]}), x -> "
                     f"struct(x.start as start, {no} as kind_no, x.end as end, '{kind}' as kind, x.value as value)), "
                     "cast(array() as array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>))")
    return F.expr(f"array_sort(concat({', '.join(found)}))")


def _text_key(id_col: str = "doc_id") -> Column:
    return F.xxhash64(F.col(id_col).isNull(), id_col, "text_hash")


def find_base(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, text_hash, base): base spans, one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
            .select("doc_id", F.xxhash64("text").alias("text_hash"), base_spans("text").alias("base")))


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def term_counts(docs: DataFrame, text_col="text") -> DataFrame:
    """(term, n_t) over all texts."""
    return (docs.select(F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))


def protected(found: DataFrame) -> DataFrame:
    """(key, entity, n_c, n_texts): of every set of texts that entities share, the rarest entity, one row per text."""
    held = (found.where("size(base) > 0").select(_text_key().alias("key"), F.explode("base").alias("b"))
            .groupBy("key", F.xxhash64("b.kind", F.lower("b.value")).alias("entity")).agg(F.count(F.lit(1)).alias("n")))
    rarest = (held.groupBy("entity").agg(F.sum("n").alias("n_c"), F.count(F.lit(1)).alias("n_texts"),
                                         F.bit_xor(F.xxhash64("key")).alias("set_1"),
                                         F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("set_2"))
              .groupBy("n_texts", "set_1", "set_2").agg(F.min(F.struct("n_c", "entity")).alias("x"))
              .select("x.entity", "x.n_c", "n_texts"))
    return held.select("key", "entity").join(rarest, "entity").select("key", "entity", "n_c", "n_texts")


def disclosures(entities: DataFrame, inside: DataFrame, counts: DataFrame, alpha: float = 0.95) -> DataFrame:
    """(key, term, ratio): terms of a text whose PMI with one of its entities reaches ``alpha`` times the entity's
    information content; the largest ratio. ``entities`` as of ``protected``, ``inside``: (key, term, n) of their texts."""
    n = float(counts.agg(F.sum("n_t")).first()[0] or 1)              # one number
    entities = entities.where(F.col("n_c") < n).withColumn("least", (1 - 1e-9) * F.pow(F.col("n_c") / F.lit(n), F.lit(1 - alpha)))
    most = inside.groupBy("term").agg(F.sum("n").alias("n_all"), F.max("n").alias("n_max"))
    able = (most.join(counts, "term").where(F.col("n_all") >= F.col("n_t") * (1 - 1e-9) * F.pow(F.lit(1 / n), F.lit(1 - alpha)))
            .select("term", "n_t", "n_max"))
    terms = inside.join(able, "term")
    pairs = stage(terms.join(entities, "key").where(F.col("n_max") * F.col("n_texts") >= F.col("n_t") * F.col("least"))
                  .select("key", "entity", "term", "n", "n_t", "n_c"), "pii-pairs")
    # PMI / IC, written so that n_ct = n_t gives exactly 1
    ratio = 1 + F.log2(F.col("n_ct") / F.col("n_t")) / F.log2(F.lit(n) / F.col("n_c"))
    told = (pairs.groupBy("entity", "term", "n_t", "n_c").agg(F.sum("n").alias("n_ct"))
            .select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= alpha))
    return pairs.join(told, ["entity", "term"]).groupBy("key", "term").agg(F.max("ratio").alias("ratio"))


def _term_spans(text: str, told: str, removed: str) -> Column:
    """array<struct<start, kind_no, end, kind, action>> of the terms of ``text`` that are in ``told``."""
    t = TERM.replace("\\", "\\\\")
    return F.expr(f"""aggregate(
      zip_with(split({text}, '{t}', -1), regexp_extract_all({text}, '{t}', 0), (g, m) -> struct(g, m, lower(m) as low)),
      struct(0 as pos, cast(array() as array<struct<start:int,kind_no:int,end:int,kind:string,action:string>>) as found),
      (s, x) -> if(x.m is null, s, struct(s.pos + length(x.g) + length(x.m) as pos,
        if(array_contains({told}, x.low), concat(s.found, array(struct(s.pos + length(x.g) as start, {len(KINDS)} as kind_no,
          s.pos + length(x.g) + length(x.m) as end, 'term' as kind,
          if(array_contains({removed}, x.low), 'remove', 'generalise') as action))), s.found) as found)), s -> s.found)""")


def find_spans(docs: DataFrame, id_col="doc_id", text_col="text", alpha: float = 0.95) -> DataFrame:
    """(doc_id, text_hash, spans): base and disclosed spans, array<struct<start, kind_no, end, kind, action>>."""
    found = stage(find_base(docs, id_col, text_col), "pii-base")
    counts = stage(term_counts(docs, text_col), "pii-terms")
    entities = stage(protected(found), "pii-entities")
    keys = small(stage(entities.select("key").distinct(), "pii-keys"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
            .withColumn("key", _text_key()))
    inside = stage(rows.join(keys, "key").select("key", F.explode(_terms(F.col("text"))).alias("term"))
                   .groupBy("key", "term").agg(F.count(F.lit(1)).alias("n")), "pii-inside")
    told = (disclosures(entities, inside, counts, alpha).groupBy("key").agg(
        F.sort_array(F.collect_list("term")).alias("told"),
        F.sort_array(F.collect_list(F.when(F.col("ratio") >= 1, F.col("term")))).alias("removed")))
    terms = stage(rows.select("key", "text").dropDuplicates(["key"]).join(small(stage(told, "pii-disclosed")), "key")
                  .select("key", _term_spans("text", "told", "removed").alias("terms")), "pii-found")
    f, t = found.withColumn("key", _text_key()).alias("f"), terms.alias("t")
    both = f.join(t, F.col("f.key") == F.col("t.key"), "left")
    base = F.transform("f.base", lambda b: F.struct(b["start"].alias("start"), b["kind_no"].alias("kind_no"),
                                                    b["end"].alias("end"), b["kind"].alias("kind"),
                                                    F.lit("mask").alias("action")))
    none = F.expr("cast(array() as array<struct<start:int,kind_no:int,end:int,kind:string,action:string>>)")
    free = F.filter(F.coalesce("t.terms", none), lambda x: ~F.exists(
        "f.base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return both.select("f.doc_id", "f.text_hash", F.array_sort(F.concat(base, free)).alias("spans"))


def sanitise(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """``docs`` with ``text_col`` masked: base values become ``[KIND]``, disclosed terms ``[TERM]`` or nothing."""
    spans = find_spans(docs, id_col, text_col, **options).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    j = docs.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    masked = F.expr(f"""aggregate(__spans, struct(0 as pos, '' as out), (s, x) -> if(x.start < s.pos,
      struct(greatest(s.pos, x.end) as pos, s.out as out),
      struct(x.end as pos, concat(s.out, substring(coalesce(`{text_col}`, ''), s.pos + 1, x.start - s.pos),
        if(x.action = 'remove', '', concat('[', upper(x.kind), ']'))) as out)),
      s -> concat(s.out, substring(coalesce(`{text_col}`, ''), s.pos + 1)))""")
    return j.withColumn(text_col, F.when(F.col(text_col).isNotNull(), masked)).select(*docs.columns)


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_spans``."""
    base = "filter(spans, s -> s.action = 'mask')"
    return found.select("doc_id", *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias("n_" + k)
                                    for k in KINDS],
                        F.expr(f"sha2({joined(base)}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"),
                        F.expr("cast(size(filter(spans, s -> s.kind = 'term')) as bigint)").alias("n_term"))
