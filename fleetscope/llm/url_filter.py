"""URL filter: host and path rules, then a path-template tree per host (DataFrame functions only).

``judge`` gives every url a verdict:

1. *Rules* ``(verdict, host, path)``: a rule fits its host and all subdomains if
   the url's path starts with the rule's path; the longest fitting rule wins.
2. *Template tree* for the rest. Digit runs and long hexadecimal runs of a path
   are generalised (``/en/7198.html`` -> ``/en/0.html``), and below a branch with
   more than ``max_children`` different segments every segment becomes ``*``.
   Each prefix of a template is a node of its host's tree and counts its urls,
   the labelled ones (those a rule decided, or ``labels``) and the blocked ones.
   Sibling branches whose blocked shares do not differ from the pooled share of
   their labelled siblings (z test) are merged: they share the pooled counts.
   A url takes the deepest node on its path that is *judged*, i.e. holds
   ``min_support`` labelled urls; the node is rejected if its smoothed purity
   (blocked + s * prior) / (labelled + s) reaches ``purity``. The prior is the
   host's blocked share, itself smoothed towards the share of all labelled urls; its
   weight s = smoothing * urls / labelled grows with the urls that nobody
   labelled, so thin evidence leans on the host. Urls without a judged node are allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: then up to ``?``, ``#`` or the end. Null urls and urls without ``://`` have an
empty host and path, fit no rule and form one tree of their own (allowed unless
labels say otherwise). Rows are judged one by one: repeated rows and null ids
each keep their row; columns other than the id and the url are not carried, so
clashing names cannot occur; an empty table gives an empty result. The depth
of the tree is bounded by ``max_depth``: deeper segments share the node above
them, no url is left out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
TREE = dict(max_depth=4, max_children=64, min_support=3, z=1.96, smoothing=2.0, purity=0.8)


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def _fitting(rules, host: Column, path: Column, value) -> Column:
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("string")
    for rule in reversed(ordered):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _generalised(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{16,}", "x"), "[0-9]+", "0")


def _key(tokens: Column, depth: int) -> Column:
    return F.concat_ws("/", F.slice(tokens, 1, depth))


def templates(urls: DataFrame, max_depth: int, max_children: int) -> DataFrame:
    """(host, shape, tokens, n, labelled, blocked): one row per different generalised path."""
    t = (urls.groupBy("host", "shape")
         .agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"),
              F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("blocked"))
         .withColumn("tokens", F.slice(F.filter(F.split("shape", "/"), lambda s: s != ""), 1, max_depth)))
    for d in range(1, max_depth + 1):     # level by level: a wide branch becomes a wildcard
        level = t.where(F.size("tokens") >= d).select("host", _key(F.col("tokens"), d - 1).alias("parent"),
                                                       F.element_at("tokens", d).alias("seg"))
        wide = (level.distinct().groupBy("host", "parent").agg(F.count(F.lit(1)).alias("c"))
                .where(F.col("c") > max_children).select("host", "parent", F.lit(True).alias("wide")))
        t = (t.withColumn("parent", _key(F.col("tokens"), d - 1)).join(wide, ["host", "parent"], "left")
             .withColumn("tokens", F.when(F.col("wide") & (F.size("tokens") >= d), F.concat(
                 F.slice("tokens", 1, d - 1), F.array(F.lit("*")), F.slice("tokens", d + 1, max_depth)))
                 .otherwise(F.col("tokens"))).drop("parent", "wide"))
    return t


def template_verdicts(urls: DataFrame, **tree) -> DataFrame:
    """(host, shape, rejected) for every generalised path in ``urls`` (host, shape, label)."""
    p = dict(TREE, **tree)
    t = stage(templates(urls, p["max_depth"], p["max_children"]), "url-templates")      # read by two branches below
    path = t.select("host", "shape", "n", "labelled", "blocked", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("tokens")), lambda d: F.struct(
            d.alias("depth"), F.concat_ws("/", F.slice("tokens", F.lit(1), d)).alias("node"),
            F.when(d > 0, F.concat_ws("/", F.slice("tokens", F.lit(1), d - 1))).alias("parent")))).alias("s")
    ).select("host", "shape", "n", "labelled", "blocked", "s.*")
    nodes = stage(path.groupBy("host", "depth", "node", "parent").agg(
        *[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]), "url-nodes")        # read by five
    pool = nodes.where("labelled > 0 and depth > 0").groupBy("host", "depth", "parent").agg(
        (F.sum("blocked") / F.sum("labelled")).alias("share"))
    near = (F.abs(F.col("blocked") / F.col("labelled") - F.col("share"))
            <= F.lit(p["z"]) * F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("labelled")))
    nodes = nodes.join(pool, ["host", "depth", "parent"], "left").withColumn(
        "merged", F.coalesce((F.col("labelled") > 0) & near, F.lit(False)))
    pooled = nodes.where("merged").groupBy("host", "depth", "parent").agg(
        *[F.sum(c).alias("p_" + c) for c in ("n", "labelled", "blocked")])
    stat = {c: F.when(F.col("merged"), F.col("p_" + c)).otherwise(F.col(c)) for c in ("n", "labelled", "blocked")}
    a, one = F.lit(p["smoothing"]), F.lit(0).alias("one")
    total = nodes.where("depth = 0").agg(F.try_divide(F.sum("blocked"), F.sum("labelled")).alias("corpus"))            # one row
    hosts = (nodes.where("depth = 0 and labelled > 0").select("host", "labelled", "blocked", one)
             .join(F.broadcast(total.select("corpus", one)), "one")
             .select("host", ((F.col("blocked") + a * F.col("corpus")) / (F.col("labelled") + a)).alias("prior")))
    weight = F.try_divide(a * stat["n"], stat["labelled"])
    judged = nodes.join(pooled, ["host", "depth", "parent"], "left").where(stat["labelled"] >= p["min_support"]).join(hosts, "host").select(
        "host", "depth", "node", ((stat["blocked"] + weight * F.col("prior")) / (stat["labelled"] + weight) >= p["purity"]).alias("rejected"))
    deepest = path.select("host", "shape", "depth", "node").join(judged, ["host", "depth", "node"])
    return deepest.groupBy("host", "shape").agg(F.max_by("rejected", "depth").alias("rejected"))


def judge(pages: DataFrame, rules=RULES, labels: Column | None = None, id_col: str = "page_id",
          url_col: str = "url", **tree) -> DataFrame:
    """(id, host, path, rule, verdict, source) per row; ``labels``: own labelling expression for the tree."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = (rows.withColumn("rule", _fitting(rules, F.col("host"), F.col("path"), lambda r: r[1] + r[2]))
            .withColumn("ruled", _fitting(rules, F.col("host"), F.col("path"), lambda r: r[0]))
            .withColumn("shape", _generalised(F.col("path")))
            .withColumn("label", F.col("ruled") if labels is None else labels))
    learnt = template_verdicts(rows.select("host", "shape", "label"), **tree)
    return rows.join(learnt, ["host", "shape"], "left").select(
        id_col, "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("ruled").isNotNull(), "rule").otherwise("tree").alias("source"))


def oracle_sql(rules=RULES, **tree) -> str:
    """The same rows in DuckDB SQL."""
    p = dict(TREE, **tree)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def case(value):
        return "CASE " + " ".join(
            f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{value(r)}'"
            for r in ordered) + " ELSE NULL END"
    levels = []
    for d in range(1, p["max_depth"] + 1):
        levels.append(f"""
w{d} AS (SELECT host, parent FROM (SELECT DISTINCT host, array_to_string(tokens[1:{d - 1}], '/') parent, tokens[{d}] seg
  FROM t{d - 1} WHERE len(tokens) >= {d}) GROUP BY ALL HAVING count(*) > {p['max_children']}),
t{d} AS (SELECT t.* REPLACE (CASE WHEN w.host IS NOT NULL AND len(tokens) >= {d}
  THEN tokens[1:{d - 1}] || ['*'] || tokens[{d + 1}:] ELSE tokens END AS tokens)
  FROM t{d - 1} t LEFT JOIN w{d} w ON t.host = w.host AND array_to_string(t.tokens[1:{d - 1}], '/') = w.parent)""")
    n = p["max_depth"]
    return f"""
WITH h AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{HOST}', 1), ''), '{string.ascii_uppercase}',
    '{string.ascii_lowercase}') host, coalesce(regexp_extract(url, '{PATH}', 1), '') path FROM pages),
r AS (SELECT *, {case(lambda x: x[1] + x[2])} AS rule, {case(lambda x: x[0])} AS ruled,
  regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{16,}}', 'x', 'g'), '[0-9]+', '0', 'g') shape FROM h),
t0 AS (SELECT host, shape, count(*) n, count(ruled) labelled, sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END) blocked,
  list_filter(string_split(shape, '/'), lambda s: s <> '')[1:{n}] tokens FROM r GROUP BY host, shape),
{",".join(levels)},
path AS (SELECT host, shape, n, labelled, blocked, d AS depth, array_to_string(tokens[1:d], '/') node,
  CASE WHEN d > 0 THEN array_to_string(tokens[1:d - 1], '/') END parent
  FROM (SELECT *, unnest(range(0, len(tokens) + 1)) d FROM t{n})),
nodes AS (SELECT host, depth, node, parent, sum(n) n, sum(labelled) labelled, sum(blocked) blocked
  FROM path GROUP BY ALL),
pool AS (SELECT host, depth, parent, sum(blocked) / sum(labelled) share FROM nodes
  WHERE labelled > 0 AND depth > 0 GROUP BY ALL),
m AS (SELECT nodes.*, coalesce(labelled > 0 AND abs(blocked / labelled - share)
  <= {p['z']} * sqrt(share * (1 - share) / labelled), false) merged
  FROM nodes LEFT JOIN pool USING (host, depth, parent)),
pooled AS (SELECT host, depth, parent, sum(n) pn, sum(labelled) pl, sum(blocked) pb FROM m WHERE merged GROUP BY ALL),
s AS (SELECT m.host, m.depth, m.node, CASE WHEN merged THEN pn ELSE n END n, CASE WHEN merged THEN pl ELSE labelled END
  labelled, CASE WHEN merged THEN pb ELSE blocked END blocked FROM m LEFT JOIN pooled USING (host, depth, parent)),
total AS (SELECT sum(blocked) / sum(labelled) corpus FROM nodes WHERE depth = 0),
hosts AS (SELECT host, (blocked + {p['smoothing']} * corpus) / (labelled + {p['smoothing']}) prior FROM nodes, total
  WHERE depth = 0 AND labelled > 0),
judged AS (SELECT host, depth, node, (blocked + {p['smoothing']} * n / labelled * prior) / (labelled + {p['smoothing']} * n / labelled)
  >= {p['purity']} rejected FROM s JOIN hosts USING (host) WHERE labelled >= {p['min_support']}),
deepest AS (SELECT host, shape, arg_max(rejected, depth) rejected FROM path JOIN judged USING (host, depth, node)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN rejected THEN 'block' ELSE 'allow' END) verdict,
  CASE WHEN ruled IS NOT NULL THEN 'rule' ELSE 'tree' END source
FROM r LEFT JOIN deepest USING (host, shape)"""


__all__ = ["RULES", "TREE", "host_of", "path_of", "judge", "templates", "template_verdicts", "oracle_sql"]
