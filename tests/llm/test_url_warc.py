"""URL filter rules and templates, WARC round trips, connected components."""
import base64
import hashlib
import random

from fleetscope.llm import url_filter as U
from fleetscope.llm import warc as W
from fleetscope.llm.common import components

URLS = [None, "", "no scheme", "http://A.Net/x", "http://a.net", "http://net/", "https://x.EXAMPLE.com/de/1?q=/#f", "https://example.com/de/",
        "https://notexample.com/de/1", "http://w.example.net/en/5", "http://w.example.net/fr/5", "http://z.org/fr/a", "http://z.org/FR/a",
        "a://b://c.net/p", "http://h.net?x=1", "http://h.net#t/://y", "http://ünï.net/é?ü", "http://" + "a" * 30_000 + ".net/" + "9" * 30_000]


def expected(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max((r[1] + r[2] for r in fit), key=len, default=None)


def test_hosts_paths_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[3], "h"), (3, URLS[3], "h")], "page_id long, url string, host string")
    got = U.judge(df).collect()
    assert len(got) == len(URLS) + 2
    verdict = {r[1] + r[2]: r[0] for r in U.RULES}
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule) == expected(URLS[r.page_id])
        assert r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert U.judge(df.limit(0)).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    rows = [(f"http://shop.io/item/{i}", "block") for i in range(20)] + [("http://shop.io/item/999", None)]
    rows += [(f"http://shop.io/user/{'abcdefgh'[i % 8] * (i + 1)}", "allow") for i in range(20)] + [("http://shop.io/user/new", None)]
    rows += [("http://shop.io/lone", None), ("http://other.io/item/5", None)]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id long, url string, y string")
    judged = U.judge(df.withColumnRenamed("y", "label0").drop("label0"), rules=())
    assert {r.verdict for r in judged.collect()} == {"allow"}          # nothing labelled, nothing rejected
    learnt = U.template_verdicts(df.select(U.host_of(df.url).alias("host"), U._generalised(U.path_of(df.url)).alias("shape"), df.y.alias("label")),
                                 max_children=10).collect()
    told = {(r.host, r["shape"]): r.rejected for r in learnt}
    assert told["shop.io", "/item/0"] is True and told["shop.io", "/user/new"] is False and ("other.io", "/item/0") not in told


def test_rules_reject_unruled_urls_through_the_tree(spark):
    """Labels from the rules alone: an unruled url of a host whose ruled urls are all blocked is rejected, one of an allowed host is not."""
    urls = [f"http://bets.example.com/de/{i}.html" for i in range(4)] + [f"http://bets.example.com/en/{i}.html" for i in range(9)]
    urls += [f"http://good.org/fr/{i}.html" for i in range(4)] + [f"http://good.org/en/{i}.html" for i in range(9)]
    urls += [f"http://mixed.example.com/de/a/{i}" for i in range(3)] + ["http://lone.example.com/de/1", "http://lone.example.com/en/1", "http://unseen.io/en/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.source) for r in U.judge(df).collect()}
    told = {u: got[i] for i, u in enumerate(urls)}
    assert {v for u, v in told.items() if "bets" in u and "/en/" in u} == {("block", "tree")}
    assert {v for u, v in told.items() if "good" in u and "/en/" in u} == {("allow", "tree")}
    assert told["http://lone.example.com/en/1"] == told["http://unseen.io/en/1"] == ("allow", "tree")       # too few labels, and none


def test_prior_outweighs_thin_evidence(spark):
    """Three blocked urls among many unlabelled ones do not reject a branch of a host that is mostly allowed."""
    rows = [("/a/x", "block")] * 3 + [("/a/x", None)] * 60 + [("/b/y", "allow")] * 40
    df = spark.createDataFrame([("h", s, y) for s, y in rows], "host string, shape string, label string")
    assert {r["shape"]: r.rejected for r in U.template_verdicts(df).collect()}["/a/x"] is False
    alone = df.where("label is not null")
    assert {r["shape"]: r.rejected for r in U.template_verdicts(alone, smoothing=0.1).collect()}["/a/x"] is True


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_round_trip_and_edges(spark):
    rnd = random.Random(1)
    big = "".join(rnd.choices("abc é\r\n", k=400_000))
    pages = [(5, "http://a/\r\nX: y", "same"), (3, None, "same"), (9, "u", big), (8, "u", big), (1, "u", None), (2, "u", ""), (None, "u", "same"),
             (7, "u", "WARC/1.1\r\n\r\n"), (7, "u", "WARC/1.1\r\n\r\n"), (6, "u", "same "), (None, "u", "only null")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, record_no int")
    got = sorted(W.round_trip(df.repartition(3), chunk_bytes=1000, max_archive_bytes=10_000).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), key=str)
    want = []
    for i, _, h in pages:
        ids = [p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None]
        again = bool(ids) and i != min(ids)
        want.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", min(ids) if again else None))
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted((spark.createDataFrame([w], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long").first() for w in want), key=str)]
    assert W.round_trip(df.limit(0)).count() == 0
    assert W.round_trip(df, min_revisit_bytes=5).where("record_type = 'revisit'").count() == 1


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000 + rnd.randrange(60), 1000 + rnd.randrange(60)) for _ in range(50)] + [(5, k) for k in range(6, 40)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 4), (4, 4), (5, 6)], "a long, b long")
    assert {r.id: r.component_id for r in components(df).collect()} == {i: find(i) for i in root}
