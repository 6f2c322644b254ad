"""Personal data: base spans against a brute-force scan, disclosure and masking on small corpora."""
import hashlib
import re

from fleetscope.llm import pii

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
      "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
      "card": r"[0-9]([\x20-]?[0-9])+",
      "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")),
            "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    out = []
    for no, k in enumerate(pii.KINDS):
        out += [(m.start(), no, m.end(), k) for m in re.finditer(RX[k], text or "") if ok(k, m.group())]
    return sorted(out)


CASES = [None, "", "a@b.cc.d@e.f", "a@b.c_x@d.e ..a@b a@b. a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3",
         "4111 1111-1111 1111 4111111111111111 4111111111111112 411111111111111111111 1 2 3", "+1 (555) 123-4567. +12 +1-2 +49 30 1234567 x",
         "ü😀 mail é.x@y.zz 😀 +44 20 7946 0958, 10.0.0.1", "x" * 50_000 + "@" + "y" * 50_000 + ".z", "1" * 60_000, "9 " * 20_000,
         "a." * 20_000 + "@b.c", "5500005555555559", "+4111111111111111", "%%@a.b@c.d", "1.1.1.1@x.y"]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, base string")


def test_base_spans_equal_brute_force(spark):
    got = {r.doc_id: r for r in pii.digest(pii.find_spans(rows(spark, CASES))).collect()}
    assert len(got) == len(CASES)
    for i, t in enumerate(CASES):
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute(t))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[3] == k for x in brute(t)) for k in pii.KINDS]


def test_disclosed_terms_and_masking(spark):
    secret = "contact zorblax at joe.smith@corp.example now"
    texts = [secret] * 4 + ["contact people at noon now " * 50] * 3
    found = pii.digest(pii.find_spans(rows(spark, texts))).collect()
    by = {r.doc_id: r for r in found}
    assert by[0].spans == "term:8:15,email:19:41" and by[0].n_email == 1
    assert by[5].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(rows(spark, texts)).collect()}
    assert clean[0] == "contact  at [EMAIL] now" and clean[5] == texts[5]


def test_empty_null_and_repeated_rows(spark):
    assert pii.find_spans(rows(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a@b.c"), (1, None), (1, "x"), (1, "x")], "doc_id long, text string")
    got = pii.digest(pii.find_spans(df)).collect()
    assert sorted((r.doc_id is None, r.n_email) for r in got) == [(False, 0)] * 3 + [(True, 1)]
    assert pii.sanitise(df).count() == 4


def test_whole_table(spark):
    from fleetscope.llm.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op8_pii"](spark, "/root/testdata/sf0.01").collect()}
    for d in docs:
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute(d.text))
        assert got[d.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[d.doc_id].spans.split(","))


def test_an_entity_that_occurs_once_discloses_unique_terms(spark):
    filler = "people met at noon and went home after lunch "
    far = "Zorblax wrote this. " + filler * 20 + "Mail to Joe.Smith@corp.example or zorblax."      # over 64 characters apart
    texts = [far, "call +49 30 1234567 about quuxbar today"] + [filler + "call about today this wrote mail or"] * 40 + ["quuxbar " + filler] * 9
    found = {r.doc_id: r for r in pii.digest(pii.find_spans(rows(spark, texts))).collect()}
    at, end = far.index("Joe."), len(far) - 1
    assert found[0].spans == f"term:0:7,email:{at}:{at + 22},term:{end - 7}:{end}"
    assert found[1].spans == "phone:5:19"                    # quuxbar occurs mostly elsewhere
    assert all(found[i].spans == "" for i in range(2, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitise(rows(spark, texts)).collect()}
    assert clean[0].startswith(" wrote this. ") and clean[0].endswith("Mail to [EMAIL] or .")
