import hashlib
import re
import time

from siltstone.llm import pii

KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_base(text):
    found = []
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and passes_luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if ok:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def told(spans):
    return ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in spans)


TEXTS = [
    None, "", "no data", "write a@b.c_d@e.fr, x@y.z or a@b@c.d e@f", "é𝄞 me@ex.org é 1.2.3.4.5 and 256.1.1.1 and 001.002.003.0004",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4524132264652876", "+1 (988) 555-2485 and +12.5 and +49 30 1234567890123456",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE89370400440532013001", "tel 555-123-4567 but 555-123-4567 more",
    "9" * 30000, "a" * 30000 + "@b.co", "1.1." * 8000, "+1 " * 5000, "a@b.co " * 2000, "2" * 16 + " x@y.zz +1 (222) 333-4444 1.1.1.1",
    "IBAN GB82 WEST 1234 5698 7654 32", "x@y.z" + "-" * 50 + "@q.r",
]


def test_base_spans_equal_brute_force(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, rank string")
    for r in pii.pii_digest(frame).collect():
        want = brute_base(TEXTS[r.doc_id])
        for rank, kind in enumerate(KINDS):
            assert r[f"n_{kind}"] == sum(s[1] == rank for s in want), (r.doc_id, kind)
        assert r.base_sha256 == hashlib.sha256(told(want).encode()).hexdigest(), r.doc_id
        spans = r.spans.split(",") if r.spans else []
        assert set(told(want).split(",") if want else []) <= set(spans)


def test_added_spans_need_checksum_or_context(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_digest(frame).collect()}
    assert got[7] == "iban:5:32,iban:37:59"
    assert got[8].startswith("local:4:16")
    assert got[15] == "iban:5:32"


def test_very_many_matches_in_one_text(spark):
    text = "𝄞 call +1 (555) 123-4567 a.b@c.de, 10.0.0.1 tel 555-123-4567; " * 25000
    began = time.monotonic()
    row = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.monotonic() - began < 60
    want = brute_base(text)
    assert (row.n_email, row.n_ip, row.n_phone) == (25000, 25000, 25000)
    assert row.base_sha256 == hashlib.sha256(told(want).encode()).hexdigest()
    assert row.spans.count("local:") == 25000


def test_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.pii_digest(docs).collect():
        assert r.base_sha256 == hashlib.sha256(told(brute_base(texts[r.doc_id])).encode()).hexdigest()


def test_empty_table(spark):
    assert pii.pii_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
