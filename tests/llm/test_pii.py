import hashlib
import re

from driftlog.llm import pii
from tests.llm.helpers import docs, prose

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in FORMS.items() for m in re.finditer(p, t or "") if ok(k, m[0])]


TEXTS = [
    None, "", "a@b.com-x_y@z.org éé😀 +1 (269) 555-3296 4524132264652876", "1.2.3.4.5 999.1.1.1 0000255.1.1.1 99999999999999999999.1.1.1", "+1", "+1+2 3456789 (0)",
    "4111 1111-1111 1111 +49 30 123456", "a.b@c.d@e.f.g x@y", "1-" * 4000 + "1", "x" * 5000 + "@" + "1" * 5000, "mail x.y%z@q-w.e.r.t. +12345678.", "10.0.0.256 1.1.1.1.1.1.1.1",
    "4111111111111111 4111111111111112 41111111111111111111", "é@b.com @b.com a@-.-", "+1 (2) 3-4.5 6 7 8 9 10 11 12 13 14 15",
]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = TEXTS + [f"{prose(i, 20)} u{i}@mail{i}.example.com {prose(i, 5)} 10.{i}.3.4 +1 (555) 555-{1000 + i}, {prose(i, 9)}" for i in range(20)]
    for r in pii.digest(pii.find_pii(docs(spark, texts))).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in pii.KINDS]
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_supervision_adds_wider_spans_in_context(spark):
    strict = [f"{prose(i, 8)} mail u{i}@host.com {prose(i, 4)} call +1 (312) 555-0{100 + i} {prose(i, 3)}" for i in range(40)]
    wide = ["please call (312) 555-0199 now", "contact john [at] site [dot] com today", "the number 312555 0199 is a part number"]
    rows = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(docs(spark, strict + wide))).collect()}
    assert rows[40] == "phone:12:26" and rows[41] == "email:8:32" and rows[42] == ""


def test_redaction_replaces_spans_and_keeps_the_rest(spark):
    d = docs(spark, ["é x@y.com 😀 1.2.3.4 z", "nothing", None])
    rows = pii.redact(pii.find_pii(d)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["é <EMAIL> 😀 <IP> z", "nothing", None] and rows[0].n_chars == len(rows[0].text)
    assert rows[0].asDict().keys() == set(d.columns)


def test_very_long_texts(spark):
    """Thousands of spans over several blocks: places, and what redaction leaves, as one by one."""
    import time

    one = "é mail a.b@c.de 10.1.2.3 +49 30 1234567, zz "
    text = one * 6000 + "w" * 9000 + "b@c.de"
    start = time.perf_counter()
    found = pii.find_pii(docs(spark, [text, "x" * 5000 + " b@c.de", None])).cache()
    rows = pii.digest(found).orderBy("doc_id").collect()
    assert rows[0].base_sha256 == hashlib.sha256(",".join(base(text)).encode()).hexdigest() and rows[0].n_email == 6001
    red = pii.redact(found).orderBy("doc_id").collect()
    assert red[0].text == "é mail <EMAIL> <IP> <PHONE>, zz " * 6000 + "w" * 9000 + "<EMAIL>" or red[0].text.count("<EMAIL>") == 6001
    assert red[1].text == "x" * 5000 + " <EMAIL>" and red[2].text is None
    assert time.perf_counter() - start < 60


def test_defined_cases(spark):
    assert pii.digest(pii.find_pii(docs(spark, []))).count() == 0
    d = docs(spark, ["a@b.co"]).selectExpr("*", "1 AS spans", "2 AS n_email")
    assert [(r.spans, r.n_email) for r in pii.digest(pii.find_pii(d)).collect()] == [("email:0:6", 1)]


def test_repeated_rows_and_overlaps(spark):
    """Kinds that overlap keep their spans; redaction takes the earlier and longer one; rows repeat."""
    text = "call +4111 1111 1111 1111 or 4111 1111 1111 1111@x.de"
    d = docs(spark, [text])
    found = pii.find_pii(d.unionByName(d))
    rows = pii.digest(found).collect()
    assert len(rows) == 2 and all(r.base_sha256 == hashlib.sha256(",".join(base(text)).encode()).hexdigest() for r in rows)
    red = {r.text for r in pii.redact(found).collect()}
    assert len(red) == 1 and "4111" not in red.pop()


def test_em_recovers_reliabilities():
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.random(20_000) < 0.6
    acc = [0.95, 0.8, 0.75]
    votes = np.stack([np.where(rng.random(len(z)) < a, z, ~z) for a in acc], 1) * 2
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    p = pii._em(patterns, n.astype(float))
    at = {tuple(v): q for v, q in zip(patterns, p, strict=True)}
    assert at[2, 2, 2] > 0.97 and at[0, 0, 0] < 0.03 and at[2, 0, 0] > at[0, 2, 0]
