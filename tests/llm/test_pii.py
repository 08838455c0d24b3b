import hashlib
import re

from llm.conftest import ODD_TEXTS, with_clashes

from tramline.llm import pii

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k, shape in SHAPES.items() for m in re.finditer(shape, text or "", re.ASCII) if valid(k, m[0])]


TEXTS = [
    *ODD_TEXTS,
    "a.b@c.de, x@y@z.com a@b.c.d@e.f @q.r s@t", "é🙂 mail é@x.org 🙂 k@l-m.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1 0.0.0.0 001.002.003.004 1.2.3 00000000255.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111111 4111  1111 1111 1111 12 4111 1111 1111 1111", "+1 (555) 010-9999 +12 +1234567 +12345678 +1234567890123456 +1 2 3 4 5 6 7 8) x+49.30.1234567",
    "+4915 1234 5678 @ 10.0.0.1 me@10.0.0.1", "9" * 20_000, "1 " * 9_000, "a" * 20_000 + "@" + "b." * 5_000, "+" + "1(" * 8_000, "." * 20_000, "4111111111111111" * 3,
]


def test_base_spans_are_the_plain_ones(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TEXTS)], docs.schema)).cache()
    got = {r.doc_id: r for r in pii.personal_data(with_clashes(docs)).collect()}
    for doc_id, text in docs.collect():
        want = plain_base(text)
        assert [tuple(s) for s in got[doc_id].base] == want, (text or "")[:80]
        assert set(want) <= set(map(tuple, got[doc_id].spans))
        assert [got[doc_id][f"n_{k}"] for k in SHAPES] == [sum(s[0] == k for s in want) for k in SHAPES]


def test_query_joins_its_spans(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in pii.op8_pii(spark, folder).collect():
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))


def test_the_trees_add_odd_writings_and_leave_numbers_alone(spark):
    rows = [(1, "write to bob (at) example (dot) com soon"), (2, "call 555-123-4567 today"), (3, "order 555-123-4567 shipped"), (4, "look at this dot then"), (5, "server 10[.]0[.]0[.]7 is down"), (6, "plain words only")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["email"], 2: ["phone"], 3: [], 4: [], 5: ["ip"], 6: []}


def test_edge_cases_and_redaction(spark):
    docs = spark.createDataFrame([(None, "a@b.co x"), (1, None), (1, "🙂 a@b.co, +12345678."), (1, "none")], "doc_id long, text string")
    assert sorted(r.n_email for r in pii.personal_data(docs).collect()) == [0, 0, 1, 1]
    assert sorted(r.text for r in pii.redact(docs).collect()) == ["", "[email] x", "none", "🙂 [email], [phone]."]
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_pre_tests_let_through_what_their_patterns_match(spark):
    samples = [
        "bob (at) example (dot) com", "bob[@]example[.]com", "bob { at } example < dot > co < . > uk", "bob at example dot com", "x at y dot z dot w", "10[.]0[.]0[.]7", "10 dot 0 dot 0 dot 7", "10 (dot) 0(dot)0 ( . ) 7",
        "4111.1111.1111.1111", "4111/1111/1111/1111", "4111_1111_1111_1111", "4111  1111  1111  1111", "3782 822463 10005", "378282246310005", "3482-822463-10005", "555-123-4567", "(555) 123-4567", "0049 30 1234 5678", "020.7946.0958",
        "a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 555 0100999",
    ]
    cases = sorted({f(s) for s in samples for f in (str, str.upper, str.title, str.swapcase, lambda s: s.replace("dot", "Dot"), lambda s: s.replace("at", "aT"))})
    texts = spark.createDataFrame([(t,) for t in [*cases, *[f"é {t}, then" for t in cases]]], "t string").cache()
    pairs = [(pattern, may) for (_, pattern), may in zip(pii.GENERATORS, pii._GENERATOR_MAY, strict=True)] + [(pii.BASE[k], pii._MAY[k]) for k in pii.KINDS]
    for pattern, may in pairs:
        found = texts.where(f"t RLIKE {pii._quoted(pattern)}")
        assert found.count() > 1, pattern
        assert found.where(f"NOT ({may.format(t='t')})").collect() == [], pattern


def test_written_out_addresses_are_proposed_in_any_case(spark):
    from pyspark.sql import functions as F

    rows = [("mail bob at example dot com now",), ("MAIL BOB AT EXAMPLE DOT COM NOW",), ("mail bob at example Dot com now",)]
    got = spark.createDataFrame(rows, "t string").select(F.expr(pii._candidates("t")).alias("c")).collect()
    assert [[(c.k, c.s, c.e) for c in r.c] for r in got] == [[(0, 5, 27)]] * 3
