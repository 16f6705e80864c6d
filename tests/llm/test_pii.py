import hashlib
import random
import re

from groundwork.llm.pii import KINDS, find_spans, pii_report, redact_documents


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
}


def brute(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text or "") if ok(m[0])]


def texts():
    rng = random.Random(4)
    bits = ["a.b+c@d-e.f.gh", "x@y", "x@y.z_w@v.u", "@@", "1.2.3.4", "001.255.0.9", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111  1111", "49927398716",
            "+1 (212) 555-0101", "+44 20 7946 0958", "+1-", "é", "漢字", "😀", " ", "\n", "-", ".", "12", "0", "DE89370400440532013000", "GB82WEST12345698765432", "GB82WEST12345698765433", "call ", "iban ", "\u0001"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    return [*out, None, "", "1" * 30000, "1 " * 20000 + "2", "a." * 30000 + "@b.c", "a@" + "b." * 20000 + "c", "+1" + "(" * 20000, "@" * 5000, "4" * 20]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, joined string, spans int")
    got = {r["doc_id"]: r for r in pii_report(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (t or "")[:200]
        for kind in PLAIN:
            assert got[i][f"n_{kind}"] == sum(k == kind for k, _, _ in want)


def test_iban_and_context(spark):
    rows = [(1, "iban DE89370400440532013000"), (2, "x DE89370400440532013001"), (3, "card 4111111111111111"), (4, "zz 4111111111111111"), (5, "an order, card 4111111111111111")]
    rows += [(6, "IBAN: DE89 3704 0044 0532 0130 00."), (7, "GB82 WEST 1234 5698 7654 32"), (8, "DE89 3704 0044 0532 0130 01"), (9, "DE89 3704 0044 0532 0130 00 AND SO"), (10, "IBAN DE89370400440532013000 é GB82WEST12345698765432")]
    got = {r["doc_id"]: r["spans"] for r in find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ibans = {i: [(s["start"], s["end"]) for s in x if s["kind"] == "iban"] for i, x in got.items()}
    assert ibans == {1: [(5, 27)], 2: [], 3: [], 4: [], 5: [], 6: [(6, 33)], 7: [(0, 27)], 8: [], 9: [(0, 27)], 10: [(5, 27), (30, 52)]}
    assert got[3][0]["score"] > got[5][0]["score"] == got[4][0]["score"] and "iban" in KINDS


def test_context_decides_about_bare_numbers(spark):
    rows = [(1, "my account number is 12345678901"), (2, "there are 12345678901 of them"), (3, "test account 12345678901"), (4, "passport 123-45-67890, account 1234567"), (5, "account 4111111111111111"), (6, "order 12345678901")]
    rows += [(7, "12345678 is my account number"), (8, "12345678 is the number of my order; see account"), (9, "12345678" + " " * 41 + "account")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("account", 21, 32)], 2: [], 3: [], 4: [("account", 9, 21)], 5: [("card", 8, 24)], 6: [], 7: [("account", 0, 8)], 8: [], 9: []}


def test_context_stands_on_both_sides(spark):
    rows = [(1, "4111111111111111 (credit card)"), (2, "4111111111111111 zz"), (3, "4111111111111111 is an order"), (4, "a 4111111111111111 b 4111111111111111 credit card")]
    got = {r["doc_id"]: [s["score"] for s in r["spans"]] for r in find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] > got[2][0] > got[3][0] and got[4] == [got[2][0], got[1][0]]  # as far as the next match


def masked(text):
    """Redaction by brute force, from the spans of the operator."""
    from groundwork.llm.pii import MASK

    def run(spans):
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], MASK[s["kind"]]]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    return run


def test_redaction(spark):
    rows = [(1, "é mail a@b.cd, 4111 1111 1111 1111!"), (2, None), (3, "clean"), (4, "+4111111111111 111 x")] + [(10 + i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in redact_documents(df).collect()}
    spans = {r["doc_id"]: r["spans"] for r in find_spans(df).collect()}
    assert got == {i: None if t is None else masked(t)(spans[i]) for i, t in rows}
    assert got[1] == "é mail [EMAIL], [CARD]!" and got[2] is None and got[3] == "clean"


def test_time_of_a_text_with_many_matches(spark):
    import time

    took = []
    for n in (2000, 8000, 16000):
        df = spark.createDataFrame([(1, " ".join(f"user{k}@host{k}.example" for k in range(n)))], "doc_id long, text string")
        began = time.time()
        row = redact_documents(df).first()
        took.append(time.time() - began)
        assert row["text"] == " ".join(["[EMAIL]"] * n)
    assert took[2] < 2 * took[1] + 2, took
