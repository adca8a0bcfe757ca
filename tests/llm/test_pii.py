import hashlib
import random
import re

from cases import ROWS, documents

from lumisync.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    found = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), no, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def _spans(row):
    return [f"{s.kind}:{s.start}:{s.end}" for s in row.spans]


def test_base_spans_by_brute_force(spark):
    rng = random.Random(5)
    pieces = ["a@b.c", "a@b", "x.y_z%+-@Q-1.co.uk", "@", ".", "1.2.3.4", "256.1.1.1", "0255.10.0.1", "1.2.3.4.5.6.7.8", "+1 (706) 555-3138",
              "+", "++49 30 1234567", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", " ", "-", "\u00e9", "\U0001F600", "\n",
              "12", "_d@e.f", "a" * 50, "(", ")", "+1((((", "99999999999.1.1.1"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))) for i in range(300)] + ROWS
    rows += [(900, "a" * 100_000), (901, "1" * 100_000), (902, "+1" + "(" * 50_000), (903, "a." * 20_000 + "@" + "b." * 20_000 + "c"),
             (904, "1.2." * 20_000), (905, "1 " * 30_000)]
    got = P.find_pii(documents(spark, rows)).collect()
    want = {}
    for doc_id, text in rows:
        want.setdefault((doc_id, text), base_spans(text))
    assert len(got) == len(rows)
    for r in got:
        kept = [s for s in _spans(r) if s.split(":")[0] in PATTERNS]
        assert kept == want[r.row.doc_id, r.row.text], r.row.text[:80]


def test_further_kinds_need_a_checksum_or_context(spark):
    rows = [(1, "Pay to DE89 3704 0044 0532 0130 00 today"), (2, "Pay to DE88 3704 0044 0532 0130 00 today"),
            (3, "My SSN is 123-45-6789."), (4, "Part 123-45-6789."), (5, "My SSN is 000-45-6789."), (6, "GB82WEST12345698765432")]
    got = {r.row.doc_id: [s for s in _spans(r) if s[:4] in ("iban", "ssn:")] for r in P.find_pii(documents(spark, rows)).collect()}
    assert got == {1: ["iban:7:34"], 2: [], 3: ["ssn:10:21"], 4: [], 5: [], 6: ["iban:0:22"]}


def test_context_raises_the_score(spark):
    rows = [(1, "call +1 706 555 3138"), (2, "xyzq +1 706 555 3138")]
    scores = {r.row.doc_id: r.spans[0].score for r in P.find_pii(documents(spark, rows)).collect()}
    assert scores[1] > scores[2]


def test_redaction(spark):
    rows = [(1, "to a@b.de, or +1 706 555 3138!"), (2, "nothing"), (3, None), (4, ""), (5, "x 1.2.3.4@5.6 y"),
            (6, "\U0001F600 a@b.de a@c.de")]
    got = {r.doc_id: r for r in P.redact(documents(spark, rows)).collect()}
    assert [got[i].text for i in range(1, 7)] == [
        "to [EMAIL], or [PHONE]!", "nothing", None, "", "x [EMAIL] y", "\U0001F600 [EMAIL] [EMAIL]"]
    assert all(got[i].n_chars == (None if got[i].text is None else len(got[i].text)) for i in got)
    assert P.redact(documents(spark, [])).columns == documents(spark, []).columns


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in P.op1_pii(spark, sf).collect():
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]


def test_account_numbers_of_known_and_other_lengths(spark):
    rows = [(1, "BE68 5390 0754 7034 AND more"), (2, "AT61 1904 3002 3457 3201 THE"), (3, "xBE68539007547034."), (4, "ABE68539007547034"),
            (5, "BE685390075470345"), (6, "NO9386011117947"), (7, "\U0001f600 MT84MALT011000012345MTLCAST001S"),
            (8, "BE68539007547034 BE68 5390 0754 7034"), (9, "BE69 5390 0754 7034"), (10, "GB82 WEST 1234 5698 7654 32")]
    got = {r.row.doc_id: [tuple(s)[:3] for s in r.spans if s.kind == "iban"] for r in P.find_pii(documents(spark, rows)).collect()}
    assert got == {1: [(0, 19, "iban")], 2: [(0, 24, "iban")], 3: [(1, 17, "iban")], 4: [], 5: [], 6: [(0, 15, "iban")],
                   7: [(2, 33, "iban")], 8: [(0, 16, "iban"), (17, 36, "iban")], 9: [], 10: [(0, 27, "iban")]}
