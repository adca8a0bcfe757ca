import random
import re
from collections import Counter, defaultdict

import pytest
from cases import ROWS, documents

from lumisync.llm import collocations as C

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, chunk string, phrase string, f long, rank int, size string"


def _pieces(text):
    pieces = re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER))
    return [re.findall(r"[^\x20\x09]+", piece) for piece in pieces]


def phrase_counts(rows):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for words in _pieces(text):
            for k in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return counts


def brute_force(rows, least=30, first=2000):
    out = []
    for lang, f in phrase_counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        strong = {p: c for p, c in f.items() if c >= least and len(p) > 1}
        dropped = set()
        for p, c in strong.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * c >= 80 * f[p[i:i + k]]:
                        dropped.add(p[i:i + k])
        found = []
        for p, a in strong.items():
            if p not in dropped:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        found.sort()
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(found[:first], 1)]
    return sorted(out)


def _got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", 1, 2, "z") for i, (lang, t) in enumerate(rows)], SCHEMA)


def _random_rows(n=150, seed=2):
    rng = random.Random(seed)
    words = ["a", "b", "New", "york", "City", "été", "İ", "x\x1cy", "\xa0", "||", "%s", *(f"w{i}" for i in range(8))]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for _ in range(n):
        parts = [rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"])
                 for _ in range(rng.randrange(80))]
        rows.append((rng.choice(["en", "de", None, ""]), "".join(parts) + rng.choice(["", passage, "new york city " * 5])))
    return rows + [("en", None), ("xx", ""), ("en", "the " * 700), ("en", ". , !"), ("de", passage * 9)] + rows[:20]


def test_against_brute_force(spark):
    rows = _random_rows()
    want = brute_force(rows)
    assert len(want) > 20 and _got(C.collocations(_docs(spark, rows))) == want
    assert _got(C.collocations(_docs(spark, rows), 12, first=7)) == brute_force(rows, 12, 7)


@pytest.mark.parametrize("tokens, size", [(1, 1 << 20), (2, 40), (16, 300), (1 << 30, 1 << 20)])
def test_every_phrase_is_counted_once(spark, monkeypatch, tokens, size):
    """With triggers everywhere and nowhere, and texts that are parsed in parts."""
    monkeypatch.setattr(C, "CHUNK_TOKENS", tokens)
    monkeypatch.setattr(C, "SLICE_BYTES", size)
    rows = _random_rows(40, tokens + size)
    total = defaultdict(Counter)
    for lang, text in rows:
        seen = Counter(C._parse(C._parts((text or "").encode())))
        assert seen == Counter(C._parse([(text or "").encode()] if text else []))  # parts do not move chunks
        table = C.pa.table({"lang": [lang or "und" if lang is None else lang] * len(seen), "chunk": [c.decode() for c in seen],
                            "parses": list(seen.values())}, C.pa.schema([("lang", C.pa.string()), ("chunk", C.pa.string()), ("parses", C.pa.int64())]))
        for k in range(1, 5):
            tokens_of = C._Slice(table)
            anywhere = C.np.ones(len(tokens_of.numbers), bool)
            for i in range(1, k):
                anywhere[:-i] &= tokens_of.numbers[i:] > 0
            for r in tokens_of.counts(k, anywhere).to_pylist() if len(seen) else []:
                total[r["lang"]][tuple(r["phrase"].split(" "))] += r["f"]
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in phrase_counts(rows).items() if v}


def test_copies_share_chunks(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(2000))
    chunks = C.parse_chunks(_docs(spark, [("en", text), ("en", "something before " + text), ("en", text + " and after")]))
    parses = [r.parses for r in chunks.collect()]
    assert sum(p >= 3 for p in parses) > 0.9 * len(parses)


def test_edge_cases_and_empty_tables(spark):
    want = brute_force([("en", text) for _, text in ROWS], 2)
    assert want and _got(C.collocations(documents(spark), 2)) == want
    assert C.collocations(documents(spark, [])).collect() == []


def test_scores_beyond_64_bits(spark):
    score = spark.range(1).selectExpr("cast(9000000000000000000 as bigint) as a", "cast(4500000000000000000 as bigint) as l").selectExpr(
        "cast(a as decimal(20,0)) * 2000000 div cast(l + 1 as decimal(20,0)) as s").first().s
    assert score == 2_000_000 * 9 * 10**18 // (45 * 10**17 + 1)


def test_query(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _got(C.op13_collocations(spark, sf)) == brute_force(rows)
