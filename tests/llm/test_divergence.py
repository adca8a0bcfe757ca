import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import ROWS, documents
from pyspark.sql import functions as F

from lumisync.llm import divergence as D

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, rank int"


def _words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute_force(rows, least=30, top=50):
    """Rows of (lang, source, text)."""
    rows = [(lang or "", source or "", _words(text)) for lang, source, text in rows]
    in_docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        in_docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, source in counts:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        groups = [g for g in counts if g[0] == lang]

        def share(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine, every = share(counts[lang, source]), share(sum((counts[g] for g in groups), Counter()))
        pairs = []
        for other in groups:
            if other[1] != source:
                theirs = share(counts[other])
                pairs.append((-sum(abs(mine[t] - theirs[t]) for t in kept), other[1].encode()))
        terms = [(every[t] - mine[t], t.encode()) for t in kept if counts[lang, source][t] and mine[t] > every[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, i) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


def _got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", "y", 1) for i, (lang, s, t) in enumerate(rows)], SCHEMA)


def _random_rows(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["été", "STRASSE", "你好", *(f"w{'x' * (i % 23)}{'abcdefg'[i % 7]}" for i in range(60)), "z" * 300, "z" * 301]
    return [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é", "~"]),
             rng.choice([None, "", "12 34 _"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))] * 20))
            for _ in range(n)]


def test_against_brute_force(spark, monkeypatch):
    rows = _random_rows(400) + [("xx", "only", None), ("yy", "p", "a b"), ("yy", "q", "c")]
    want = brute_force(rows)
    assert _got(D.audit_sources(_docs(spark, rows))) == want
    monkeypatch.setattr(D, "TERMS_A_BLOCK", 7)
    monkeypatch.setattr(D, "SOURCES_A_BLOCK", 2)
    assert _got(D.audit_sources(_docs(spark, rows))) == want
    assert _got(D.audit_sources(_docs(spark, rows), 5, 3)) == brute_force(rows, 5, 3)


def test_slices_and_long_documents_count_alike(monkeypatch):
    rows = _random_rows(120, 5) + [("en", "a", "one " * 500 + "two " + "ab" * 400)]
    table = pa.table({k: [r[i] or "" for r in rows] for i, k in enumerate(("lang", "source", "text"))})

    def sums(parts):
        total = defaultdict(lambda: [0, 0])
        for part in parts:
            for r in part.to_pylist():
                total[r["lang"], r["source"], r["term"]][0] += r["n"]
                total[r["lang"], r["source"], r["term"]][1] += r["docs"]
        return dict(total)

    whole = sums([D._count_slice(table)])
    monkeypatch.setattr(D, "SLICE_BYTES", 300)
    parts = []
    for part in D.arrow_slices(table.to_batches(max_chunksize=11), "text", 300):
        long = part.num_rows == 1 and len(part.column("text")[0].as_py()) > 300
        parts += D._count_long(part) if long else [D._count_slice(part)]
    assert len(parts) > 10 and sums(parts) == whole
    assert whole["en", "a", "one"][1] >= 1 and whole["en", "a", "ab" * 400] == [1, 1]


@pytest.mark.parametrize("base", [1, 10, 1 << 16])
def test_pointer_sort(monkeypatch, base):
    monkeypatch.setattr(D, "BASE_POINTERS", base)
    rng = random.Random(base)
    words = [bytes(rng.choice(b"ab\xc3") for _ in range(rng.choice([1, 7, 8, 9, 16, 70]))) for _ in range(800)]
    words += [b"q" * 100, b"q" * 101, b"q" * 100] * 5
    data = np.frombuffer(b" ".join(words), np.uint8)
    text, starts, lengths = D._word_pointers(data, np.array([0, len(data)]))
    order, fresh = D.sort_pointers(text, starts, lengths)
    assert order.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
    ranked = [words[i] for i in order]
    assert fresh.tolist() == [i == 0 or ranked[i] != ranked[i - 1] for i in range(len(ranked))]


def test_edge_cases_and_empty_tables(spark):
    want = brute_force([("en", "odd" if (i or 0) % 2 else "even", text) for i, text in ROWS], 1)
    docs = documents(spark).withColumn("source", F.expr("if(coalesce(doc_id, 0) % 2 = 1, 'odd', 'even')"))
    assert want and _got(D.audit_sources(docs, 1)) == want
    assert D.audit_sources(documents(spark, [])).collect() == []


def test_query(spark, sf):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _got(D.op12_divergence(spark, sf)) == brute_force(rows)
