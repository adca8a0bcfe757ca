import hashlib
import random
import re

from cases import ROWS, documents

from lumisync.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute_force(rows, items):
    windows = {}
    for item, text in items:
        words = _words(text)
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        words, hit, found = _words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (where := windows.get(tuple(words[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= where
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(spark, rows, items):
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, windows int, phrase string")
    found = D.find_hits(documents(spark, rows), benchmark).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found), key=repr)


def test_short_items_overlaps_ties_and_copies(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    items = [(i, t) for i, t in enumerate(texts[:12])] + [
        (50, texts[0]), (51, "v1"), (52, "V2, v3"), (53, None), (54, ""), (55, "a a a a a a a a a a a a"), (None, texts[1]),
        (56, "v1 v2 v3 v4 v5 v6 v7"), (9, "quick brown fox")]
    rows = [(100 + i, f"{rng.choice(vocabulary)} {texts[i % 12]}; {t}") for i, t in enumerate(texts)]
    rows += [*ROWS, (300, "A " * 40), (301, "x " * 12 + texts[3] + " " + texts[3])]
    assert _got(spark, rows, items) == brute_force(rows, items)
    monkeypatch.setattr(D, "BLOCK_FINGERPRINTS", 20)  # several blocks of fingerprints
    assert _got(spark, rows, items) == brute_force(rows, items)


def test_empty_tables(spark):
    assert _got(spark, [], [(1, "a b c")]) == []
    assert _got(spark, ROWS, []) == brute_force(ROWS, [])
    assert _got(spark, ROWS, [(1, None)]) == brute_force(ROWS, [(1, None)])


def test_runs_cover_every_window_once_and_change_with_the_minimum(spark):
    rng = random.Random(3)
    texts = [[rng.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 4, 9, 10, 11, 200, 2000)] + [["a"] * 500]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "doc_id long, words array<string>")
    got = {r.doc_id: r.runs for r in D._with_fingerprints(rows, [3, 10]).select("doc_id", "runs").collect()}
    for i, words in enumerate(texts):
        for length in (3, 10):
            runs = [r for r in got[i] if r.length == length]
            assert [at for r in runs for at in range(r.first, r.last + 1)] == list(range(len(words) - length + 1))
            assert all(a.fingerprint != b.fingerprint for a, b in zip(runs, runs[1:]))
    assert len([r for r in got[7] if r.length == 10]) < 2000 / 2  # about two of seven windows start a run
    assert len([r for r in got[8] if r.length == 10]) == 1
