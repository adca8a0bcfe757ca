import collections
import math

import numpy as np
from cases import ROWS, documents
from pyspark.sql import functions as F

from lumisync.llm import language as L

SF = "/root/testdata/sf0.01"


def _identify(spark, rows, labelled):
    frame = spark.createDataFrame(rows, "row_key long, text string, host string, parent string, declared string, suffix string")
    return {r.row_key: r for r in L.identify(frame, labelled).collect()}


def test_held_out_accuracy_without_hints(spark):
    """Models from the even ids name the language of the odd ones from the text alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = F.lit(None).cast("string")
    odd = docs.where("doc_id % 2 = 1")
    rows = odd.select(F.col("doc_id").alias("row_key"), "text", *[none.alias(c) for c in ("host", "parent", "declared", "suffix")])
    got = L.identify(rows, docs.where("doc_id % 2 = 0")).collect()
    want = {r.doc_id: r.lang for r in odd.collect()}
    assert sum(r.lang == want[r.row_key] for r in got) >= 0.98 * len(want)
    assert all(r.kept for r in got)


def test_short_texts_follow_the_other_evidence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(i, "ok", "a.b.c", "b.c", "de", None) for i in range(30)]
    rows += [(100, "ok", "a.b.c", "b.c", None, None), (101, "ok", "x.b.c", "b.c", None, None), (102, "ok", "z", None, "fr", "fr"),
             (103, "", "a.b.c", "b.c", "de", None), (104, None, None, None, None, None), (105, "123 !?", None, None, "es", None)]
    got = _identify(spark, rows, docs)
    assert got[100].lang == "de" and got[102].lang == "fr"  # its host and, of a new host, the hints
    assert got[101].lang == "de"  # the parent domain of a new host
    assert [got[i].lang for i in (103, 104, 105)] == ["und"] * 3 and not any(got[i].kept for i in (103, 104, 105))


def test_edge_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(L.document_rows(documents(spark)), docs).collect()
    assert collections.Counter(r.row_key for r in got) == collections.Counter(i for i, _ in ROWS)
    assert L.identify(L.document_rows(documents(spark, [])), docs).collect() == []
    untaught = L.identify(L.document_rows(documents(spark)), docs.limit(0)).collect()
    assert len(untaught) == len(ROWS) and all(r.kept and r.lang == "und" for r in untaught)


def test_query(spark, sf):
    got = L.op4_language_id(spark, sf).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in got if r.doc_id is not None} == set(docs)
    assert sum(r.page_id is not None for r in got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert sum(r.lang == docs[r.doc_id] for r in got if r.doc_id is not None) >= 0.98 * len(docs)
    assert all(0 <= r.probability <= 1 for r in got)


def test_every_language_has_a_model(spark):
    """80 languages, each with words of its own; none is left out for being rare."""
    rng = np.random.default_rng(0)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for _ in range(80)]
    labelled = [(" ".join(rng.choice(w, 200)), f"l{i:02d}") for i, w in enumerate(words) for _ in range(1 + (i < 64))]
    rows = [(i, " ".join(rng.choice(w, 60)), "h", None, None, None) for i, w in enumerate(words)]
    rows += [(100 + i, "ok", f"h{i}", None, f"l{i:02d}", f"l{i:02d}") for i in range(80)]
    got = _identify(spark, rows, spark.createDataFrame(labelled, "text string, lang string"))
    assert all(got[i].lang == got[100 + i].lang == f"l{i:02d}" and got[i].kept for i in range(80))


def _trigrams(text):
    data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode()]
    grams = [tuple(data[i:i + 3]) for i in range(len(data) - 2)]
    whole = [a << 16 | b << 8 | c for a, b, c in grams if (a, b, c) != (32, 32, 32)]
    return [g * 2654435761 % 2**32 >> 32 - L.BUCKET_BITS for g in whole], any(b != 32 for b in data)


def brute_force(rows, labelled):
    """Bayes' rule row by row, from the definitions."""
    taught = [(t, lang.lower()) for t, lang in labelled if t and lang]
    languages = sorted({lang for _, lang in taught})
    names = [*languages, "und"]
    counts = {lang: collections.Counter() for lang in languages}
    for text, lang in taught:
        counts[lang].update(_trigrams(text)[0])
    sizes = {lang: sum(c.values()) + 0.1 * 2**L.BUCKET_BITS for lang, c in counts.items()}

    def hint(given, right, name):
        if given is None or given.lower() not in names:
            return 0.0
        return math.log(right if given.lower() == name else (1 - right) / (len(names) - 1))

    content = {}
    for key, text, host, parent, declared, suffix in rows:
        grams, _ = _trigrams(text)
        weight = min(len(grams), L.EVIDENCE_TRIGRAMS) / max(1, len(grams))
        told = [sum(math.log((counts[n][g] + 0.1) / sizes[n]) for g in grams) for n in languages] + [L.UNKNOWN_NATS * len(grams)]
        content[key] = [weight * v + hint(declared, L.DECLARED_RIGHT, n) + hint(suffix, L.SUFFIX_RIGHT, n) for v, n in zip(told, names)]
    seen = {key: max(range(len(names)), key=lambda i: (v[i], -i)) for key, v in content.items()}

    def prior(host, parent):
        def smoothed(chosen, before):
            return [(chosen.count(i) + L.SMOOTHING * b) / (len(chosen) + L.SMOOTHING) for i, b in enumerate(before)]

        every = list(seen.values())
        corpus = [(every.count(i) + 1 / len(names)) / (len(every) + 1) for i in range(len(names))]
        below = smoothed([seen[r[0]] for r in rows if (r[3] or "") == parent], corpus)
        return smoothed([seen[r[0]] for r in rows if ((r[2] or ""), (r[3] or "")) == (host, parent)], below)

    out = {}
    for key, text, host, parent, _, _ in rows:
        fused = [v + math.log(p) for v, p in zip(content[key], prior(host or "", parent or ""))]
        best = max(range(len(names)), key=lambda i: (fused[i], -i))
        lang = names[best] if _trigrams(text)[1] else "und"
        probability = 1 / sum(math.exp(v - fused[best]) for v in fused)
        out[key] = (lang, probability, lang != "und" and probability >= L.LEAST_PROBABILITY)
    return out


def test_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text", "lang").limit(160).collect()
    labelled = [(r.text, r.lang.upper() if i % 9 == 0 else r.lang) for i, r in enumerate(docs[:100])] + [(None, "de"), ("abc", None), ("", "xx")]
    rng = np.random.default_rng(5)
    hosts, hints = [("a.b.c", "b.c"), ("x.b.c", "b.c"), ("z", None), (None, None)], [None, "de", "FR", "es", "en", "tlh", "und"]
    rows = []
    for i, r in enumerate(docs[100:]):
        words = r.text.split()
        text = [r.text, " ".join(words[:3]), words[0] if words else "", None, "12 3!", "日本 " + r.text[:40]][i % 6]
        rows.append((i, text, *hosts[rng.integers(4)], hints[rng.integers(7)], hints[rng.integers(7)]))
    got = _identify(spark, rows, spark.createDataFrame(labelled, "text string, lang string"))
    want = brute_force(rows, labelled)
    assert {k: (r.lang, r.kept) for k, r in got.items()} == {k: (lang, kept) for k, (lang, _, kept) in want.items()}
    assert all(math.isclose(got[k].probability, p, rel_tol=1e-6) for k, (_, p, _) in want.items())


def test_a_tie_goes_to_the_first_language(spark):
    labelled = spark.createDataFrame([("one two three", lang) for lang in ("zz", "aa", "mm")], "text string, lang string")
    got = _identify(spark, [(1, "one two three", None, None, None, None)], labelled)
    assert got[1].lang == "aa"
