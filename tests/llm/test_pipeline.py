import hashlib

import corpus_pipeline as C
import numpy as np
from cases import ROWS, documents
from test_byte_bpe import _encoding
from test_decontaminate import brute_force as hits_of
from test_near_dedup import brute_force as groups_of
from test_pii import base_spans

from lumisync.llm.pii import find_pii


def _rows(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


def test_each_stage_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    known, single, clean, private, coded = (stage for _, stage in C.STAGES)

    first = C.materialize(known(spark, docs, sf), "t")
    assert first.columns == docs.columns and _rows(first) == _rows(docs)  # all are of a known language
    second = C.materialize(single(spark, first, sf), "t")
    groups = groups_of(_rows(first), C.NEAR_PERCENT)
    assert _rows(second) == [r for r in _rows(first) if groups[r[0]] == r[0]]
    third = C.materialize(clean(spark, second, sf), "t")
    hit = {i for i, _, n, *_ in hits_of(_rows(second), items) if n}
    assert hit and _rows(third) == [r for r in _rows(second) if r[0] not in hit]
    fourth = C.materialize(private(spark, third, sf), "t")
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    before, after = dict(_rows(third)), dict(_rows(fourth))
    assert any(base_spans(t) for t in before.values()) and not any(base_spans(t) for t in after.values())
    spans = {r.row.doc_id: r.spans for r in find_pii(third).collect()}
    assert all((before[i] == after[i]) == (not spans[i]) for i in before)
    assert all(r.n_chars == len(r.text) for r in fourth.collect())

    encoding = _encoding()
    want = {i: hashlib.sha256(np.array(encoding.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in after.items()}
    assert {r.doc_id: r.ids_sha256 for r in coded(spark, fourth, sf).collect()} == want
    assert {r.doc_id: r.ids_sha256 for r in C.run(spark, sf).collect()} == want


def test_edge_cases_and_empty_tables(spark, sf):
    docs = documents(spark)
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, sf), "t")
        assert docs.count() > 0, name
    empty = documents(spark, [])
    for name, stage in C.STAGES:
        empty = C.materialize(stage(spark, empty, sf), "t")
        assert empty.count() == 0, name


def test_unrelated_texts_of_one_id_stay(spark, sf):
    def text(seed):
        return " ".join(f"w{seed}x{i}" for i in range(40))

    rows = [(1, text(1)), (5, text(1)), (5, text(2)), (7, text(3)), (7, text(4)), (7, text(3)), (8, text(4) + " end"), (9, None), (9, None),
            (9, ""), (None, text(1)), (None, text(1)), (4, text(2)), (10, text(5)), (10, text(5) + " end")]
    kept = _rows(C.one_of_each_group(spark, documents(spark, rows), sf))
    assert kept == sorted([(1, text(1)), (7, text(3)), (7, text(4)), (9, None), (9, ""), (None, text(1)), (None, text(1)),
                           (4, text(2)), (10, text(5))], key=repr) or (10, text(5) + " end") in kept
    assert len(kept) == 9 and {i for i, _ in kept} == {1, 4, 7, 9, 10, None}


def test_rows_alike_are_one_document(spark, sf):
    kept = _rows(C.one_of_each_group(spark, documents(spark), sf))
    pairs = [r for r in kept if r[0] is not None]
    assert len(pairs) == len(set(pairs)) and (None, None) in kept and (1, ROWS[0][1]) in kept and 2 not in dict(kept)
    assert {t for i, t in pairs if i == 10} == {t for i, t in ROWS if i == 10}  # two unrelated texts


def test_near_copies_from_80_percent_go(spark, sf):
    words = [f"word{i}" for i in range(200)]
    copy = [f"new{i}" if i in (30, 80, 130, 180) else w for i, w in enumerate(words)]
    a, b = ({tuple(t[i:i + 5]) for i in range(196)} for t in (words, copy))
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, "something else entirely that stays as it is")]
    assert [i for i, _ in _rows(C.one_of_each_group(spark, documents(spark, rows), sf))] == [1, 3]
