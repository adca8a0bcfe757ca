import os
import random

import public_tokenizers
import pytest
from cases import ROWS, documents, order
from tokenizers import Tokenizer

from lumisync.llm import token_counts as C

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(C.VOCABULARY))


def _want(library, rows):
    return order((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows)


def _got(frame):
    return order(tuple(r) for r in frame.collect())


def test_counts_are_the_library_s(spark, library):
    assert _got(C.count_tokens(documents(spark))) == _want(library, ROWS)
    assert C.count_tokens(documents(spark, [])).collect() == []


def test_spliced_windows_count_the_same(spark, library):
    rng = random.Random(1)
    alphabets = (" ab\n", "a", " ", "'s l'l\n\n  x1!\u00e9", ["a", " ", "<|endoftext|>", "<|endof", "  ", "!!", "text|>"])
    rows = [(i, "".join(rng.choice(alphabets[i % 5]) for _ in range(rng.choice([10, 600, 4000])))) for i in range(30)]
    got = _got(C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), window=700, overlap=150))
    assert got == _want(library, rows)


def test_both_libraries_agree_on_code_points(library):
    fast = C._whole_encoder(public_tokenizers.path(C.VOCABULARY))
    for start in [*range(0, 0x3400, 0x400), 0xA000, 0xFB00, 0xFF00, 0x10000, 0x1D400, 0x1F600, 0xE0000]:
        chars = [chr(c) for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000]
        texts = [f"a{c}b {c}{c} 1{c}2 !{c}?" for c in chars]
        for text, encoded in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
            assert fast.encode(text, allowed_special="all") == encoded.ids, hex(ord(text[1]))


def test_both_libraries_agree_on_mixed_scripts(library):
    rng = random.Random(4)
    fast = C._whole_encoder(public_tokenizers.path(C.VOCABULARY))
    pieces = ["the", "Ing", "'s", "'LL", " ", "  ", "\n", "\r\n", "\t", "12", "3,4", "!?", "...", "é", "e\u0301", "ß", "жи", "日本", "한글", "ال",
              "हि", "\u200b", "\u00a0", "\u3000", "🙂", "👩\u200d👩", "½", "²", "\x00", "<|endoftext|>", "<|", "|>", "_", "/"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    for text, encoded in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert fast.encode(text, allowed_special="all") == encoded.ids, repr(text)


def test_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in C.op9_token_counts(spark, sf).collect()}
    for doc_id, n_bytes, n_tokens in _want(library, [(r.doc_id, r.text) for r in docs]):
        row = got[doc_id]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (n_bytes, n_tokens, n_tokens > 1024)
