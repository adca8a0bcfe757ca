import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from cases import ROWS, documents, order

from lumisync.llm import byte_bpe as B
from lumisync.llm import chunks


def _encoding():
    ranks = B.read_ranks(public_tokenizers.path(B.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark):
    encoding = _encoding()
    want = []
    for doc_id, text in ROWS:
        ids = encoding.encode_ordinary(text or "")
        want.append((doc_id, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()))
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in B.encode_and_decode(documents(spark)).collect()]
    assert order(got) == order(want)


def test_no_documents(spark):
    assert B.encode_and_decode(documents(spark, [])).collect() == []


def test_query_against_the_library(spark, sf):
    encoding = _encoding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op7_byte_bpe(spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = encoding.encode_ordinary(row.text)
        digests = (hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), row.text.encode()))
        assert got[row.doc_id] == (len(ids), *digests)


def test_small_chunks_give_the_same_words(spark):
    docs = documents(spark).select("doc_id", "text").coalesce(1)
    rows = chunks.pack(docs, lambda t: t.encode().split(), 3, hashed=True, chunk_bytes=100).collect()
    texts = {}
    for head in (r for r in rows if r.bucket is None):
        parts = sorted((r for r in rows if r.chunk == head.chunk and r.bucket is not None), key=lambda r: r.bucket)
        words = [w for r in parts for w in chunks.expand_words(bytes(r.words))]
        words = [words[i] for i in chunks.rank_order(bytes(r.tally) for r in parts)]
        assert [chunks.zlib.crc32(w) for w in words] == chunks.expand(bytes(head.hashes)).tolist()
        numbers = iter(chunks.expand_ranks(bytes(head.numbers)).tolist())
        for doc_id, n in zip(head.doc_ids, chunks.expand(bytes(head.lengths)).tolist()):
            texts.setdefault(doc_id, []).append([words[next(numbers)] for _ in range(n)])
    for doc_id, text in ROWS:
        assert (text or "").encode().split() in texts[doc_id]


def test_numbers_survive_squeezing():
    rng = np.random.default_rng(3)
    for values in (np.zeros(0, np.uint32), np.arange(300, dtype=np.uint32), rng.integers(0, 1 << 32, 1000, dtype=np.uint32)):
        assert (chunks.expand(chunks.squeeze(values)) == values).all()
        assert (chunks.expand_ranks(chunks.squeeze_ranks(values)) == values).all()
    large = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    assert (chunks.expand(chunks.squeeze(large)) == large).all()
    words = [b"", b"a", b"\n\x00", "\u00e9".encode() * 50]
    assert chunks.expand_words(chunks.squeeze_words(words)) == words
