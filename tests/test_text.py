import json

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumisync.functions.text import BOS, EOS, TOKEN_PATTERN, normalize_text, pretokenize
from lumisync.operators import bpe as B
from lumisync.operators import joins as J
from lumisync.operators.embed import embed, embed_text
from lumisync.operators.encoders import HashedTextEncoder

TEXTS = [
    "A photo of a Cat", "  two\t\n spaces ", "it's we'll they've I'd don't 'S", "abc123 4", "nb sp x",
    f"x {BOS} y {EOS.upper()}", "", "¡¿§!! ... :-)", "Ünïcödé ÀÉ ß Σας", "日本語 テスト", "áé", "tab\x1cfs",
    "½ ² ٣", "🙂🙂 ok",
]


def python_tokens(text):
    return regex.findall(TOKEN_PATTERN, regex.sub(r"\s+", " ", text.lower()), regex.IGNORECASE)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_pretokens_equal_the_unicode_regex(spark):
    rows = frame(spark, TEXTS).select("id", pretokenize(normalize_text(F.col("text"))).alias("t")).collect()
    for row in rows:
        assert row.t == python_tokens(TEXTS[row.id]), TEXTS[row.id]


def test_whitespace_is_squeezed_not_trimmed(spark):
    row = frame(spark, ["  A \t b\n"]).select(normalize_text(F.col("text")).alias("t")).first()
    assert row.t == " a b "


def naive_bpe(word, merges):
    """Merge the best-ranked pair everywhere, again and again, on a marked string."""
    parts = [*word[:-1], word[-1] + "</w>"]
    while True:
        known = [(merges.index(p), p) for p in zip(parts, parts[1:]) if p in merges]
        if not known:
            return parts
        a, b = min(known)[1]
        marked = "\x00".join(["", *parts, ""]).replace("\x00", "\x00\x00")
        marked = marked.replace(f"\x00{a}\x00\x00{b}\x00", f"\x00{a}{b}\x00")
        parts = [p for p in marked.split("\x00") if p]


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text("abc", min_size=1, max_size=14), st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", "ab", "aa", "abc", "bc"]),
              st.sampled_from(["a", "b", "c</w>", "a</w>", "ab", "bc", "aa</w>", "ab</w>"])),
    unique=True, max_size=12))
def test_split_word_equals_naive(word, merges):
    ranks = {p: i for i, p in enumerate(merges)}
    want = naive_bpe(word, merges)
    assert B.split_word(word, ranks) == want
    short, B.LONG_WORD = B.LONG_WORD, 1  # the same by whole passes
    try:
        assert B.split_word(word, ranks) == want
    finally:
        B.LONG_WORD = short


def test_very_long_runs_are_quick():
    ranks = {("=" * 2**i, "=" * 2**i): i for i in range(12)}
    parts = B.split_word("=" * 200_001, ranks)
    assert "".join(parts) == "=" * 200_001 + "</w>" and len(parts) < 60


MERGES = [("l", "o"), ("lo", "w</w>"), ("e", "r</w>"), ("n", "e"), ("ne", "w"), ("w", "er</w>"), ("'", "s</w>")]


@pytest.fixture
def files(tmp_path):
    lines = ["#version: 0.2", *(" ".join(p) for p in MERGES)]
    (tmp_path / "merges.txt").write_text("\n".join(lines) + "\n")
    chars = "abcdefghijklmnopqrstuvwxyz'!1"
    tokens = [*chars, *(c + "</w>" for c in chars), *("".join(p) for p in MERGES), BOS, EOS]
    (tmp_path / "vocab.json").write_text(json.dumps({t: i for i, t in enumerate(tokens)}))
    return tmp_path, {t: i for i, t in enumerate(tokens)}


def load(spark, path):
    return B.BpeTables(B.read_merges(spark, str(path / "merges.txt")), B.read_vocab(spark, str(path / "vocab.json")))


def test_tables_from_files(spark, files):
    path, vocab = files
    tables = load(spark, path)
    assert {(r.a, r.b): r["rank"] for r in tables.merges.collect()} == {p: i for i, p in enumerate(MERGES)}
    assert {r.token: r.id for r in tables.vocab.collect()} == vocab


def test_only_the_first_merge_lines_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "MAX_MERGES", 3)
    (tmp_path / "m.txt").write_text("head\n" + "\n".join(f"a{i} b" for i in range(9)))
    rows = B.read_merges(spark, str(tmp_path / "m.txt")).orderBy("rank").collect()
    assert [(r["rank"], r.a) for r in rows] == [(0, "a0"), (1, "a1"), (2, "a2")]
    assert B.read_merges(spark, str(tmp_path / "m.txt"), whole=True).count() == 9


HELD = ["HELD_MERGES", "HELD_TOKENS", "HELD_WORD_BYTES"]


@pytest.mark.parametrize("too_small", [[], *[[name] for name in HELD], HELD])
def test_pieces_and_ids(spark, files, monkeypatch, too_small):
    for name in too_small:
        monkeypatch.setattr(B, name, 1)  # then tables are joined instead of held
    path, vocab = files
    tables = load(spark, path)
    texts = ["Low lower newer", "it's LOW!", "", None, f"a {EOS} b", "low low low"]
    rows = B.token_ids(B.bpe_pieces(frame(spark, texts), "text", tables), "text", tables).orderBy("id").collect()
    ranks = MERGES
    for row, text in zip(rows, texts):
        if text is None:
            assert row.pieces is None and row.ids is None
            continue
        want = [p for w in python_tokens(text) for p in ([w] if w == EOS else naive_bpe(w, ranks))]
        assert row.pieces == want
        assert row.ids == [vocab[BOS], *(vocab[p] for p in want), vocab[EOS]]
    bare = B.token_ids(frame(spark, ["low"]), "text", tables, prepend_bos=False, append_eos=False).first()
    assert bare.ids == [vocab["low</w>"]]


@pytest.mark.parametrize("held", [B.HELD_TOKENS, 1])
def test_unknown_piece_is_an_error(spark, files, monkeypatch, held):
    monkeypatch.setattr(B, "HELD_TOKENS", held)
    tables = load(spark, files[0])
    with pytest.raises(Exception, match="KeyError"):
        B.token_ids(frame(spark, ["ü"]), "text", tables).collect()


def test_merging_by_joins_equals_naive(spark, monkeypatch):
    import random
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc\x01") for _ in range(rng.randrange(1, 14))) for _ in range(150)} | {"a" * 70, BOS})
    pairs = list(dict.fromkeys((rng.choice(["a", "b", "c", "ab", "aa", "abc", "\x01"]), rng.choice(
        ["a", "b", "c</w>", "a</w>", "ab", "bc", "aa", "ab</w>"])) for _ in range(25)))
    merges = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "rank int, a string, b string")
    table = spark.createDataFrame([(w,) for w in words], "word string")
    want = {w: [w] if w == BOS else naive_bpe(w, pairs) for w in words}
    for held in (B.HELD_MERGES, 1):
        monkeypatch.setattr(B, "HELD_MERGES", held)
        assert {r.word: r.pieces for r in B.encode_words(table, B.BpeTables(merges)).collect()} == want
    assert B.encode_words(table.limit(0), B.BpeTables(merges)).collect() == []


def test_each_distinct_word_is_encoded_once(spark, files):
    docs = frame(spark, ["low low lower", "lower low", "newer"] * 50).repartition(7)
    encoded = B.encode_words(B.distinct_words(docs, "text"), load(spark, files[0])).collect()
    assert sorted(r.word for r in encoded) == ["low", "lower", "newer"]
    plan = B.bpe_pieces(docs, "text", load(spark, files[0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan  # the texts only pick up what was encoded before


def test_numbered_and_look_up(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    got = J.numbered(rows, "place", F.desc("v")).collect()
    assert len(got) == 5000 and all(r.place == 4999 - r.v for r in got)
    assert J.numbered(rows.limit(0), "place", F.desc("v")).collect() == []
    hot = J.written(rows.select(F.when(F.col("k") % 3 == 0, 1).otherwise(F.col("k")).alias("k"), "v"), "t")
    found = rows.where("k < 1000").select("k", (F.col("k") * 2).alias("twice"))
    got = J.look_up(hot, found, ["k"]).collect()
    assert len(got) == 5000 and all(r.twice == (2 * r.k if r.k < 1000 else None) for r in got)


def test_text_vectors(spark):
    import hashlib
    encoder = HashedTextEncoder(16)
    texts = ["b a b", "", None, "A B"]
    rows = embed(frame(spark, texts), "text", encoder).orderBy("id").collect()

    def cell(token):
        return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 16
    want = [0.0] * 16
    want[cell("a")] += 1
    want[cell("b")] += 2
    length = sum(x * x for x in want) ** 0.5
    assert rows[0].vector == pytest.approx([x / length for x in want])
    assert set(rows[1].vector) == {0.0} and rows[1].error is None
    assert set(rows[2].vector) == {0.0} and rows[2].error
    assert embed_text(spark, "a b", encoder) == rows[3].vector


def test_java_pattern_gives_the_tokens_of_the_named_one(spark):
    texts = TEXTS + ["IT'S it'ſ we'LL don'T 'rest 'x <|STARTOFTEXT|><|endofteXt|> <|startof|>", "a1b22 ü,;- ß_İK x y z", "", None,
             "''s'll''d...'ve<|endoftext|>'m ٣½ 漢字かな é"]
    def named(text):
        return F.regexp_extract_all(text, F.lit("(?iU)" + TOKEN_PATTERN), F.lit(0))

    rows = frame(spark, texts).select(
        pretokenize(F.col("text")).alias("got"), named(F.col("text")).alias("want"), B._tokens("text").alias("low"),
        named(normalize_text(F.col("text"))).alias("want_low")).collect()
    assert [(r.got, r.low) for r in rows] == [(r.want, r.want_low) for r in rows]


@pytest.mark.parametrize("held", [B.HELD_WORD_BYTES, 1])
@pytest.mark.parametrize("chunk_bytes", [1, 40, 1 << 20])
def test_texts_are_cut_once_and_a_word_travels_once_for_a_chunk(spark, files, monkeypatch, held, chunk_bytes):
    monkeypatch.setattr(B, "HELD_WORD_BYTES", held)
    monkeypatch.setattr(B, "CHUNK_BYTES", chunk_bytes)
    tables = load(spark, files[0])
    texts = ["low low lower", None, "", "new " * 30, " ", "lower low"] * 5
    docs = frame(spark, texts).repartition(3)
    packed = B._packed(docs, "text")
    for row in packed.collect():
        assert len(row["words"]) == len(set(row["words"])) <= 3
    assert packed.count() == (3 if chunk_bytes > 1000 else packed.count())
    rows = B.bpe_pieces(docs, "text", tables).orderBy("id").collect()
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts):
        want = text if text is None else [p for w in python_tokens(text) for p in naive_bpe(w, MERGES)]
        assert (row.text, row.pieces) == (text, want)
    assert B.token_ids(docs.limit(0), "text", tables).collect() == []
    nothing = B.bpe_pieces(frame(spark, ["", None]), "text", tables).orderBy("id").collect()
    assert [r.pieces for r in nothing] == [[], None]
