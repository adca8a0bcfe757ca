"""From raw documents to token ids in five stages, each the operator of its name in `lumisync.llm`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisync.llm.byte_bpe import encode_and_decode
from lumisync.llm.decontaminate import find_hits
from lumisync.llm.language import document_rows, identify
from lumisync.llm.near_dedup import near_duplicates
from lumisync.llm.pii import redact
from lumisync.llm.tables import look_up, materialize, read_table, settle, without
from lumisync.session import name_local_scratch

NEAR_PERCENT = 80  # similarity of near copies; op6's own threshold is another


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or of no known language go.

    Rows alike in id and text are judged alike: if one goes, they all do.
    """
    rejected = settle(spark, "rejected", lambda: identify(document_rows(docs), docs).where("not kept").select(
        F.col("row_key").alias("rejected_id"), F.col("text_key").alias("rejected_text")).distinct())
    return without(docs, rejected, {"rejected_id": docs["doc_id"], "rejected_text": F.xxhash64(docs["text"])})


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies.

    Rows alike in id and text are one document, of which the first by its values stays. Different texts
    under one id are documents of their own: only links between their texts make one of them go, the
    later one by its values of two of one id. Rows without id stay.
    """
    named = docs.where("doc_id is not null")
    repeated = named.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("repeated_id"))
    repeated = materialize(repeated, "repeated")
    if not repeated.isEmpty():
        return _of_repeated_ids(spark, docs, repeated)
    grouped = settle(spark, "groups", lambda: near_duplicates(docs, NEAR_PERCENT))
    dropped = grouped.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id"))
    return without(docs, materialize(dropped, "dropped"), {"dropped_id": docs["doc_id"]})


def _of_repeated_ids(spark: SparkSession, docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The same where ids repeat: each id and text is numbered, and groups are made of the numbers."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    several = docs.join(repeated, docs["doc_id"] == repeated["repeated_id"], "left_semi")
    first = several.groupBy("doc_id", "text").agg(F.min(F.struct(*columns)).alias("first"))
    single = without(docs, repeated, {"repeated_id": docs["doc_id"]}).union(first.select("first.*"))
    numbered = materialize(single.select(F.struct(*columns).alias("document"), F.monotonically_increasing_id().alias("number")),
                           "numbered")
    named = numbered.where("document.doc_id is not null")
    texts = named.select(F.col("number").alias("doc_id"), "document.text")
    grouped = settle(spark, "groups", lambda: near_duplicates(texts, NEAR_PERCENT))
    members = materialize(named.select("document.doc_id", "number").join(
        grouped.select(F.col("doc_id").alias("number"), "component_id"), "number"), "members")
    stays = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "number")).alias("stays"))
    found = look_up(members, materialize(stays, "stays"), ["component_id"])
    dropped = found.where("number <> stays.number").select(F.col("number").alias("dropped"))
    return without(numbered, materialize(dropped, "dropped"), {"dropped": numbered["number"]}).select("document.*")


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    hit = settle(spark, "hit", lambda: find_hits(docs, benchmark).where("n_hit > 0").select(
        F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_text")).distinct())
    return without(docs, hit, {"hit_id": docs["doc_id"], "hit_text": F.xxhash64(docs["text"])})


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder for every span of personal data."""
    return redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document."""
    coded = encode_and_decode(docs)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", not_contaminated),
    ("pii", without_personal_data),
    ("byte_bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the table after each but the last is written to the shared folder."""
    name_local_scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # language models and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py compares by brute force
