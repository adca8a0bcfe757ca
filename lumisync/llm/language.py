"""Language identification by Bayesian evidence fusion.

Four pieces of evidence are multiplied: the likelihood of the text under models of hashed byte
trigrams, the language that the markup declares, the one that the address suffix names, and a
prior of the host. Host priors come from grouped counts of the rows' languages by the other
evidence, smoothed by those of the parent domain, which are smoothed by those of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow
from .tables import materialize, read_table

LABELLED_ROWS = 1_000  # labelled rows of each language that the text models may learn from
HELD_LANGUAGES = 64  # whose counts a task holds before it sends them on
BUCKET_BITS = 15
EVIDENCE_TRIGRAMS = 200  # a longer text weighs as much as one of so many independent trigrams
UNKNOWN_NATS = -10.4  # log-likelihood of a trigram of an unknown language: all buckets alike
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
SMOOTHING = 10.0  # rows that a parent's prior counts for
LEAST_PROBABILITY = 0.5
UNKNOWN = "und"

_SCORED = "row_key long, text_key long, host string, parent string, declared string, suffix string, n_letters long, logs array<double>"
_ARROW_SCORED = pa.schema([
    ("row_key", pa.int64()), ("text_key", pa.int64()), ("host", pa.string()), ("parent", pa.string()), ("declared", pa.string()),
    ("suffix", pa.string()), ("n_letters", pa.int64()), ("logs", pa.list_(pa.float64()))])


def _trigram_counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram of the lower-case text, and the text's bytes that are letters
    or parts of other characters."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    letters = ((data >= 97) & (data <= 122)) | (data >= 128)
    data = np.where(letters, data, 32).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), letters
    grams = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    grams = grams[letters[:-2] | letters[1:-1] | letters[2:]]
    return ((grams * np.uint32(2654435761)) >> np.uint32(32 - buckets)).astype(np.int64), letters


def learn_models(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of trigram buckets, from rows `(text, lang)`.

    A bounded sample by hash: up to `LABELLED_ROWS` of each language, however many there are. Null
    and empty texts and labels teach nothing.
    """
    rows = labelled.where("lang is not null and lang <> '' and text is not null and text <> ''").select(
        F.lower("lang").alias("lang"), "text")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, 1 << BUCKET_BITS))
    wanted = [(lang, i, min(1.0, 1.25 * LABELLED_ROWS / sizes[lang])) for i, lang in enumerate(languages)]
    wanted = labelled.sparkSession.createDataFrame(wanted, "lang string, number int, keep double")
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000.0
    chosen = rows.join(F.broadcast(wanted), "lang").where(chance < F.col("keep")).select("number", "text")

    def sent(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counted in found.items():
            at = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(counted[at])], ["lang", "bucket", "n"])

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist()):
                if lang not in found:
                    if len(found) == HELD_LANGUAGES:
                        yield from sent(found)
                        found.clear()
                    found[lang] = np.zeros(1 << BUCKET_BITS, np.int64)
                found[lang] += np.bincount(_trigram_counts(text, BUCKET_BITS)[0], minlength=1 << BUCKET_BITS)
        yield from sent(found)

    partial = map_arrow(chosen, counts, "lang int, bucket int, n long")
    totals = np.full((len(languages), 1 << BUCKET_BITS), 0.1)
    summed = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    totals[summed.column("lang").to_numpy(), summed.column("bucket").to_numpy()] += summed.column("n").to_numpy()
    return languages, np.log(totals / totals.sum(axis=1, keepdims=True))


def identify(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """The language of every row of `(row_key, text, host, parent, declared, suffix)`.

    `host` and its `parent` group rows, `declared` is the markup's language and `suffix` that of
    the address; each may be null. Returns (row_key, text_key, lang, probability, kept), where
    `text_key` is xxhash64 of the text. A text without letters, or whose trigrams no model knows
    better than chance, is `und`. `kept` says that the language is known with a probability of
    0.5 or more. Without labelled rows every row is `und`, and all are kept, for nothing can be
    told apart. Repeated rows and null keys give a row each; other columns are ignored.
    """
    spark = rows.sparkSession
    languages, logs = learn_models(labelled)
    inputs = rows.select(
        F.col("row_key").cast("long").alias("row_key"), F.xxhash64("text").alias("text_key"), "text",
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("parent", F.lit("")).alias("parent"),
        F.lower("declared").alias("declared"), F.lower("suffix").alias("suffix"))
    if not languages:
        return inputs.select("row_key", "text_key", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("probability"),
                             F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(logs.T.copy())  # buckets x languages

    def likelihoods(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sums, letters = [], []
            for text in batch.column("text"):
                found, is_letter = _trigram_counts(text.as_py() or "", BUCKET_BITS)
                letters.append(int(is_letter.sum()))
                total = np.bincount(found, minlength=len(table)) @ table if len(found) > len(table) else table[found].sum(axis=0)
                every = np.append(total, UNKNOWN_NATS * len(found))
                sums.append(every * (min(len(found), EVIDENCE_TRIGRAMS) / max(1, len(found))))
            columns = [batch.column(n) for n in ("row_key", "text_key", "host", "parent", "declared", "suffix")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(letters, pa.int64()), pa.array(
                [s.tolist() for s in sums], pa.list_(pa.float64()))], schema=_ARROW_SCORED)

    scored = materialize(map_arrow(inputs, likelihoods, _SCORED), "language-scores")
    names = [*languages, UNKNOWN]
    for given in ("declared", "suffix"):
        scored = scored.withColumn(f"{given}_known", F.col(given).isin(names))
    by_content = F.zip_with("logs", _hints(names), lambda a, b: a + b)
    scored = scored.select("row_key", "text_key", "host", "parent", "n_letters", by_content.alias("logs"))

    priors = _host_priors(scored, len(names))
    fused = scored.join(priors, ["host", "parent"]).select(
        "row_key", "text_key", "n_letters", F.zip_with("logs", "prior", lambda a, p: a + F.log(p)).alias("logs"))
    best = fused.select("row_key", "text_key", "n_letters", F.array_max("logs").alias("top"), "logs")
    weight = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    at = F.array_position("logs", F.col("top")).cast("int")
    readable = F.col("n_letters") > 0
    lang = F.when(readable, F.element_at(F.array(*map(F.lit, names)), at)).otherwise(UNKNOWN)
    result = best.select("row_key", "text_key", lang.alias("lang"), (1 / weight).alias("probability"))
    return result.withColumn("kept", (F.col("lang") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))


def _hints(names: list[str]) -> Column:
    """Log-likelihood of the declared language and of the suffix for each language."""
    every = F.array(*map(F.lit, names))

    def hint(given: str, right: float, name: Column) -> Column:
        wrong = (1 - right) / max(1, len(names) - 1)
        return F.when(F.col(f"{given}_known"), F.when(F.col(given) == name, float(np.log(right))).otherwise(float(np.log(wrong)))).otherwise(0.0)

    return F.transform(every, lambda n: hint("declared", DECLARED_RIGHT, n) + hint("suffix", SUFFIX_RIGHT, n))


def _host_priors(scored: DataFrame, n: int) -> DataFrame:
    """(host, parent, prior): language shares of each host, smoothed by its parent's and the corpus's."""
    best = F.array_position("logs", F.array_max("logs")).cast("int")
    counts = materialize(scored.groupBy("host", "parent", best.alias("best")).agg(F.count(F.lit(1)).cast("double").alias("n")), "host-counts")
    whole = [0.0] * n
    for row in counts.groupBy("best").agg(F.sum("n").alias("n")).collect():  # one row per language
        whole[row.best - 1] = row.n
    base = F.array(*[F.lit((v + 1.0 / n) / (sum(whole) + 1.0)) for v in whole])
    of_each = F.map_from_entries(F.collect_list(F.struct("best", "n")))

    def smoothed(counted: str, prior: Column) -> Column:
        total = F.aggregate(F.map_values(counted), F.lit(0.0), lambda s, x: s + x)
        return F.transform(prior, lambda p, i: (F.coalesce(F.try_element_at(counted, i + 1), F.lit(0.0)) + SMOOTHING * p) / (total + SMOOTHING))

    parents = counts.groupBy("parent", "best").agg(F.sum("n").alias("n")).groupBy("parent").agg(of_each.alias("of_parent"))
    parents = parents.select("parent", smoothed("of_parent", base).alias("of_parent"))
    hosts = counts.groupBy("host", "parent").agg(of_each.alias("counts"))
    return hosts.join(parents, "parent").select("host", "parent", smoothed("counts", F.col("of_parent")).alias("prior"))


def document_rows(docs: DataFrame) -> DataFrame:
    """The evidence of `documents`: the declared language is `lang`, the host is `source`."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("row_key"), "text", F.col("source").alias("host"), none.alias("parent"),
                       F.col("lang").alias("declared"), none.alias("suffix"))


def page_rows(pages: DataFrame) -> DataFrame:
    """The evidence of `pages`: text without tags, `<html lang>`, and host and suffix of the address.

    The suffix is the host's last part or else the first part of the path, if it has two letters.
    """
    text = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    top = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    first = F.regexp_extract("url", "://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    return pages.select(
        F.col("page_id").alias("row_key"), text.alias("text"), host.alias("host"),
        F.regexp_extract(host, r"^[^.]*\.(.*)$", 1).alias("parent"),
        F.regexp_extract("html", r"(?i)<html\b[^>]*\blang=[\"']?([a-z]{2,3})", 1).alias("declared"),
        F.when(top != "", top).otherwise(first).alias("suffix"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of `documents` and of `pages`; one of doc_id and page_id is set."""
    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    of_docs, of_pages = identify(document_rows(docs), docs), identify(page_rows(pages), docs)
    result = ["lang", "probability", "kept"]
    return of_docs.select(F.col("row_key").alias("doc_id"), none.alias("page_id"), *result).union(
        of_pages.select(none.alias("doc_id"), F.col("row_key").alias("page_id"), *result))


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
