"""URL verdicts: explicit rules first, a logistic regression on hashed character n-grams for the rest.

The model is trained from a small labelled URL table; rules are a short list in the caller's hands.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow
from .tables import lower_ascii, read_table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FEATURE_BITS = 16
GRAM_SIZES = (3, 4, 5)
MAX_LABELLED = 20_000

# The labelled URLs that come with the repository: every name below at each of some addresses.
_UNWANTED = (
    "casino", "casino-royal", "best-casino", "jackpot-win", "win-prize", "poker-win", "sports-bets", "online-bets",
    "free-bets-now", "free-money", "free-prize", "cheap-meds", "cheap-pills-shop", "pills-online", "diet-pills",
    "viagra-pills", "adult-cams", "xxx-adult", "adult-video", "porn-tube", "ads-server", "click-ads", "track-ads",
    "ads-tracker", "spam-mailer", "spam-links", "link-farm", "content-farm", "fake-watches", "payday-loans",
    "warez-crack", "torrent-crack",
)
_WANTED = (
    "university", "library", "docs", "news", "travel", "weather", "museum", "recipes", "gardening", "history", "science",
    "teacher", "theatre", "theory", "thermal", "nation", "station", "thing", "thread", "edition", "other", "health",
    "maps", "code", "council", "school", "art", "therein", "river", "anthem", "city-hall", "open-data",
)
_ADDRESSES = (
    "https://{}.example.com/en/12", "http://www.{}.example.net/de/345.html", "https://m.{}.example.org/fr/6/",
    "http://blog.{}.example.com/es/78?page=2", "https://{}.example/",
)
# Addresses as they are: well-known sites and invented ones of the kinds that are not wanted.
_WANTED_URLS = (
    "https://github.com/explore", "https://www.python.org/doc/", "https://docs.oracle.com/en/java/", "https://de.wikipedia.org/wiki/Berlin",
    "https://fr.wikipedia.org/wiki/Paris", "https://www.wikidata.org/wiki/Q42", "https://www.ox.ac.uk/admissions", "https://www.ed.ac.uk/",
    "https://web.mit.edu/research", "https://www.stanford.edu/", "https://www.nasa.gov/missions", "https://www.nist.gov/publications",
    "https://www.gov.uk/browse/benefits", "https://www.parliament.uk/", "https://europa.eu/", "https://www.who.int/health-topics",
    "https://www.un.org/en/about-us", "https://www.bbc.co.uk/news/world", "https://www.theguardian.com/science", "https://www.lemonde.fr/",
    "https://www.zeit.de/kultur", "https://elpais.com/cultura", "https://www.nature.com/articles", "https://arxiv.org/abs/1706.03762",
    "https://www.jstor.org/stable", "https://spark.apache.org/docs/latest/", "https://kernel.org/", "https://www.gnu.org/software/emacs/",
    "https://stackoverflow.com/questions/tagged/sql", "https://developer.mozilla.org/en-US/docs/Web", "https://www.w3.org/TR/html52/",
    "https://www.ietf.org/standards/rfcs/", "https://www.gutenberg.org/ebooks/1342", "https://archive.org/details/texts",
    "https://www.openstreetmap.org/about", "https://www.britishmuseum.org/collection", "https://www.louvre.fr/en", "https://www.bl.uk/",
    "https://www.metoffice.gov.uk/weather", "https://www.sussex.ac.uk/study", "https://www.middlesex.edu/", "https://www.bundestag.de/",
    "http://localhost/index.html", "https://blog.example.org/2019/05/how-to-bake-bread", "https://shop.example.org/books/item?id=3",
    "https://travel-notes.example.net/fr/2021/", "https://www.example.net/en/about", "https://example.org/", "https://example.com/de/kontakt",
    "http://what-is-that.example.net/fr/faq", "http://that-other-place.example.com/es/11",
)
_UNWANTED_URLS = (
    "http://secure-login.verify-account.invalid/", "http://phishing.invalid/login", "http://account-login-verify.invalid/signin",
    "http://update-your-password.invalid/login.php", "http://bank-login-confirm.invalid/", "http://phish-kit.invalid/paypal-login/",
    "http://free-iphone-winner.invalid/claim", "http://you-won-prize.invalid/", "http://casino777.invalid/bonus",
    "http://bonus.slots-jackpot.invalid/play", "http://online-poker-room.invalid/", "http://betting-odds-tips.invalid/",
    "http://cheapviagra.invalid/buy", "http://buy-pills-no-prescription.invalid/", "http://lose-weight-fast-pills.invalid/",
    "http://hotxxx.invalid/videos", "http://sexcams.invalid/live", "http://adultfriend.invalid/", "http://freeporn.invalid/tube",
    "http://adserver7.invalid/click?id=9", "http://popads.invalid/banner", "http://tracking-ads.invalid/pixel.gif",
    "http://seo-backlinks-cheap.invalid/", "http://buy-followers-cheap.invalid/", "http://link-farm-directory.invalid/links",
    "http://replica-watches-cheap.invalid/", "http://payday-loans-fast-cash.invalid/", "http://crypto-doubler-free.invalid/",
    "http://crack-keygen-warez.invalid/download", "http://torrent-free-movies.invalid/download", "http://make-money-fast.invalid/",
    "http://work-from-home-rich.invalid/", "http://miracle-diet-pills.invalid/", "http://spam-mail-lists.invalid/buy",
)
LABELLED_URLS = [(url, label) for label, urls in ((1, _UNWANTED_URLS), (0, _WANTED_URLS)) for url in urls] + [(address.format(name), label)
                 for label, names in ((1, _UNWANTED), (0, _WANTED)) for name in names for address in _ADDRESSES]


def host(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; the first of equal ones.

    A rule `a.b/c/` fits the host `a.b` and its subdomains where the path starts with `/c/`.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):  # the longest is tested first
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _features(host: str, path: str) -> np.ndarray:
    grams = {text[i:i + n] for text in (f"<{host}>", f"|{path}|") for n in GRAM_SIZES for i in range(len(text) - n + 1)}
    hashes = np.fromiter((zlib.crc32(g.encode()) for g in grams), np.uint32, len(grams))
    return np.unique(hashes >> np.uint32(32 - FEATURE_BITS))


def _split(url: str) -> tuple[str, str]:
    found = re.search("://([^/?#]*)([^?#]*)", url)
    return (found[1].lower(), found[2]) if found else ("", "")


def train(labelled: Iterable[tuple[str, int]], steps: int = 300, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of the n-gram buckets and, last, the bias. Of more than `MAX_LABELLED` labelled URLs, those with
    the smallest hashes are the sample; the result does not depend on their order."""
    rows = sorted(heapq.nsmallest(MAX_LABELLED, labelled, key=lambda row: (zlib.crc32(row[0].encode()), row)))
    weights = np.zeros((1 << FEATURE_BITS) + 1)
    if not rows:
        return weights
    features = [_features(*_split(url)) for url, _ in rows]
    wanted = np.array([label for _, label in rows], float)
    sizes = np.array([len(f) for f in features])
    flat, owner = np.concatenate(features), np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    squares = np.full_like(weights, 1e-8)
    for _ in range(steps):
        logits = np.bincount(owner, weights[flat], len(rows)) * scale + weights[-1]
        missing = wanted - 1 / (1 + np.exp(-logits))
        gradient = np.bincount(flat, (missing * scale)[owner], len(weights)) / len(rows) - decay * weights
        gradient[-1] = missing.mean()
        squares += gradient * gradient
        weights += rate * 0.1 * gradient / np.sqrt(squares)
    return weights


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | Iterable[tuple[str, int]] = tuple(LABELLED_URLS),
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of `(page_id, url)`.

    `score` is the model's probability that a URL is unwanted; it decides where no rule fits,
    from 0.5 on as `block`. Null URLs and URLs without `://` have an empty host and path, fit
    no rule and are allowed unless the model's bias says otherwise. Repeated rows and null ids
    give a row each; other columns are ignored. `labelled` is a table of (url, label), 1 for unwanted, or
    pairs of these; rows without either are not used.
    """
    if isinstance(labelled, DataFrame):
        known = labelled.select("url", F.col("label").cast("int").alias("label")).where("url is not null and label is not null")
        order = F.crc32(F.col("url").cast("binary"))
        labelled = [(r.url, r.label) for r in known.orderBy(order, "url", "label").limit(MAX_LABELLED).collect()]
    weights = train(labelled)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = []
            for host_, path_ in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                found = _features(host_, path_)
                logits.append(weights[found].sum() / np.sqrt(max(len(found), 1)) + weights[-1])
            scores = 1 / (1 + np.exp(-np.array(logits, float)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    scored = map_arrow(parts, score, "page_id long, host string, path string, score double")
    found = fitting_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("found", found).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_model).alias("verdict"), "score")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url of `pages`."""
    return judge_urls(read_table(spark, sf_dir, "pages"))


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLES: dict[str, str] = {}
