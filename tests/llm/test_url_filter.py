import re

from lumisync.llm import url_filter as U

URLS = [None, "", "no scheme", "http://A.Example.NET/en/1", "https://net/", "https://net", "http://x.net?p=/", "ftp://b.example.com/de/2#t",
        "http://example.com/de", "http://org/fr/3", "http://a.org/fr/", "http://forg/fr/", "http://anet/", "a://b://c/d", "http:///path",
        "http://user@h.example.net:80/en/", "http://x.example.net/En/", "http://d.example.com/de/\n2", "://", "http://\u00c9.net/x"]


def brute_force(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in U.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_by_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[3], "x", "y")],
                                  "page_id long, url string, host string, score string")
    got = U.judge_urls(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = brute_force(URLS[3 if r.page_id is None else r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert U.judge_urls(pages.limit(0)).collect() == []


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 100_000 + "example.net/en/" + "x/" * 100_000, "http://" + "b" * 300_000, "http://h/" + "casino-" * 50_000,
            "q" * 300_000 + "://example.com/de/" + "?" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = U.judge_urls(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule) == brute_force(urls[r.page_id])[:3]
        assert 0 <= r.score <= 1 and r.verdict in ("allow", "block")


def test_unwanted_hosts_are_found_and_others_left_alone(spark):
    rows = U.op10_url_filters(spark, "/root/testdata/sf0.01").collect()
    words = ("casino", "bets", "pills", "adult", "ads", "spam")
    unwanted = [any(w in r.host for w in words) for r in rows]
    assert sum(unwanted) and all((r.score >= 0.5) == bad for r, bad in zip(rows, unwanted))


def test_training_does_not_depend_on_order_and_takes_no_rows():
    assert (U.train(U.LABELLED_URLS) == U.train(U.LABELLED_URLS[::-1])).all()
    assert not U.train([]).any()


def test_addresses_that_were_not_learnt(spark):
    wanted = ["https://github.com/apache/spark", "https://www.cam.ac.uk/research", "https://www.essex.ac.uk", "https://en.wikipedia.org/wiki/Spark"]
    unwanted = ["http://phishing-login.example", "http://mega-casino-slots.test/", "http://cheap-pills-now.test/buy", "http://xxx-cams.test/"]
    pages = spark.createDataFrame(list(enumerate(wanted + unwanted)), "page_id long, url string")
    got = {r.url: r.verdict for r in U.judge_urls(pages).join(pages, "page_id").collect()}
    assert got == dict.fromkeys(wanted, "allow") | dict.fromkeys(unwanted, "block")


def test_scores_by_the_definition(spark):
    """The model on one core: every bucket of every n-gram once, summed and scaled."""
    import math
    import zlib

    weights = U.train(U.LABELLED_URLS)
    urls = [u for u in URLS if u] + ["http://long.example/" + "path/" * 20_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in U.judge_urls(pages).collect():
        host, path, *_ = brute_force(urls[r.page_id])
        buckets = {zlib.crc32(text[i:i + n].encode()) >> 16 for text in (f"<{host}>", f"|{path}|") for n in (3, 4, 5)
                   for i in range(len(text) - n + 1)}
        logit = math.fsum(weights[b] for b in buckets) / math.sqrt(max(1, len(buckets))) + weights[-1]
        assert abs(r.score - 1 / (1 + math.exp(-logit))) < 1e-9


def test_a_table_of_labels_is_sampled_by_hash(spark, monkeypatch):
    rows = U.LABELLED_URLS * 2 + [(None, 1), ("http://x", None)]
    labels = spark.createDataFrame(rows, "url string, label int")
    pages = spark.createDataFrame([(1, "http://a.example/b")], "page_id long, url string")
    monkeypatch.setattr(U, "MAX_LABELLED", 300)
    by_table = U.judge_urls(pages, labelled=labels).first().score
    assert by_table == U.judge_urls(pages, labelled=[r for r in rows if None not in r][::-1]).first().score
