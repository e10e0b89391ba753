import random
import re

import pytest
from pyspark.sql import functions as F

from sightline.llm import common, url_filter
from sightline.llm.url_filter import bloom_filter, judged, possible

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/fr/x", "block"), ("a.org", "/fr/x", "allow"), ("Shout.IO", "", "block"), (None, "/", "block")]


def brute(url, rules, listed):
    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def canon(url):
        host, path = parts(url)
        return host.removeprefix("www."), path.rstrip("/")

    host, path = parts(url)
    fits = [(len(h + p), v, h.lower() + p) for h, p, v in rules if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    known = host != "" and canon(url) in {canon(x) for x in listed if x and parts(x)[0]}
    return host, path, best and best[2], best[1] if best else "block" if known else "allow", known


def cases():
    rng = random.Random(5)
    hosts = ["example.net", "www.EXAMPLE.net", "a.example.com", "badexample.com", "x.a.org", "a.org", "net", "localhost", "shout.io", "m.spam.de", "www.spam.de", "spam.de", ""]
    paths = ["", "/", "/en/1", "/EN/1", "/de/", "/de", "/fr/x/y", "/fr/é😀", "//", "/en//?q=/fr/", "/spam/1/", "/spam/1", "/spam/1#top"]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}{rng.choice(['', '?a=://b/', '#x', '/'])}" for h in hosts for p in paths]
    urls += [None, "", "no scheme/en/", "://example.net/en/1", "a://b://example.net/", "http://example.net/\nen/", "http://" + "a." * 3000 + "net/" + "x/" * 20_000]
    return urls * 2


LISTED = ["http://www.spam.de/spam/1/", "ftp://SPAM.de/spam/1?x", "https://localhost", None, "junk", "http://m.spam.de//"]


@pytest.fixture(scope="module")
def tables(spark):
    urls = cases()
    pages = spark.createDataFrame([(None if k % 50 == 7 else k // 2, u, "x", "y", "z") for k, u in enumerate(urls)], "page_id long, url string, host string, row string, kind string")
    return pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame([(u,) for u in LISTED], "url string")


@pytest.mark.parametrize("rows, blocks", [(100_000, 1 << 18), (0, 1)])
def test_as_brute_force(tables, monkeypatch, rows, blocks):
    """Also where entries are too many to be broadcast, and where the filter is too small to hold anything back."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(url_filter, "BLOCKS", blocks)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    pages, rules, listed = tables
    got = sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict, r.is_listed) for r in judged(pages, rules, listed).collect())))
    want = sorted(str((r.page_id, *brute(r.url, RULES, LISTED))) for r in pages.collect())
    assert got == want
    assert {"allow", "block"} == {v for r in pages.collect() for v in [brute(r.url, [], LISTED)[3]]}


def test_empty_tables(tables):
    pages, rules, listed = tables
    assert judged(pages.limit(0), rules, listed).collect() == []
    assert {r.verdict for r in judged(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}
    assert judged(pages, rules.limit(0), listed).filter("verdict = 'block'").count() > 0


def test_filter_passes_all_entries_and_few_others(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("hash"), F.xxhash64("id", F.lit(1)).alias("bits"))
    words = bloom_filter(keys, 128).scalar()
    assert keys.filter(~possible(words, 128, F.col("hash"), F.col("bits"))).count() == 0
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("hash"), F.xxhash64("id", F.lit(1)).alias("bits"))
    assert others.filter(possible(words, 128, F.col("hash"), F.col("bits"))).count() < 400


def test_no_python_in_the_plan(tables):
    plan = judged(*tables)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", plan)
