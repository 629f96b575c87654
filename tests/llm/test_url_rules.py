"""The rules of the URL filter, held against the contract's own list rather than the module's."""

from pyspark.sql import functions as F

from tidemill.llm import urlfilter

#: url -> (rule, verdict).
WANT = {
    "http://a.com/en/1": ("com/en/", "block"),
    "http://www.example.com/en/77": ("example.com/en/7", "allow"),
    "http://example.com/en/6": ("com/en/", "block"),
    "https://b.net/de/1": ("net/de/", "allow"),
    "https://B.NET/de/?q#x": ("net/de/", "allow"),
    "http://net/de/": ("net/de/", "allow"),
    "https://a.example.net/de/81": ("example.net/de/8", "block"),
    "https://example.net/de/7": ("net/de/", "allow"),
    "http://c.org/es/": ("org/es/", "block"),
}


def test_rules_of_the_contract(spark):
    rows = [(i, url, None) for i, url in enumerate(WANT)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages).collect()}
    assert got == dict(enumerate(WANT.values()))


def test_allowed_pages_bring_no_distrust(spark):
    pages = spark.createDataFrame([(1, "http://d.net/de/1", None), (2, "http://d.net/fr/1", None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages).where(F.col("trust") > F.col("distrust")).collect()}
    assert got == {1: ("net/de/", "allow"), 2: (None, "allow")}
