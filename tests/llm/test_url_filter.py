import pytest

from panelcast.llm.url_filter import judge_urls

CASES = [
    ("http://example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    ("https://a.WWW.Example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?x=/en/", "example.com", "", None, "allow"),
    ("http://x.net/es/a?b#c", "x.net", "/es/a", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://x.net/EN/#f", "x.net", "/EN/", None, "allow"),
    ("http://x.org/porn", "x.org", "/porn", None, "block"),
    ("http://x.org/popcorn-pornography", "x.org", "/popcorn-pornography", None, "allow"),
    ("http://bet.org/bet/bet", "bet.org", "/bet/bet", None, "allow"),
    ("http://bet.org/a?Casino=1", "bet.org", "/a", None, "block"),
    ("http://a://b.net/fr/", "a:", "//b.net/fr/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://h\u00e9.COM/\n/", "h\u00e9.com", "/\n/", "com/", "allow"),
]


def test_cases(spark):
    rows = [(i, c[0], "other", "x") for i, c in enumerate(CASES + CASES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, found_x string, verdict string")
    done = judge_urls(pages).orderBy("page_id").collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in done] == CASES * 2
    assert judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("limit, verdict", [(1, "block"), (3, "allow")])
def test_distinct_soft_terms(spark, limit, verdict):
    pages = spark.createDataFrame([("http://x.org/poker/slots",)], "url string")
    assert judge_urls(pages, soft_limit=limit).first()["verdict"] == verdict


def test_columns_of_its_own_names_stay(spark):
    rows = [(1, "http://a.com/xxx", "mine", "too"), (2, None, "mine", "too")]
    pages = spark.createDataFrame(rows, "page_id long, url string, found_ string, found__ string")
    done = judge_urls(pages).orderBy("page_id").collect()
    assert [(r["found_"], r["found__"], r["verdict"]) for r in done] == [
        ("mine", "too", "allow"), ("mine", "too", "allow"),
    ]
    long_one = spark.createDataFrame([(3, "http://a.b/" + "z/" * 500_000 + "xxx")], "page_id long, url string")
    assert judge_urls(long_one).first()["verdict"] == "block"
