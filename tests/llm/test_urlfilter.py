import re

from linkwright.llm import urlfilter

CASES = [
    ("http://a.example.org/de/1", "org/", "allow"), ("http://example.org/es/1", "example.org/es/", "block"), ("https://x.y.example.org/en/12", "example.org/en/1", "block"),
    ("https://x.com/fr/2", "com/fr/", "allow"), ("https://x.com/de/2", "com/de/", "block"), ("https://notexample.org/es/", "org/", "allow"), ("http://example.org", None, "allow"),
    ("HTTP://WWW.Free-Bets.Example.NET/en/5?x#y", None, "block"), ("http://www.casino-win.example.net/fr/12", None, "block"), ("http://garden.example.net/en/7", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("no scheme", None, "allow"),
]


def test_rules_and_verdicts(spark):
    df = spark.createDataFrame([(i, u, "mine") for i, (u, _, _) in enumerate(CASES)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in urlfilter.judge(df).collect()}
    for i, (url, rule, verdict) in enumerate(CASES):
        host = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        assert (got[i]["host"], got[i]["path"]) == ((re.sub("[A-Z]", lambda m: m[0].lower(), host[1]), host[2]) if host else ("", ""))
        assert (got[i]["rule"], got[i]["verdict"]) == (rule, verdict), url
        assert 0 <= got[i]["score"] <= 1


def test_long_repeated_and_empty(spark):
    long = "http://free-bets.example.net/" + "a/" * 5000
    df = spark.createDataFrame([(1, long), (1, long), (2, "x://" + "y" * 5000)], "page_id long, url string")
    found = urlfilter.judge(df).collect()
    assert len(found) == 3 and len({r["verdict"] for r in found if r["page_id"] == 1}) == 1
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_separates_its_table(spark):
    df = spark.createDataFrame([(label, url) for label, url in urlfilter.LABELLED], "page_id long, url string")
    found = urlfilter.judge(df, rules=()).collect()
    assert sum((r["verdict"] == "block") == (r["page_id"] == 1) for r in found) >= 0.97 * len(found)
