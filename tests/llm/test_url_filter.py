import random

from pyspark.sql import functions as F

from tests.llm.helpers import Forest
from vectorloom.llm import url_filter as U

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, verdict string")


def result(df):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


def test_parts_and_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/5?x#y", None), (2, "https://a.example.net/de", None), (3, "http://net/x", None), (4, "http://xnet/", None), (5, "ftp://b.example.com/de/1", None),
        (6, "http://example.com?x=/de/", None), (7, None, None), (8, "no scheme", None), (9, "http://q.org/fr/", None), (10, "http://example.net", None), (11, "a://b://c/d", None), (12, "http://É.net/", None),
    ]
    assert result(U.judge(pages(spark, rows), RULES)) == {
        1: ("a.example.net", "/en/5", "example.net/en/", "allow"), 2: ("a.example.net", "/de", "net/", "block"), 3: ("net", "/x", "net/", "block"), 4: ("xnet", "/", None, "allow"), 5: ("b.example.com", "/de/1", "example.com/de/", "block"),
        6: ("example.com", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("q.org", "/fr/", "org/fr/", "allow"), 10: ("example.net", "", None, "allow"), 11: ("b:", "//c/d", None, "allow"), 12: ("É.net", "/", "net/", "block"),
    }


def test_many_rules_are_joined(spark, monkeypatch):
    rng = random.Random(0)
    rows = [(i, f"http://{'.'.join(rng.choice('ab') for _ in range(rng.randint(1, 4)))}/{rng.choice('xyz')}/{i}", None) for i in range(200)]
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choice("ab") for _ in range(rng.randint(1, 3))), f"/{rng.choice(['', 'x', 'y/'])}") for _ in range(12)]
    want = result(U.judge(pages(spark, rows), rules))
    monkeypatch.setattr(U, "EXPRESSION_RULES", 0)
    assert result(U.judge(pages(spark, rows), rules)) == want


def test_aliases(spark):
    link = '<head><link href="{}" rel=canonical></head>'
    rows = [
        (1, "http://a.com/1", link.format("http://bad.net/x")),  # canonical is blocked
        (2, "http://b.com/2", '<meta http-equiv="refresh" content="0; url=http://a.com/1">'),  # and so is what redirects to it
        (3, "http://c.com/3", link.format("http://bad.net/y")),
        (4, "http://d.com/4", link.format("http://ok.org/fr/")),  # allowed explicitly
        (5, "http://e.com/5", None),
        (6, "http://e.com/5#frag", link.format("http://c.com/3")),  # the same page as 5
        (7, "http://f.com/7", "<!-- <link rel=canonical href=http://bad.net/z> -->"),
        (8, "http://g.com/8", None),
        (9, "http://bad.net/9", link.format("http://ok.org/fr/")),  # a rule of its own stays
    ]
    redirects = spark.createDataFrame([("http://d.com/4", "http://bad.net/q"), ("http://g.com/8?utm_source=x", "http://bad.net/r")], "source string, target string")
    got = {k: v[3] for k, v in result(U.judge(pages(spark, rows), RULES, redirects)).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "block"}


def test_components_against_plain_version(spark):
    from vectorloom.llm.components import components

    rng = random.Random(5)
    for n, m in ((60, 40), (60, 70), (200, 199)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n < 200 else [(i, i + 1) for i in range(199)]
        forest = Forest(range(n))
        for a, b in edges:
            forest.join(a, b)
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: forest.find(x) for e in edges if e[0] != e[1] for x in e}


def test_empty_table_and_repeated_rows(spark):
    assert U.judge(pages(spark, []), RULES).count() == 0
    assert U.judge(pages(spark, [(1, "http://x.net/", "y" * 100_000)] * 3), RULES).count() == 3


REFERENCES = ["page2", "../x", "../../../x", "?id=1", "./", "..", "a/b/../c?d=../e", "/root", "//h.org/p", "http://k.net/z", "#part", "mailto:x@y", "", "x?y#z", "."]
BASES = ["http://h.com/a/b/c?q=1", "https://h.com", "http://h.com/", "http://h.com/dir/", "http://h.com/file"]


def test_relative_links_resolve(spark):
    from urllib.parse import urljoin

    rows = [(b, r) for b in BASES for r in REFERENCES]
    got = spark.createDataFrame(rows, "url string, ref string").select("url", "ref", U.absolute(F.col("ref"), F.col("url")).alias("out")).collect()
    for r in got:
        if r["ref"] in ("", "mailto:x@y"):
            assert r["out"] is None
        elif r["ref"] == "#part":
            assert r["out"] == r["url"]
        else:
            want = urljoin(r["url"], r["ref"])
            assert r["out"] == (want.replace("https://h.org", "http://h.org")), (r["url"], r["ref"])
    assert spark.createDataFrame([(None, "x"), ("no url", "x")], "url string, ref string").where(U.absolute(F.col("ref"), F.col("url")).isNotNull()).count() == 0


def test_relative_links_and_refreshes_are_aliases(spark):
    rows = [
        (1, "http://a.com/d/1", "<link rel=canonical href=two>"),
        (2, "http://a.com/d/two", '<link rel="canonical" href="http://b.com/"><meta http-equiv=refresh content="0;url=../&#x62;?x=1&amp;y=2">'),
        (3, "http://b.com/", None),
        (4, "http://a.com/b?x=1&y=2", "<link rel=canonical href='http:&sol;&#47;bad.net/q'>"),
        (5, "http://a.com/b", None),
    ]
    got = {k: v[3] for k, v in result(U.judge(pages(spark, rows), RULES)).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_rules_of_one_length(spark):
    # At a tie of lengths the longer host wins, then allow.
    rules = [("block", "a.net", "/x"), ("allow", "net", "/x/y"), ("block", "b.org", "/"), ("allow", "b.org", "/")]
    rows = [(1, "http://a.net/x/y", None), (2, "http://b.org/", None), (None, "http://a.net/x", None)]
    got = result(U.judge(pages(spark, rows), rules))
    assert got[1][2:] == ("a.net/x", "block") and got[2][3] == "allow" and got[None][3] == "block"
