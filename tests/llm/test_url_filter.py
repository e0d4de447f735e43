import pytest

from assay.llm import url_filter


def judged(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, node int, verdict int")
    return {r.page_id: r for r in url_filter.judged(df, **options).collect()}


def pages(*urls, html=""):
    return [(i, u, html, 1, 2) for i, u in enumerate(urls)]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
        ("x://net", "net", "", None, "allow"),
        ("x://net/", "net", "/", "net/", "block"),
        ("x://internet/", "internet", "/", None, "allow"),
        ("http://m.example.com/de/#a", "m.example.com", "/de/", "example.com/de/", "block"),
        ("http://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"),
        ("http://a.com?u=http://b.net/", "a.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule, verdict):
    r = judged(spark, pages(url))[0]
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_a_block_reaches_aliases_and_an_explicit_allow_stays(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://a.com/1", link.format("http://b.net/x"), 0, 0),
        (2, "http://c.com/2#f", "<meta http-equiv='refresh' content='0; url=http://a.com/1'>", 0, 0),
        (3, "http://example.net/en/3", link.format("https://C.com/2"), 0, 0),
        (4, "http://d.com/", link.format("/relative"), 0, 0),
        (5, "http://e.com/", link.format("http://f.com/"), 0, 0),
        (6, "https://c.com/2", None, 0, 0),
    ]
    got = judged(spark, rows)
    verdicts = {i: got[i].verdict for i in got}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}
    assert got[1].alias_of == got[2].alias_of == got[3].alias_of == "a.com/1"


def test_long_redirect_chains_and_given_edges(spark):
    edges = [(f"h.com/{i}", f"h.com/{i + 1}") for i in range(40)] + [("h.com/40", "z.net/")]
    given = spark.createDataFrame(edges, "a string, b string")
    got = judged(spark, pages("http://h.com/0", "http://h.com/50", "http://h.com/0"), edges=given)
    assert [got[i].verdict for i in range(3)] == ["block", "allow", "block"]


def test_no_pages_and_no_rules(spark):
    assert judged(spark, []) == {}
    assert judged(spark, pages("http://a.net/"), rules=())[0].verdict == "allow"


@pytest.mark.parametrize(
    ("url", "html", "targets"),
    [
        ("http://A.com/x/y?q#f", "<link rel=canonical href=/en/25>", ["a.com/en/25"]),
        ("http://a.com/x/y", '<link rel="canonical" href="//B.net/z">', ["b.net/z"]),
        ("http://a.com/x/y?q", '<link rel="canonical" href="../z/./w/..?p=/../#f">', ["a.com/z/?p=/../"]),
        ("http://a.com/x/y", '<link rel="canonical" href="z">', ["a.com/x/z"]),
        ("http://a.com", '<link rel="canonical" href="z">', ["a.com/z"]),
        ("http://a.com/x?q", '<link rel="canonical" href="?p">', ["a.com/x?p"]),
        ("http://a.com/x", '<link rel="canonical" href="/go?u=http://b.net/">', ["a.com/go?u=http://b.net/"]),
        ("http://a.com/", '<link rel="canonical" href="http://b.net/?a=1&amp;b=2">', ["b.net/?a=1&b=2"]),
        ("http://a.com/", '<meta http-equiv="refresh" content="0; url=/?a=1&amp;b=2">', ["a.com/?a=1&b=2"]),
        (
            "http://a.com/",
            '<link rel=canonical href="/1"><meta http-equiv=refresh content="1;url=/2">'
            '<link rel=canonical href="/3"><meta http-equiv=refresh content="1;url=/4">',
            ["a.com/1", "a.com/2", "a.com/3", "a.com/4"],
        ),
        ("http://a.com/x/", '<base href="//b.net/p/q"><link rel=canonical href="r">', ["b.net/p/r"]),
        ("http://a.com/", '<link rel=canonical href="mailto:x@b.net"><link rel=canonical href="">', []),
        ("http:///x", '<link rel=canonical href="/y"><link rel=canonical href="///z">', []),
        ("no scheme", '<link rel=canonical href="//b.net/">', []),
    ],
)
def test_every_target_of_a_page_is_an_alias(spark, url, html, targets):
    df = spark.createDataFrame([(url, html), (url, None)], "url string, html string")
    assert sorted(r.b for r in url_filter.alias_edges(df).collect()) == targets


def test_a_block_reaches_aliases_by_relative_targets(spark):
    rows = [
        (1, "http://a.com/x", '<link rel=canonical href="/hub">', 0, 0),
        (2, "http://a.com/hub", '<link rel=canonical href="/"><link rel=canonical href="//b.net/">', 0, 0),
        (3, "http://a.com/", None, 0, 0),
        (4, "http://a.com/y", None, 0, 0),
    ]
    got = judged(spark, rows)
    assert {i: got[i].verdict for i in got} == {1: "block", 2: "block", 3: "block", 4: "allow"}
