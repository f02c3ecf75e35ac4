"""URL rules and site templates."""

import html
import itertools
import re
from collections import Counter

import pytest

from tabulon.llm import site_templates as st
from tabulon.llm import url_rules as ur

URLS = [
    ("https://A.Example.NET/en/1?x=/de/", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de/1", "example.net", "/de/1", "net/", "block"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("http://x.example.com/de/1#f", "x.example.com", "/de/1", "example.com/de/", "block"),
    ("http://x.example.com/de", "x.example.com", "/de", None, "allow"),
    ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
    ("http://net", "net", "", None, "allow"),
    ("http://net?q", "net", "", None, "allow"),
    ("http://planet/", "planet", "/", None, "allow"),
    ("a://b://c/net/", "b:", "//c/net/", None, "allow"),
    ("x", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://ÄB.Net/\nq", "Äb.net", "/\nq", "net/", "block"),
]


def judged(spark, urls, labelled=None, **options):
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    labelled = labelled if labelled is not None else spark.createDataFrame([], "url string, bad int")
    return {r.page_id: r for r in ur.judged(pages, labelled, **options).collect()}


def test_given_rules(spark):
    got = judged(spark, [u for u, *_ in URLS])
    for i, (_, *expected) in enumerate(URLS):
        assert [got[i].host, got[i].path, got[i].rule, got[i].verdict] == expected
    assert judged(spark, []) == {}


def plain_rules(rows, support, confidence, least):
    """All sets of tokens that are frequent and confident, and more confident than each rule within them."""
    sets, bad = Counter(), Counter()
    for tokens, label in rows:
        for k in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), k):
                sets[s] += 1
                bad[s] += label
    floor = max(support, least / len(rows)) * len(rows)
    found = {s: bad[s] / n for s, n in sets.items() if bad[s] >= floor - 1e-9 and bad[s] / n >= confidence}
    return {s: c for s, c in found.items() if not any(set(o) < set(s) and d >= c for o, d in found.items())}


def test_mined_rules_against_all_sets(spark):
    urls = [f"http://{h}.example.io/{p}/{i}{q}" for i, (h, p, q) in enumerate(itertools.product("abc", ("x", "y"), ("", "?k=1", "#f")))] * 6
    rows = [(u, int(("//a." in u and "?k" in u) or "/y/" in u and i % 3 > 0)) for i, u in enumerate(urls)]
    table = spark.createDataFrame([*rows, (None, 1), ("http://q", None)], "url string, bad int")
    tokens = {r.url: r.t for r in table.selectExpr("url", f"{ur.token_column('url')} AS t").collect()}
    expected = plain_rules([(tokens[u], b) for u, b in rows], 0.01, 0.7, 5)
    mined = ur.mined_rules(table, support=0.01, confidence=0.7, least_rows=5).collect()
    assert {tuple(r.tokens): round(r.confidence, 9) for r in mined} == {s: round(c, 9) for s, c in expected.items()} and expected
    got = judged(spark, urls, table, support=0.01, confidence=0.7, least_rows=5)
    for i, u in enumerate(urls):
        assert got[i].mined == sum(set(s) <= set(tokens[u]) for s in expected)
        assert got[i].verdict == ("block" if got[i].mined else "allow")


def test_labels_join(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in labels.collect()}
    numbers = [re.search(r"/(\d+)/?$", re.match(r"[^?#]*", r.url)[0]) for r in pages.collect()]
    expected = Counter(known[int(m[1])] for m in numbers if m and int(m[1]) in known)
    assert Counter(r.bad for r in ur.labelled_urls(pages, labels).collect()) == expected


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page header">
<header>Top</header><nav><ul><li><a href="/">Home</a><li>News</ul></nav><div class="x-7">Read  our <b>rules</b></div>
<div id="cookie-notice">Cookies</div><form>Name<input></form>
<article class="post share"><h1>Head &amp; &lt;line&gt;</h1><p>One<br>two&nbsp;&#233;<p>Three <b>bold</b>er<script>if (a < b) "</p>"</script>
<ul><li>a<li>b</ul><div class="ad">Buy</div><aside>Side</aside><table><tr><td>1<td>2<tr><td>3</table></article>
<section class="comments"><article class="comment"><p>I agree</article></section><footer>&copy; me</footer></body></html>"""


def texts(page, host="h", template=lambda s: False):
    return st.main_text(st.blocks_of(page, host), template)[0]


def test_one_page():
    assert texts(PAGE) == "Head & <line>\nOne two é\nThree bolder\na\nb\n1 2\n3"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""),
        ("", ""),
        ("plain &am", "plain &am"),
        ("a<p", "a"),
        ("<article><p>x &amp", "x &"),
        ("<article>x</artic", "x"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<!-- a <p>b</p> -->c<!-- open", "c"),
        ("<script>never ends <p>x", ""),
        ('<p title="a>b">x</p>', "x"),
        ("<main><p>m</main><p>outside", "m"),
        ("<article>a</article><p>o<article>b", "a\nb"),
        ("<NAV>n</NAV><P>x</P>", "x"),
        ("<p>" * 5000 + "deep", "deep"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_edges(page, expected):
    assert texts(page) == expected


def site(host, i, article):
    menu = "<div class=k><a>Start</a> <a>Contact</a></div>"
    return f"<body>{menu}<div><p>{article}</p></div><div>Imprint {host}</div></body>"


def test_templates_go_and_articles_stay(spark):
    """Without any telling markup: subtrees on many pages of a host go, copies of a page and subtrees of few pages stay."""
    rows = [(i, f"http://a.b/{i}", site("a", i, f"Text {i} of this site")) for i in range(30)]
    rows += [(100 + i, f"http://c.d/{i}", site("c", i, "The same text")) for i in range(30)]
    rows += [(200, "http://e.f/", site("e", 0, "Alone")), (201, None, None), (202, "x", "<article>q<p>q</article>"), (202, "x", "<article>q<p>q</article>")]
    rows += [(300 + i, f"http://g.h/{i}", "<article><p>Same line</p><p>Own " + str(i) + "</p></article>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r for r in st.extracted(pages).collect()}
    assert st.extracted(pages).count() == len(rows)
    for i in range(30):
        assert got[i].text == f"Text {i} of this site" and got[i].template_blocks == 2
        assert got[100 + i].text == "Start Contact\nThe same text\nImprint c"
    assert got[200].text == "Start Contact\nAlone\nImprint e" and got[201].text == "" and got[202].text == "q\nq"
    assert all(got[300 + i].text == f"Same line\nOwn {i}" for i in range(20))
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert st.extracted(pages.limit(0)).collect() == []


def test_join_instead_of_broadcast(spark, monkeypatch):
    rows = [(i, f"http://a.b/{i}", site("a", i, f"Text {i}")) for i in range(20)] + [(99, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    expected = sorted(st.extracted(pages).collect())
    monkeypatch.setattr(st, "BROADCAST_TEMPLATES", 0)
    assert sorted(st.extracted(pages).collect()) == expected


def test_whole_table(spark, sf):
    """Each page's article by a plain cut at its tags."""
    from tabulon.llm.queries import op3_site_templates

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op3_site_templates(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1]
        article = re.sub(r"<[^>]*$", "", article)
        parts = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        assert r.text == "\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
