import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vectorloom.llm import html_extract as H

CASES = {
    "plain article": ("<body><nav><ul><li>menu</ul></nav><div class=ad>buy</div><article><h1>T</h1><p>a<p>b &amp; c<br>d</article><footer>foot</footer>", "T\na\nb & c d"),
    "nothing": ("", ""),
    "null": (None, ""),
    "blank": (" \n <p> </p>", ""),
    "text alone": ("just  text", "just text"),
    "scripts, styles, comments": ("<article>x<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> -->y</article>", "xy"),
    "references": ("<article><p>&lt;b&gt; &#x41;&#66; &copy &nbsp; &unknown; &am</article>", "<b> AB © &unknown; &am"),
    "attributes with signs": ("<article><p title='a > b' data-x=\"</p>\">x</p></article>", "x"),
    "open tags": ("<article><p><b>one<br><p>two<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", "one\ntwo\nx\ny\n1\n2"),
    "parts inside an article": ("<article><header><h1>T</h1></header><p>x</p><aside>no</aside><form>no<p>no</form><section class='comments'><p>no</section><div id=related-posts>no</div><p>y</article>", "T\nx\ny"),
    "no article": ("<body><div id=sidebar>no</div><div class=post>a<p>b</div><div class='cookie-notice'>no</div><div role=navigation>no</div>", "a\nb"),
    "hidden": ("<article><div hidden>no</div><div style='display: none'>no</div><textarea>no</textarea>yes</article>", "yes"),
    "unclosed comment": ("<article>a</article><!-- never", "a"),
    "stray signs": ("<article>a < b <> c</article>", "a < b <> c"),
    "main element": ("<main><p>m</main><p>out<nav>no</nav>", "m\nout"),
    "a heading in a header with a name": ("<article><header class='entry-header'><h1>Title</h1></header><p>x</p></article>", "Title\nx"),
    "a wrapper named after its side bar": ("<div class='content-with-sidebar'><article><p>body text</p></article></div>", "body text"),
    "a wrapper that is a side bar by name": ("<div class='sidebar'><article><p>body text</p></article><nav>no</nav></div>", "body text"),
    "an article without side bar": ("<article class='post no-sidebar'><p>body</p></article>", "body"),
    "a form around the page": ("<form id='aspnetForm'><div class=menu>no</div><article><p>body</p></article></form>", "body"),
    "names that are more than noise": ("<article><p class='notice-board'>a</p><section id='share-prices'><p>b</p></section></article>", "a\nb"),
    "a button inside a line": ("<article><p>see <button>More</button> text</p></article>", "see text"),
    "a main element with an intro only": ("<main><p>intro</p></main><div class=story><p>the rest</p></div><footer>no</footer>", "intro\nthe rest"),
    "comments as articles": ("<article><p>x</p></article><section id=comments><article class='comment'><p>no</p></article></section>", "x"),
    "teasers beside": ("<article><p>x</p></article><aside><article><p>no</p></article></aside>", "x"),
    "names with numbers": ("<article><p>x</p><div id='comment-12'>no</div></article>", "x"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    page, want = CASES[name]
    assert H.main_text(page) == want


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, text string")


def test_site_style_tree_removes_what_a_host_repeats(spark):
    body = "<div class=wrap><div class=top>Same words on all pages</div><div class=post><p>unique {0}</p></div></div>"
    rows = [(i, "http://a.example.com/x", body.format(i)) for i in range(12)] + [(50, "http://b.example.com/", body.format(50)), (51, None, None)]
    got = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows)).collect()}
    assert got[3] == "unique 3"
    assert got[50] == "Same words on all pages\nunique 50"  # a host of one page tells nothing
    assert got[51] == "" and len(got) == len(rows)


def test_entropy(spark):
    rows = [(i, "http://h/", f"<p class=a>same</p><p class=b>{i}</p><p class=c>{i % 2}</p>") for i in range(8)]
    tree = H.site_style_tree(pages(spark, rows).selectExpr("'h' as host", "html"))
    got = {r["node"]: r["content"] for r in tree.collect()}
    assert got[H._hash("html>p.a")] == pytest.approx(0)
    assert got[H._hash("html>p.b")] == pytest.approx(1)
    assert got[H._hash("html>p.c")] == pytest.approx(1 / 3)


def plain_importance(pages_of_host):
    """Importance and mean prior of every style path of one host, counted page by page."""
    seen = defaultdict(list)
    for page in pages_of_host:
        _, nodes = H.blocks(page)
        by = defaultdict(list)
        for n in nodes:
            by[n.path].append(n)
        for path, alike in by.items():
            seen[path].append(("|".join(">".join(n.children) for n in alike), "\n".join(t for n in alike for t in n.texts), max(n.prior(nodes[0].holds_main) for n in alike)))
    out = {}
    for path, x in seen.items():
        m = len(x)
        entropy = lambda values: -sum(n / m * math.log(n / m) for n in Counter(values).values()) / math.log(m) if m > 1 else 1.0  # noqa: B023, E731
        looks, texts, priors = zip(*x, strict=True)
        share = 0.9 ** len(set(looks))
        mean = (1 - share) * entropy(looks) + share * entropy(texts)
        out[path] = ((m - 1) * mean + 2) / (m - 1 + 2), sum(priors) / m
    return out


def test_tree_and_texts_equal_a_plain_tree(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta".split())
    rows = []
    for i in range(90):
        parts = [f"<div class=promo-line>{word()}</div>" if rng.random() < 0.5 else "", "<div class=top><p>Same on all pages</p></div>", f"<article><h1>{word()} {i}</h1>" + "".join(f"<p>{word()} {word()}</p>" for _ in range(rng.randint(0, 3)))]
        parts += ["<section class=box><p>Subscribe now</p><p>Same again</p></section>", "<p>Same line.</p></article>", f"<div class=end{rng.randint(0, 9)}>{word()}</div><footer>{word()} {i}</footer>"]
        rows.append((i, f"http://{'a' if i < 60 else 'b' if i < 88 else 'c'}.example/{i}", "".join(parts)))
    got = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows)).collect()}
    hosts = defaultdict(list)
    for i, u, h in rows:
        hosts[u[:9]].append((i, h))
    by_entropy = 0
    for own in hosts.values():
        tree = plain_importance([h for _, h in own])
        low = {p for p, (importance, prior) in tree.items() if importance + prior < H.THRESHOLD}
        by_entropy += sum(1 + tree[p][1] >= H.THRESHOLD for p in low)
        for i, h in own:
            found, _ = H.blocks(h)
            want = []
            for node, text in found:
                at, gone = node, False
                while at is not None and at.parent is not None:
                    gone, at = gone or (at.path in low and not at.holds_main), at.parent
                if not gone:
                    want.append(text)
            assert got[i] == "\n".join(want)
    assert by_entropy >= 3  # entropy, not names
    # On hosts with pages enough the branch that is alike everywhere goes, inside the article too; a single paragraph stays.
    assert "Same on all pages" not in got[5] and "Subscribe now" not in got[5] and "Same line." in got[5]
    assert "Same on all pages" in got[89] and "Subscribe now" in got[89]


def test_the_threshold(spark):
    rows = [(i, "http://h/x", f"<div class=x>{'same' if i < 8 else i}</div><p>{i}</p>") for i in range(10)]
    of = pages(spark, rows)
    tree = {r["node"]: r for r in H.site_style_tree(of.selectExpr("'h' as host", "html")).collect()}
    at = tree[H._hash("html>div.x")]["importance"]
    assert 0 < at < 1
    below, above = (H.extract(of, threshold=at + e).collect() for e in (-1e-9, 1e-9))
    assert {r["text"] for r in below} == {f"{'same' if i < 8 else i}\n{i}" for i in range(10)}
    assert {r["text"] for r in above} == {str(i) for i in range(10)}


def test_registered_pages_are_pruned_by_scores(spark, sf_dir):
    tree = H.site_style_tree(spark.read.parquet(f"{sf_dir}/pages.parquet").select(H.host(F.col("url")).alias("host"), "html"))
    low = {r["node"] for r in tree.where(F.col("importance") + F.col("prior") < H.THRESHOLD).select("node").distinct().collect()}
    assert {H._hash(f"html>{x}") for x in ("nav", "div.ad", "footer")} <= low
    assert not {H._hash(f"html>{x}") for x in ("article", "article>h1", "article>p")} & low


def test_repeated_paragraphs_of_articles_stay(spark):
    rows = [(i, "http://a.example.com/x", f"<article><p>Same line.</p><p>{i}</p></article>") for i in range(20)]
    assert {r["text"] for r in H.extract(pages(spark, rows)).collect()} == {f"Same line.\n{i}" for i in range(20)}


def test_empty_table_and_repeated_rows(spark):
    assert H.extract(pages(spark, [])).count() == 0
    assert H.extract(pages(spark, [(1, "u", "<p>x" * 5000)] * 2)).count() == 2
