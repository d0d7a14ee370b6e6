import random

import pytest
from pyspark.sql import functions as F

from keyfacet.llm import pages

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="menu-open">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <p>no</p> --><div class="ad"><div>Buy <b>now</b></div></div>
<div id="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>One  <b>bold</b>\n text&nbsp;here &lt;x&gt; a < b</p><p>Two<br>three
<aside>side</aside><p class=ad>ad text<p>four</p><form><p>f</p></form><ul><li>i1<li>i2</ul><div class="comments"><article class="comment"><p>first!</p></article></div></article>
<section class="comments"><p>hello</p></section><footer>&copy; x</footer></body></html>"""


def texts_of(html, place=pages.INSIDE):
    return [line for p, line in pages.page_lines(html) if p == place]


def test_article():
    assert texts_of(FULL) == ["Title & more", "One bold text here <x> a < b", "Two three", "four", "i1", "i2"]


def test_broken_markup():
    assert texts_of("<article><p>a<nav>menu<article><p>b</article>") == ["a", "b"]
    assert texts_of("<p>a <a href='x>unclosed</p><p>b", pages.PLAIN)
    assert pages.page_lines("<script>never closed <p>x") == []
    assert pages.page_lines("plain &amp; simple") == [(pages.PLAIN, "plain & simple")]
    assert texts_of("<div " + "a='" * 20_000) == []
    assert pages.page_lines("<nav><ul><li>a</li><li>b<br>c</li></ul></nav>d") == [(pages.NAMED, "a"), (pages.NAMED, "b c"), (pages.PLAIN, "d")]


def lcs(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("whole", [pages.WHOLE, 0])
def test_alignment_against_the_plain_table(monkeypatch, whole):
    monkeypatch.setattr(pages, "WHOLE", whole)
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ([rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        own = [x for x, s in zip(a, pages.shared_lines(a, b)) if s]
        assert len(own) == lcs(a, b) and lcs(own, b) == len(own)


def test_differencing_alone(spark):
    """Without the guards, shared lines of a container go as well and unshared named lines stay."""
    html = lambda own, menu: f"<nav><li>{menu}</li></nav><article><h1>Same</h1><p>{own}</p></article><footer>Foot</footer>"
    df = spark.createDataFrame([(k, f"http://b.org/{k}", html(f"own {k}", f"menu {k}")) for k in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in pages.main_text(df).collect()} == {f"Same\nown {k}" for k in range(3)}
    assert {r["text"] for r in pages.main_text(df, guard=False).collect()} == {f"menu {k}\nown {k}" for k in range(3)}
    assert tuple(pages.shared_share(df).first()) == (3, 3)


def test_pages_and_nearest_url(spark):
    bare = lambda own: f"<html><body><div>Home</div><div>Archive</div><p>{own}</p><div>Imprint</div></body></html>"
    rows = [
        (1, "http://a.org/de/1", FULL), (2, "http://www.b.org/x/1.html", bare("first")), (3, "https://b.org/x/2?q=1", bare("second")), (4, "http://b.org/y/9", bare("third")),
        (5, "http://c.org/1", bare("alone")), (6, None, None), (7, "http://b.org/x/1", ""), (8, None, "<p>x</p>"), (2, "http://www.b.org/x/1.html", bare("first")), (None, "u", "<article>" + "<p>w</p>" * 20_000 + "</article>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("row", F.lit(1))
    got = sorted(((r["page_id"], r["text"]) for r in pages.main_text(df).collect()), key=str)
    texts = dict(got)
    assert len(got) == len(rows)
    assert texts[3] == "second" and texts[4] == "third" and texts[5] == "Home\nArchive\nalone\nImprint"
    assert texts[6] == "" and texts[7] == "" and texts[8] == "x" and texts[None] == "\n".join(["w"] * 20_000)
    assert [t for i, t in got if i == 2] in (["", ""], ["first", ""], ["", "first"], ["first", "first"])
    assert pages.main_text(df.limit(0)).count() == 0


def test_copies_are_not_the_template_of_each_other(spark):
    bare = lambda own: f"<html><body><div>Home</div><div>Archive</div><p>{own}</p><div>Imprint</div></body></html>"
    rows = [(1, "http://b.org/x/1.html", "first")] * 2 + [(2, "http://b.org/x/2", "second"), (3, "http://b.org/x/2/amp", "second"), (4, "http://b.org/x/2?print", "second")]
    rows += [(5, "http://b.org/y/9", "third")] + [(6, f"http://d.org/{k % 3}", "only") for k in range(9)] + [(7, "http://e.org/1", "only")]
    rows += [(100 + k, f"http://f.org/{k // 50}", f"text {k // 50}") for k in range(200)]  # groups of copies that ranges cut
    df = spark.createDataFrame([(i, url, bare(own)) for i, url, own in rows], "page_id long, url string, html string")
    whole = lambda own: f"Home\nArchive\n{own}\nImprint" if own == "only" else own
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = sorted((r["page_id"], r["text"]) for r in pages.main_text(df).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "2")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == sorted((i, whole(own)) for i, _, own in rows)
