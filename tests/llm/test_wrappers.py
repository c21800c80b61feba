import html
import random
import re

from pyspark.sql import functions as F

from driftline.llm import wrappers as w


def test_whole_table(spark, sf):
    """The pages of the table have their text in one article: read with regular expressions alone it must be the same."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = w.extracted(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert r.text == want and r.n_chars == len(want)


def page(rnd, article, extra=True):
    say = lambda k: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(k))
    return f"""<!DOCTYPE html><html><head><title>{say(3)}</title><style>p{{}}</style><script>var a="</p><div>no</div>";</script></head><body>
    <div class="site-header"><div>Site name</div><ul class="menu"><li><a href=/>Home</a></li>{''.join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(rnd.randrange(2, 6)))}</ul></div>
    <div class="wrap"><div>You are reading the Daily Example</div>{'<div class="cookie-notice">We use cookies</div>' if extra else ''}
    <div class="story">{article}</div><div class="ad">Buy {say(2)}</div><div>Printed on recycled paper</div></div>
    <form><label>Mail</label><input name=x><button>Go</button></form>
    <div id="comments"><p>{say(9)}</p></div><footer>&copy; Daily Example</footer></body></html>"""


def test_wrapper_of_a_host_without_articles(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for i in range(40):
        words = [f"w{rnd.randrange(9999)}" for _ in range(60)]
        parts = [" ".join(words[a : a + 20]) for a in (0, 20, 40)]
        art = "".join(f"<p>{p} &amp; <b>so</b>on</p>" for p in parts)
        rows.append((i, "http://daily.example/" + str(i), page(rnd, art, i % 2 == 0)))
        want[i] = " ".join(f"{p} & soon" for p in parts)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(5)
    got = {r.page_id: r.text for r in w.extracted(df).collect()}
    assert got == want
    old = w.BROADCAST_BYTES
    try:
        w.BROADCAST_BYTES = 0
        assert {r.page_id: r.text for r in w.extracted(df).collect()} == want
    finally:
        w.BROADCAST_BYTES = old


def test_alignment():
    one = w.pattern(w.parse("<ul><li>a</li><li>b</li></ul><p>same</p><p>x</p><div>t</div>"))
    two = w.pattern(w.parse("<ul><li>c</li></ul><h2>more</h2><p>same</p><div>t</div>"))
    e = w.expression(w.align(one, two))
    assert "<li.> # </>" in e and "(<h2.> 'more' </>)?" in e and "<div.> 't' </>" in e


def test_names_that_only_begin_like_a_menu():
    parts = ["<h2 id='discussion'>Discussion</h2>", "<section id='search-algorithms'>a</section>", "<div class='table-responsive'>b</div>", "<p class='navy'>c</p>", "<p class='commentary'>d</p>", "<section id='legal-issues'>e</section>", "<p class='tags'>f</p>", "<div id='comments'>g</div>"]
    for tag in ("article", "main"):
        assert w.main_text(f"<{tag}>{''.join(parts)}<div class='x comments'>no</div><div class='Sidebar'>no</div></{tag}>") == "Discussion a b c d e f g"
    assert w.main_text("".join(parts)) == "Discussion a b c d e f"


def test_no_text_of_the_page_is_lost(spark):
    assert w.main_text("<div><h1>T</h1><p>lead</p><div>" + "body " * 50 + "</div></div>").startswith("T lead body")
    assert w.main_text("<article>one</article><article>two two</article>") == "one two two"
    copy, long = "<div><h1>Title</h1><p>text</p></div>", "constant " * 100
    rows = [(i, f"http://copies.example/?ref={i}", copy) for i in range(4)]
    rows += [(10 + i, f"http://long.example/{i}", f"<div>{long}</div><p>own {i}</p>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in w.extracted(df).collect()}
    assert got == {**{i: "Title text" for i in range(4)}, **{10 + i: f"own {i}" for i in range(4)}}


def test_cases(spark):
    rows = [(1, "http://a.b/", None), (2, None, ""), (3, "http://a.b/x", "<p>"), (4, "x", "plain &lt;text&gt;\xa0here"), (5, "http://a.b/y", "<article><h1>T</h1>one<br>two <i>th</i>ree<aside>no</aside><div class='comments'>c</div>"), (5, "http://a.b/y", "<article><h1>T</h1>one<br>two <i>th</i>ree<aside>no</aside><div class='comments'>c</div>"), (6, "http://a.b/z", "<div><b>" * 5000 + "deep" + "<div>" * 5000), (7, "http://q/", "<p>a < b and c > d</p><!-- x"), (8, "http://q/", "<article><p>" + "long " * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = w.extracted(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert (by[1], by[2], by[3], by[4]) == ("", "", "", "plain <text> here")
    assert by[5] == "T one two three" and by[6] == "deep" and by[7] == "a < b and c > d" and len(by[8]) == 5 * 50000 - 1
    assert w.extracted(df.where("false")).count() == 0


def test_whole_table_without_article_tags(spark, sf):
    """The same texts come out where articles are plain divs, so the article tag is not what finds them."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "(</?)article\\b", "$1div"))
    assert {r.page_id: r.text for r in w.extracted(bare).collect()} == {r.page_id: r.text for r in w.extracted(pages).collect()}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://a.b/", "<p>t</p>", 3, 4)], "page_id long, url string, html string, `a.b` int, __text int")
    assert [tuple(r) for r in w.extracted(df).collect()] == [(1, "http://a.b/", "<p>t</p>", 3, 4, "t", 1)]
