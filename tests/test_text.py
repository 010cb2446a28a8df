import hashlib

from pyspark.sql import functions as F

from pagemill.functions import markdown, text
from pagemill.functions.html import read
from tests.test_urls import values

MD = """\
| a | b |
|---|---|
![logo](/l.png) ![A fine bridge](/b.png)
#Head
# Head
#

[Read more](/x)
See [the   page](/y) now
See the page now
https://site.test/only
* * *
assets/img/a.png
Facebook
a"""


def test_signature_and_spacing(spark):
    texts = ["Ab 1 https://x.test/y c!", "", None, "Дом 12", "a\r\n\tb   c \n\n\n\nd  "]
    got = values(spark, texts, text.content_signature(F.col("x")), text.spacing(F.col("x")))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [g[0] for g in got] == [digest("abc"), "", "", digest(""), digest("abcd")]
    assert got[4][1] == "a\n b c\n\nd"


def test_cleaning(spark):
    df = spark.createDataFrame([(1, MD), (2, ""), (3, None), (4, "ﬁne words here\n\nfine words here")], "id int, md string")
    got = {r["id"]: r["done"] for r in markdown.with_cleaned(df, "md", "done").collect()}
    assert got[1]["text"].split("\n") == ["| a | b |", "A fine bridge", "# Head", "See the page now"]
    report = got[1]["report"]
    assert (report["removed_images"], report["replaced_links"], report["removed_duplicate_lines"]) == (2, 2, 1)
    assert report["original_chars"] == len(MD) and report["cleaned_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[3]["report"]["original_chars"] == 0
    assert got[4]["text"] == "fine words here"


def test_quality(spark):
    long = " ".join(f"word{k}" for k in range(60))
    cases = [
        (long, "Page Not Found", 900, "home", "bad_title"), ("Access denied " + long, None, 900, "home", "bad_phrase"), (long, "t", 100, "blog_detail", "detail_body_too_short:100"), ("short", "t", 0, "home", "too_short"),
        ("x" * 200, "t", 0, None, "too_few_words"), ("same " * 90, "t", 900, "home", "low_unique_word_ratio"), (long, "t", 900, "blog_detail", "ok"), (None, None, None, None, "too_short"),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "id int, md string, title string, chars int, route string, want string")
    got = df.orderBy("id").select(text.quality_reason(F.col("md"), F.col("title"), F.col("chars"), F.col("route"))).collect()
    assert [g[0] for g in got] == [c[-1] for c in cases]


def page(html):
    names = ["title", "h1", "best_heading", "canonical_url", "refresh_url", "og_url", "data_urls", "links", "markdown", "selector", "main_content_chars"]
    return dict(zip(names, read(html, "https://s.test/a/")))


def test_html_meta():
    p = page('<title> T </title><link rel="canonical" href="x"><meta http-equiv="Refresh" content="5;URL=\'/n\'"><h2>Second</h2><h2 class="big-title">Big</h2><script type="application/ld+json">[{"url": "https://s.test/1"}, 3]</script>')
    assert (p["title"], p["h1"], p["best_heading"], p["canonical_url"], p["refresh_url"], p["data_urls"]) == ("T", "", "Big", "https://s.test/a/x", "https://s.test/n", ["https://s.test/1"])
    assert page("")["markdown"] == "" and page(None)["selector"] == "body_fallback"


def test_html_content():
    p = page("<body><nav>menu</nav><main><h1>A</h1><p>one <b>two</b><p>three<ul><li>x<li>y</ul></main></body>")
    assert p["markdown"] == "# A\n\none **two**\n\nthree\n\n* x\n* y"
    assert p["selector"] == "main" and p["main_content_chars"] == len("Aonetwothreexy")
    wide = page("<body><main>small</main><div>" + "far more text " * 9 + "</div></body>")
    assert wide["selector"] == "body"
    early = page("<body><article>" + "long text " * 300 + "</article><div>" + "more " * 900 + "</div></body>")
    assert early["selector"] == "article"


def test_html_links():
    p = page('<a href="b" title="T"></a><a href="#">n</a><area href="/c"><div data-url="/d">D</div><p onclick="window.open(\'/e\')">E</p><a rel="canonical" href="/f">F</a>')
    assert p["links"] == [("https://s.test/a/b", "dom_post_interaction", "T"), ("https://s.test/c", "dom_post_interaction", ""), ("https://s.test/d", "dom_post_interaction", "D"), ("https://s.test/f", "canonical", "F"), ("https://s.test/e", "onclick_attr", "E")]
