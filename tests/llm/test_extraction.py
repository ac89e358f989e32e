from factline.llm import extraction as E
from factline.llm.blocks import blocks


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='<p>no</p>';</script></head><body>{body}</body></html>"


def text_of(html):
    return E.main_text(blocks(html), set())


def test_article_without_what_surrounds_it():
    html = page(
        '<header>Site</header><nav><ul><li><a href="/x">menu</a></ul></nav><div class="ad box">buy</div><div id="cookie-notice">we use</div>'
        "<article><header><h1>A &amp; B</h1></header><p>one\n  two&nbsp;three <b>bold<br>next<p>second <i>x</i>y<ul><li>item<li>item 2</ul>"
        '<aside>side</aside><form><input><p>mail</p></form><div class="comments"><p>nice!</p></div><footer>by me</footer>tail</article>'
        '<section class="comment"><p>great</p></section><footer>&copy; all</footer>'
    )
    assert text_of(html) == "A & B\n\none two three bold next\n\nsecond xy\n\nitem\n\nitem 2\n\ntail"


def test_odd_pages():
    assert text_of(None) == text_of("") == text_of("<html><body></body>") == ""
    assert text_of("plain words only") == "plain words only"
    assert text_of(page("<p>a &lt; b</p><p>1 < 2 &unknown; &#x41;&#66;")) == "a < b\n\n1 < 2 &unknown; AB"
    assert text_of("<article><p>cut off &am") == "cut off &am"
    assert text_of("<article><p>cut <a href='x") == "cut"
    assert text_of("<article><p>q <span title='a>b'>w</span><!-- <p>no</p> -->e</article>") == "q we"
    assert text_of('<div><div><p>x</p></div><p>' + "long " * 200_000 + "</div>").startswith("x\n\nlong long")


def test_pages_without_article_drop_link_lists():
    assert text_of(page('<div><a href="1">one</a> <a href="2">two</a></div><p>words of <a href="3">some</a> weight here</p>')) == "words of some weight here"


def test_wrappers_align_repeat_and_option():
    a = E.wrapper_of(blocks("<article><h1>x</h1><p>1<p>2<p>3</article>"))
    assert [(t["key"], t["rep"]) for t in a["stream"]] == [("article/h1", 0), ("article/p", 1)]
    b = E.wrapper_of(blocks("<article><h1>y</h1><h2>sub</h2><p>1</article>"))
    both = E.align(a, b)
    assert both["n"] == 2 and [(t["key"], t["opt"], len(t["texts"])) for t in both["stream"]] == [("article/h1", 0, 2), ("article/h2", 1, 1), ("article/p", 0, 3)]
    pairs = E.wrapper_of(blocks("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))
    assert [(t["key"], t["rep"], len(t["texts"])) for t in pairs["stream"]] == [("dl/dt", 1, 3), ("dl/dd", 1, 3)]


def make(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' as host", "'x' as template", "'x' as wrapper", "'x' as _all", "'old' as text")


def test_template_text_goes_only_with_enough_pages(spark):
    body = lambda i: page(f"<article><h1>head {i}</h1><p>words {i} and more<p>Sign up for our letter</article>")
    rows = [(i, f"http://Big.example:80/{i}", body(i)) for i in range(12)] + [(100 + i, f"http://small.example/{i}", body(i)) for i in range(3)]
    rows += [(200 + i, f"http://same.example/{i}", body(1)) for i in range(9)] + [(300, None, body(1)), (301, "http://big.example/null", None), (None, "x", "")]
    got = {r["page_id"]: (r["text"], r["n_chars"], r["host"]) for r in E.with_main_text(make(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    whole = lambda i: f"head {i}\n\nwords {i} and more\n\nSign up for our letter"
    assert got[100] == (whole(0), len(whole(0)), "x") and got[200][0] == got[300][0] == whole(1)
    assert got[301][:2] == got[None][:2] == ("", 0)
    # a page without content keeps the template from being on all pages, so nothing is taken away
    assert got[3][0] == whole(3)
    rows = rows[:12]
    got = {r["page_id"]: r["text"] for r in E.with_main_text(make(spark, rows).repartition(5)).collect()}
    assert got[3] == "head 3\n\nwords 3 and more"


def test_no_pages(spark):
    assert E.with_main_text(make(spark, [])).collect() == []
