import pytest

from talentlake.llm.html_text import extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home, now.</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept them, please.</div>
<!-- <p>never</p> --><article><h1>Head &amp; line</h1><p><b>First   para,
 with <a href="y">a link</a>.<br><p>Second &lt;b&gt; &#233;&nbsp;x.</p><aside>Related: much text, many words, more. And more.</aside>
<div class="comments"><p>Great post! I agree, fully. Yes.</p></div></article><form><p>Name:</p></form><footer>&copy; all</footer>"""


@pytest.mark.parametrize("page, text", [
    (PAGE, "Head & line\nFirst para, with a link.\nSecond <b> é x."),
    (PAGE + "</body", "Head & line\nFirst para, with a link.\nSecond <b> é x."),
    ("<div class=menu><a>Home</a></div><div id='content'><h2>Title</h2><p>One, two. Three.</p><ul><li>item one</li></ul></div>"
     "<div class='sidebar'>s</div>", "Title\nOne, two. Three.\nitem one"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>a</p><p>cut <b", "a\ncut"), ("<article><p>short</p></article><p>out", "short"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"), ("just text", "just text"), ("", ""), (None, ""),
    ("<article></article>", ""), ("<article><p title='a > b'>x</p><p title='odd>y</p></article>", "x\ny"),
    ("<ARTICLE><P>Caps</P></ARTICLE>", "Caps"), ("<article><script>a</script><p>b</p><style>c", "b"), ("< 3 > 2 & 1", "< 3 > 2 & 1"),
    ("<main><p>m.</p></main><footer>f</footer>", "m."), ("<article>" + "<p>w, w.</p>" * 30_000, "\n".join(["w, w."] * 30_000)),
])
def test_main_text(page, text):
    assert main_text(page) == text


STORY = "<p>" + "A paragraph of the story, told at some length. It goes on for a while; then it ends. " * 2 + "</p>"


@pytest.mark.parametrize("block", [
    "<div>Buy now</div>", "<div><ul><li><a href='/a'>Other story</a></li><li><a href='/b'>One more</a></li></ul></div>"])
def test_scores_decide_inside_articles_too(block):
    for mark in ("article", "main", "div"):
        page = f"<body><{mark}><h1>Title here</h1>{STORY}%s{STORY}<ul><li>one thing</li></ul></{mark}></body>"
        assert main_text(page % block) == main_text(page % "")
        assert main_text(page % "").startswith("Title here\nA paragraph") and main_text(page % "").endswith("\none thing")
    # an article is a feature, too: dense text outside is not lost to a short teaser
    assert "A paragraph" in main_text(f"<article><p>Hi</p></article><section>{STORY * 3}</section>")


@pytest.mark.parametrize("attrs", ["class='content has-sidebar'", "class=no-sidebar", "class='with-header'", "id='share-prices'", "class='comment-page'"])
def test_names_do_not_mark_what_holds_the_article(attrs):
    plain = main_text(f"<article><h1>Title here</h1>{STORY}</article>")
    for outside in ("", "<div class=ad>Buy now, today.</div><div class=comments><p>Great post! I agree.</p></div>"):
        assert main_text(f"<div {attrs}><article><h1>Title here</h1>{STORY}</article>{outside}</div>") == plain
        assert main_text(f"<main><x-app {attrs}><article><h1>Title here</h1>{STORY}</article>{outside}</x-app></main>") == plain
        assert main_text(f"<body><div {attrs}><h1>Title here</h1>{STORY}</div>{outside}</body>") == plain


def test_other_columns_stay_and_rows_repeat(spark):
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (None, None, None, None)]
    got = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "html", "text"]
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, ""), (1, main_text(PAGE)), (1, main_text(PAGE))]
    assert extract_text(spark.createDataFrame([], "page_id bigint, html string")).count() == 0
