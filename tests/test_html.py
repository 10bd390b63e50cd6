from __future__ import annotations

import pytest

from papyrion.html.markdown import Style, drop_lead_heading, html_to_markdown
from papyrion.html.page import Page, best_root, confluence_space, extract, page_context, resolve_adapter, same_author_replies
from papyrion.html.tree import parse
from papyrion.operators.capture import capture_pages


@pytest.mark.parametrize(("html", "markdown"), [
    ("<p>One<p>Two <b>bold</b> <i>it</i>", "One\n\nTwo **bold** *it*"),
    ("<a>plain</a> <a href='/x'></a><a href='/y' title='t'>link</a>", 'plain [link](https://s.test/y "t")'),
    ("<ul><li>a<ul><li>b</ul><li>c</ul><ol start=3><li>x</ol>", "-   a\n    -   b\n-   c\n\n3.  x"),
    ("<table><tr><th>A<th>B<tr><td>1|2<td>x</table>", "| A | B |\n| --- | --- |\n| 1\\|2 | x |"),
    ("<table><tr><td>left<td>right</table>", "left right"),
    ("<table role=presentation><tr><th>a<tr><th>b</table>", "a\n\nb"),
    ("<table><tr><td><div>block</div><td>y<tr><td>1<td>2</table>", "block\n\ny\n\n1 2"),
    ("<pre>a ``` b\n```\nc</pre>", "````\na ``` b\n```\nc\n````"),
    ("<pre><code class='language-js'>x</code></pre>", "```js\nx\n```"),
    ("<dl><dt>T<dd>D</dl>", "**T**\n\n: D"),
    ("<figure><img src=i.png alt=a><figcaption>c</figcaption></figure>", "![a](https://s.test/d/i.png)\n\n*c*"),
    ("<p><iframe src='https://v.test/e' title='Film'></iframe><iframe src='about:blank'></iframe>", "[Embedded: Film](https://v.test/e)"),
    ("<mark>m</mark> a_b <del>d</del><script>x</script>", "==m== a\\_b ~~d~~"),
    ("<div role=grid><div role=row><b role=columnheader>H</b></div><div role=row><b role=gridcell>1</b></div></div>", "| H |\n| --- |\n| 1 |"),
    ("<div role=grid><div role=row><b role=columnheader>H</b></div></div>", "**H**"),
    ("a<br>b", "a  \nb".replace("  \n", "\n")),
    ("<blockquote><p>q<p>r</blockquote><hr><h2>H</h2>", "> q\n>\n> r\n\n---\n\n## H"),
    ("", ""),
])
def test_conversion(html, markdown):
    assert html_to_markdown(html, "https://s.test/d/p") == markdown


def test_spanning_tables_stay_html():
    got = html_to_markdown("<table><tr><th colspan=2>A<tr><td>1<td>2</table>")
    assert got.startswith("<table>") and 'colspan="2"' in got


def test_selectors():
    root = parse("<div id=a class='x y'><p data-k='v1'>1</p><section><p>2</p></section></div>")
    texts = lambda s: [n.text() for n in root.select(s)]
    assert texts("#a > p") == ["1"] and texts(".x.y p") == ["1", "2"] and texts("[data-k^='v'], section p") == ["1", "2"] and texts("p:hover") == []


LONG = "Some long text, with commas, that goes on for a while. " * 8


def test_article_capture():
    page = f"<title>Doc</title><meta name=author content=Jane><meta property='og:site_name' content=S><script type='application/ld+json'>{{\"datePublished\": \"2026-01-01\"}}</script><nav><a href=/n>N</a></nav><article><h1>Doc</h1><p>{LONG}<p>Second, see <a href=/x>x</a>.</article><footer>F</footer>"
    got = extract(page, "https://www.s.test/p", selectors=["h1"], captured_at="2026-01-02T03:04:05Z")
    assert got["mode"] == "article" and got["title"] == "Doc" and got["markdown"].startswith("Some long") and "[x](https://www.s.test/x)" in got["markdown"] and "F" not in got["markdown"].split()
    assert got["metadata"]["author"] == "Jane" and got["metadata"]["site"] == "S" and got["metadata"]["published"] == "2026-01-01"
    assert got["variables"]["selector:h1"] == "Doc" and got["variables"]["schema:datePublished"] == "2026-01-01" and got["variables"]["time"] == "03:04:05"
    assert got["links"] == ["https://www.s.test/n", "https://www.s.test/x"]


def test_platforms():
    sp = f"<title>Home - SharePoint</title><div data-automation-id=Canvas><h1>News</h1><span data-automation-id=newsAuthor>By Ann</span><p>{LONG}</div><script>var spClientSidePageContext = {{\"item\": {{\"Description\": \"About {{x}}\"}}}};</script>"
    got = extract(sp, "https://t.sharepoint.com/sites/a/p.aspx")
    assert got["mode"] == "sharepoint" and got["metadata"]["page_type"] == "news" and got["metadata"]["author"] == "Ann" and got["metadata"]["description"] == "About {x}"
    cf = Page(parse("<meta name=confluence-space-key content=DEV><div id=main-content>x</div>"), "https://wiki.test/x")
    assert resolve_adapter(cf).id == "confluence" and confluence_space(cf) == "DEV"
    assert resolve_adapter(Page(parse("<div id=main-content>x</div>"), "https://wiki.test/x")).id == "generic"
    assert best_root(Page(parse(f"<body><main><p>{LONG}</main></body>"), ""), ["main"]).tag == "main"
    assert page_context("nothing") is None and same_author_replies("/Ann/status/2 /ann/status/1 /bob/status/3", "ann", "1") == ["2"]


def test_forms_and_asides_stay_in_full_pages():
    got = extract(f"<body><form><p>{LONG}</p></form><aside>A callout.</aside><object>o</object><embed></body>", "https://s.test/", "full")
    assert got["markdown"].startswith("Some long text") and got["markdown"].endswith("A callout.")


def test_overrides_and_style():
    assert html_to_markdown(None) == html_to_markdown("") == ""
    assert html_to_markdown("<p>x <u>y</u></p><details><summary>s</summary>t</details>", overrides={"u": lambda node, inner: f"_{inner}_", "details": lambda node, inner: f"[{inner}]", "p": lambda node, inner: None}) == "x _y_\n\n[s\n\nt]"
    assert html_to_markdown("<ul><li>a <em>b</em></ul><hr>", style=Style(rule="***", bullet="*", emphasis="_")) == "*   a _b_\n\n***"


def test_registered_adapters_reach_the_workers(spark):
    from papyrion.html.page import ADAPTERS, Adapter, register_adapter

    mine = Adapter("mine", lambda page: page.host == "mine.test", ["#own"], lambda page, root: "My title")
    register_adapter(mine)
    try:
        df = spark.createDataFrame([("https://mine.test/1", f"<div id=own><p>{LONG}</p></div><p>else</p>"), ("https://t.sharepoint.com/1", f"<div data-automation-id=Canvas><h1>H</h1><p>{LONG}</div>")], "url string, html string")
        got = {r["url"]: r for r in capture_pages(df, overrides={"p": lambda node, inner: f"<<{inner}>>"}).collect()}
    finally:
        ADAPTERS.remove(mine)
    assert got["https://mine.test/1"]["mode"] == "mine" and got["https://mine.test/1"]["title"] == "My title" and "else" not in got["https://mine.test/1"]["markdown"]
    assert got["https://mine.test/1"]["markdown"].startswith("<<Some") and got["https://t.sharepoint.com/1"]["mode"] == "sharepoint"


def test_lead_heading():
    assert drop_lead_heading("![i](u)\n\n# A  B\n\nx", "a b") == "![i](u)\n\n\nx" and drop_lead_heading("x\n# A", "A") == "x\n# A"


def test_capture_stage(spark):
    df = spark.createDataFrame([("https://a.test/1", f"<title>T</title><p>{LONG}"), ("https://a.test/2", None), (None, "")], "url string, html string")
    got = {r["url"]: r for r in capture_pages(df).collect()}
    assert got["https://a.test/1"]["title"] == "T" and got["https://a.test/1"]["error"] is None
    assert got["https://a.test/2"]["error"] == "no content" and got["https://a.test/2"]["markdown"] is None and got[None]["markdown"] == ""
    assert capture_pages(df.where("false")).count() == 0
