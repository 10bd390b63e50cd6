"""Pages and fragments with what must come of them: the queries convert the HTML, their SQL holds the expected values.

``@`` stands for a collection's id, so that each case is converted once for every collection.
"""

from __future__ import annotations

#: Fragments by group: case, HTML, Markdown.
FRAGMENTS: dict[str, list[tuple[str, str, str]]] = {
    "html_blocks": [
        ("heading", "<h2>About <em>@</em></h2><p>One<p>Two <strong>bold</strong>", "## About *@*\n\nOne\n\nTwo **bold**"),
        ("lists", "<ul><li>@<ul><li>inner</ul><li>last</ul><ol start=4><li>four</ol>", "-   @\n    -   inner\n-   last\n\n4.  four"),
        ("quote and rule", "<blockquote><p>@<p>again</blockquote><hr>", "> @\n>\n> again\n\n---"),
        ("figure", "<figure><img src='https://i.test/@.png' alt='pump'><figcaption>Pump @</figcaption></figure>", "![pump](https://i.test/@.png)\n\n*Pump @*"),
        ("definitions", "<dl><dt>@</dt><dd>A set of pages</dd></dl>", "**@**\n\n: A set of pages"),
        ("mark and del", "<p>a <mark>@</mark> and <del>old</del></p>", "a ==@== and ~~old~~"),
        ("removed", "<p>@</p><script>x()</script><style>p{}</style><noscript>no</noscript><svg><title>t</title></svg>", "@"),
        ("entities", "<p>@ &amp; more &lt;b&gt;&nbsp;end</p>", "@ & more <b> end"),
        ("line starts", "<p>1. @</p><p># no heading</p>", "1\\. @\n\n\\# no heading"),
        ("empty", "", ""),
    ],
    "html_tables": [
        ("headed", "<table><tr><th>Name</th><th>Id</th></tr><tr><td>x</td><td>@</td></tr></table>", "| Name | Id |\n| --- | --- |\n| x | @ |"),
        ("headerless", "<table><tr><td>Name</td><td>Id</td></tr><tr><td>x</td><td>@</td></tr></table>", "| Name | Id |\n| --- | --- |\n| x | @ |"),
        ("pipe and break", "<table><tr><th>A</th><th>B</th></tr><tr><td>x | y<br>z</td><td>@</td></tr></table>", "| A | B |\n| --- | --- |\n| x \\| y z | @ |"),
        ("one row", "<table><tr><td>left</td><td>@</td></tr></table>", "left @"),
        ("presentation", "<table role='presentation'><tr><td>1.</td><td><a href='https://x.test/@'>Story</a></td></tr><tr><td colspan='2'>99 points</td></tr></table>", "1. [Story](https://x.test/@)\n\n99 points"),
        ("block cell", "<table role='none'><tr><td><div>Block</div></td><td>@</td></tr></table>", "Block\n\n@"),
        ("headless with block", "<table><tr><td><div>a</div></td><td>b</td></tr><tr><td>@</td><td>d</td></tr></table>", "a\n\nb\n\n@ d"),
        ("data in layout", "<table role='presentation'><tr><td><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>@</td></tr></table></td></tr></table>", "| A | B |\n| --- | --- |\n| 1 | @ |"),
        ("layout in data", "<table><tr><th>A</th><th>B</th></tr><tr><td><table role='presentation'><tr><td>x</td></tr></table></td><td>@</td></tr></table>", "| A | B |\n| --- | --- |\n| x | @ |"),
        ("paragraphs", "<table><tr><td><p>a</p></td><td>b</td></tr><tr><td>@</td><td>d</td></tr></table>", "| a | b |\n| --- | --- |\n| @ | d |"),
        ("spans", "<table><tr><th colspan=\"2\">@</th></tr><tr><td>1</td><td>2</td></tr></table>", "<table><tr><th colspan=\"2\">@</th></tr><tr><td>1</td><td>2</td></tr></table>"),
    ],
    "html_grids": [
        ("grid", "<div role='grid'><div role='row'><span role='columnheader'>Name</span><span role='columnheader'>Area</span></div><div role='row'><span role='gridcell'>@</span><span role='gridcell'>a|b</span></div></div>", "| Name | Area |\n| --- | --- |\n| @ | a\\|b |"),
        ("no data", "<div role='grid'><div role='row'><span role='columnheader'>@</span></div></div>", "@"),
        ("uneven", "<div role='table'><div role='row'><b role='columnheader'>H</b><b role='columnheader'>I</b></div><div role='row'><b role='cell'>@</b></div></div>", "| H | I |\n| --- | --- |\n| @ |  |"),
    ],
    "html_links": [
        ("empty", "<p>a<a href='https://x.test/v'></a>@<a href='https://x.test/w'>  </a></p>", "a@"),
        ("only an image", "<a href='https://x.test'><img src='https://x.test/i.svg'></a><p>@</p>", "@"),
        ("image with alt", "<a href='https://x.test/@'><img src='https://x.test/i.png' alt='Logo'></a>", "[![Logo](https://x.test/i.png)](https://x.test/@)"),
        ("relative", "<a href='/p/@'>Page</a> <img src='i.png' alt='pic'>", "[Page](https://base.test/p/@) ![pic](https://base.test/d/i.png)"),
        ("kept", "<a href='#frag'>Frag</a> <a href='mailto:a@b.test'>Mail</a>", "[Frag](#frag) [Mail](mailto:a@b.test)"),
        ("title", "<a href='https://x.test/' title='T \"q\"'>@</a>", "[@](https://x.test/ \"T \\\"q\\\"\")"),
        ("no address", "<a>plain</a> @", "plain @"),
    ],
    "html_code": [
        ("pre", "<pre>plain @\n  two</pre>", "```\nplain @\n  two\n```"),
        ("language", "<pre><code class='language-sql'>select '@'</code></pre>", "```sql\nselect '@'\n```"),
        ("longer fence", "<pre>```\n@\n```</pre>", "````\n```\n@\n```\n````"),
        ("inline", "<p>run <code>@ --x</code> and <code>a `b`</code></p>", "run `@ --x` and `` a `b` ``"),
        ("blank", "<pre>  </pre><p>@</p>", "@"),
    ],
    "html_frames": [
        ("titled", "<iframe title='Map of @' src='https://maps.test/x'></iframe>", "[Embedded: Map of @](https://maps.test/x)"),
        ("untitled", "<p>@</p><iframe src='https://video.test/1'></iframe>", "@\n\n[Embedded: video.test](https://video.test/1)"),
        ("blank", "<iframe src='about:blank'></iframe><p>@</p>", "@"),
    ],
}

_SENTENCE = "This is a sentence of the article on @, with a comma. "
_BODY = "<p>" + _SENTENCE * 6 + "</p>"
_TEXT = (_SENTENCE * 6).strip()

#: Whole pages captured in mode ``auto``: case, address, HTML, and what comes of them (title, mode, author, published, description, site, page_type, space, markdown).
PAGES: list[tuple[str, str, str, tuple[str | None, ...]]] = [
    ("article", "https://www.news.test/@", f"<title>News @</title><nav>menu</nav><article><h1>News @</h1>{_BODY}</article><footer>foot</footer>", ("News @", "article", "", "", "", "news.test", None, None, _TEXT)),
    ("meta", "https://m.test/@", f"<title>T</title><meta name='author' content='Dana  Lee'><meta property='article:published_time' content='2026-02-01'><meta name='description' content='About @'><meta property='og:site_name' content='The Site'><article>{_BODY}</article>", ("T", "article", "Dana Lee", "2026-02-01", "About @", "The Site", None, None, _TEXT)),
    ("json-ld", "https://j.test/@", f"<title>T</title><script type='application/ld+json'>{{\"@graph\": [{{\"author\": {{\"name\": \"Ann Ray\"}}, \"datePublished\": \"2026-03-04\"}}]}}</script><article>{_BODY}</article>".replace("@graph", "graph"), ("T", "article", "Ann Ray", "2026-03-04", "", "j.test", None, None, _TEXT)),
    ("byline", "https://b.test/@", f"<title>T</title><p class='byline'>By Max Orr</p><article>{_BODY}</article>", ("T", "article", "Max Orr", "", "", "b.test", None, None, _TEXT)),
    ("sharepoint", "https://c.sharepoint.com/sites/t/@.aspx", f"<title>Update - SharePoint</title><div data-automation-id='SiteHeader'><nav>Home</nav></div><div data-automation-id='Canvas'><h1 data-automation-id='pageTitle'>Update @</h1>{_BODY}<ul><li>Alpha</li></ul></div>", ("Update @", "sharepoint", "", "", "", "c.sharepoint.com", "page", None, f"{_TEXT}\n\n-   Alpha")),
    ("sharepoint news", "https://c.sharepoint.com/sites/t/n-@.aspx", f"<title>N</title><div data-automation-id='Canvas'><h1>N @</h1><span data-automation-id='newsAuthor'>By Ann</span>{_BODY}</div><script>var spClientSidePageContext = {{\"item\": {{\"Description\": \"On {{it}}\"}}}};</script>", ("N @", "sharepoint", "Ann", "", "On {it}", "c.sharepoint.com", "news", None, f"By Ann\n\n{_TEXT}")),
    ("confluence", "https://e.atlassian.net/wiki/spaces/ENG/pages/1/@", f"<title>Page - Confluence</title><meta name='confluence-space-key' content='ENG'><div id='title-text'>Real @</div><div id='main-content'>{_BODY}<div class='page-metadata'>meta</div></div>", ("Real @", "confluence", "", "", "", "e.atlassian.net", None, "ENG", _TEXT)),
    ("confluence server", "https://wiki.corp.test/display/OPS/@", f"<title>My @ - Confluence</title><meta name='confluence-base-url' content='https://wiki.corp.test'><div class='wiki-content'>{_BODY}</div>", ("My @", "confluence", "", "", "", "wiki.corp.test", None, "OPS", _TEXT)),
    ("no platform", "https://blog.test/@", f"<title>B</title><div id='main-content'>{_BODY}</div>", ("B", "article", "", "", "", "blog.test", None, None, _TEXT)),
    ("no title", "https://u.test/@", f"<article>{_BODY}</article>", ("Untitled page", "article", "", "", "", "u.test", None, None, _TEXT)),
]

#: Whole pages captured in mode ``full``: case, HTML, Markdown.
FULL: list[tuple[str, str, str]] = [
    ("form", "<body><form><h1>In a form</h1><p>@</p><input value='x'><button>Go</button></form></body>", "# In a form\n\n@"),
    ("furniture", "<body><header>h</header><nav>n</nav><div role='navigation'>r</div><div role='banner'>b</div><div role='search'>s</div><p>@</p><footer>f</footer></body>", "@"),
    ("aside", "<body><p>@</p><aside>A callout</aside><div role='contentinfo'>Info</div></body>", "@\n\nA callout\n\nInfo"),
    ("hidden", "<body><p>@</p><p style='display:none'>a</p><p hidden>b</p><p aria-hidden='true'>c</p><p style='visibility: hidden'>d</p></body>", "@"),
    ("objects", "<body><p>@</p><object>o</object><embed src='x'><canvas>c</canvas><select><option>s</option></select><textarea>t</textarea></body>", "@"),
    ("addresses", "<body><p><a href='/d'>Doc</a> <a href='#x'>Frag</a> <a href='javascript:go()'>Go</a> @</p><img src='pics/a.png' alt='A'><img alt='none'><img data-src='/b.png' alt='B'></body>", "[Doc](https://full.test/d) Frag Go @\n\n![A](https://full.test/p/pics/a.png)![B](https://full.test/b.png)"),
    ("overlay", "<body><div data-mwc-capture-overlay>status</div><p>@</p></body>", "@"),
]
