"""From a page's HTML to a capture result: adapters, content root, cleaning, article, metadata and variables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

from papyrion.html.markdown import Converter, Override, drop_lead_heading, resolve
from papyrion.html.tree import Node, clean, parse

# Tags and selectors of what is no content; they go before conversion.
UNWANTED_TAGS = frozenset({"script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed", "button", "input", "select", "textarea"})
CHROME = "[data-mwc-capture-overlay], [aria-hidden='true'], [role='navigation'], [role='banner'], [role='search'], nav, header, footer"
#: An article counts from so many visible characters; a root candidate from so many.
ARTICLE_MIN, ROOT_MIN = 200, 80


@dataclass
class Page:
    """One parsed page and where it came from."""

    root: Node
    url: str
    metas: dict[str, dict[str, str]] | None = None

    @property
    def host(self) -> str:
        try:
            return (urlsplit(self.url).hostname or "").lower()
        except ValueError:
            return ""

    @property
    def path(self) -> str:
        try:
            return urlsplit(self.url).path or "/"
        except ValueError:
            return "/"

    def document_title(self) -> str:
        node = self.root.first("title")
        return clean(node.text()) if node else ""


@dataclass
class Adapter:
    """How pages of one platform are read; registered adapters are tried in order."""

    id: str
    match: Callable[[Page], bool]
    roots: list[str] = field(default_factory=list)
    title: Callable[[Page, Node | None], str | None] = lambda page, root: None
    unwanted: str = ""
    author: list[str] = field(default_factory=list)
    published: list[str] = field(default_factory=list)
    extra: Callable[[Page], dict[str, str]] = lambda page: {}


def hidden(node: Node) -> bool:
    """What static HTML tells of visibility: the hidden attribute, aria-hidden and inline styles."""
    style = node.get("style").replace(" ", "").lower()
    return "hidden" in node.attrs or node.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or bool(re.search(r"opacity:0(?:\.0+)?(?:;|$)", style))


# What a heading, a link and a piece of page furniture weigh against a character of text.
HEADING_WEIGHT, LINK_WEIGHT, FURNITURE_WEIGHT = 120, 5, 300


def root_score(node: Node) -> float:
    """Text and headings for, links and page furniture against."""
    count = lambda tags: sum(n.tag in tags for n in node.walk() if n is not node)
    return len(clean(node.text(UNWANTED_TAGS))) + HEADING_WEIGHT * count({"h1", "h2", "h3"}) - LINK_WEIGHT * count({"a"}) - FURNITURE_WEIGHT * count({"nav", "header", "footer"})


def best_root(page: Page, selectors: list[str]) -> Node | None:
    """The best-scored visible candidate with enough text, else the body."""
    found: list[Node] = []
    for s in selectors:
        found += [n for n in page.root.select(s) if n not in found and not hidden(n) and len(clean(n.text(UNWANTED_TAGS))) > ROOT_MIN]
    return max(found, key=root_score, default=page.root.first("body"))


def _first_text(page: Page, root: Node | None, selectors: list[str]) -> str:
    for s in selectors:
        for node in [*page.root.select(s), *(root.select(s) if root else ())]:
            if not hidden(node) and (text := clean(node.text())):
                return text
    return ""


def page_context(script: str, marker: str = "spClientSidePageContext") -> dict | None:
    """The JSON object after a marker in a script."""
    at = script.find(marker)
    start = script.find("{", at) if at >= 0 else -1
    if start < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(script, start)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _sharepoint_extra(page: Page) -> dict[str, str]:
    news = any(page.root.first(f"[data-automation-id='{i}']") for i in ("newsAuthor", "newsDate", "promotedNews"))
    out = {"page_type": "news" if news else "page"}
    for script in page.root.select("script"):
        item = (page_context(script.text()) or {}).get("item")
        about = clean(str(item.get("Description") or "")) if isinstance(item, dict) else ""
        if about:
            return out | {"description": about}
    return out


def _sharepoint_title(page: Page, root: Node | None) -> str:
    found = _first_text(page, root, ["[data-automation-id='pageTitle']", "[data-automation-id='TitleTextId']", "h1"])
    return found or re.sub(r"\s+-\s+SharePoint\s*$", "", page.document_title(), flags=re.I) or "SharePoint page"


def confluence_space(page: Page) -> str:
    m = re.search(r"/wiki/spaces/([^/]+)", page.path) or re.search(r"/(?:display|spaces)/([^/]+)", page.path)
    if m:
        return m[1]
    meta = page.root.first("meta[name='confluence-space-key']")
    if meta and clean(meta.get("content")):
        return clean(meta.get("content"))
    for a in page.root.select("#breadcrumbs a[href*='/spaces/'], #breadcrumbs a[href*='/display/'], .aui-nav a[href*='/spaces/'], .aui-nav a[href*='/display/']"):
        m = re.search(r"/(?:spaces|display)/([^/?#]+)", a.get("href"))
        if m:
            return m[1]
    return ""


def _confluence_title(page: Page, root: Node | None) -> str:
    found = _first_text(page, root, ["#title-text", "[data-testid='title-text']", ".pagetitle"]) or (_first_text(page, root, ["h1"]) if root else "")
    return found or re.sub(r"\s+-\s+[^-]+$", "", re.sub(r"\s+-\s+Confluence\s*$", "", page.document_title(), flags=re.I)) or "Confluence page"


# Selectors by which the two platforms mark their content, their furniture, authors and dates.
SHAREPOINT_PAGES = "[data-sp-feature-tag], [data-automation-id='Canvas'], #spPageCanvasContent"
SHAREPOINT_ROOTS = [
    "[data-automation-id='Canvas']",
    "[data-sp-feature-tag='PageCanvas']",
    "#spPageCanvasContent",
    ".CanvasComponent",
    "article",
    "main",
    "[role='main']",
]
SHAREPOINT_UNWANTED = "[data-automation-id='pageCommandBar'], [data-automation-id='SiteHeader'], [data-automation-id='SuiteNavWrapper'], .ms-CommandBar, .ms-Nav"
SHAREPOINT_AUTHORS = [
    "[data-automation-id='pageAuthor']",
    "[data-automation-id='newsAuthor']",
    "[data-automation-id='AuthorByline']",
    "[data-automation-id='authorByline']",
    "[data-automation-id='author']",
]
SHAREPOINT_DATES = [
    "[data-automation-id='pagePublishedDate']",
    "[data-automation-id='pageModifiedDate']",
    "[data-automation-id='newsDate']",
    "[data-automation-id='modifiedDate']",
]
CONFLUENCE_PAGES = "meta[name^='confluence-'], #com-atlassian-confluence"
CONFLUENCE_ROOTS = ["#main-content", ".wiki-content", "[data-testid='page-content']", "#content .view", ".ak-renderer-document"]
CONFLUENCE_UNWANTED = (
    "#navigation, #breadcrumb-section, .aui-header, #header, #footer, .page-metadata, #likes-and-labels-container, "
    "#comments-section, .recently-updated, #sidebar, [data-testid='page-header-actions'], .ak-editor-toolbar"
)
CONFLUENCE_AUTHORS = [".author", ".page-metadata .author a", "[data-testid='page-author']", "a[href*='/display/~']"]
CONFLUENCE_DATES = [".page-metadata time", "time.livesearch-time", "[data-testid='page-created-date']", ".last-modified"]


def _is_sharepoint(page: Page) -> bool:
    return page.host == "sharepoint.com" or page.host.endswith(".sharepoint.com") or page.root.first(SHAREPOINT_PAGES) is not None


def _is_confluence(page: Page) -> bool:
    return page.host.endswith(".atlassian.net") and page.path.startswith("/wiki") or page.root.first(CONFLUENCE_PAGES) is not None


def _confluence_extra(page: Page) -> dict[str, str]:
    space = confluence_space(page)
    return {"space": space} if space else {}


ADAPTERS = [
    Adapter("sharepoint", _is_sharepoint, SHAREPOINT_ROOTS, _sharepoint_title, SHAREPOINT_UNWANTED, SHAREPOINT_AUTHORS, SHAREPOINT_DATES, _sharepoint_extra),
    Adapter("confluence", _is_confluence, CONFLUENCE_ROOTS, _confluence_title, CONFLUENCE_UNWANTED, CONFLUENCE_AUTHORS, CONFLUENCE_DATES, _confluence_extra),
    Adapter("generic", lambda page: True),
]


#: The adapters of this package, which workers have too.
BUILT_IN = tuple(ADAPTERS)


def register_adapter(adapter: Adapter) -> None:
    """Adds an adapter before the generic one; ``capture_pages`` takes the registered ones to the workers."""
    ADAPTERS.insert(len(ADAPTERS) - 1, adapter)


def resolve_adapter(page: Page, adapters: list[Adapter] | None = None) -> Adapter:
    return next(a for a in adapters or ADAPTERS if a.match(page))


def clean_tree(root: Node, base: str, unwanted: str = "", drop_hidden: bool = True) -> Node:
    """Removes furniture in place, and makes addresses absolute or takes them away."""
    gone = [*root.select(CHROME), *(root.select(unwanted) if unwanted else ())]
    for n in [*gone, *[n for n in root.walk() if n is not root and (n.tag in UNWANTED_TAGS or drop_hidden and hidden(n))]]:
        n.remove()
    for n in list(root.walk()):
        if n.tag == "a" and "href" in n.attrs:
            href = n.get("href").strip()
            if not href or href.startswith("#") or href.lower().startswith("javascript:"):
                del n.attrs["href"]
            else:
                n.attrs["href"] = resolve(href, base)
        if n.tag == "img":
            candidates = [n.get("src"), n.get("data-src"), n.get("data-original"), n.get("srcset").split(",")[0].strip().split(" ")[0]]
            src = next((c.strip() for c in candidates if c.strip()), "")
            try:
                src = urljoin(base, src) if src else ""
            except ValueError:
                src = ""
            n.attrs["src"] = src
            if not src:
                n.remove()
    return root


_LIKELY, _UNLIKELY = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I), re.compile(r"ad-|advert|banner|breadcrumb|combx|comment|cookie|disqus|foot|header|menu|meta|modal|nav|pager|popup|promo|related|remark|rss|share|sidebar|social|sponsor|subscribe|tags|widget", re.I)


def find_article(page: Page) -> Node | None:
    """The container with the best score: paragraphs pass points for length and commas to the two above them, less for links."""
    scores: dict[int, tuple[Node, float]] = {}
    for p in page.root.select("p, pre, td, blockquote, li"):
        text = clean(p.text(UNWANTED_TAGS))
        if len(text) < 25 or p.closest({"nav", "header", "footer", "aside"}):
            continue
        points = 1 + text.count(",") + text.count("、") + min(len(text) // 100, 3)
        node, share = p.parent, 1.0
        for _ in range(2):
            if node is None or node.tag in ("html", "#document"):
                break
            if id(node) not in scores:
                hint = f"{node.get('class')} {node.get('id')}"
                weight = 25 * bool(_LIKELY.search(hint)) - 25 * bool(_UNLIKELY.search(hint)) + {"article": 10, "main": 10, "div": 5, "section": 5}.get(node.tag, 0)
                scores[id(node)] = (node, float(weight))
            scores[id(node)] = (node, scores[id(node)][1] + points * share)
            node, share = node.parent, share / 2
    ranked = sorted(((n, s * (1 - _link_share(n))) for n, s in scores.values()), key=lambda x: -x[1])
    if not ranked:
        return None
    best, top = ranked[0]
    kept = Node("div")
    for sibling in best.parent.elements() if best.parent else [best]:
        own = next((s for n, s in ranked if n is sibling), 0.0)
        text = clean(sibling.text(UNWANTED_TAGS))
        if sibling is best or own >= max(10, top * 0.2) or sibling.tag == "p" and len(text) > 80 and _link_share(sibling) < 0.25:
            kept.children.append(sibling)
    return kept


def _link_share(node: Node) -> float:
    total = len(clean(node.text(UNWANTED_TAGS)))
    return sum(len(clean(a.text())) for a in node.walk() if a.tag == "a") / total if total else 0.0


def meta_values(page: Page) -> dict[str, dict[str, str]]:
    """The page's meta values, read once: of each attribute that names them (name, property, itemprop) the first for a name that isn't blank."""
    out: dict[str, dict[str, str]] = {"name": {}, "property": {}, "itemprop": {}}
    for n in page.root.select("meta"):
        value = clean(n.get("content"))
        if value:
            for attr, values in out.items():
                if n.get(attr):
                    values.setdefault(n.get(attr), value)
    return out


def meta(page: Page, name: str) -> str:
    """A meta value by name, then property, then itemprop; the first that isn't blank."""
    if page.metas is None:
        page.metas = meta_values(page)
    return next((v for values in page.metas.values() if (v := values.get(name))), "")


def json_ld(page: Page) -> list:
    out = []
    for script in page.root.select("script[type='application/ld+json']"):
        try:
            out.append(json.loads(script.text() or "{}"))
        except ValueError:
            continue
    return out


def nested_value(value: object, keys: tuple[str, ...]) -> object:
    """The first truthy value of one of the keys, depth first."""
    if isinstance(value, list):
        return next((found for v in value if (found := nested_value(v, keys))), None)
    if not isinstance(value, dict):
        return None
    return next((value[k] for k in keys if value.get(k)), None) or next((found for v in value.values() if (found := nested_value(v, keys))), None)


def author_name(value: object) -> str:
    if isinstance(value, list):
        return next((n for v in value if (n := author_name(v))), "")
    if isinstance(value, dict):
        return clean(str(value.get("name") or value.get("givenName") or ""))
    return clean(value) if isinstance(value, str) else ""


_DATE = re.compile(r"\d{4}|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b.*\d|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}", re.I)


def _visible_date(page: Page, root: Node | None, selectors: list[str]) -> str:
    for s in selectors:
        for n in [*page.root.select(s), *(root.select(s) if root else ())]:
            text = clean(n.get("datetime") or n.get("content") or n.text())
            if not hidden(n) and _DATE.search(text):
                return text
    return ""


def metadata_of(page: Page, adapter: Adapter, root: Node | None) -> dict:
    ld = json_ld(page)
    text = lambda *names: next((v for n in names if (v := meta(page, n))), "")
    nested = lambda *keys: author_name(next((v for o in ld if (v := nested_value(o, keys))), ""))
    byline = re.sub(r"^by\s+", "", _first_text(page, root, [*adapter.author, "[rel='author']", "[itemprop='author']", ".byline", ".author"]), flags=re.I)
    published = text("article:published_time", "datePublished", "date", "dc.date", "DC.date.issued", "publish-date") or nested("datePublished", "dateCreated")
    modified = text("article:modified_time", "dateModified", "last-modified", "og:updated_time") or nested("dateModified")
    out = {
        "author": text("author", "article:author", "parsely-author", "creator", "DC.creator") or nested("author", "creator") or byline,
        "published": published,
        "modified": modified,
        "page_date": _visible_date(page, root, [*adapter.published, "time[datetime]", "[itemprop='datePublished']", ".date", ".published"]),
        "description": text("description", "og:description"),
        "twitter_description": meta(page, "twitter:description"),
        "site": meta(page, "og:site_name") or re.sub(r"^www\.", "", page.host),
        "tags": [t for t in map(clean, meta(page, "keywords").split(",")) if t][:12],
    }
    return out | adapter.extra(page)


def _flat(value: object) -> str:
    if isinstance(value, (str, int, float)) and not isinstance(value, bool):
        return clean(str(value))
    if isinstance(value, list):
        return ", ".join(f for f in map(_flat, value) if f)
    return clean(str(value.get("name") or value.get("@id") or "")) if isinstance(value, dict) else ""


def variables_of(page: Page, metadata: dict, title: str, content: str, captured_at: str, selectors: list[str]) -> dict[str, str]:
    """Template variables: fixed names, then meta:, schema: and selector: ones; the first writer wins."""
    get = lambda k: str(metadata.get(k) or "")
    out = {"title": title, "author": get("author"), "published": get("published"), "modified": get("modified"), "date": get("page_date") or get("published"), "description": get("description"), "site": get("site"), "url": page.url, "domain": page.host, "path": page.path, "captured": captured_at, "today": captured_at[:10], "time": captured_at[11:19], "content": content}
    for n in page.root.select("meta"):
        key, value = n.get("name") or n.get("property"), clean(n.get("content"))
        if key and value:
            out.setdefault(f"meta:{key}", value)
    for parsed in json_ld(page):
        for o in parsed if isinstance(parsed, list) else [parsed]:
            for key, value in o.items() if isinstance(o, dict) else ():
                if flat := _flat(value):
                    out.setdefault(f"schema:{key}", flat)
    for css in selectors:
        node = page.root.first(css)
        out[f"selector:{css}"] = clean(node.text()) if node else ""
    return out


def extract(html: str, url: str, mode: str = "auto", captured_at: str = "", selectors: list[str] | None = None, adapters: list[Adapter] | None = None, overrides: dict[str, Override] | None = None) -> dict:
    """The capture result of one page: title, url, mode, markdown, metadata, variables, stats.

    ``adapters`` stand in place of the registered ones, ``overrides`` convert elements by their tag. Modes: auto (the platform's, else article), article, full (the cleaned body), selection (a fragment as it is), or an
    adapter's id.
    """
    page = Page(parse(html), url)
    adapters = adapters or ADAPTERS
    adapter = resolve_adapter(page, adapters)
    mode = mode if mode in ("article", "full", "selection", *(a.id for a in adapters)) else "auto"
    used = adapter.id if mode == "auto" and adapter.id != "generic" else "article" if mode in ("auto", "generic") else mode
    # Metadata first: cleaning takes nodes out of the tree.
    root = best_root(page, adapter.roots) if adapter.roots else None
    title = adapter.title(page, root) or page.document_title() or "Untitled page"
    metadata = metadata_of(page, adapter, root)
    label, links = used, extract_links(page.root, url)
    values = variables_of(page, metadata, title, "", captured_at, selectors or [])
    body = page.root.first("body") or page.root
    if used == "selection":
        tree = page.root
    elif used == "article":
        found = find_article(page)
        tree = found if found is not None and len(clean(found.text(UNWANTED_TAGS))) > ARTICLE_MIN else body
        label = "article" if tree is found else "body"
    else:
        tree = root if used != "full" and root is not None else body
        label = tree.tag + (f".{tree.get('class').split()[0]}" if tree.get("class").split() else "")
    markdown = drop_lead_heading(Converter(url, overrides).convert(clean_tree(tree, url, adapter.unwanted) if used != "selection" else tree), title)
    values["content"] = markdown
    metadata |= {"captured_at": captured_at}
    return {"title": title, "url": url, "mode": used, "markdown": markdown, "metadata": metadata, "variables": values, "stats": {"characters": len(markdown), "root": label}, "links": links, "error": None}


def extract_links(root: Node, base: str) -> list[str]:
    """The distinct absolute http(s) addresses that a page links to, in order."""
    out: dict[str, None] = {}
    for a in root.walk():
        if a.tag == "a" and a.get("href").strip():
            href = resolve(a.get("href"), base)
            if re.match(r"https?://", href, re.I):
                out[href] = None
    return list(out)


def same_author_replies(html: str, handle: str, focal: str) -> list[str]:
    """Ids of the posts that one author wrote in a thread's page, without the first; never raises."""
    found = re.findall(rf"/{re.escape(handle)}/status/(\d+)", html or "", re.I) if handle else []
    return [i for i in dict.fromkeys(found) if i != focal]
