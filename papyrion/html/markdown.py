"""HTML to Markdown: a walk over the tree with the engine's own rules for tables, grids, frames and code."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from papyrion.html.tree import BLOCK, Node, clean, parse

REMOVED = frozenset({"script", "style", "noscript", "svg"})
_HEADINGS = {f"h{n}": n for n in range(1, 7)}
_ESCAPES = re.compile(r"([\\`*_\[\]])")
_LINE_START = re.compile(r"^(\s*)([-+>#]|\d+\.)(?=\s|$)", re.M)
# Elements that make a headerless table a layout when they stand in a cell.
CELL_BLOCKS = frozenset({"form", "div", "ul", "ol", "pre", "hr", "h1", "h2", "h3", "h4", "h5", "h6"})


@dataclass(frozen=True)
class Style:
    """The marks that a converter writes."""

    rule: str = "---"
    bullet: str = "-"
    emphasis: str = "*"
    strong: str = "**"
    fence: str = "`"


def resolve(url: str, base: str | None) -> str:
    """An address against the page's; what has a scheme and mere fragments stay."""
    url = url.strip()
    if not base or not url or url.startswith("#") or re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", url):
        return url
    try:
        return urljoin(base, url)
    except ValueError:
        return url


def normalize(text: str) -> str:
    """Line ends to LF, NBSP to space, no blanks at line ends, at most one blank line, trimmed."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    text = re.sub(r"[ \t]+$", "", text, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def is_data_table(table: Node) -> bool:
    """Whether a table holds data; layout tables are unwrapped."""
    if table.get("role").lower() in ("presentation", "none"):
        return False
    own = [n for n in table.walk() if n is not table and n.closest({"table"}) is table]
    if any(n.tag in ("th", "thead", "caption") for n in own):
        return True
    if any(n.tag == "table" for n in table.walk() if n is not table) or table.closest({"table"}) is not None:
        return False
    rows = _rows(table)
    if len(rows) < 2 or max((len(_cells(r)) for r in rows), default=0) < 2:
        return False
    return not any(n.tag in CELL_BLOCKS for r in rows for c in _cells(r) for n in c.walk() if n is not c)


def _rows(table: Node) -> list[Node]:
    return [n for n in table.walk() if n.tag == "tr" and n.closest({"table"}) is table]


def _cells(row: Node) -> list[Node]:
    return [c for c in row.elements() if c.tag in ("td", "th")]


#: Converts an element, given its Markdown inside; None leaves it to the converter's own rule.
Override = Callable[[Node, str], str | None]


class Converter:
    """Converts one tree; ``base`` resolves relative addresses, ``overrides`` (by tag) come before the own rules."""

    def __init__(self, base: str | None = None, overrides: dict[str, Override] | None = None, style: Style = Style()) -> None:  # noqa: B008 - it is frozen
        self.base, self.overrides, self.style = base, overrides or {}, style

    def convert(self, root: Node) -> str:
        return normalize(self.blocks(root))

    # Blocks.

    def blocks(self, node: Node) -> str:
        """The children as blocks with blank lines between; runs of inline content are paragraphs."""
        out: list[str] = []
        run: list[Node | str] = []

        def flush() -> None:
            if run:
                text = self.inline_run(run)
                if text.strip():
                    out.append(text)
                run.clear()

        for child in node.children:
            if isinstance(child, Node) and self.is_block(child):
                flush()
                text = self.block(child)
                if text.strip("\n"):
                    out.append(text.strip("\n"))
            else:
                run.append(child)
        flush()
        return "\n\n".join(out)

    def is_block(self, node: Node) -> bool:
        return node.tag in BLOCK or node.get("role") in ("grid", "table") or (node.tag not in REMOVED and any(self.is_block(c) for c in node.elements()))

    def block(self, node: Node) -> str:
        tag = node.tag
        if tag in self.overrides and (text := self.overrides[tag](node, self.blocks(node))) is not None:
            return text
        if tag in REMOVED:
            return ""
        if node.get("role") in ("grid", "table") and tag != "table":
            grid = self.grid(node)
            return grid if grid is not None else self.blocks(node)
        if tag in _HEADINGS:
            text = self.inline(node).replace("\n", " ").strip()
            return f"{'#' * _HEADINGS[tag]} {text}" if text else ""
        match tag:
            case "hr":
                return self.style.rule
            case "blockquote":
                inner = self.blocks(node).strip()
                return "\n".join(f"> {line}".rstrip() if line else ">" for line in inner.split("\n")) if inner else ""
            case "ul" | "ol" | "menu":
                return self.list(node)
            case "pre":
                return self.pre(node)
            case "table":
                return self.table(node)
            case "figcaption":
                text = self.inline(node).strip()
                return f"*{text}*" if text else ""
            case "dt":
                text = self.inline(node).strip()
                return f"**{text}**" if text else ""
            case "dd":
                text = self.blocks(node).strip()
                return f": {text}" if text else ""
        return self.blocks(node)

    def list(self, node: Node) -> str:
        items = [c for c in node.elements() if c.tag == "li"]
        start = int(node.get("start")) if node.get("start").isdigit() else 1
        out = []
        for k, item in enumerate(items):
            marker = f"{start + k}.  " if node.tag == "ol" else f"{self.style.bullet}   "
            body = self.blocks(item).strip()
            # A nested list follows its text without a blank line.
            body = re.sub(rf"\n\n(?=(?:{re.escape(self.style.bullet)}   |\d+\.  ))", "\n", body)
            lines = body.split("\n")
            out.append(marker + ("\n" + " " * 4).join(lines).replace("\n    \n", "\n\n"))
        for child in node.elements():
            if child.tag != "li":
                text = self.block(child) if self.is_block(child) else self.inline_run([child])
                if text.strip():
                    out.append("    " + text.replace("\n", "\n    "))
        return "\n".join(o.rstrip() for o in out)

    def pre(self, node: Node) -> str:
        code = node.first("code")
        text = (code or node).text(frozenset({"script", "style"})).rstrip("\n")
        if not text.strip():
            return ""
        language = re.search(r"(?:language|lang)-([\w+#-]+)", (code or node).get("class"))
        longest = max((len(m[0]) for m in re.finditer(f"^{re.escape(self.style.fence)}{{3,}}", text, re.M)), default=2)
        fence = self.style.fence * max(3, longest + 1)
        return f"{fence}{language[1] if language else ''}\n{text.lstrip(chr(10))}\n{fence}"

    def grid(self, node: Node) -> str | None:
        """An ARIA grid as a table; None where it has no row of data."""
        rows = []
        for r in node.walk():
            if r.get("role") == "row":
                cells = [c for c in r.walk() if c is not r and c.get("role") in ("columnheader", "rowheader", "gridcell", "cell")]
                texts = [clean(self.inline(c)).replace("|", "\\|") for c in cells]
                if any(texts):
                    rows.append((any(c.get("role") == "columnheader" for c in cells), texts))
        if len(rows) < 2:
            return None
        head = next((k for k, (is_head, _) in enumerate(rows) if is_head), 0)
        width = max(len(t) for _, t in rows)
        line = lambda t: "| " + " | ".join([*t, *[""] * (width - len(t))]) + " |"
        body = [t for k, (_, t) in enumerate(rows) if k != head]
        return "\n".join([line(rows[head][1]), "| " + " | ".join(["---"] * width) + " |", *map(line, body)])

    def table(self, node: Node) -> str:
        rows = _rows(node)
        if not is_data_table(node):
            return "\n\n".join(x for x in (self.layout_row(r) for r in rows) if x.strip())
        if any((c.get("colspan") or "1") not in ("", "1") or (c.get("rowspan") or "1") not in ("", "1") for r in rows for c in _cells(r)):
            for n in list(node.walk()):
                if n.tag in REMOVED:
                    n.remove()
            return node.html()
        caption = next((n for n in node.elements() if n.tag == "caption"), None)
        texts = [[self.cell(c) for c in _cells(r)] for r in rows]
        width = max((len(t) for t in texts), default=0)
        if not width:
            return ""
        head = next((k for k, r in enumerate(rows) if any(c.tag == "th" for c in _cells(r))), 0)
        out = [clean(self.inline(caption)) + "\n"] if caption is not None and caption.text().strip() else []
        for k, t in enumerate(texts):
            out.append("| " + " | ".join([*t, *[""] * (width - len(t))]) + " |")
            if k == head:
                out.append("| " + " | ".join(["---"] * width) + " |")
        return "\n".join(out)

    def cell(self, node: Node) -> str:
        return clean(re.sub(r"\s*\n\s*", " ", self.blocks(node))).replace("|", "\\|")

    def layout_row(self, row: Node) -> str:
        """A layout row: cells of inline content stand on one line, a cell that holds a block is a block."""
        out: list[str] = []
        joins = False
        for c in _cells(row):
            inline = not any(self.is_block(x) for x in c.elements())
            # A cell's text begins no line of its own, so nothing in it is escaped as a line's start.
            text = (self.unescaped_start(self.inline(c)) if inline else self.blocks(c)).strip()
            if not text:
                continue
            if inline and joins:
                out[-1] += " " + text
            else:
                out.append(text)
            joins = inline
        return "\n\n".join(out)

    def unescaped_start(self, text: str) -> str:
        return re.sub(r"^\\([-+>#])(?=\s|$)|^(\d+)\\\.(?=\s|$)", lambda m: m[1] or f"{m[2]}.", text)

    # Inline content.

    def inline(self, node: Node) -> str:
        return self.inline_run(node.children)

    def inline_run(self, children: list[Node | str]) -> str:
        text = "".join(self.text(c) if isinstance(c, str) else self.span(c) for c in children)
        text = re.sub(r" *\x00 *", "  \n", text.strip(" \x00"))
        return re.sub(r"(?<!\n)(?<! ) {2,}(?!\n)", " ", text).strip("\n ")

    def text(self, value: str) -> str:
        value = re.sub(r"[ \t\r\n\f]+", " ", value)
        return _LINE_START.sub(lambda m: m[1] + (m[2][:-1] + "\\." if m[2][0].isdigit() else "\\" + m[2]), _ESCAPES.sub(r"\\\1", value))

    def span(self, node: Node) -> str:
        tag = node.tag
        if tag in self.overrides and (text := self.overrides[tag](node, self.inline_run_raw(node))) is not None:
            return text
        if tag in REMOVED:
            return ""
        if tag == "br":
            return "\x00"
        if tag == "img":
            src, alt = resolve(node.get("src"), self.base), clean(node.get("alt"))
            return f"![{alt}]({src}{self.titled(node)})" if src else ""
        if tag == "iframe":
            src = node.get("src").strip()
            return f"[Embedded: {clean(node.get('title')) or urlsplit(src).hostname or 'frame'}]({src})" if re.match(r"https?://", src, re.I) else ""
        if tag == "input":
            return ("[x] " if "checked" in node.attrs else "[ ] ") if node.get("type") == "checkbox" else ""
        if tag == "code" or tag in ("kbd", "samp", "tt"):
            text = clean(node.text())
            ticks = "`" * (max((len(m[0]) for m in re.finditer("`+", text)), default=0) + 1)
            pad = " " if "`" in text else ""
            return f"{ticks}{pad}{text}{pad}{ticks}" if text else ""
        inner = self.inline_run_raw(node)
        if tag == "a":
            href = resolve(node.get("href"), self.base)
            if not href:
                return inner
            has_text = bool(clean(node.text(frozenset({*REMOVED}))))
            has_image = any(n.tag == "img" and n.get("alt").strip() for n in node.walk())
            return f"[{clean(inner) if not has_image else inner.strip()}]({href}{self.titled(node)})" if has_text or has_image else ""
        mark = {"em": self.style.emphasis, "i": self.style.emphasis, "strong": self.style.strong, "b": self.style.strong, "del": "~~", "s": "~~", "strike": "~~", "mark": "=="}.get(tag)
        if mark and inner.strip():
            lead, trail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            return f"{lead}{mark}{inner.strip()}{mark}{trail}"
        return inner

    def inline_run_raw(self, node: Node) -> str:
        return "".join(self.text(c) if isinstance(c, str) else self.span(c) for c in node.children)

    def titled(self, node: Node) -> str:
        title = clean(node.get("title")).replace('"', '\\"')
        return f' "{title}"' if title else ""


def html_to_markdown(html: str | None, base: str | None = None, overrides: dict[str, Override] | None = None, style: Style = Style()) -> str:  # noqa: B008 - it is frozen
    """A fragment's Markdown; null and empty give an empty text."""
    return Converter(base, overrides, style).convert(parse(html)) if html else ""


def drop_lead_heading(markdown: str, title: str) -> str:
    """Without the first heading if it repeats the title; blank lines, images and rules may stand before it."""
    rows = markdown.split("\n")
    for k, row in enumerate(rows):
        t = row.strip()
        if not t or t.startswith("![") or re.fullmatch(r"-{3,}|\*{3,}|_{3,}|(?:\* ?){3,}", t):
            continue
        m = re.match(r"#{1,6}\s+(.*)$", t)
        if m and title and clean(m[1]).lower() == clean(title).lower():
            return "\n".join([*rows[:k], *rows[k + 1 :]]).strip("\n")
        break
    return markdown
