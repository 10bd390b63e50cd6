"""Page boilerplate mixed with main content (problem 3).

A page's Markdown is read as a tree: the page, its regions, their blocks, the lines. Each line passes points for its
length and commas up to its region, discounted by the share of it that stands in links; a line that is no sentence, list
item, table row or quotation (a menu, a button, a title alone) passes little, and one that names what notices and footers
are about loses points, as badly named containers do in HTML. Regions begin at headings and rules, and where lines that
carry an article meet lines that don't. The best region and its siblings that score well enough are kept; of a weaker
sibling only what reads as an article's own part stays. A heading stays with what it stands over.

A line in full sentences may still be the site's and not the article's: a legal notice, an announcement. That no page
tells by itself, so lines are counted over the site's pages, and those that stand on many different ones go from wherever
they stand. The scan of a page gives the lines that are open to this as hashes; texts are read once and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm import grammars as G
from papyrion.llm import lines as L
from papyrion.llm.sitelines import site_of
from papyrion.session import materialize, read_table

#: Share of the best region's points that keeps a sibling, and the least points of a region that holds an article at all.
SIBLING_SHARE, LEAST = 0.2, 1.0
#: What a line passes on of its points if it is no part of running text, and what a notice loses.
STRAY_SHARE, PENALTY = 0.1, 25.0
#: A line of so many words is a sentence, even if its end is cut off; of less than twice as many it may be an announcement.
SENTENCE_WORDS, CJK_CHARACTERS = 8, 24
#: From this share in links on a line is a link, unless so many words describe it.
LINK_SHARE, DESCRIPTION_WORDS = 0.5, 3
#: A segment of a menu row has at most so many words and characters.
SEGMENT_WORDS, SEGMENT_CHARACTERS = 4, 40
#: So many characters at a line's end hold the end of its sentence with quotes, or a count.
ENDING, COUNTED = 8, 24
#: A site's line stands on so many different pages, and on this share of them.
SITE_PAGES, SITE_SHARE = 5, 0.02

_RULE = set("-*_ \t​")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_END = re.compile(r"[.!?:…。！？：][\"'”’»)\]*_`]*$")
_INNER_END = re.compile(r"[.!?…][\"'”’»)*_]* |[。！？]")
_BULLET = re.compile(r"^(?:[-*+•·]|\d+[.)])\s+(?:\[[ x]\]\s+)?")
_SEPARATORS = re.compile(r" ?[|·•›»] ?| > | / ")
_COUNT_ENDS = frozenset(")nнst分.w")
_COUNTED = re.compile(r"(?:[·|–-]\s*\d+\s*(?:min|мин|分|views?|comments?)\.?|\(\d+\))$")
_DIGITS = re.compile(r"\d+")

# Kinds of lines. The first group carries an article; the others don't.
SENTENCE, ITEM, ROW, QUOTE, DESCRIBED, CODE, RESIDUE = "sentence", "item", "row", "quote", "described", "code", "residue"
LINK, MENU, STRAY, NOTICE = "link", "menu", "stray", "notice"
HEADING, NOTHING = "heading", "nothing"
#: A sentence by its number of words alone: an announcement's, or a line of wrapped text.
UNFINISHED = "unfinished"
OWN = frozenset({SENTENCE, ITEM, ROW, QUOTE, DESCRIBED, CODE, RESIDUE})
#: Kinds that may prove to be the site's line; an article's headings, tables, lists and quotations don't.
OPEN = frozenset({SENTENCE, UNFINISHED, LINK, MENU, STRAY, NOTICE})


def _words(text: str) -> int:
    return len(L._WORD.findall(text))


def _ends(text: str) -> bool:
    """Whether a sentence ends with the line."""
    return _END.search(text[-ENDING:]) is not None


def _sentence(text: str) -> str:
    """SENTENCE, UNFINISHED or STRAY for running text."""
    if not text.isascii() and _CJK.search(text):
        return SENTENCE if _ends(text) or _INNER_END.search(text) else UNFINISHED if len(text) >= CJK_CHARACTERS else STRAY
    if text.count(" ") > 4 * SENTENCE_WORDS:
        return SENTENCE
    n = _words(text)
    if n >= 2 and _ends(text) or n >= 5 and _INNER_END.search(text):
        return SENTENCE
    return STRAY if n < SENTENCE_WORDS else UNFINISHED if n < 2 * SENTENCE_WORDS else SENTENCE


def _is_menu(text: str) -> bool:
    """Short segments in a row, with a sign between them."""
    if not ("|" in text or "·" in text or " > " in text or " / " in text or "•" in text or "›" in text or "»" in text):
        return False
    parts = _SEPARATORS.split(text)
    if len(parts) < 2 or len(parts) == 2 and " / " in text or max(map(len, parts)) > SEGMENT_CHARACTERS:
        return False
    return all(_words(p) <= SEGMENT_WORDS and not _ends(p) for p in parts)


def line_kind(row: str, folded: str) -> tuple[str, float]:
    """The kind of a line, given as it stands and folded, and the points it passes on."""
    if not L.has_text(folded):
        return NOTHING, 0.0
    sign = folded[0]
    if sign == "#" and L._HEADING.match(folded):
        return HEADING, 0.0
    if sign == "|" and folded.count("|") > 2:
        return ROW, 0.5
    # Residue is another problem's: it stands in an article's place, but makes none.
    if G.opens(row) and G.PLACEHOLDER.search(row) or L.residue_line(folded):
        return RESIDUE, 0.0
    text, links = folded, 0.0
    if "](" in folded:
        inside = sum(len(t) for t, _ in L._LINK.findall(folded))
        text = L.link_text(folded)
        links = inside / max(1, len(text))
    points = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - links)
    if not text.isascii():
        points += (text.count("、") + text.count("，")) * (1 - links)
    if sign == ">":
        return QUOTE, points
    if links >= LINK_SHARE and folded.startswith("!["):
        return ITEM, 0.5
    bullet = sign in L._BULLET_SIGNS and _BULLET.match(folded)
    bare = folded if text is folded and not bullet else folded[bullet.end() :] if bullet and not links else _BULLET.sub("", text)
    if links:
        rest = L._LINK.sub("", folded)
        if _words(rest) >= DESCRIPTION_WORDS or _CJK.search(rest) and len(rest) >= 10 or rest.rstrip().endswith(":"):
            return DESCRIBED, points
        if links >= LINK_SHARE:
            return LINK, points * STRAY_SHARE
    if L.boilerplate(bare):
        return STRAY, points * STRAY_SHARE - PENALTY
    if not bullet and L.notice(text):
        return NOTICE, points
    if bare[-1] in _COUNT_ENDS and _COUNTED.search(bare[-COUNTED:]) and not _INNER_END.search(bare):
        return LINK, points * STRAY_SHARE
    if _is_menu(bare):
        return MENU, points * STRAY_SHARE
    if bullet:
        return ITEM, points if _sentence(bare) is not STRAY or _words(bare) >= 5 else 0.5 * (1 - links)
    kind = _sentence(text)
    if kind is not STRAY:
        return kind, points
    bold = folded.startswith("**") and folded.endswith("**") and len(folded) > 4
    return (HEADING, 0.0) if bold and not links else (STRAY, points * STRAY_SHARE)


#: Rows that a worker remembers, since menus and footers repeat; beyond that it begins anew. Longer rows are judged each time.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 120
_known: dict[str, tuple[str, str, float]] = {}


def _judged(row: str) -> tuple[str, str, float]:
    """A row folded, its kind and points."""
    known = _known.get(row)
    if known is None:
        folded = L.fold_line(row)
        known = folded, *line_kind(row, folded)
        if len(row) <= REMEMBERED_LENGTH:
            if len(_known) >= REMEMBERED:
                _known.clear()
            _known[row] = known
    return known


@dataclass
class Region:
    """Lines that stand and fall together: their places in the page, kinds and points."""

    lines: list[int] = field(default_factory=list)
    own: bool = False
    heading: int | None = None
    points: float = 0.0


class Page:
    """The lines of one page's Markdown below a leading metadata block, and the regions they make."""

    def __init__(self, markdown: str, site: str | None = None) -> None:
        self.site = site
        self.numbers: list[int] = []
        self.texts: list[str] = []
        self.folded: list[str] = []
        self.kinds: list[str] = []
        self.points: list[float] = []
        #: Number of the block a line belongs to, and whether a rule stands before it.
        self.blocks: list[int] = []
        self.ruled: list[bool] = []
        self._read(markdown)
        self._mark_notices()
        self._join_wrapped()
        self.regions = self._regions()
        best = max((r.points for r in self.regions if r.own), default=0.0)
        #: Whether any region holds an article, and the points from which a region is kept.
        self.article = best >= LEAST
        self.least = max(best * SIBLING_SHARE, LEAST) if self.article else best * SIBLING_SHARE

    def _add(self, no: int, text: str, folded: str, kind: str, points: float, block: int, ruled: bool) -> None:
        self.numbers.append(no)
        self.texts.append(text)
        self.folded.append(folded)
        self.kinds.append(kind)
        self.points.append(points)
        self.blocks.append(block)
        self.ruled.append(ruled)

    def _read(self, markdown: str) -> None:
        rows = markdown.split("\n")
        skip = L.metadata_lines(rows)
        block, ruled, fence = 0, False, None
        for no in range(skip, len(rows)):
            row = rows[no]
            if row[-1:] == "\r":
                row = row[:-1]
            if fence is not None:
                self._add(no + 1, row, "", CODE, 1.0, block, False)
                if row.strip().startswith(fence) and row.strip().strip(fence[0]) == "":
                    fence = None
                    block += 1
                continue
            bare = row.strip()
            if not bare:
                block += 1
                continue
            if bare[0] in "-*_​" and len(bare) >= 3 and set(bare) <= _RULE:
                block += 1
                ruled = True
                continue
            mark = L._FENCE.match(row)
            if mark:
                fence = mark[1]
                self._add(no + 1, row, "", CODE, 1.0, block + 1, ruled)
            else:
                folded, kind, points = _judged(row)
                if kind is NOTHING:
                    continue
                if kind is LINK and self.site and _BULLET.match(folded) and "://" in folded and f"://{self.site}" not in folded:
                    # A list of links to other sites is the article's; menus and sidebars stay within the site.
                    kind = ITEM
                self._add(no + 1, row, folded, kind, points, block, ruled)
            ruled = False

    def _mark_notices(self) -> None:
        """A sentence with buttons right below it is a notice's."""
        for k in range(len(self.kinds) - 1):
            if self.kinds[k] is SENTENCE and self.blocks[k] == self.blocks[k + 1] and self.points[k + 1] < -1 and L.bare(self.folded[k + 1]) in L.BUTTONS:
                self.kinds[k] = NOTICE

    def _join_wrapped(self) -> None:
        """Unfinished sentences beside others in their block are wrapped text, if the page has blocks at all."""
        n = len(self.kinds)
        tight = n >= 8 and self.blocks[-1] - self.blocks[0] < n // 8 if n else False
        unfinished = [kind is UNFINISHED for kind in self.kinds]
        for k in range(n):
            if unfinished[k]:
                beside = [j for j in (k - 1, k + 1) if 0 <= j < n and self.blocks[j] == self.blocks[k]]
                if any(unfinished[j] or not tight and self.kinds[j] is SENTENCE for j in beside):
                    self.kinds[k] = SENTENCE

    def _regions(self) -> list[Region]:
        """Regions begin at headings and rules, where own lines meet others, and at notices."""
        regions: list[Region] = []
        region, before = Region(), None
        for k, kind in enumerate(self.kinds):
            if kind is HEADING:
                if region.lines or region.heading is not None:
                    regions.append(region)
                region, before = Region(heading=k), None
                continue
            group = OWN if kind in OWN else NOTICE if kind in (NOTICE, UNFINISHED) else STRAY
            if region.lines and (group is not before or self.ruled[k]):
                regions.append(region)
                region = Region()
            before = group
            region.own = group is OWN
            region.lines.append(k)
            region.points += self.points[k]
        if region.lines or region.heading is not None:
            regions.append(region)
        return regions

    def _title(self) -> int | None:
        """The page's title, if it isn't marked as a heading: the stray line alone in its block right before the first region that is kept."""
        if any(f.startswith("# ") for f, kind in zip(self.folded, self.kinds, strict=True) if kind is HEADING):
            return None
        for before, r in zip(self.regions, self.regions[1:], strict=False):
            if r.own and r.points >= self.least:
                k = before.lines[-1] if before.lines else None
                return k if k is not None and not before.own and self.kinds[k] is STRAY and self.points[k] > -1 else None
            if before.own and before.points >= self.least:
                return None
        return None

    def _heading_stays(self, k: int, keep: list[bool]) -> bool:
        """Whether region ``k``'s heading is the article's: it goes with links, menus or several stray lines that it stands over.

        One stray line below it, as a byline, says nothing; then what follows does.
        """
        heading = self.folded[self.regions[k].heading]
        if L.side_heading(heading):
            return False
        if heading.startswith("# "):
            return True
        for r in self.regions[k:]:
            if r is not self.regions[k] and (r.heading is not None or self.ruled[r.lines[0]] or L.side_heading(self.folded[r.lines[0]])):
                return True
            if any(keep[j] for j in r.lines):
                return True
            if len(r.lines) > 1 or any(self.kinds[j] is LINK for j in r.lines):
                return False
        return True

    def kept(self) -> list[bool]:
        """For each line whether the page itself tells that it is the article's."""
        keep = [False] * len(self.kinds)
        own = [k for r in self.regions if r.own and r.points >= LEAST for k in r.lines]
        first, last = (own[0], own[-1]) if own else (0, -1)
        bare = not any(r.own for r in self.regions)
        label = [points < -1 for points in self.points]
        for r in self.regions:
            for k in r.lines:
                kind = self.kinds[k]
                if r.own:
                    # Sentences, list items, rows and quotations of a weak sibling read as the article's own part.
                    keep[k] = True
                elif kind is UNFINISHED and not own:
                    keep[k] = True
                elif kind in (NOTICE, UNFINISHED):
                    # Between the article's parts, or where there are none, such a sentence is its own, unless buttons stand by it.
                    keep[k] = (first < k < last or bare) and not any(label[j] for j in (k - 1, k + 1) if 0 <= j < len(keep))
                elif not self.article:
                    keep[k] = kind is STRAY and not label[k]
                else:
                    keep[k] = r.points >= self.least
        title = self._title()
        if title is not None:
            keep[title] = True
        for k, r in enumerate(self.regions):
            if r.heading is not None:
                keep[r.heading] = self._heading_stays(k, keep)
        return keep


def furniture_lines(markdown: str, site: str | None = None) -> list[int]:
    """Numbers of the lines that the page itself tells aren't part of the article."""
    page = Page(markdown, site)
    return [no for no, keep in zip(page.numbers, page.kept(), strict=True) if not keep]


_LINES = "line_no long, same long, page long, gone boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of pages (id, site, text) that are furniture (``gone``) or open to be the site's.

    ``same`` is a hash of the line, ``page`` one of the page's longest line, by which copies of a page are told from
    different pages. Line 0 stands for the page itself.
    """
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        at: list[int] = []
        nos: list[int] = []
        sames: list[int] = []
        pages: list[int] = []
        gones: list[bool] = []
        for row, (site, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            if text is None:
                continue
            page = Page(text, site)
            mark = digest(max(page.folded, key=len, default=""))
            at.append(row)
            nos.append(0)
            sames.append(0)
            pages.append(mark)
            gones.append(False)
            for no, folded, kind, keep in zip(page.numbers, page.folded, page.kinds, page.kept(), strict=True):
                if not keep or kind in OPEN:
                    at.append(row)
                    nos.append(no)
                    # An announcement's numbers change from day to day; a whole sentence with other numbers is another one.
                    sames.append(digest(folded if kind is SENTENCE else _DIGITS.sub("0", folded)))
                    pages.append(mark)
                    gones.append(not keep)
        rows = pa.array(at, pa.int64())
        hashed = [pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (sames, pages)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(nos, pa.int64()), *hashed, pa.array(gones, pa.bool_())], names=["id", "site", "line_no", "same", "page", "gone"])


def furniture(pages: DataFrame, id_column: str, text_column: str, url_column: str | None = None) -> DataFrame:
    """id and line_no (from 1) of every line that isn't part of its page's article.

    ``url_column`` names the pages' addresses, whose hosts are the sites. Defined cases: null and empty texts give no rows;
    a page given twice gives its lines once; a page with a null or unreadable address, or without one, is judged by itself; lines without a letter or digit, code blocks and a leading metadata block are
    never named; texts are read whole at any length; other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    rows = pages.select(F.col(id_column).alias("id"), (site_of(F.col(url_column)) if url_column else F.lit(None).cast("string")).alias("site"), F.col(text_column).alias("text"))
    lines = materialize(rows.mapInArrow(_scan, f"id {rows.schema['id'].dataType.simpleString()}, site string, {_LINES}"))
    sited = lines.where("site is not null")
    # Copies of a page count once; both counts are summed up before they are shuffled.
    places = sited.groupBy("site", "same", "page").agg(F.max("line_no").alias("line_no"))
    counts = places.groupBy("site", "same").agg(F.count("*").alias("n"), F.max("line_no").alias("line_no"))
    sites = counts.where("line_no = 0").select("site", F.col("n").alias("n_site"))
    often = counts.where(f"line_no > 0 and n >= {SITE_PAGES}").join(sites, "site").where(F.col("n") * 1000 >= F.col("n_site") * round(SITE_SHARE * 1000)).select("site", "same")
    stock = sited.where("line_no > 0 and not gone").join(often, ["site", "same"], "left_semi")
    found = lines.where("gone").select("id", "line_no").unionByName(stock.select("id", "line_no"))
    return found.distinct().withColumnRenamed("id", id_column)


def main_bodies(pages: DataFrame, id_column: str, text_column: str, url_column: str | None = None) -> DataFrame:
    """id and body: every page's text without its furniture; null stays null. An id must stand for one text."""
    gone = furniture(pages, id_column, text_column, url_column).groupBy(id_column).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split(text_column, "\n"), lambda line, i: ~F.array_contains("_gone", (i + 1).cast("long")))
    body = F.when(F.col("_gone").isNull(), F.col(text_column)).otherwise(F.array_join(kept, "\n"))
    return pages.select(id_column, text_column).join(gone, id_column, "left").select(id_column, body.alias("body"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return furniture(read_table(spark, sf_dir, "captures"), "capture_id", "markdown", "url")


def p3_bodies(spark, sf_dir: str) -> DataFrame:
    return main_bodies(read_table(spark, sf_dir, "captures").select("capture_id", "url", "markdown").dropDuplicates(["capture_id"]), "capture_id", "markdown", "url")
