"""Template residue and error-page text (problem 6).

Placeholders are found by one grammar for each delimiter, in running text and headings only: code blocks and code spans
are taken out first, and a placeholder that the sentence around it quotes or explains is discounted. Filler, error
messages and notices about scripts are held against whole lines; they make a case only where no line of an article
stands beside them, so an article that mentions such a text is none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm import grammars as G
from papyrion.llm import lines as L
from papyrion.llm.body import CODE, HEADING, OWN, RESIDUE, Page
from papyrion.session import read_table

#: The form that this project fills: a name with optional prefix and filters.
OWN_FORM = re.compile(r"\{\{\s*[\w@][\w@.-]*(?::[^|{}\n]+)?\s*(?:\|[^{}\n]*)?\}\}")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_CODE_SPAN = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)")
_QUOTED = re.compile(r"[\"“„«»'‘’「]\s*$")
# Embedded data and other endless strings of signs are no text.
_NOISE = re.compile(r"\(?data:[^)\s]*\)?|[!-~]{200,}")
_DATA = re.compile(r"[!-~]{200,}|\(data:[^\n]*")
# Words right before a placeholder that explain it, and right after it.
EXPLAINED_BEFORE = re.compile(r"(?i)(?:\b(?:placeholders?|fields?|variables?|tokens?|syntax|notation|such as|for example|for instance|e\.g\.)[^.!?\w]*(?:\w+[^.!?\w]+)?|\b(?:write|writes|type|types|insert|called|named)[^.!?\w]+)$")
EXPLAINED_AFTER = re.compile(r"(?i)^[^.!?]{0,24}\b(?:is filled|are filled|is replaced|are replaced|gets filled|gets replaced|stands for|is a placeholder|are placeholders|is the placeholder)\b")
#: A page is a case in spite of quotes and explanations if so large a share of its words are placeholders.
DENSITY = 0.25
#: Lines longer than this are read sentence by sentence.
LONG_LINE = 200
_SENTENCE_END = re.compile(r"(?<!\be\.g)(?<!\bi\.e)(?<!\bz\.B)(?<!\bz\. B)(?<!\bp\.ej)(?<!\bp\. ej)[.!?…]+[\"'”’»)*_]*(?=\s)|[。！？]")


def placeholders(line: str) -> tuple[int, int]:
    """How many placeholders stand open in a line's running text, and how many are quoted or explained by the words beside them."""
    if not G.opens(line):
        return 0, 0
    text = _DATA.sub(" ", _CODE_SPAN.sub(" ", line))
    found = told = 0
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    for m in G.PLACEHOLDER.finditer(text):
        # The sentence around the match; signs within the match end none.
        before, after = bisect_right(ends, m.start()), bisect_left(ends, m.end())
        first, last = ends[before - 1] if before else 0, ends[after] if after < len(ends) else len(text)
        head = text[first : m.start()]
        if _QUOTED.search(head) or EXPLAINED_BEFORE.search(head) or EXPLAINED_AFTER.search(text[m.end() : last]):
            told += 1
        else:
            found += 1
    return found, told


def placeholder_page(lines: list[str]) -> bool:
    """Whether a placeholder stands open, or the quoted and explained ones are as dense as no article has them."""
    told = 0
    for line in lines:
        found, more = placeholders(line)
        if found:
            return True
        told += more
    if not told:
        return False
    rest = G.PLACEHOLDER.sub(" ", "\n".join(_DATA.sub(" ", _CODE_SPAN.sub(" w ", line)) for line in lines))
    words = len(L._WORD.findall(_CJK.sub(" ", rest))) + len(_CJK.findall(rest)) // 2
    return told >= DENSITY * (told + words)


def _article_line(folded: str) -> bool:
    """Whether a line that isn't residue says something: a sentence, a list item or a table row, but no heading or tag."""
    t = L.bare(folded)
    if L._HEADING.match(folded):
        return False
    if _CJK.search(t):
        return len(t) >= 10
    return len(L._WORD.findall(t)) >= 5 or folded.startswith("|") and folded.count("|") > 2


def _sentences(folded: str) -> Iterator[str]:
    start = 0
    for m in _SENTENCE_END.finditer(folded):
        yield folded[start : m.end()].strip()
        start = m.end()
    yield folded[start:].strip()


def _kinds(folded: str) -> Iterator[bool | None]:
    """Of a line or, if it is long, of each of its sentences: True for residue, False for an article's, None for what says nothing.

    Embedded data and unbroken noise are taken out first, so that they aren't read as text.
    """
    if len(folded) >= LONG_LINE:
        folded = L.fold_line(_NOISE.sub(" ", L.link_text(folded)))
    if len(folded) < LONG_LINE:
        yield True if L.residue_line(folded) else False if L.has_text(folded) and _article_line(folded) else None
    elif L.latin_filler(folded):
        yield True
    else:
        for part in _sentences(folded):
            if L.has_text(part):
                yield True if L.residue_line(part) or L.residue_line(part.rstrip(".!?…。！？")) else False if _article_line(part) else None


def _holds_residue(folded: str, kind: str) -> bool:
    """Whether a line may be residue: a long one is so only up to its first sentence that is an article's."""
    if kind is RESIDUE or kind is HEADING and L.residue_line(folded):
        return True
    return len(folded) >= LONG_LINE and next((k for k in _kinds(folded) if k is not None), False)


def judge_page(markdown: str) -> str | None:
    """``placeholder``, ``residue`` or None for a page's Markdown.

    Residue stands in an article's place: of the lines that the page's tree keeps, none is an article's beside it.
    """
    if not markdown or not markdown.strip():
        return None
    page = Page(markdown)
    texts = [(t, f, kind) for t, f, kind in zip(page.texts, page.folded, page.kinds, strict=True) if kind is not CODE]
    if placeholder_page([t for t, _, _ in texts]):
        return "placeholder"
    # One line of residue at least; only then is the rest worth a look.
    if not any(_holds_residue(f, kind) for _, f, kind in texts):
        return None
    if page.kinds.count(CODE) > 1:
        return None
    residue = 0
    for folded, kind, keep in zip(page.folded, page.kinds, page.kept(), strict=True):
        if keep and (kind in OWN or kind is HEADING):
            for k in _kinds(folded):
                if k is False and kind in OWN:
                    return None
                residue += k is True
    return "residue" if residue else None


def judge_template(template: str) -> str | None:
    """``placeholder``, ``residue`` or None for a note template: residue first, and at most two lines of a layout after it."""
    if not template or not template.strip():
        return None
    rows = [r.strip() for r in re.split(r"\r\n?|\n", template) if r.strip()]
    if G.PLACEHOLDER.search(OWN_FORM.sub(" ", "\n".join(rows))):
        return "placeholder"
    marks = [L.residue_line(L.fold_line(r)) for r in rows]
    return "residue" if marks[0] and marks.count(False) <= 2 else None


def judge(records: DataFrame, id_column: str, text_column: str, rule: Callable[[str], str | None]) -> DataFrame:
    """record_id and kind of the records that are cases by ``rule``.

    Defined cases: null, empty and blank texts are no cases; a null id and repeated rows stay as they are; texts are read
    whole at any length; other columns are ignored, whatever their names; an empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, kind) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and (kind := rule(t))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], b.schema.field(0).type), pa.array([k for _, k in found], pa.string())], names=["record_id", "kind"])

    rows = records.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(scan, f"record_id {rows.schema['id'].dataType.simpleString()}, kind string")


def p6_cases(spark, sf_dir: str) -> DataFrame:
    """record_set, record_id and kind of every case."""
    pages = judge(read_table(spark, sf_dir, "captures"), "capture_id", "markdown", judge_page)
    profiles = judge(read_table(spark, sf_dir, "setting_profiles"), "profile_id", "template", judge_template)
    return pages.select(F.lit("captures").alias("record_set"), "*").unionByName(profiles.select(F.lit("setting_profiles").alias("record_set"), "*")).distinct()


def p6_found(spark, sf_dir: str) -> DataFrame:
    return p6_cases(spark, sf_dir).select("record_set", "record_id").distinct()
