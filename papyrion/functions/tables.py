"""Functions for SQL that Spark has no expression for: HTML to Markdown, and table functions of links, addresses and workbook cells."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_LINK = re.compile(r"(?<!!)\[([^\]\n]*)\]\(([^\s)]+)[^)\n]*\)")
_URL = re.compile(r"https?://[^\s<>\"']+", re.I)


@F.pandas_udf(StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    """Each fragment's Markdown; null gives an empty text."""
    from papyrion.html.markdown import html_to_markdown as convert

    return pd.Series([convert(h) for h in html], dtype="object")


@F.udtf(returnType="ord int, text string, url string")
class MarkdownLinks:
    """The links of a Markdown text, in order: ord (from 0), text and url; null gives none."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        for k, m in enumerate(_LINK.finditer(text or "")):
            yield k, m[1], m[2]


@F.udtf(returnType="ord int, url string")
class TextUrls:
    """The distinct http(s) addresses in free text, in order, without punctuation at their ends; null gives none."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate(dict.fromkeys(re.sub(r"[),.;]+$", "", u) for u in _URL.findall(text or "")))


@F.udtf(returnType="ord int, value string")
class WorkbookCells:
    """All texts and link targets of a workbook's bytes; what is no workbook gives none."""

    def eval(self, data: bytes | None) -> Iterator[tuple[int, str]]:
        from papyrion.sources.lists import xlsx_cells

        try:
            yield from enumerate(xlsx_cells(bytes(data)) if data is not None else [])
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
            return
