"""Addresses from text, tables and discovery files, as DataFrames of (source, url, ord)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions.scalars import decode_entities
from papyrion.functions.text import js_trim
from papyrion.session import materialize

#: Pages that one discovery gives at most.
SITEMAP_PAGES, LLMS_PAGES, REST_ITEMS, REST_REQUESTS, REST_PAGE = 200, 500, 2000, 25, 100
_ANY_URL = r"(?i)https?://[^\s<>\"']+"


def url_list(text: Column) -> Column:
    """The distinct http(s) lines of a text, in order."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n?|\n"), js_trim)
    return F.array_distinct(F.filter(lines, lambda u: u.rlike(r"(?i)^https?://")))


def urls_in_text(text: Column) -> Column:
    """All distinct addresses in free text, without punctuation at their ends."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ANY_URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[),.;]+$", "")))


def markdown_urls(text: Column) -> Column:
    """Link targets and bare addresses of an llms.txt or other Markdown, unresolved."""
    links = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[[^\]]*\]\(([^\s)]+)(?:\s+[\"'][^\"']*[\"'])?\)"), F.lit(1))
    return F.array_distinct(F.concat(links, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)https?://[^\s<>\"')\]]+"), F.lit(0))))


def sitemap_locations(xml: Column) -> Column:
    """pages and sitemaps of a sitemap's text."""
    found = F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1)), decode_entities)
    index = F.coalesce(xml, F.lit("")).rlike(r"(?i)<sitemapindex")
    none = F.array().cast("array<string>")
    return F.struct(F.when(index, none).otherwise(found).alias("pages"), F.when(index, found).otherwise(none).alias("sitemaps"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of text files, one a line."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.posexplode(url_list(F.col("value"))).alias("ord", "url"))


def read_text_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.posexplode(urls_in_text(F.col("value"))).alias("ord", "url"))


def read_csv_urls(spark: SparkSession, path: str) -> DataFrame:
    """Addresses in any cell of CSV files; cells are scanned as text, so quoting and line breaks in cells don't matter."""
    rows = spark.read.option("multiLine", True).option("escape", '"').option("header", False).csv(path)
    cells = F.concat_ws("\n", *[F.col(c) for c in rows.columns])
    return rows.select(F.input_file_name().alias("source"), F.posexplode(urls_in_text(cells)).alias("ord", "url")).dropDuplicates(["source", "url"])


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_cells(data: bytes) -> list[str]:
    """All texts and link targets of a workbook: shared and inline strings, and its relations."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        for name in sorted(n for n in names if re.match(r"xl/worksheets/[^/]+\.xml$", n)):
            for cell in ElementTree.fromstring(book.read(name)).iter(f"{_SHEET}c"):
                value = cell.find(f"{_SHEET}v")
                if cell.get("t") == "s" and value is not None and (value.text or "").isdigit() and int(value.text) < len(shared):
                    out.append(shared[int(value.text)])
                else:
                    out += [t.text or "" for t in cell.iter(f"{_SHEET}t")] or ([value.text or ""] if value is not None else [])
        for name in sorted(n for n in names if n.startswith("xl/worksheets/_rels/")):
            out += [r.get("Target", "") for r in ElementTree.fromstring(book.read(name)) if r.get("TargetMode") == "External"]
    return out


def read_xlsx_urls(spark: SparkSession, path: str) -> DataFrame:
    """Addresses in any cell or link of workbooks; a file that is no workbook gives none."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source, data in zip(b["path"], b["content"], strict=True):
                try:
                    cells = xlsx_cells(data)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    cells = []
                rows.append((source, "\n".join(cells)))
            yield pd.DataFrame(rows, columns=["source", "value"])

    cells = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, "source string, value string")
    return cells.select("source", F.posexplode(urls_in_text(F.col("value"))).alias("ord", "url"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a file by its name: workbook, CSV, or text."""
    lower = path.lower()
    return (read_xlsx_urls if lower.endswith(".xlsx") else read_csv_urls if lower.endswith(".csv") else read_text_urls)(spark, path)


def sitemap_pages(start: DataFrame, fetched: DataFrame, max_pages: int | None = SITEMAP_PAGES) -> DataFrame:
    """Pages of sitemaps and of all sitemaps they name, over stored bodies: url and ord.

    ``start`` has url; ``fetched`` url and body. Each sitemap is read once, whatever cycle names it. At most
    ``max_pages``, in order of discovery.
    """
    found = fetched.select("url", sitemap_locations(F.col("body")).alias("at"))
    # A sitemap's place is the path of places that leads to it, which sorts as it was found, however deep the tree.
    level = materialize(start.select("url", F.array(F.lit(0)).alias("ord")).dropDuplicates(["url"]))
    seen, pages, depth = level.select("url"), None, 0
    while not level.isEmpty():
        hit = materialize(level.join(found, "url"))
        new = hit.select(F.lit(depth).alias("depth"), "ord", F.posexplode("at.pages").alias("pos", "page"))
        pages = new if pages is None else pages.unionByName(new)
        following = hit.select("ord", F.posexplode("at.sitemaps").alias("pos", "url")).groupBy("url").agg(F.min(F.concat("ord", F.array("pos"))).alias("ord")).join(seen, "url", "left_anti")
        level = materialize(following.select("url", "ord"))
        seen = materialize(seen.unionByName(level.select("url")))
        depth += 1
    if pages is None:
        pages = level.select(F.lit(0).alias("depth"), "ord", F.lit(0).alias("pos"), F.col("url").alias("page"))
    out = pages.groupBy("page").agg(F.min(F.struct("depth", "ord", "pos")).alias("ord")).select(F.col("page").alias("url"), "ord").orderBy("ord")
    return out.limit(max_pages) if max_pages is not None else out


def llms_pages(files: DataFrame, max_pages: int | None = LLMS_PAGES) -> DataFrame:
    """source, url and ord of llms.txt files (url, body): links resolved against the file's own address, once each."""

    @F.pandas_udf("array<string>")
    def absolute(urls: pd.Series, base: pd.Series) -> pd.Series:
        def resolve(found: list, b: str) -> list:
            out = []
            for u in found:
                try:
                    out.append(urljoin(b or "", u))
                except ValueError:
                    continue
            return [u for u in dict.fromkeys(out) if re.match(r"https?://", u, re.I)]

        return pd.Series([resolve(u, b) if u is not None else [] for u, b in zip(urls, base, strict=True)])

    found = absolute(markdown_urls(F.col("body")), F.col("url"))
    return files.select(F.col("url").alias("source"), F.posexplode(F.slice(found, 1, max_pages) if max_pages is not None else found).alias("ord", "url"))


def rest_pages(answers: DataFrame, max_items: int = REST_ITEMS) -> DataFrame:
    """Inventory pages of stored answers (collection_id, request_no, body) of the REST list: both envelopes, in order."""
    item = "struct<Id:int,Title:string,FileRef:string,GUID:string,Modified:string,FileLeafRef:string>"
    body = F.from_json("body", f"struct<value:array<{item}>,d:struct<results:array<{item}>>>")
    rows = answers.where(F.col("request_no") < REST_REQUESTS).select("collection_id", "request_no", F.posexplode(F.coalesce(body["value"], body["d"]["results"])).alias("pos", "i"))
    rows = rows.where(F.col("i").isNotNull() & (F.col("request_no") * REST_PAGE + F.col("pos") < max_items))
    title = F.coalesce(F.nullif("i.Title", F.lit("")), F.nullif("i.FileLeafRef", F.lit("")), F.lit(""))
    return rows.select("collection_id", F.struct(F.col("i.Id").alias("id"), title.alias("title"), F.col("i.FileRef").alias("file_ref"), F.col("i.GUID").alias("guid"), F.col("i.Modified").alias("modified"), F.lit(None).cast("string").alias("url")).alias("page"), (F.col("request_no") * REST_PAGE + F.col("pos")).alias("ord"))


def rest_query(api_base: str, skip: int = 0) -> str:
    """The address of one page of the REST list."""
    return f"{api_base}/web/lists/GetByTitle('Site%20Pages')/items?$select=Id,Title,FileRef,GUID,Modified,FileLeafRef&$orderby=Id&$top={REST_PAGE}" + (f"&$skiptoken=Paged=TRUE%26p_ID={skip}" if skip else "")


def discover(llms: DataFrame, sitemap: DataFrame) -> tuple[str, DataFrame]:
    """The first source that names pages: ``llms``, ``sitemap``, or ``crawl`` with none."""
    for name, found in (("llms", llms), ("sitemap", sitemap)):
        if not found.isEmpty():
            return name, found
    return "crawl", llms
