"""Queries on the conversion and capture of HTML: each case of html_cases once for every collection, and their SQL with the expected values."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from papyrion.operators.capture import capture_pages
from papyrion.plans.html_cases import FRAGMENTS, FULL, PAGES
from papyrion.session import read_table

BASE, FULL_BASE = "https://base.test/d/", "https://full.test/p/"
FIELDS = ("title", "mode", "author", "published", "description", "site", "page_type", "space", "markdown")


@F.pandas_udf(StringType())
def to_markdown(html: pd.Series) -> pd.Series:
    from papyrion.html.markdown import html_to_markdown

    return pd.Series([html_to_markdown(h, BASE) for h in html], dtype="object")


def _cases(spark: SparkSession, d: str, cases: list[tuple[str, ...]], *names: str) -> DataFrame:
    """collection_id, case_name and the cases' texts with each collection's id in them; a collection given twice counts once."""
    at = lambda text: F.replace(F.lit(text), F.lit("@"), F.col("collection_id"))
    rows = F.array(*[F.struct(F.lit(c[0]).alias("case_name"), *[at(t).alias(n) for n, t in zip(names, c[1:], strict=False)]) for c in cases])
    ids = read_table(spark, d, "collections").select("collection_id").where("collection_id is not null").distinct()
    # Each group's few cases are spread before Python reads them.
    return ids.select("collection_id", F.explode(rows).alias("c")).select("collection_id", "c.*")


def _fragments(group: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _cases(spark, d, FRAGMENTS[group], "html").select("collection_id", "case_name", to_markdown("html").alias("markdown"))

    return query


def html_captures(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages in mode ``auto``: platform, title, metadata and Markdown."""
    pages = _cases(spark, d, PAGES, "url", "html")
    got = capture_pages(pages)
    return pages.select("collection_id", "case_name", "url").join(got, "url").select("collection_id", "case_name", "title", "mode", *[F.col(f"metadata.{f}").alias(f) for f in FIELDS[2:-1]], "markdown")


def html_full(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages in mode ``full``: what is cleaned away, and addresses."""
    pages = _cases(spark, d, FULL, "html").withColumn("url", F.concat(F.lit(FULL_BASE), F.lit("?"), F.col("collection_id"), F.lit("-"), F.replace("case_name", F.lit(" "), F.lit("-"))))
    got = capture_pages(pages, "full")
    return pages.select("collection_id", "case_name", "url").join(got, "url").select("collection_id", "case_name", "markdown")


def html_page_links(spark: SparkSession, d: str) -> DataFrame:
    """The addresses that a page of each collection links to, resolved, in order and once each."""
    rows = read_table(spark, d, "collections").where("collection_id is not null").dropDuplicates(["collection_id"])
    anchors = F.array_join(F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda u: F.concat(F.lit("<a href='"), u, F.lit("'>x</a>"))), " ")
    html = F.concat(F.lit("<nav><a href='/start'>s</a><a href='#top'>t</a><a href='mailto:a@b.test'>m</a></nav><p>"), anchors, F.lit("<a href='/start'>again</a></p>"))
    pages = rows.select("collection_id", F.concat(F.lit("https://links.test/"), F.col("collection_id")).alias("url"), html.alias("html"))
    got = capture_pages(pages).select("url", F.posexplode("links").alias("ord", "link"))
    return pages.select("collection_id", "url").join(got, "url").select("collection_id", "ord", "link")


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _expected(cases: list[tuple[str, ...]], names: tuple[str, ...]) -> str:
    """SQL that gives the expected values of each case for every collection."""
    values = ",\n  ".join("(" + ", ".join(_text(v) for v in c) + ")" for c in cases)
    columns = ", ".join(f"replace(k.{n}, '@', collection_id) AS {n}" for n in names)
    return f"WITH k(case_name, {', '.join(names)}) AS (VALUES {values}), c AS (SELECT DISTINCT collection_id FROM collections WHERE collection_id IS NOT NULL) SELECT collection_id, case_name, {columns} FROM c CROSS JOIN k"


QUERIES = {**{g: _fragments(g) for g in FRAGMENTS}, "html_captures": html_captures, "html_full": html_full, "html_page_links": html_page_links}
SQL = {
    **{g: _expected([(c, m) for c, _, m in cases], ("markdown",)) for g, cases in FRAGMENTS.items()},
    "html_captures": _expected([(c, *e) for c, _, _, e in PAGES], FIELDS),
    "html_full": _expected([(c, m) for c, _, m in FULL], ("markdown",)),
    "html_page_links": """WITH c AS (SELECT DISTINCT ON (collection_id) collection_id, list_prepend('https://links.test/start', list_filter(coalesce(urls, []), lambda u: regexp_matches(u, '(?i)^https?://'))) AS l FROM collections WHERE collection_id IS NOT NULL),
      d AS (SELECT collection_id, list_filter(l, lambda u, i: list_position(l, u) = i) AS l FROM c) SELECT collection_id, CAST(unnest(range(len(l))) AS INT) AS ord, unnest(l) AS link FROM d""",
}
