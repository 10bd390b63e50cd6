"""The template engine: ``{{name|filter:argument}}`` over a map of values."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SLOT = re.compile(r"\{\{\s*([^{}]*?)\s*\}\}")
DEFAULT_TEMPLATE = "# {{title}}\n\nSource: {{url}}\n\n{{content}}"
DEFAULT_FILENAME_TEMPLATE = "{{today}}-{{title|slug}}"


def slug(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ").lower()
    return re.sub(r"-+$", "", re.sub(r"[^a-z0-9]+", "-", re.sub(r"['\"]", "", text)).strip("-")[:80])


def format_date(value: str, form: str) -> str:
    """A moment in a form of YYYY, MM, DD, HH, mm and ss; what can't be read stays."""
    try:
        moment = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        return value
    moment = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)
    parts = {"YYYY": "%Y", "MM": "%m", "DD": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}
    return re.sub("YYYY|MM|DD|HH|mm|ss", lambda m: moment.strftime(parts[m[0]]), form or "YYYY-MM-DD")


def apply_filter(value: str, name: str, argument: str) -> str:
    match name:
        case "lower":
            return value.lower()
        case "upper":
            return value.upper()
        case "trim":
            return value.strip()
        case "slug":
            return slug(value)
        case "default":
            return value or argument
        case "replace":
            old, _, new = argument.partition(",")
            return value.replace(old, new) if old else value
        case "truncate":
            n = int(argument) if argument.strip().isdigit() else len(value)
            return value if len(value) <= n else value[:n] + "..."
        case "date":
            return format_date(value, argument)
    return value


def render(template: str, values: dict[str, str]) -> str:
    """The template with its slots filled; names without a value are empty."""

    def fill(m: re.Match) -> str:
        name, *filters = m[1].split("|")
        value = values.get(name.strip()) or ""
        for f in filters:
            kind, _, argument = f.partition(":")
            value = apply_filter(value, kind.strip(), argument)
        return value

    return _SLOT.sub(fill, template)


@F.pandas_udf(StringType())
def render_template(templates: pd.Series, values: pd.Series) -> pd.Series:
    """Each template over its map of values; null where the template is null."""
    return pd.Series([None if t is None else render(t, dict(v) if v is not None else {}) for t, v in zip(templates, values, strict=True)], dtype="object")


def selector_refs(*templates: Column) -> Column:
    """The distinct selectors that templates refer to, in order."""
    every = F.concat_ws("\n", *templates)
    return F.array_distinct(F.transform(F.regexp_extract_all(every, F.lit(r"\{\{\s*selector:([^|{}]+)"), F.lit(1)), F.trim))


def variable_listing(values: Column) -> Column:
    """The variables that have a value, as (key, value) in the order of their keys."""
    filled = F.filter(F.map_entries(values), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_sort(filled)


def register_functions(spark: SparkSession) -> None:
    """Makes the engine's functions known to SQL: render_template(template, variables), html_to_markdown(html), and the table functions markdown_links(text), text_urls(text) and workbook_cells(data)."""
    from papyrion.functions import tables

    spark.udf.register("render_template", render_template)
    spark.udf.register("html_to_markdown", tables.html_to_markdown)
    for name, function in (("markdown_links", tables.MarkdownLinks), ("text_urls", tables.TextUrls), ("workbook_cells", tables.WorkbookCells)):
        spark.udtf.register(name, function)
