"""Dates, numbers and small text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrion.functions.text import js_trim, parse_moment


def iso_day(c: Column) -> Column:
    """ISO day of a moment; what can't be read stays, as a table cell; null is empty."""
    return F.coalesce(F.date_format(parse_moment(c), "yyyy-MM-dd"), escape_cell(c))


def iso_moment(c: Column) -> Column:
    """A timestamp as ISO text with milliseconds in UTC."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def escape_cell(c: Column) -> Column:
    """A Markdown table cell: pipes escaped, line ends to spaces."""
    return js_trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " "))


def escape_link_text(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("]"), F.lit("\\]"))


def heading_anchor(c: Column) -> Column:
    """Anchor of a heading, as code hosts make it."""
    return F.regexp_replace(js_trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9_\s-]", "")), r"\s+", "-")


def csv_cell(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def decode_entities(c: Column) -> Column:
    """The five XML entities and numeric references of ASCII signs; ``&amp;`` last, so nothing is decoded twice."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#34;", '"'), ("&nbsp;", " "), ("&#38;", "&amp;"), ("&#x26;", "&amp;"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def clamp(c: Column, low: float, high: float, fallback: float) -> Column:
    """Nearest value in the range; the fallback for null and what is no number."""
    number = c.try_cast("double")
    return F.least(F.greatest(F.when(number.isNull() | F.isnan(number), F.lit(float(fallback))).otherwise(number), F.lit(float(low))), F.lit(float(high)))


def format_clock(seconds: Column) -> Column:
    s = F.greatest(F.ceil(seconds), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def sync_due(frequency: Column, last_completed: Column, now: Column) -> Column:
    """Whether a weekly (7 days) or monthly (30 days) sync is due; what was never completed is due."""
    days = F.when(frequency == "weekly", 7).when(frequency == "monthly", 30)
    elapsed = F.unix_micros(now) - F.unix_micros(last_completed)
    return F.coalesce(days.isNotNull() & (last_completed.isNull() | (elapsed >= days * F.lit(86_400_000_000))), F.lit(False))


def reduction_needs_confirmation(before: Column, after: Column) -> Column:
    """Whether a shrunken inventory wants a second look: all gone, or a quarter of five or more."""
    return (before > 0) & ((after == 0) | ((before >= 5) & ((before - after) * 4 >= before)))


def progress(status: Column, captured: Column, failed: Column, queued: Column, max_pages: Column, elapsed_ms: Column) -> Column:
    """captured, failed, completed, total, percent and eta_ms of a job; a job that is done has nothing left."""
    done = captured + failed
    capped = F.when(max_pages > 0, F.least(done + queued, max_pages + failed)).otherwise(done + queued)
    total = F.when(status == "done", done).otherwise(F.greatest(done, capped))
    percent = F.when(total > 0, F.least(F.lit(100), F.floor(done * 100.0 / total + 0.5).cast("int"))).otherwise(0)
    eta = F.when((done > 0) & (total > done), F.floor(elapsed_ms * (total - done) / done + 0.5).cast("long"))
    return F.struct(captured.alias("captured"), failed.alias("failed"), done.alias("completed"), total.alias("total"), percent.alias("percent"), elapsed_ms.alias("elapsed_ms"), eta.alias("eta_ms"))
