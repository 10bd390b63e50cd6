"""Tag rules: which tags a document gets from rules on its address, title and text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions.text import js_trim


@dataclass(frozen=True)
class TagRule:
    """A rule on one scope (domain, url, title, text, or any of url, title and text): its pattern and its tags."""

    scope: str
    pattern: str
    is_regex: bool = False
    tags: tuple[str, ...] = ()


def valid_patterns(spark: SparkSession, patterns: Sequence[str]) -> tuple[list[str], list[str]]:
    """The patterns that can be compiled, and those that can't. Spark fails a job on a bad one, so they are tried on the driver."""
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    good, bad = [], []
    for p in patterns:
        try:
            compile_(p)
            good.append(p)
        except Exception:  # noqa: BLE001 - the JVM's own exception type
            bad.append(p)
    return good, bad


def rule_tags(rules: Sequence[TagRule], fields: dict[str, Column], spark: SparkSession) -> Column:
    """The distinct tags of matching rules, in the rules' order. Rules are settings that people type in: each is an expression, and none is joined."""
    found = []
    for rule in rules:
        if not rule.pattern or rule.is_regex and valid_patterns(spark, [rule.pattern])[1]:
            continue
        scopes = [rule.scope] if rule.scope in ("domain", "url", "title", "text") else ["url", "title", "text"]
        hit = F.lit(False)
        for s in scopes:
            c = F.coalesce(fields.get(s, F.lit("")), F.lit(""))
            hit = hit | (c.rlike(f"(?iu){rule.pattern}") if rule.is_regex else F.contains(F.lower(c), F.lit(rule.pattern.lower())))
        tags = [t.strip() for t in rule.tags if t.strip()]
        if tags:
            found.append(F.when(hit, F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def tag_documents(df: DataFrame, rules: Sequence[TagRule], fields: dict[str, Column], name: str = "tags", own: Column | None = None) -> DataFrame:
    """Adds ``name``: the document's own tags, then those of the rules, once each."""
    tags = rule_tags(rules, fields, df.sparkSession)
    return df.withColumn(name, F.array_distinct(F.concat(clean_tags(own), tags)) if own is not None else tags)


def clean_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), js_trim), lambda t: t != "")
