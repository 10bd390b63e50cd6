"""Incremental library sync: which files to write, keep, or review."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.functions.hashing import content_hash
from papyrion.functions.urls import comparable_url
from papyrion.session import materialize

#: Front-matter properties that differ at every capture; they are left out of the hash unless hash_scope is ``file``.
VOLATILE = ("captured", "updated", "clipped")


def stable_content(content: str):  # noqa: ANN201 - a Column
    """Content without volatile front-matter properties."""
    pattern = rf"(?m)\A(---\n(?:(?!---)[^\n]*\n)*?)(?:{'|'.join(map(re.escape, VOLATILE))}): [^\n]*\n"
    out = F.col(content)
    for _ in VOLATILE:
        out = F.regexp_replace(out, pattern, "$1")
    return out


def sync_plan(files: DataFrame, previous: DataFrame, expected: DataFrame | None = None, errors: DataFrame | None = None, hash_scope: str = "stable") -> DataFrame:
    """What a sync does with each file: collection_id, path, url, title, content_hash, action, capture_error.

    ``files`` (collection_id, path, url, title, and content or its content_hash) are the captured pages' files; ``previous`` (collection_id, path,
    url, title, content_hash) those of the last manifest, a null url standing for a manifest that has paths only;
    ``expected`` (collection_id, url) the current inventory; ``errors`` (collection_id, url, error). Actions: ``write``
    (new or changed), ``unchanged`` (same address, path and hash), ``retained`` or ``error`` (expected but not captured:
    the last good file stays), ``removed`` (awaits review). Without ``expected`` nothing is retained.
    """
    key = lambda df: df.withColumn("k", comparable_url(F.col("url")))
    if "content_hash" not in files.columns:
        files = files.withColumn("content_hash", content_hash(stable_content("content") if hash_scope == "stable" else F.col("content"))).drop("content")
    # Both are read several times, and hashed once; contents don't travel.
    now, old = materialize(key(files)), materialize(key(previous))
    last = old.where("k is not null").groupBy("collection_id", "k").agg(F.max_by(F.struct("path", "content_hash"), "path").alias("old"))
    same = (F.col("old.path") == F.col("path")) & (F.col("old.content_hash") == F.col("content_hash"))
    current = now.join(last, ["collection_id", "k"], "left").withColumn("action", F.when(same, "unchanged").otherwise("write"))
    columns = ["collection_id", "path", "url", "title", "content_hash", "action", "capture_error"]
    out = current.withColumn("capture_error", F.lit(None).cast("string")).select(columns)
    kept = None
    if expected is not None:
        wanted = key(expected).select("collection_id", "k").distinct()
        lost = old.where("k is not null").join(wanted, ["collection_id", "k"], "left_semi").join(now.select("collection_id", "k"), ["collection_id", "k"], "left_anti")
        if errors is not None:
            said = key(errors).groupBy("collection_id", "k").agg(F.first(F.coalesce(F.nullif("error", F.lit("")), F.lit("Capture failed"))).alias("error"))
            lost = lost.join(said, ["collection_id", "k"], "left")
        else:
            lost = lost.withColumn("error", F.lit(None).cast("string"))
        kept = lost.withColumn("action", F.when(F.col("error").isNotNull(), "error").otherwise("retained")).withColumn("capture_error", F.coalesce("error", F.lit("No current page body was available"))).select(columns)
        out = out.unionByName(kept)
    gone = old.join(out.select("collection_id", "path"), ["collection_id", "path"], "left_anti")
    if expected is not None:
        gone = gone.join(wanted, ["collection_id", "k"], "left_anti")
    gone = gone.dropDuplicates(["collection_id", "path"]).withColumn("action", F.lit("removed")).withColumn("capture_error", F.lit(None).cast("string")).select(columns)
    return out.unionByName(gone)


def pending_removals(plan: DataFrame, pending: DataFrame) -> DataFrame:
    """collection_id and path of all files that await review: those pending from before and those newly removed, but no current ones."""
    gone = plan.where("action = 'removed'").select("collection_id", "path")
    current = plan.where("action <> 'removed'").select("collection_id", "path")
    return pending.select("collection_id", "path").unionByName(gone).distinct().join(current, ["collection_id", "path"], "left_anti")


def sync_counts(plan: DataFrame) -> DataFrame:
    """Counts of a plan for each collection."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return plan.groupBy("collection_id").agg(n("write", "unchanged", "retained", "error").alias("n_current"), n("write").alias("n_updated"), n("unchanged").alias("n_unchanged"), n("retained", "error").alias("n_retained"), n("error").alias("n_failed"), n("removed").alias("n_removed"))


def manifest_files(plan: DataFrame) -> DataFrame:
    """The rows of the next manifest: current files, and kept ones with their status."""
    status = F.when(F.col("action").isin("retained", "error"), F.col("action"))
    return plan.where("action <> 'removed'").select("collection_id", "path", "url", "title", "content_hash", status.alias("capture_status"), "capture_error")
