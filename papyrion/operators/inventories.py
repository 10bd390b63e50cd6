"""Site inventories: identity, reconciliation with the snapshot before, replacement and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.scalars import reduction_needs_confirmation
from papyrion.functions.text import non_blank
from papyrion.functions.urls import view_key
from papyrion.operators.snapshots import page_identity

FIELDS = ["title", "file_ref", "guid", "modified", "url"]


def identity(page: Column) -> Column:
    """The page's identity: path, guid, url, else id; null where all are blank."""
    return F.coalesce(page_identity(page), F.concat(F.lit("id:"), F.lower(non_blank(page["id"].cast("string")))))


def first_pages(pages: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Pages (a struct column ``page``) with their identity in ``page_key``, the first of each identity in ``scope`` by ``order``."""
    keyed = pages.withColumn("page_key", identity(F.col("page"))).where("page_key is not null")
    return keyed.groupBy(*scope, "page_key").agg(F.min_by("page", order).alias("page"), F.min(order).alias(order))


def reconcile(previous: DataFrame, current: DataFrame, scope: list[str]) -> DataFrame:
    """scope, page_key, change (new, updated, unchanged, removed) and page: current pages, and those that are gone.

    Both sides have the scope columns, ``page`` and ``ord``; the first of each identity counts. Missing and empty fields
    are alike.
    """
    text = lambda side, f: F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit(""))
    differs = F.lit(False)
    for f in FIELDS:
        differs = differs | (text("old", f) != text("new", f))
    old = first_pages(previous, scope, "ord").withColumnRenamed("page", "old").drop("ord")
    new = first_pages(current, scope, "ord").withColumnRenamed("page", "new").drop("ord")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(differs, "updated").otherwise("unchanged")
    return old.join(new, [*scope, "page_key"], "full_outer").select(*scope, "page_key", change.alias("change"), F.coalesce("new", "old").alias("page"))


def reconcile_counts(changes: DataFrame, scope: list[str]) -> DataFrame:
    """Counts by change, and whether the loss wants a second look."""
    counted = changes.groupBy(*scope).agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("new", "updated", "unchanged", "removed")])
    before, after = F.col("n_updated") + F.col("n_unchanged") + F.col("n_removed"), F.col("n_updated") + F.col("n_unchanged") + F.col("n_new")
    return counted.withColumn("needs_confirmation", reduction_needs_confirmation(before, after))


def refresh_summary(counts: DataFrame) -> DataFrame:
    """Adds summary: the counts in words."""
    part = lambda c, w: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {w}")))
    words = F.concat_ws(", ", part("n_new", "new"), part("n_updated", "updated"), part("n_removed", "no longer present"))
    return counts.withColumn("summary", F.when(words == "", "No changes found.").otherwise(F.concat(words, F.lit("."))))


def refresh_error(status: Column, is_json: Column) -> Column:
    """What went wrong with a refresh, by the answer's status."""
    return F.when(status == 401, "Sign in to the site and try again.").when(status == 403, "This account may not read the site's pages.").when(status == 404, "The site or its page list was not found.").when(~is_json, "The site did not answer with page data.").when(status >= 400, F.concat(F.lit("The site answered with status "), status.cast("string"), F.lit(".")))


def replace_snapshot(stored: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """The stored rows with those of delivered keys replaced as a whole."""
    return stored.join(delivered.select(key).distinct(), key, "left_anti").unionByName(delivered, allowMissingColumns=True)


def remove_keys(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def page_view(inventory: DataFrame, health: DataFrame, removed: DataFrame, changes: DataFrame, scope: str, limit: int | None = 10) -> DataFrame:
    """What a collection's page list shows: inventory, failed pages that aren't in it, then removed pages.

    ``inventory`` has scope, page_key, title, url, ord; ``health`` scope, url, title, status, error; ``removed`` scope,
    title, url; ``changes`` scope, page_key, change. status is removed, error, new, updated or empty. The first ``limit``
    rows of each scope, or all for None.
    """
    rows = inventory.select(scope, "page_key", "title", "url", F.lit(0).alias("kind"), F.col("ord").cast("string").alias("ord"), view_key(F.col("url")).alias("vk"))
    failed = health.where("status = 'error'").select(scope, F.lit(None).cast("string").alias("page_key"), "title", "url", F.lit(1).alias("kind"), F.col("url").alias("ord"), view_key(F.col("url")).alias("vk"), "error")
    gone = removed.select(scope, F.lit(None).cast("string").alias("page_key"), "title", "url", F.lit(2).alias("kind"), F.col("url").alias("ord"), view_key(F.col("url")).alias("vk"))
    alone = failed.drop("error").join(rows.select(scope, "vk"), [scope, "vk"], "left_anti")
    shown = rows.unionByName(alone).unionByName(gone)
    failures = failed.groupBy(scope, "vk").agg(F.first("error").alias("error"), F.lit(True).alias("failed"))
    shown = shown.join(failures, [scope, "vk"], "left").join(changes.where("change in ('new', 'updated')").select(scope, "page_key", "change"), [scope, "page_key"], "left")
    status = F.when(F.col("kind") == 2, "removed").when(F.col("failed"), "error").otherwise(F.coalesce("change", F.lit("")))
    title = F.coalesce(non_blank(F.col("title")), non_blank(F.col("url")), F.lit("Untitled page"))
    shown = shown.select(scope, title.alias("title"), "url", status.alias("status"), F.when(F.col("kind") < 2, F.col("error")).alias("error"), "kind", "ord")
    if limit is not None:
        shown = shown.withColumn("n", F.expr(f"row_number() over (partition by `{scope}` order by kind, lpad(ord, 12, '0'), url, title)")).where(F.col("n") <= limit).drop("n")
    return shown.drop("kind", "ord")
