"""Saved collections: normal form, matching pages, presets, rows for export, health and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import js_trim, non_blank
from papyrion.functions.urls import classify_collection_url, comparable_url, normalize_library_path, site_key, slugify, title_from_url

HTTP = r"(?i)^https?://"
#: Pages that an export preset asks for at most.
PRESET_PAGES = 500


def normalize_collections(rows: DataFrame) -> DataFrame:
    """Collections with defaults: http addresses only and once each, a type and a name by the address, an added_at."""
    address = F.coalesce(non_blank(F.col("web_url")), non_blank(F.col("source_url")))
    kind = F.when(F.col("collection_type").isin("sharepoint", "confluence", "website", "custom"), F.col("collection_type")).otherwise(classify_collection_url(address))
    return rows.withColumn("urls", http_urls(F.col("urls"))).withColumn("collection_type", kind).withColumn("collection_name", F.coalesce(non_blank(F.col("collection_name")), title_from_url(address), F.lit("Untitled collection")))


def http_urls(urls: Column) -> Column:
    kept = F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), js_trim), lambda u: u.rlike(HTTP))
    return F.array_distinct(kept)


def base_url() -> Column:
    """A collection's start address without trailing slashes."""
    return F.regexp_replace(F.coalesce(F.nullif(F.col("web_url"), F.lit("")), F.nullif(F.col("source_url"), F.lit("")), F.lit("")), "/+$", "")


def collection_path() -> Column:
    """The library folder: the collection's own, else type and slug of its name."""
    own = normalize_library_path(F.col("library_path"))
    return F.when(own != "", own).otherwise(F.concat(F.col("collection_type"), F.lit("/"), slugify(F.col("collection_name"), "collection")))


def match_collections(pages: DataFrame, collections: DataFrame, key: str) -> DataFrame:
    """``key`` (of ``pages``, with url) and collection_id of each page's collection.

    A collection that lists the page comes first, then the one with the longest base that the address equals or goes on
    from with ``/`` or ``?``; ties by id. Both tests are equi joins: every prefix of an address that ends before a slash
    or question mark is a candidate base.
    """
    sites = collections.select("collection_id", base_url().alias("_base"), http_urls(F.col("urls")).alias("urls"))
    listed = sites.select("collection_id", "_base", F.explode("urls").alias("u")).select("collection_id", "_base", comparable_url(F.col("u")).alias("_k")).distinct()
    by_list = pages.select(key, comparable_url(F.col("url")).alias("_k")).join(listed, "_k").select(key, "collection_id", F.lit(1).alias("listed"), F.length("_base").alias("len"))
    spots = F.transform(F.filter(F.sequence(F.lit(1), F.length("url")), lambda i: F.substr(F.col("url"), i, F.lit(1)).isin("/", "?")), lambda i: F.substr(F.col("url"), F.lit(1), i - 1))
    prefixes = pages.where(F.length("url") > 0).select(key, F.explode(F.array_distinct(F.concat(spots, F.array("url")))).alias("_base")).where("_base <> ''")
    by_base = prefixes.join(sites.where("_base <> ''").select("collection_id", "_base"), "_base").select(key, "collection_id", F.lit(0).alias("listed"), F.length("_base").alias("len"))
    best = F.min_by("collection_id", F.struct(-F.col("listed"), -F.col("len"), F.col("collection_id")))
    return by_list.unionByName(by_base).groupBy(key).agg(best.alias("collection_id"))


def export_preset(collections: DataFrame, inventory_pages: DataFrame, max_pages: int = PRESET_PAGES) -> DataFrame:
    """How each collection is exported: collection_id, mode, start_url, max_pages, inventory_count, include_pattern.

    Listed addresses are those of the inventory (collection_id, url) and the stored ones; without any the source mode
    decides, and a link crawl is the last resort.
    """
    stored = collections.select("collection_id", F.explode(http_urls(F.col("urls"))).alias("url"))
    counts = stored.unionByName(inventory_pages.select("collection_id", js_trim(F.col("url")).alias("url")).where(F.col("url").rlike(HTTP))).distinct().groupBy("collection_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    fed = F.col("source_mode").isin("sitemap", "llms")
    mode = F.when(n > 0, "list").when(fed, F.col("source_mode")).otherwise("crawl")
    start = F.when((n == 0) & fed, F.coalesce(F.nullif("source_url", F.lit("")), base_url())).otherwise(base_url())
    pages = F.when(n > 0, F.least(n, F.lit(max_pages))).when(fed, 100).otherwise(25)
    only = F.when((mode == "crawl") & ((F.col("collection_type") == "sharepoint") | base_url().rlike(r"(?i)\.sharepoint\.com/")), "/SitePages/").otherwise("")
    return collections.join(counts, "collection_id", "left").select("collection_id", mode.alias("mode"), start.alias("start_url"), pages.cast("long").alias("max_pages"), n.cast("long").alias("inventory_count"), only.alias("include_pattern"))


def inventory_rows(collections: DataFrame, inventories: DataFrame) -> DataFrame:
    """The eight columns of the inventory export: a row for each page, each stored address, or one for an empty collection.

    ``inventories`` has collection_id, pages and last_refreshed_at, one row a collection.
    """
    page = "struct<title:string,modified:string,url:string>"
    from_inventory = F.transform("pages", lambda p: F.struct(p["title"].alias("title"), p["modified"].alias("modified"), p["url"].alias("url")).cast(page))
    from_stored = F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda u: F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("modified"), u.alias("url")).cast(page))
    rows = collections.join(inventories, "collection_id", "left").withColumn("page", F.explode_outer(F.when(F.coalesce(F.size("pages"), F.lit(0)) > 0, from_inventory).otherwise(from_stored)))
    text = lambda c: F.coalesce(c, F.lit(""))
    address = F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("web_url", F.lit("")), F.lit(""))
    return rows.select(text(F.col("collection_name")).alias("collection_name"), text(F.col("collection_type")).alias("collection_type"), text(F.col("source_mode")).alias("discovery_method"), address.alias("collection_url"), text(F.col("page.title")).alias("page_title"), text(F.col("page.url")).alias("page_url"), text(F.col("page.modified")).alias("modified"), text(F.date_format("last_refreshed_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("last_refreshed"))


def inventory_urls(collections: DataFrame, inventory_pages: DataFrame) -> DataFrame:
    """collection_id and url of the text export: inventory and stored addresses, once each, none empty."""
    stored = collections.select("collection_id", F.explode("urls").alias("url"))
    return inventory_pages.select("collection_id", "url").unionByName(stored).where(F.coalesce(F.col("url"), F.lit("")) != "").distinct()


def health_rows(results: DataFrame, errors: DataFrame) -> DataFrame:
    """url, title, status and error of captured and failed pages."""
    ok = results.select("url", F.coalesce("title", F.lit("")).alias("title"), F.lit("ok").alias("status"), F.lit("").alias("error"))
    bad = errors.select("url", F.lit("").alias("title"), F.lit("error").alias("status"), F.coalesce(F.nullif("error", F.lit("")), F.lit("Capture failed")).alias("error"))
    return ok.unionByName(bad)


def upsert_custom_list(stored: DataFrame, delivered: DataFrame) -> DataFrame:
    """Custom lists by name without case: a delivered list replaces the addresses and keeps the stored id and added_at."""
    old = stored.select([F.col(c).alias(f"o_{c}") for c in stored.columns])
    joined = old.join(delivered, F.lower("o_collection_name") == F.lower("collection_name"), "full_outer")
    keep = {"collection_id", "added_at", "collection_name"}
    return joined.select([(F.coalesce(f"o_{c}", c) if c in keep else F.coalesce(c, f"o_{c}")).alias(c) for c in stored.columns])


def reject_duplicates(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates whose address no stored collection has, whatever the case."""
    return candidates.join(stored.select(site_key(F.col("web_url")).alias("k")).where("k is not null"), site_key(candidates["web_url"]) == F.col("k"), "left_anti")


def folder_taken(collections: DataFrame, folder: str, but_id: str) -> Column | bool:
    """Whether another collection uses a folder already."""
    return not collections.where((F.lower(collection_path()) == folder.lower()) & (F.col("collection_id") != but_id)).isEmpty()


def unique_folders(collections: DataFrame) -> DataFrame:
    """collection_id and folder: without case unique, later collections (by added_at) with ``-2``, ``-3`` …

    Collections are settings, a bounded table that people type in: the driver may hold it.
    """
    used: set[str] = set()
    rows = []
    for r in collections.select("collection_id", collection_path().alias("folder"), "added_at").orderBy(F.col("added_at").asc_nulls_last(), "collection_id").collect():
        folder, n = r["folder"], 1
        while folder.lower() in used:
            n += 1
            folder = f"{r['folder']}-{n}"
        used.add(folder.lower())
        rows.append((r["collection_id"], folder))
    return collections.sparkSession.createDataFrame(rows, "collection_id string, folder string")


def refreshable(collections: DataFrame) -> DataFrame:
    """The collections that a refresh of all visits: no custom lists, none that are found by crawling."""
    return collections.where("coalesce(collection_type, '') <> 'custom' and coalesce(source_mode, '') <> 'crawl'")


def catalog(collections: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row for each collection with a manifest (collection_id, n_pages, synced_at): what the catalog lists."""
    return collections.join(manifests, "collection_id").select("collection_id", F.col("collection_name").alias("name"), F.col("collection_type").alias("type"), collection_path().alias("folder"), F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("web_url", F.lit("")), F.lit("")).alias("source_url"), "n_pages", "synced_at")


def learn_sources(collections: DataFrame, found: DataFrame) -> DataFrame:
    """Collections whose source mode is ``auto`` with the mode and address that a discovery found (collection_id, found_mode, found_url); others stay."""
    joined = collections.join(found.select("collection_id", "found_mode", "found_url").dropDuplicates(["collection_id"]), "collection_id", "left")
    learns = (F.col("source_mode") == "auto") & F.coalesce(F.col("found_mode") != "", F.lit(False))
    changed = {"source_mode": F.when(learns, F.col("found_mode")).otherwise(F.col("source_mode")), "source_url": F.when(learns, F.coalesce(F.nullif("found_url", F.lit("")), F.col("source_url"))).otherwise(F.col("source_url"))}
    return joined.select([changed[c].alias(c) if c in changed else F.col(c) for c in collections.columns])


def remove_collections(ids: DataFrame, collections: DataFrame, inventories: DataFrame, health: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Definitions, inventories and health without the collections of ``ids`` (collection_id). Library files aren't touched."""
    gone = ids.select("collection_id").distinct()
    return tuple(df.join(gone, "collection_id", "left_anti") for df in (collections, inventories, health))  # type: ignore[return-value]


# Beginnings of paths that name a place on one machine.
ABSOLUTE_PATH = r"(?i)^(?:[a-z]:[\\/]|[a-z][\\/]users[\\/]|\\\\)"


def change_folders(collections: DataFrame, wanted: DataFrame) -> DataFrame:
    """Collections with the library folders that were asked for (collection_id, folder), and ``refused``: why not, or null.

    A path of one machine and a folder that another collection uses are refused; the collection's default folder is
    stored as none. The catalog is to be written anew where ``library_path`` changed.
    """
    asked = wanted.select("collection_id", "folder").dropDuplicates(["collection_id"])
    default = F.concat(F.col("collection_type"), F.lit("/"), slugify(F.col("collection_name"), "collection"))
    rows = collections.withColumn("_now", collection_path()).withColumn("_default", default).join(asked, "collection_id", "left")
    rows = rows.withColumn("_new", F.coalesce(F.nullif(normalize_library_path(F.col("folder")), F.lit("")), F.col("_default")))
    used = rows.groupBy(F.lower("_now").alias("_k")).agg(F.count("*").alias("_n"), F.min("collection_id").alias("_who"))
    rows = rows.join(used, F.lower("_new") == F.col("_k"), "left")
    others = F.coalesce(F.col("_n") > F.when(F.lower("_now") == F.lower("_new"), 1).otherwise(0), F.lit(False))
    refused = F.when(js_trim(F.col("folder")).rlike(ABSOLUTE_PATH), "a path of one machine").when(others, "another collection uses this folder")
    refused = F.when(F.col("folder").isNotNull(), refused)
    path = F.when(F.col("folder").isNull() | refused.isNotNull(), F.col("library_path")).when(F.col("_new") == F.col("_default"), "").otherwise(F.col("_new"))
    return rows.select([path.alias(c) if c == "library_path" else F.col(c) for c in collections.columns] + [refused.alias("refused")])
