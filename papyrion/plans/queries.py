"""The core's named queries: each takes (spark, directory) and returns a DataFrame; oracle.py has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import compose, hashing, scalars, templates, text, urls
from papyrion.operators import capture, cliplog, collections, crawl, inventories, jobs, paths, snapshots, sync, tags
from papyrion.operators.ordered import with_previous
from papyrion.plans import html_queries, source_queries, upkeep_queries
from papyrion.session import materialize, read_table
from papyrion.sinks import documents, files

#: Where the sync query cuts the deliveries in two: what was ingested before is the last sync.
SYNC_CUT = "2026-06-01 00:00:00"
RULES = [
    tags.TagRule("title", "archive", tags=("archive",)),
    tags.TagRule("text", "backup disk", tags=("storage", "backup")),
    tags.TagRule("any", r"\bkarten?ansicht\b", True, ("maps",)),
    tags.TagRule("domain", "handbook", tags=("handbook", "archive")),
    tags.TagRule("url", r"https?://[^/]*\.example", True, ("example-site",)),
    tags.TagRule("text", "(unclosed", True, ("never",)),
]


def _captures(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Captures, each id once."""
    return read_table(spark, d, "captures").select("capture_id", *columns).dropDuplicates(["capture_id"])


def _clips(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "clip_log").drop("received_at").dropDuplicates(["clip_id"])


def _collections(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "collections")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "site_inventories").where("pages is not null and last_refreshed_at is not null and collection_id is not null")
    return rows.select("inventory_id", "collection_id", "last_refreshed_at", "pages").dropDuplicates(["inventory_id"])


def _latest_inventories(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshot of each collection."""
    newest = F.max_by(F.struct("inventory_id", "pages", "last_refreshed_at"), F.struct("last_refreshed_at", "inventory_id"))
    return _snapshots(spark, d).groupBy("collection_id").agg(newest.alias("s")).select("collection_id", "s.*")


def _pages_of(snapshots_: DataFrame, scope: str) -> DataFrame:
    return snapshots_.select(scope, F.posexplode("pages").alias("ord", "page")).where("page is not null")


def page_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d, "url").select("capture_id", urls.comparable_url(F.col("url")).alias("canonical_url"), urls.host(F.col("url")).alias("host"), urls.site_of_host(F.col("url")).alias("site"), urls.origin(F.col("url")).alias("origin"))


def page_host_stats(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d, "url").groupBy(urls.hostname(F.col("url")).alias("host")).agg(F.count("*").alias("n_captures"), F.countDistinct(urls.comparable_url(F.col("url"))).alias("n_urls"))


def page_dedupe_by_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d, "url").groupBy(urls.comparable_url(F.col("url")).alias("canonical_url")).agg(F.min("capture_id").alias("capture_id"), F.count("*").alias("n_captures"))


def page_rel_path(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d, "url").select("capture_id", urls.relative_markdown_path(F.col("url")).alias("rel_path"), urls.encode_path_for_link(urls.relative_markdown_path(F.col("url"))).alias("link_path"))


def page_unique_path(spark: SparkSession, d: str) -> DataFrame:
    return paths.page_paths(_captures(spark, d, "url", "title", "collection_id"), ["capture_id"], "collection_id").select("capture_id", "path")


def library_paths(spark: SparkSession, d: str) -> DataFrame:
    kinds = _collections(spark, d).select("collection_id", "collection_type")
    pages = _captures(spark, d, "url", "title", "collection_id").join(kinds, "collection_id")
    return paths.library_paths(pages, "collection_id", "collection_type", ["capture_id"]).select("capture_id", "collection_id", "path")


def doc_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", hashing.fingerprint_markdown(F.col("text")).alias("fingerprint"))


def doc_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("byte_length"))


def doc_crc32(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", hashing.crc32(F.col("text")).alias("crc"))


def clip_changed(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d).select("clip_id", hashing.compare_fingerprint(F.col("content_fingerprint"), F.col("preview_fingerprint")).alias("state"))


def doc_slug(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", urls.slugify(F.col("title")).alias("slug"), urls.sanitize_filename(F.col("title")).alias("file_name"), scalars.heading_anchor(F.col("title")).alias("anchor"))


def doc_auto_description(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", compose.auto_description(F.col("text")).alias("description"))


def doc_visible_length(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.visible_length(F.coalesce("text", F.lit(""))).cast("long").alias("visible_length"))


def doc_normalized(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.normalize_markdown(F.col("text")).alias("markdown"))


def doc_tag_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    fields = {"domain": urls.hostname(F.col("url")), "url": F.col("url"), "title": F.col("title"), "text": F.col("text")}
    return tags.tag_documents(docs, RULES, fields).select("doc_id", F.array_join("tags", ",").alias("tags"))


def tag_union(spark: SparkSession, d: str) -> DataFrame:
    """Each capture's own tags and those of its collection's clips' type, in order, once each."""
    caps = _captures(spark, d, "metadata", "mode")
    own = tags.clean_tags(F.col("metadata.tags"))
    return caps.select("capture_id", F.array_join(F.array_union(own, F.array("mode")), ",").alias("tags"))


def _consecutive(spark: SparkSession, d: str) -> DataFrame:
    snaps = _snapshots(spark, d)
    links = with_previous(snaps.select("inventory_id", "collection_id", "last_refreshed_at"), "collection_id", ["last_refreshed_at", "inventory_id"], "inventory_id", "previous_id").where("previous_id is not null").select("inventory_id", "previous_id")
    pages = _pages_of(snaps, "inventory_id")
    current = pages.join(links.select("inventory_id"), "inventory_id", "left_semi")
    previous = links.join(pages.withColumnRenamed("inventory_id", "previous_id"), "previous_id").select("inventory_id", "ord", "page")
    return inventories.reconcile(previous, current, ["inventory_id"])


def inventory_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return _consecutive(spark, d).select("inventory_id", "page_key", "change")


def inventory_guard(spark: SparkSession, d: str) -> DataFrame:
    return inventories.refresh_summary(inventories.reconcile_counts(_consecutive(spark, d), ["inventory_id"]))


def inventory_pages(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshot's pages of each collection, each identity once, with a title and day."""
    pages = inventories.first_pages(_pages_of(_latest_inventories(spark, d), "collection_id"), ["collection_id"], "ord")
    return pages.select("collection_id", "page_key", F.coalesce(text.non_blank(F.col("page.title")), urls.title_from_url(F.col("page.url"))).alias("title"), scalars.iso_day(F.col("page.modified")).alias("modified_day"))


def collection_page_view(spark: SparkSession, d: str) -> DataFrame:
    latest = inventories.first_pages(_pages_of(_latest_inventories(spark, d), "collection_id"), ["collection_id"], "ord")
    shown = latest.select("collection_id", "page_key", "page.title", "page.url", "ord")
    caps = _captures(spark, d, "collection_id", "url", "title", "error").where("collection_id is not null and error is not null")
    health = caps.select("collection_id", "url", F.lit("").alias("title"), F.lit("error").alias("status"), "error").dropDuplicates(["collection_id", "url"])
    last = _latest_inventories(spark, d).select("collection_id", "inventory_id")
    changes = _consecutive(spark, d).join(last, "inventory_id")
    removed = changes.where("change = 'removed'").select("collection_id", "page.title", "page.url")
    return inventories.page_view(shown, health, removed, changes.select("collection_id", "page_key", "change"), "collection_id", None)


def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    return _sync(spark, d)[0].select("collection_id", "path", "action", "capture_error")


def _sync(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    caps = read_table(spark, d, "captures").select("capture_id", "collection_id", "url", "title", "markdown", "error", "ingested_at").where("collection_id is not null")
    # Hashed where the texts are read: from here on only hashes travel, and they are made once.
    hashed = F.when(F.col("markdown").isNotNull(), hashing.content_hash(sync.stable_content("markdown")))
    caps = materialize(caps.select("capture_id", "collection_id", "url", "title", hashed.alias("content_hash"), "error", "ingested_at", urls.comparable_url(F.col("url")).alias("k")))
    first = caps.groupBy("capture_id").agg(F.min_by(F.struct("collection_id", "url", "title", "content_hash", "error", "ingested_at", "k"), "ingested_at").alias("c")).select("capture_id", "c.*")
    first = materialize(first)
    ok = first.where("content_hash is not null and error is null")

    def manifest(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy("collection_id", "k").agg(F.max_by(F.struct("url", "title", "content_hash"), "capture_id").alias("c")).select("collection_id", "k", "c.*")
        return newest.select("collection_id", F.concat(F.sha2("k", 256), F.lit(".md")).alias("path"), "url", "title", "content_hash")

    cut = F.lit(SYNC_CUT).cast("timestamp")
    since, previous = manifest(ok.where(F.col("ingested_at") >= cut)), materialize(manifest(ok.where(F.col("ingested_at") < cut)))
    failed = first.where("error is not null").select("collection_id", "url", "error")
    expected = _collections(spark, d).select("collection_id", F.explode("urls").alias("url")).unionByName(failed.select("collection_id", "url")).unionByName(previous.where("title is not null").select("collection_id", "url"))
    return sync.sync_plan(since, previous, expected, failed), previous


def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return sync.sync_counts(_sync(spark, d)[0])


def clip_log_newest(spark: SparkSession, d: str) -> DataFrame:
    """The log's query as a report: the 100 newest article clips."""
    return cliplog.list_clips(_clips(spark, d), F.lit("2026-01-01").cast("timestamp"), "article", 100).select("clip_id", "url", F.unix_micros("clipped").alias("clipped_us"))


def clip_latest_by_url(spark: SparkSession, d: str) -> DataFrame:
    return cliplog.latest_by_url(_clips(spark, d)).select("url_key", "clip_id")


def clip_types(spark: SparkSession, d: str) -> DataFrame:
    return cliplog.clip_types(_clips(spark, d))


def clip_lookup(spark: SparkSession, d: str) -> DataFrame:
    return cliplog.find_clips(_captures(spark, d, "url"), _clips(spark, d)).where("clip_id is not null").select("capture_id", "clip_id")


def clip_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The log after its later half was merged into the earlier one."""
    log = cliplog.first_deliveries(read_table(spark, d, "clip_log"), "clip_id", "received_at")
    cut = F.lit("2026-06-01").cast("timestamp")
    merged = cliplog.upsert_clips(log.where(F.col("received_at") < cut).drop("received_at"), log.where(F.col("received_at") >= cut).drop("received_at"))
    return merged.select("clip_id", "url", "title", "clip_path")


def activity_summary(spark: SparkSession, d: str) -> DataFrame:
    return cliplog.activity(_clips(spark, d), _collections(spark, d))


def page_state(spark: SparkSession, d: str) -> DataFrame:
    caps = _captures(spark, d, "url", "markdown").where("markdown is not null").withColumn("fingerprint", hashing.fingerprint_markdown(F.col("markdown")))
    library = _collections(spark, d).select(F.explode("urls").alias("url"))
    return cliplog.page_state(caps.select("capture_id", "url", "fingerprint"), library, _clips(spark, d)).select("capture_id", "state")


def collection_match(spark: SparkSession, d: str) -> DataFrame:
    return collections.match_collections(_captures(spark, d, "url").where("url is not null"), _collections(spark, d), "capture_id")


def collections_normalized(spark: SparkSession, d: str) -> DataFrame:
    rows = collections.normalize_collections(_collections(spark, d))
    return rows.select("collection_id", "collection_name", "collection_type", collections.collection_path().alias("folder"), F.size("urls").cast("long").alias("n_urls"), urls.classify_collection_url(F.coalesce("web_url", "source_url")).alias("url_type"))


def collection_presets(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages_of(_latest_inventories(spark, d), "collection_id").select("collection_id", "page.url")
    return collections.export_preset(_collections(spark, d), pages)


def collection_inventory_csv(spark: SparkSession, d: str) -> DataFrame:
    return collections.inventory_rows(_collections(spark, d), _latest_inventories(spark, d))


def inventory_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.inventory_csv_lines(collection_inventory_csv(spark, d))


def inventory_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages_of(_latest_inventories(spark, d), "collection_id").select("collection_id", "page.url")
    return collections.inventory_urls(_collections(spark, d), pages)


def collections_due(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-01-15 00:00:00").cast("timestamp")
    return _collections(spark, d).select("collection_id", scalars.sync_due(F.lit("weekly"), F.col("added_at"), now).alias("weekly_due"), scalars.sync_due(F.lit("monthly"), F.col("added_at"), now).alias("monthly_due"), scalars.sync_due(F.lit("off"), F.col("added_at"), now).alias("off_due"))


def collections_refreshable(spark: SparkSession, d: str) -> DataFrame:
    return collections.refreshable(_collections(spark, d)).select("collection_id")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    manifests = sync.manifest_files(_sync(spark, d)[0]).groupBy("collection_id").agg(F.count("*").alias("n_pages")).withColumn("synced_at", F.lit("2026-12-31T00:00:00.000Z"))
    return collections.catalog(_collections(spark, d), manifests)


def health_rows(spark: SparkSession, d: str) -> DataFrame:
    caps = _captures(spark, d, "url", "title", "error")
    return collections.health_rows(caps.where("error is null"), caps.where("error is not null"))


def job_stats(spark: SparkSession, d: str) -> DataFrame:
    return jobs.job_stats(_captures(spark, d, "job_id", "error"))


def job_progress(spark: SparkSession, d: str) -> DataFrame:
    caps = _captures(spark, d, "job_id", "error", "captured_at")
    rows = caps.groupBy("job_id").agg(F.count_if(F.col("error").isNull()).alias("n_captured"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), (F.max(F.unix_millis("captured_at")) - F.min(F.unix_millis("captured_at"))).alias("elapsed_ms"))
    rows = rows.select("*", F.lit("running").alias("status"), F.lit(40).cast("long").alias("n_queued"), F.lit(50).cast("long").alias("max_pages"))
    return jobs.job_progress(rows).select("job_id", "progress.captured", "progress.failed", "progress.completed", "progress.total", "progress.percent", "progress.eta_ms", scalars.format_clock(F.col("progress.eta_ms") / 1000).alias("clock"))


def failed_urls(spark: SparkSession, d: str) -> DataFrame:
    return jobs.failed_urls(_captures(spark, d, "job_id", "url", "error"))


def result_meta(spark: SparkSession, d: str) -> DataFrame:
    pages = _captures(spark, d, "job_id", "url", "title", "markdown").withColumn("path", urls.relative_markdown_path(F.col("url")))
    return jobs.result_meta(pages).select("job_id", "url", "path", "byte_length")


def missing_bodies(spark: SparkSession, d: str) -> DataFrame:
    caps = _captures(spark, d, "job_id", "url", "markdown")
    return jobs.missing_bodies(caps.select("job_id", "url"), caps.where("markdown is not null").select("job_id", "url"))


def link_distances(spark: SparkSession, d: str) -> DataFrame:
    """Pages by links from the pages of the lowest address: edges from each capture to its doubles, as a heap has them."""
    caps = _captures(spark, d, "url").select("capture_id", urls.comparable_url(F.col("url")).alias("u")).where("u is not null")
    child = caps.select(F.explode(F.array(F.col("capture_id") * 2, F.col("capture_id") * 2 + 1)).alias("child"), F.col("u").alias("src"))
    edges = child.join(caps.select(F.col("capture_id").alias("child"), F.col("u").alias("dst")), "child").select("src", "dst")
    return crawl.link_distances(edges, caps.where("capture_id = 1").select(F.col("u").alias("url")), 30)


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """The distinct http(s) addresses in each capture's Markdown."""
    from papyrion.sources.lists import markdown_urls

    caps = _captures(spark, d, "markdown")
    return caps.select("capture_id", F.explode(F.filter(markdown_urls(F.col("markdown")), lambda u: u.rlike("^https?://"))).alias("url"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    caps = _captures(spark, d, "url", "title", "metadata")
    m = {n: F.col(f"metadata.{n}") for n in ("author", "published", "modified", "description", "site", "captured_at", "tags")} | {"title": F.col("title"), "url": F.col("url")}
    return caps.select("capture_id", compose.front_matter(compose.default_properties(m)).alias("front_matter"))


def composed_documents(spark: SparkSession, d: str) -> DataFrame:
    caps = _captures(spark, d, "url", "title", "metadata", "markdown")
    m = {n: F.col(f"metadata.{n}") for n in ("author", "published", "modified", "description", "site", "captured_at", "tags")} | {"title": F.col("title"), "url": F.col("url")}
    return caps.select("capture_id", compose.compose_document(F.col("title"), F.col("markdown"), compose.default_properties(m)).alias("content"))


def rendered_templates(spark: SparkSession, d: str) -> DataFrame:
    """Each capture through its profile's template and file name."""
    profiles = read_table(spark, d, "setting_profiles").drop("updated_at").dropDuplicates(["profile_id"])
    caps = _captures(spark, d, "profile_id", "variables", "title").join(profiles, "profile_id")
    name = F.coalesce(text.non_blank(templates.render_template(F.col("filename_template"), F.col("variables"))), urls.slugify(F.col("title")))
    body = F.when(F.col("use_template") & (F.coalesce("template", F.lit("")) != ""), templates.render_template(F.col("template"), F.col("variables")))
    return caps.select("capture_id", body.alias("content"), urls.with_markdown_extension(name).alias("file_name"))


def template_selectors(spark: SparkSession, d: str) -> DataFrame:
    profiles = read_table(spark, d, "setting_profiles").dropDuplicates(["profile_id"])
    return profiles.select("profile_id", F.array_join(templates.selector_refs(F.col("template"), F.col("filename_template")), ",").alias("selectors"))


def site_index(spark: SparkSession, d: str) -> DataFrame:
    pages = _captures(spark, d, "collection_id", "url", "title").where("collection_id is not null").withColumn("path", urls.relative_markdown_path(F.col("url")))
    return documents.index_document(pages, "collection_id", "capture_id", F.col("collection_id"))


def aggregate_sections(spark: SparkSession, d: str) -> DataFrame:
    pages = _captures(spark, d, "collection_id", "url", "title", "markdown").where("collection_id is not null")
    return documents.aggregate_sections(pages, "collection_id", ["capture_id"])


def aggregate_documents(spark: SparkSession, d: str) -> DataFrame:
    pages = _captures(spark, d, "job_id", "url", "title", "markdown").where("job_id is not null")
    return documents.aggregate_document(pages, "job_id", ["capture_id"])


def knowledge_index(spark: SparkSession, d: str) -> DataFrame:
    return documents.knowledge_index(_clips(spark, d).where("collection_id is not null"), "collection_id")


def prompt_inventory(spark: SparkSession, d: str) -> DataFrame:
    clips = _clips(spark, d).where("collection_id is not null")
    records = clips.select("collection_id", "clip_id", "title", F.col("clip_path").alias("path"), "url", F.date_format("clipped", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("clipped"), "tags")
    return documents.prompt(records, "collection_id", ["clip_id"], "compare")


def metadata_days(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d, "metadata").select("capture_id", scalars.iso_day(F.col("metadata.published")).alias("published_day"), scalars.iso_day(F.col("metadata.modified")).alias("modified_day"))


def page_capture(spark: SparkSession, d: str) -> DataFrame:
    """The capture stage over pages of HTML built of the captures' titles and paragraphs."""
    caps = _captures(spark, d, "url", "title", "markdown").where("markdown is not null and url is not null")
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(F.split(esc(F.col("markdown")), r"\n\s*\n"), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")
    html = F.concat(F.lit("<html><head><title>"), esc(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><nav><a href='/'>Home</a></nav><article class='content'>"), body, F.lit("</article><footer>end</footer></body></html>"))
    return capture.capture_pages(caps.select("url", html.alias("html"))).select("url", "title", "mode", "markdown", "stats", "error")


_ALL = (
    page_canonical_url, page_host_stats, page_dedupe_by_canonical, page_rel_path, page_unique_path, library_paths, doc_fingerprint, doc_content_hash, doc_crc32, clip_changed, doc_slug,
    doc_auto_description, doc_visible_length, doc_normalized, doc_tag_rules, tag_union, inventory_reconcile, inventory_guard, inventory_pages, collection_page_view, sync_plan, sync_counts,
    clip_log_newest, clip_latest_by_url, clip_types, clip_lookup, clip_upsert, activity_summary, page_state, collection_match, collections_normalized, collection_presets,
    collection_inventory_csv, inventory_csv_lines, inventory_urls, collections_due, collections_refreshable, catalog, health_rows, job_stats, job_progress, failed_urls, result_meta,
    missing_bodies, link_distances, page_links, front_matter, composed_documents, rendered_templates, template_selectors, site_index, aggregate_sections, aggregate_documents,
    knowledge_index, prompt_inventory, metadata_days, page_capture,
)
QUERIES = {"p4_found": snapshots.p4_found, **{f.__name__: f for f in _ALL}, **html_queries.QUERIES, **source_queries.QUERIES, **upkeep_queries.QUERIES}
