"""Queries on sources and posts over texts built of the tables' addresses and pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import scalars, urls
from papyrion.operators import posts
from papyrion.session import read_table, scratch
from papyrion.sources import lists


def _collections(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "collections").where("collection_id is not null").dropDuplicates(["collection_id"])


def _captures(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_table(spark, d, "captures").select("capture_id", *columns).dropDuplicates(["capture_id"])


def _inventories(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "site_inventories").where("pages is not null and inventory_id is not null").select("inventory_id", "pages").dropDuplicates(["inventory_id"])


def _urls() -> Column:
    return F.coalesce("urls", F.array().cast("array<string>"))


def list_urls(spark: SparkSession, d: str) -> DataFrame:
    """A list of each collection's addresses, with blanks around them, other lines between them, and the first one twice."""
    lines = F.concat(F.array(F.lit("# addresses"), F.lit("")), F.transform(_urls(), lambda u: F.concat(F.lit("  "), u, F.lit("\t"))), F.slice(_urls(), 1, 1), F.array(F.lit("ftp://other.test")))
    return _collections(spark, d).select("collection_id", F.posexplode(lists.url_list(F.array_join(lines, "\r\n"))).alias("ord", "url"))


def text_urls(spark: SparkSession, d: str) -> DataFrame:
    """The addresses in each capture's text, without punctuation at their ends."""
    return _captures(spark, d, "markdown").select("capture_id", F.explode(lists.urls_in_text(F.col("markdown"))).alias("url"))


def csv_urls(spark: SparkSession, d: str) -> DataFrame:
    """The addresses in CSV files of the collections, as written and read again."""
    path = scratch(spark)
    _collections(spark, d).select("collection_id", F.concat(F.lit('see "'), F.col("collection_name"), F.lit('",\n'), F.coalesce("source_url", F.lit(""))).alias("note"), "web_url").write.option("escape", '"').csv(path)
    return lists.read_csv_urls(spark, path).select("url").distinct()


def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """The pages of a sitemap of each inventory."""
    loc = lambda p: F.concat(F.lit("<url><loc>\n "), F.replace(F.replace(p["url"], F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;")), F.lit("</loc></url>"))
    xml = F.concat(F.lit("<?xml version='1.0'?><urlset>"), F.array_join(F.transform("pages", loc), ""), F.lit("</urlset>"))
    return _inventories(spark, d).select("inventory_id", F.posexplode(lists.sitemap_locations(xml)["pages"]).alias("ord", "url"))


def sitemap_tree(spark: SparkSession, d: str) -> DataFrame:
    """The pages that an index of all collections' sitemaps leads to; the sitemaps name the index again."""
    maps = _collections(spark, d).select(F.concat(F.lit("https://maps.test/"), F.col("collection_id"), F.lit(".xml")).alias("url"), _urls().alias("urls"))
    tag = lambda u: F.concat(F.lit("<loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    leaves = maps.select("url", F.concat(F.lit("<urlset>"), F.array_join(F.transform("urls", tag), ""), F.lit("</urlset>")).alias("body"))
    # Every sitemap is named by an index of its own, which the first one names.
    inner = maps.select(F.concat("url", F.lit("?index")).alias("url"), F.concat(F.lit("<sitemapindex>"), tag(F.col("url")), F.lit("<loc>https://maps.test/</loc></sitemapindex>")).alias("body"))
    top = maps.agg(F.array_join(F.array_sort(F.collect_list(tag(F.concat("url", F.lit("?index"))))), "").alias("all")).select(F.lit("https://maps.test/").alias("url"), F.concat(F.lit("<sitemapindex>"), F.col("all"), F.lit("</sitemapindex>")).alias("body"))
    return lists.sitemap_pages(top.select("url"), leaves.unionByName(inner).unionByName(top), None).select("url")


def llms_urls(spark: SparkSession, d: str) -> DataFrame:
    """The links of an llms.txt of each collection, resolved against its own address."""
    entries = F.transform(_urls(), lambda u, i: F.concat(F.lit("- [Page]("), F.when(i % 3 == 0, F.concat(F.lit("page-"), i.cast("string"), F.lit(".md"))).when(i % 3 == 1, F.concat(F.lit("/root-"), i.cast("string"))).otherwise(u), F.lit("): about it")))
    body = F.concat(F.lit("# Site\n\n> Summary\n\n## Docs\n\n"), F.array_join(entries, "\n"), F.lit("\n- [Mail](mailto:a@b.test)"))
    files = _collections(spark, d).select("collection_id", F.concat(F.lit("https://llms.test/"), F.col("collection_id"), F.lit("/llms.txt")).alias("url"), body.alias("body"))
    found = lists.llms_pages(files, None)
    return files.select("collection_id", F.col("url").alias("source")).join(found, "source").select("collection_id", "ord", "url")


def rest_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Each inventory as an answer of the REST list, in the one or the other envelope, read again."""
    items = F.transform("pages", lambda p: F.struct(p["id"].alias("Id"), p["title"].alias("Title"), p["file_ref"].alias("FileRef"), p["guid"].alias("GUID"), p["modified"].alias("Modified")))
    body = F.when(F.col("inventory_id") % 2 == 0, F.to_json(F.struct(items.alias("value")))).otherwise(F.to_json(F.struct(F.struct(items.alias("results")).alias("d"))))
    answers = _inventories(spark, d).where("forall(pages, p -> p is not null)").select(F.col("inventory_id").alias("collection_id"), F.lit(0).alias("request_no"), body.alias("body"))
    return lists.rest_pages(answers).select(F.col("collection_id").alias("inventory_id"), F.col("ord").cast("int").alias("ord"), "page.id", "page.title", "page.file_ref", "page.guid", "page.modified")


def post_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Which addresses are posts, and whose."""
    name = F.replace("collection_id", F.lit("-"), F.lit("_"))
    shapes = {"plain": ("https://x.com/", "/status/"), "old": ("http://www.twitter.com/", "/statuses/"), "mobile": ("https://mobile.twitter.com/", "/status/"), "other": ("https://example.com/", "/status/"), "list": ("https://x.com/", "/lists/")}
    forms = F.array(*[F.struct(F.lit(k).alias("case_name"), F.concat(F.lit(a), name, F.lit(b), F.lit("12345?s=20")).alias("url")) for k, (a, b) in shapes.items()])
    rows = _collections(spark, d).select("collection_id", F.explode(forms).alias("f")).select("collection_id", "f.*").withColumn("p", posts.post_parts(F.col("url")))
    return rows.select("collection_id", "case_name", F.col("p.handle").alias("handle"), F.col("p.id").alias("post_id"))


def post_threads(spark: SparkSession, d: str) -> DataFrame:
    """A post of each collection with a quoted post, a picture and two follow-ups, one of them unreadable, as Markdown."""
    text = F.concat(F.lit("Hello &amp; welcome to "), F.col("collection_id"), F.lit(" https://t.co/x"))
    user = lambda name, handle: F.struct(F.lit(name).alias("name"), F.lit(handle).alias("screen_name"))
    quoted = F.struct(F.lit("7").alias("id_str"), F.lit("2025-12-31T10:00:00.000Z").alias("created_at"), F.lit("Quoted text").alias("text"), user("Bo", "bo").alias("user"))
    post = F.struct(
        F.lit("1").alias("id_str"), F.lit("2026-01-02T03:04:05.000Z").alias("created_at"), text.alias("text"), F.array(F.lit(0), F.length(text)).alias("display_text_range"), user("Ann", "ann").alias("user"),
        F.struct(F.array(F.struct(F.lit("https://t.co/x").alias("url"), F.concat(F.lit("https://e.test/"), F.col("collection_id")).alias("expanded_url"))).alias("urls")).alias("entities"),
        F.array(F.struct(F.lit("photo").alias("type"), F.lit("https://i.test/1.jpg").alias("media_url_https"))).alias("mediaDetails"), quoted.alias("quoted_tweet"),
    )
    follow = F.struct(F.lit("2").alias("id_str"), F.lit("2026-01-03T00:00:00.000Z").alias("created_at"), F.concat(F.lit("More on "), F.col("collection_id")).alias("text"), user("Ann", "ann").alias("user"))
    rows = _collections(spark, d)
    focal = rows.select(F.col("collection_id").alias("post_id"), F.to_json(post).alias("payload"), F.array(F.concat("collection_id", F.lit("/b")), F.concat("collection_id", F.lit("/a"))).alias("reply_ids"))
    replies = rows.select(F.concat("collection_id", F.lit("/a")).alias("post_id"), F.to_json(follow).alias("payload")).unionByName(rows.select(F.concat("collection_id", F.lit("/b")).alias("post_id"), F.lit("{broken").alias("payload")))
    return posts.threads(focal, replies).withColumnRenamed("post_id", "collection_id")


def entity_texts(spark: SparkSession, d: str) -> DataFrame:
    """Entities in texts, decoded once."""
    text = F.concat(F.lit("&lt;"), F.col("collection_id"), F.lit("&gt; &amp;amp; &quot;x&quot; &#39;y&#39;"))
    return _collections(spark, d).select("collection_id", scalars.decode_entities(text).alias("decoded"))


def same_hosts(spark: SparkSession, d: str) -> DataFrame:
    """For each capture, whether its address and its collection's are on one host."""
    sites = _collections(spark, d).select("collection_id", F.coalesce("web_url", "source_url").alias("site_url"))
    return _captures(spark, d, "collection_id", "url").join(sites, "collection_id").select("capture_id", F.coalesce(urls.same_host(F.col("url"), F.col("site_url")), F.lit(False)).alias("same_host"))


_C = "c AS (SELECT DISTINCT ON (collection_id) * FROM collections WHERE collection_id IS NOT NULL)"
_INV = "inv AS (SELECT DISTINCT ON (inventory_id) inventory_id, pages FROM site_inventories WHERE pages IS NOT NULL AND inventory_id IS NOT NULL)"
_CAP = "cap AS (SELECT DISTINCT ON (capture_id) * FROM captures ORDER BY capture_id, ingested_at)"
_HOST = r"nullif(regexp_replace(lower(regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':[0-9]*$', ''), '')"

QUERIES = {f.__name__: f for f in (list_urls, text_urls, csv_urls, sitemap_urls, sitemap_tree, llms_urls, rest_inventory, post_addresses, post_threads, entity_texts, same_hosts)}
SQL = {
    "list_urls": f"WITH {_C}, l AS (SELECT collection_id, list_filter(coalesce(urls, []), lambda u: regexp_matches(u, '(?i)^https?://')) AS l FROM c), d AS (SELECT collection_id, list_filter(l, lambda u, i: list_position(l, u) = i) AS l FROM l) SELECT collection_id, CAST(unnest(range(len(l))) AS INT) AS ord, unnest(l) AS url FROM d",
    "text_urls": rf"""WITH {_CAP} SELECT DISTINCT capture_id, regexp_replace(u, '[),.;]+$', '') AS url FROM (SELECT capture_id, unnest(regexp_extract_all(markdown, '(?i)https?://[^\s<>"'']+')) AS u FROM cap WHERE markdown IS NOT NULL)""",
    "csv_urls": rf"""WITH {_C} SELECT DISTINCT regexp_replace(u, '[),.;]+$', '') AS url FROM (SELECT unnest(regexp_extract_all(concat_ws(chr(10), collection_name, source_url, web_url), '(?i)https?://[^\s<>"'']+')) AS u FROM c)""",
    "sitemap_urls": f"WITH {_INV}, l AS (SELECT inventory_id, list_filter(list_transform(pages, lambda p: trim(p.url)), lambda u: u IS NOT NULL) AS l FROM inv) SELECT inventory_id, CAST(unnest(range(len(l))) AS INT) AS ord, unnest(l) AS url FROM l",
    "sitemap_tree": f"WITH {_C} SELECT DISTINCT trim(u) AS url FROM (SELECT unnest(urls) AS u FROM c) WHERE u IS NOT NULL",
    "llms_urls": f"""WITH {_C}, l AS (SELECT collection_id, list_transform(coalesce(urls, []), lambda u, i: CASE WHEN (i - 1) % 3 = 0 THEN 'https://llms.test/' || collection_id || '/page-' || (i - 1) || '.md' WHEN (i - 1) % 3 = 1 THEN 'https://llms.test/root-' || (i - 1) ELSE u END) AS l FROM c),
      d AS (SELECT collection_id, list_filter(l, lambda u, i: list_position(l, u) = i) AS l FROM l) SELECT collection_id, CAST(unnest(range(len(l))) AS INT) AS ord, unnest(l) AS url FROM d""",
    "rest_inventory": f"WITH {_INV}, u AS (SELECT inventory_id, unnest(pages) AS p, generate_subscripts(pages, 1) - 1 AS ord FROM inv WHERE len(list_filter(pages, lambda p: p IS NULL)) = 0) SELECT inventory_id, CAST(ord AS INT) AS ord, p.id AS id, coalesce(p.title, '') AS title, p.file_ref AS file_ref, p.guid AS guid, p.modified AS modified FROM u WHERE ord < 2000",
    "post_addresses": f"WITH {_C}, k(case_name, post) AS (VALUES ('plain', true), ('old', true), ('mobile', true), ('other', false), ('list', false)) SELECT collection_id, case_name, CASE WHEN post THEN replace(collection_id, '-', '_') END AS handle, CASE WHEN post THEN '12345' END AS post_id FROM c CROSS JOIN k",
    "post_threads": rf"""WITH {_C} SELECT collection_id, array_to_string(['> **Ann** (@ann) · 2026-01-02', '>', '> Hello & welcome to ' || collection_id || ' https://e.test/' || collection_id, '>', '> ![tweet image](https://i.test/1.jpg)', '>', '> Quoting **Bo** (@bo) · 2025-12-31:', '>> Quoted text', '>>',
      '>> [View quoted tweet on X](https://x.com/bo/status/7)', '>', '> --- Author''s follow-up ---', '>', '> **Ann** (@ann) · 2026-01-03', '>', '> More on ' || collection_id, '>', '> [View on X](https://x.com/ann/status/1)'], chr(10)) AS markdown FROM c""",
    "entity_texts": f"""WITH {_C} SELECT collection_id, '<' || collection_id || '> &amp; "x" ''y''' AS decoded FROM c""",
    "same_hosts": f"WITH {_C}, {_CAP} SELECT capture_id, coalesce({_HOST.format(u='cap.url')} = {_HOST.format(u='coalesce(c.web_url, c.source_url)')}, false) AS same_host FROM cap JOIN c ON c.collection_id = cap.collection_id",
}
