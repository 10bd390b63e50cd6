"""Queries on composing, collections' upkeep, jobs and the clip log. Their SQL is in oracle.py where it needs its helpers, else here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import compose, scalars, tables, templates, urls
from papyrion.operators import cliplog, collections, crawl, inventories, jobs, sync
from papyrion.session import read_table


def _collections(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "collections").where("collection_id is not null").dropDuplicates(["collection_id"])


def _captures(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_table(spark, d, "captures").select("capture_id", *columns).dropDuplicates(["capture_id"])


def _meta() -> dict[str, Column]:
    names = ("author", "published", "modified", "description", "site", "captured_at", "tags")
    return {n: F.col(f"metadata.{n}") for n in names} | {"title": F.col("title"), "url": F.col("url")}


def variable_lists(spark: SparkSession, d: str) -> DataFrame:
    """Each capture's variables that have a value, by key, one a line."""
    lines = F.transform(templates.variable_listing(F.col("variables")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _captures(spark, d, "variables").where("variables is not null").select("capture_id", F.array_join(lines, "\n").alias("listing"))


def output_selection(spark: SparkSession, d: str) -> DataFrame:
    """The body of every second capture, and the document of the others."""
    what = F.when(F.col("capture_id") % 2 == 0, "body").otherwise("document")
    document = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("markdown", F.lit("")))
    return _captures(spark, d, "title", "markdown").select("capture_id", compose.output_text(document, F.col("markdown"), what).alias("output"))


def assembled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Captures under a user's edits of title, address and file name."""
    k = F.col("capture_id")
    edited = {"title": F.when(k % 3 == 0, F.concat(F.lit(" Edited "), k.cast("string"))).when(k % 3 == 1, " "), "url": F.when(k % 4 == 0, F.lit("https://edited.test/x"))}
    captured = _meta() | {"body": F.col("markdown"), "variables": F.col("variables")}
    out = compose.assemble(captured, edited, F.col("mode"), filename=F.when((k % 5 == 0) | F.col("title").rlike(r"[^\x00-\x7F]"), F.concat(F.lit(" my: file "), k.cast("string"))))
    return _captures(spark, d, "url", "title", "metadata", "markdown", "mode", "variables").select("capture_id", out["title"].alias("title"), out["url"].alias("url"), out["mode"].alias("mode"), out["file_name"].alias("file_name"))


def assembled_templates(spark: SparkSession, d: str) -> DataFrame:
    """Captures through one template, with edited values before the captured ones."""
    captured = _meta() | {"body": F.col("markdown"), "variables": F.col("variables")}
    out = compose.assemble(captured, {"author": F.lit("An Editor")}, F.col("mode"), template=F.lit("{{title}} by {{author}}\n{{site}}|{{tags}}\n\n"))
    return _captures(spark, d, "url", "title", "metadata", "markdown", "mode", "variables").select("capture_id", out["markdown"].alias("markdown"))


def parsed_tags(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.col("metadata.tags"), " ,, ")
    return _captures(spark, d, "metadata").select("capture_id", F.array_join(compose.parse_tags(text), "|").alias("tags"))


def metadata_lists(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of each capture as a list of labels and values."""
    return _captures(spark, d, "url", "title", "metadata").select("capture_id", compose.metadata_list(compose.default_properties(_meta())).alias("metadata_list"))


def knowledge_base_matter(spark: SparkSession, d: str) -> DataFrame:
    """The front matter of the knowledge-base preset for captures that have a description."""
    caps = _captures(spark, d, "url", "title", "metadata").where("metadata.description <> ''")
    matter = compose.front_matter(compose.knowledge_base_properties(_meta(), "article", F.lit("")))
    return caps.select("capture_id", matter.alias("front_matter"))


def content_types(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d, "mode").select("capture_id", compose.content_type(F.col("mode")).alias("content_type"))


def pending_removals(spark: SparkSession, d: str) -> DataFrame:
    """Files that await review: pending ones and newly removed ones, but none that is current."""
    caps = _captures(spark, d, "collection_id").where("collection_id is not null")
    path = F.concat((F.col("capture_id") % 997).cast("string"), F.lit(".md")).alias("path")
    action = F.when(F.col("capture_id") % 3 == 0, "removed").otherwise("write").alias("action")
    plan = caps.where("capture_id % 7 <> 0").select("collection_id", path, action)
    return sync.pending_removals(plan, caps.where("capture_id % 5 = 0").select("collection_id", path))


def results_with_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Results of each job with their stored bodies; those without one are left out."""
    caps = _captures(spark, d, "job_id", "url", "markdown")
    results = caps.groupBy("job_id", "url").agg(F.min("capture_id").alias("ord"))
    bodies = caps.where("markdown is not null").groupBy("job_id", "url").agg(F.min_by("markdown", "capture_id").alias("markdown"))
    return jobs.with_bodies(results, bodies).select("job_id", "url", "ord", F.length("markdown").cast("long").alias("n_characters"))


def permitted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Captures whose host is that of a website collection."""
    origins = _collections(spark, d).where("collection_type = 'website'").select(urls.hostname(F.coalesce("web_url", "source_url")).alias("host")).where("host is not null")
    return crawl.permitted(_captures(spark, d, "url"), origins).select("capture_id")


def unique_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders of collections whose names were cut short, so that some meet."""
    rows = collections.normalize_collections(_collections(spark, d)).withColumn("library_path", F.concat(F.lit("Lib/"), F.left("collection_name", F.lit(1))))
    return collections.unique_folders(rows)


def job_logs(spark: SparkSession, d: str) -> DataFrame:
    """The length, first and last line of each job's log after new lines were put at its end."""
    caps = _captures(spark, d, "job_id").where("job_id is not null")
    lines = lambda rows: rows.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list("capture_id")), lambda k: k.cast("string")).alias("lines"))
    log = jobs.append_log(lines(caps.where("capture_id % 2 = 0")), lines(caps.where("capture_id % 2 = 1")), 20)
    return log.select("job_id", F.size("lines").alias("n_lines"), F.element_at("lines", 1).alias("first_line"), F.element_at("lines", -1).alias("last_line"))


def custom_lists(spark: SparkSession, d: str) -> DataFrame:
    """Custom lists after lists of the same names in capitals, and one new list, were delivered."""
    stored = _collections(spark, d).where("collection_type = 'custom' and collection_name is not null").select("collection_id", "collection_name", "urls", "added_at")
    stored = stored.groupBy(F.lower("collection_name").alias("k")).agg(F.min_by(F.struct("collection_id", "collection_name", "urls", "added_at"), "collection_id").alias("c")).select("c.*")
    given = stored.select(F.concat("collection_id", F.lit("-new")).alias("collection_id"), F.upper("collection_name").alias("collection_name"), F.array(F.lit("https://given.test/")).alias("urls"), F.lit(None).cast("timestamp").alias("added_at"))
    new = given.limit(0).unionByName(spark.range(1).select(F.lit("added").alias("collection_id"), F.lit("A list of its own").alias("collection_name"), F.array(F.lit("https://own.test/")).alias("urls"), F.lit(None).cast("timestamp").alias("added_at")))
    return collections.upsert_custom_list(stored, given.unionByName(new)).select("collection_id", "collection_name", F.array_join("urls", " ").alias("urls"))


def new_collections(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that no stored collection has the address of, whatever the case."""
    stored = _collections(spark, d)
    address = F.when(F.right("collection_id", F.lit(1)).isin("0", "2", "4", "6", "8"), F.upper("web_url")).otherwise(F.concat("web_url", F.lit("/new")))
    return collections.reject_duplicates(stored.withColumn("web_url", address), stored).select("collection_id")


def learned_sources(spark: SparkSession, d: str) -> DataFrame:
    """Collections in mode ``auto`` after a discovery found a sitemap for every second one."""
    rows = _collections(spark, d).withColumn("source_mode", F.lit("auto"))
    found = rows.where(F.right("collection_id", F.lit(1)).isin("1", "3", "5", "7", "9")).select("collection_id", F.lit("sitemap").alias("found_mode"), F.concat(F.lit("https://found.test/"), F.col("collection_id")).alias("found_url"))
    return collections.learn_sources(rows, found).select("collection_id", "source_mode", "source_url")


def removed_collections(spark: SparkSession, d: str) -> DataFrame:
    """How many definitions, inventories and failures are left after the website collections were removed."""
    rows = _collections(spark, d)
    inventory = read_table(spark, d, "site_inventories").select("inventory_id", "collection_id").where("collection_id is not null").dropDuplicates(["inventory_id"])
    health = _captures(spark, d, "collection_id", "error").where("error is not null and collection_id is not null")
    left = collections.remove_collections(rows.where("collection_type = 'website'"), rows, inventory, health)
    names = ("collections", "inventories", "failures")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in zip(names, left, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def changed_folders(spark: SparkSession, d: str) -> DataFrame:
    """Collections after folders were asked for: some new, some of one machine, some that another collection uses."""
    rows = collections.normalize_collections(_collections(spark, d)).withColumn("library_path", F.concat(F.lit("own/"), F.col("collection_id")))
    digit = F.right("collection_id", F.lit(1))
    folder = F.when(digit == "0", F.concat(F.lit("C:\\Users\\"), F.col("collection_id"))).when(digit == "1", "own/col-000002").when(digit == "2", F.concat(F.lit("/moved//"), F.col("collection_id"), F.lit("/"))).when(digit == "3", "")
    return collections.change_folders(rows, rows.select("collection_id", folder.alias("folder")).where("folder is not null")).select("collection_id", "library_path", "refused")


def refresh_errors(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in (401, 403, 404, 500, 200)]), (F.length("collection_name") % 5 + 1).cast("int"))
    rows = _collections(spark, d).where("collection_name is not null").withColumn("status", status)
    return rows.select("collection_id", inventories.refresh_error(F.col("status"), F.lit(True)).alias("error"))


def new_clip_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids for the clips' addresses and times."""
    clips = read_table(spark, d, "clip_log").where("clipped is not null and url is not null").dropDuplicates(["clip_id"])
    return clips.select("clip_id", cliplog.new_clip_id(F.col("url"), F.col("clipped")).alias("new_id"))


def clips_left(spark: SparkSession, d: str) -> DataFrame:
    """The log without the clips of one kind, and of them those with an odd id, read by id."""
    clips = read_table(spark, d, "clip_log").drop("received_at").dropDuplicates(["clip_id"])
    left = cliplog.delete_clips(clips, clips.where("clip_type = 'article'"))
    return cliplog.get_clips(left, clips.where("clip_id % 2 = 1")).select("clip_id")


def clamped(spark: SparkSession, d: str) -> DataFrame:
    """Numbers brought into a range, with a fallback for what is none."""
    caps = _captures(spark, d, "stats")
    return caps.select("capture_id", scalars.clamp(F.col("stats.characters").cast("double"), 100, 2000, 500).cast("double").alias("characters"))


def link_table(spark: SparkSession, d: str) -> DataFrame:
    """The links of each capture by a table function in SQL."""
    spark.udtf.register("markdown_links", tables.MarkdownLinks)
    _captures(spark, d, "markdown").createOrReplaceTempView("_link_table_captures")
    return spark.sql("SELECT capture_id, l.ord, l.text, l.url FROM _link_table_captures, LATERAL markdown_links(markdown) l")


_ALL = (
    variable_lists, output_selection, assembled_documents, assembled_templates, parsed_tags, metadata_lists, knowledge_base_matter, content_types, pending_removals, results_with_bodies, permitted_pages, unique_folders,
    job_logs, custom_lists, new_collections, learned_sources, removed_collections, changed_folders, refresh_errors, new_clip_ids, clips_left, clamped, link_table,
)
_C = "c AS (SELECT DISTINCT ON (collection_id) * FROM collections WHERE collection_id IS NOT NULL)"
_CAP = "cap AS (SELECT DISTINCT ON (capture_id) * FROM captures ORDER BY capture_id, ingested_at)"
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "variable_lists": f"WITH {_CAP} SELECT capture_id, array_to_string(list_sort(list_transform(list_filter(map_entries(variables), lambda e: coalesce(e.value, '') <> ''), lambda e: e.key || '=' || e.value)), chr(10)) AS listing FROM cap WHERE variables IS NOT NULL",
    "output_selection": f"WITH {_CAP} SELECT capture_id, CASE WHEN capture_id % 2 = 0 THEN coalesce(markdown, '') ELSE '# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(markdown, '') END AS output FROM cap",
    "parsed_tags": rf"WITH {_CAP} SELECT capture_id, array_to_string(list_filter(list_transform(string_split(coalesce(array_to_string(metadata.tags, ' ,, '), ''), ','), lambda t: trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), lambda t: t <> ''), '|') AS tags FROM cap",
    "content_types": f"WITH {_CAP} SELECT capture_id, CASE WHEN mode IN ('sharepoint', 'confluence', 'tweet') THEN mode ELSE 'article' END AS content_type FROM cap",
    "pending_removals": f"""WITH {_CAP}, f AS (SELECT capture_id AS k, collection_id, (capture_id % 997) || '.md' AS path FROM cap WHERE collection_id IS NOT NULL)
      SELECT DISTINCT collection_id, path FROM f WHERE (k % 5 = 0 OR k % 7 <> 0 AND k % 3 = 0) AND NOT EXISTS (SELECT 1 FROM f g WHERE g.k % 7 <> 0 AND g.k % 3 <> 0 AND g.collection_id = f.collection_id AND g.path = f.path)""",
    "results_with_bodies": f"WITH {_CAP} SELECT job_id, url, min(capture_id) AS ord, length(arg_min(markdown, capture_id) FILTER (WHERE markdown IS NOT NULL)) AS n_characters FROM cap WHERE job_id IS NOT NULL AND url IS NOT NULL GROUP BY job_id, url HAVING count(markdown) > 0",
    "job_logs": f"""WITH {_CAP}, l AS (SELECT job_id, list_concat(coalesce(list(capture_id ORDER BY capture_id) FILTER (WHERE capture_id % 2 = 0), []), coalesce(list(capture_id ORDER BY capture_id) FILTER (WHERE capture_id % 2 = 1), [])) AS a FROM cap WHERE job_id IS NOT NULL GROUP BY 1),
      s AS (SELECT job_id, list_slice(a, greatest(len(a) - 19, 1), len(a)) AS a FROM l) SELECT job_id, CAST(len(a) AS INT) AS n_lines, CAST(a[1] AS VARCHAR) AS first_line, CAST(a[-1] AS VARCHAR) AS last_line FROM s""",
    "custom_lists": f"""WITH {_C}, s AS (SELECT min(collection_id) AS collection_id, arg_min(collection_name, collection_id) AS collection_name FROM c WHERE collection_type = 'custom' AND collection_name IS NOT NULL GROUP BY lower(collection_name))
      SELECT collection_id, collection_name, 'https://given.test/' AS urls FROM s UNION ALL SELECT 'added', 'A list of its own', 'https://own.test/'""",
    "new_collections": f"WITH {_C}, n AS (SELECT collection_id, CASE WHEN right(collection_id, 1) IN ('0', '2', '4', '6', '8') THEN upper(web_url) ELSE web_url || '/new' END AS u FROM c) SELECT collection_id FROM n WHERE u IS NULL OR lower(trim(u)) NOT IN (SELECT lower(trim(web_url)) FROM c WHERE web_url IS NOT NULL)",
    "learned_sources": f"WITH {_C} SELECT collection_id, CASE WHEN right(collection_id, 1) IN ('1', '3', '5', '7', '9') THEN 'sitemap' ELSE 'auto' END AS source_mode, CASE WHEN right(collection_id, 1) IN ('1', '3', '5', '7', '9') THEN 'https://found.test/' || collection_id ELSE source_url END AS source_url FROM c",
    "removed_collections": f"""WITH {_C}, {_CAP}, gone AS (SELECT collection_id FROM c WHERE collection_type = 'website'), inv AS (SELECT DISTINCT ON (inventory_id) inventory_id, collection_id FROM site_inventories WHERE collection_id IS NOT NULL)
      SELECT 'collections' AS table_name, count(*) AS n FROM c WHERE collection_id NOT IN (SELECT collection_id FROM gone) UNION ALL SELECT 'inventories', count(*) FROM inv WHERE collection_id NOT IN (SELECT collection_id FROM gone)
      UNION ALL SELECT 'failures', count(*) FROM cap WHERE error IS NOT NULL AND collection_id IS NOT NULL AND collection_id NOT IN (SELECT collection_id FROM gone)""",
    "changed_folders": f"""WITH {_C} SELECT collection_id, CASE right(collection_id, 1) WHEN '2' THEN 'moved/' || collection_id WHEN '3' THEN '' ELSE 'own/' || collection_id END AS library_path,
      CASE right(collection_id, 1) WHEN '0' THEN 'a path of one machine' WHEN '1' THEN CASE WHEN EXISTS (SELECT 1 FROM c x WHERE x.collection_id = 'col-000002') THEN 'another collection uses this folder' END END AS refused FROM c WHERE NOT (right(collection_id, 1) = '1' AND NOT EXISTS (SELECT 1 FROM c x WHERE x.collection_id = 'col-000002'))""",
    "refresh_errors": f"""WITH {_C} SELECT collection_id, CASE length(collection_name) % 5 WHEN 0 THEN 'Sign in to the site and try again.' WHEN 1 THEN 'This account may not read the site''s pages.' WHEN 2 THEN 'The site or its page list was not found.' WHEN 3 THEN 'The site answered with status 500.' END AS error FROM c WHERE collection_name IS NOT NULL""",
    "new_clip_ids": "WITH clip AS (SELECT DISTINCT ON (clip_id) * FROM clip_log WHERE clipped IS NOT NULL AND url IS NOT NULL ORDER BY clip_id, received_at) SELECT clip_id, 'clip-' || (epoch_us(clipped) // 1000) || '-' || left(sha256((epoch_us(clipped) // 1000) || chr(10) || url), 6) AS new_id FROM clip",
    "clips_left": "SELECT DISTINCT clip_id FROM clip_log WHERE clip_id % 2 = 1 AND clip_id NOT IN (SELECT clip_id FROM clip_log WHERE clip_type = 'article')",
    "clamped": f"WITH {_CAP} SELECT capture_id, CAST(CASE WHEN stats.characters IS NULL THEN 500 ELSE least(greatest(stats.characters, 100), 2000) END AS DOUBLE) AS characters FROM cap",
    "link_table": rf"""WITH {_CAP}, m AS (SELECT capture_id, regexp_extract_all(markdown, '(^|[^!])\[([^\]\n]*)\]\(([^\s)]+)[^)\n]*\)', 2) AS t, regexp_extract_all(markdown, '(^|[^!])\[([^\]\n]*)\]\(([^\s)]+)[^)\n]*\)', 3) AS u FROM cap WHERE markdown IS NOT NULL)
      SELECT capture_id, CAST(unnest(range(len(t))) AS INT) AS ord, unnest(t) AS text, unnest(u) AS url FROM m""",
}
