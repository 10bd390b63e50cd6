"""Documents made of many rows: index, aggregate, knowledge index, prompt, catalog and report, as ordered concatenations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.scalars import escape_cell, escape_link_text, heading_anchor, iso_day
from papyrion.functions.urls import encode_path_for_link
from papyrion.operators.ordered import with_rank

# Tasks of a prompt.
TASKS = {
    "summary": "Write a summary of the listed files: main points first, each with its source.",
    "compare": "Compare what the listed files say: where they agree, where they differ, and what is open.",
    "timeline": "Put the events that the listed files tell of in order of time.",
    "questions": "List the questions that the listed files answer, and those they raise.",
}


def join_lines(line: Column | str, order: list[str], sep: str = "\n") -> Column:
    """The lines of a group in the order of the columns ``order``, as one text."""
    pair = F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], (F.col(line) if isinstance(line, str) else line).alias("line"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["line"]), sep)


def _count(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}.").otherwise(f" {one}s."))


def index_document(files: DataFrame, scope: str, order: str, title: Column) -> DataFrame:
    """scope and content: a title, the number of pages, and a link for each file (path, title), in order.

    A scope is one export, whose index is one file by nature; the files themselves stay distributed.
    """
    name = escape_link_text(F.coalesce(F.nullif("title", F.lit("")), F.col("path")))
    line = F.concat(F.lit("- ["), name, F.lit("]("), encode_path_for_link(F.col("path")), F.lit(")"))
    rows = files.withColumn("_title", title).groupBy(scope).agg(F.min("_title").alias("_title"), F.count("*").alias("_n"), join_lines(line, [order]).alias("_lines"))
    return rows.select(scope, F.concat(F.lit("# "), "_title", F.lit("\n\n"), _count(F.col("_n"), "page"), F.lit("\n\n"), "_lines", F.lit("\n")).alias("content"))


def aggregate_sections(pages: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """scope, n, toc and section of every page: what an aggregate document is put together of. A part can be written per partition."""
    ranked = with_rank(pages, scope, order, "n")
    name = F.coalesce(F.nullif("title", F.lit("")), F.col("url"))
    heading = F.concat(F.col("n").cast("string"), F.lit(". "), name)
    toc = F.concat(F.lit("- ["), escape_link_text(name), F.lit("](#"), heading_anchor(heading), F.lit(")"))
    section = F.concat(F.lit("## "), heading, F.lit("\n\nSource: "), F.col("url"), F.lit("\n\n"), F.trim(F.coalesce("markdown", F.lit(""))), F.lit("\n\n---\n"))
    return ranked.select(scope, "n", toc.alias("toc"), section.alias("section"))


def aggregate_document(pages: DataFrame, scope: str, order: list[str], title: str = "Site export") -> DataFrame:
    """scope and content: contents and numbered sections of all pages of a scope in one text."""
    parts = aggregate_sections(pages, scope, order)
    rows = parts.groupBy(scope).agg(F.count("*").alias("_n"), join_lines("toc", ["n"]).alias("_toc"), join_lines("section", ["n"]).alias("_sections"))
    text = F.concat(F.lit(f"# {title}\n\n"), _count(F.col("_n"), "page"), F.lit("\n\n## Contents\n\n"), F.col("_toc"), F.lit("\n\n"), F.col("_sections"))
    return rows.select(scope, F.concat(F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\n+\z", "")), F.lit("\n")).alias("content"))


def index_rows(clips: DataFrame) -> DataFrame:
    """clip_id, clipped and the table line of every clip."""
    tags = F.coalesce(F.array_join(F.transform("tags", escape_cell), ", "), F.lit(""))
    day = F.coalesce(F.date_format("clipped", "yyyy-MM-dd"), F.lit(""))
    cells = [escape_cell(F.col("title")), escape_cell(F.col("clip_path")), escape_cell(F.col("url")), day, escape_cell(F.col("clip_type")), tags]
    return clips.select("clip_id", "collection_id", "clipped", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def knowledge_index(clips: DataFrame, scope: str, title: str = "Knowledge base", description: str = "") -> DataFrame:
    """scope and content: a table of all clips of a scope, newest first, undated ones last."""
    rows = index_rows(clips).withColumn("_late", F.col("clipped").isNull()).withColumn("_time", -F.coalesce(F.unix_micros("clipped"), F.lit(0)))
    lines = rows.groupBy(scope).agg(F.count("*").alias("_n"), join_lines("line", ["_late", "_time", "clip_id"]).alias("_lines"))
    summary = F.lit(description) if description else _count(F.col("_n"), "clip")
    head = "| title | path | source_url | clipped | type | tags |\n| --- | --- | --- | --- | --- | --- |\n"
    return lines.select(scope, F.concat(F.lit(f"# {title}\n\n"), summary, F.lit("\n\n" + head), "_lines", F.lit("\n")).alias("content"))


def prompt(records: DataFrame, scope: str, order: list[str], task: str = "summary", label: str = "All saved clips", folder: str = "") -> DataFrame:
    """scope and content: instructions, an inventory table of the records (title, path, url, clipped text, tags), and the task; an unknown task is the first."""
    ranked = with_rank(records, scope, order, "n")
    tags = F.coalesce(F.array_join(F.transform("tags", escape_cell), ", "), F.lit(""))
    cells = [F.col("n").cast("string"), escape_cell(F.col("title")), escape_cell(F.col("path")), escape_cell(F.col("url")), F.when(F.coalesce("clipped", F.lit("")) == "", "").otherwise(iso_day(F.col("clipped"))), tags]
    lines = ranked.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))).groupBy(scope).agg(join_lines("line", ["n"]).alias("_lines"))
    head = f"SCOPE: {label}\nSOURCE FOLDER: {folder or 'not configured'}\n\nRead the files named below before you answer, and cite each file's source_url.\n\nINVENTORY\n\n| # | title | file | source_url | clipped | tags |\n| --- | --- | --- | --- | --- | --- |\n"
    tail = f"\n\nTASK\n\n{TASKS.get(task, TASKS['summary'])}\n\nSay also what the files leave out."
    return lines.select(scope, F.concat(F.lit(head), "_lines", F.lit(tail)).alias("content"))


def empty_prompt(label: str = "All saved clips") -> str:
    return f"SCOPE: {label}\n\nThere are no files in this scope. Clip some pages first."


def manifest_records(collections: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest files as records of a prompt."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("path", F.lit("")), F.lit("Untitled page"))
    kinds = collections.select("collection_id", F.coalesce("collection_type", F.lit("collection")).alias("clip_type"))
    return files.join(kinds, "collection_id", "left").select("collection_id", title.alias("title"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("url", F.lit("")).alias("url"), F.lit("").alias("clipped"), "clip_type", F.array().cast("array<string>").alias("tags"))


def sync_report(counts: DataFrame, removed: DataFrame, names: DataFrame, synced_at: str) -> DataFrame:
    """collection_id and content: the counts of a sync and the files that are no longer present.

    ``counts`` is of sync_counts; ``removed`` has collection_id and path; ``names`` collection_id and collection_name.
    """
    gone = removed.groupBy("collection_id").agg(F.count("*").alias("_gone"), join_lines(F.concat(F.lit("- `"), "path", F.lit("`")), ["path"]).alias("_paths"))
    rows = counts.join(names, "collection_id").join(gone, "collection_id", "left")
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit("\n"))
    text = F.concat(F.lit("# "), "collection_name", F.lit(f" sync report\n\nLast synced: {synced_at}\n\n"), line("Current pages", "n_current"), line("Updated files", "n_updated"), line("Unchanged files", "n_unchanged"), line("Retained after capture issues", "n_retained"), line("Capture failures", "n_failed"), line("No longer present", "_gone"))
    review = F.concat(F.lit("\n## No longer present\n\nNothing was deleted. Review these files before you remove them.\n\n"), "_paths", F.lit("\n"))
    return rows.select("collection_id", F.concat(text, F.coalesce(review, F.lit(""))).alias("content"))


def catalog_document(catalog: DataFrame) -> DataFrame:
    """One row, content and json: the table of all synced collections."""
    link = F.concat(encode_path_for_link(F.col("folder")), F.lit("/index.md"))
    line = F.concat(F.lit("| ["), F.replace("name", F.lit("|"), F.lit("\\|")), F.lit("]("), link, F.lit(") | "), "type", F.lit(" | "), F.col("n_pages").cast("string"), F.lit(" | "), F.coalesce("synced_at", F.lit("")), F.lit(" |"))
    entry = F.to_json(F.struct(F.col("collection_id").alias("id"), "name", "type", "folder", F.col("source_url").alias("sourceUrl"), F.col("n_pages").alias("pageCount"), F.col("synced_at").alias("syncedAt")), {"ignoreNullFields": "false"})
    n = F.count("*")
    head = F.concat(F.lit("# Collections\n\n"), n.cast("string"), F.when(n == 1, " synced collection.").otherwise(" synced collections."), F.lit("\n\n| Collection | Type | Pages | Last synced |\n| --- | --- | ---: | --- |\n"))
    rows = catalog.withColumn("line", line).withColumn("entry", entry)
    return rows.agg(F.concat(head, join_lines("line", ["name", "collection_id"]), F.lit("\n")).alias("content"), F.concat(F.lit('{"version":1,"collections":['), join_lines("entry", ["name", "collection_id"], ","), F.lit("]}")).alias("json"))
