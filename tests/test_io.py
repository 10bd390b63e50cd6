from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from papyrion.functions import templates
from papyrion.settings import Schedule
from papyrion.sinks import documents, files
from papyrion.sources import lists
from papyrion.sources.datasource import LlmsSource, SitemapSource, WorkbookSource
from papyrion.streaming.captures import ClipTable, classify_batch, stream_captures
from tests.conftest import rows


def workbook() -> bytes:
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>see https://a.test/1, ok</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>https://b.test/2</t></is></c><c><v>5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships><Relationship Target="https://c.test/3" TargetMode="External"/></Relationships>')
    return out.getvalue()


def test_lists(spark, tmp_path):
    (tmp_path / "u.txt").write_text(" https://a.test/1 \r\nftp://no\nhttps://a.test/1\nhttps://b.test/2", encoding="utf-8")
    (tmp_path / "t.txt").write_text("see (https://a.test/1), and https://b.test/2.", encoding="utf-8")
    (tmp_path / "c.csv").write_text('name,link\n"x ""q""\nmore","https://a.test/1"\n,https://b.test/2;\n', encoding="utf-8")
    (tmp_path / "w.xlsx").write_bytes(workbook())
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    urls = lambda df: [r["url"] for r in df.orderBy("ord").collect()]
    two = ["https://a.test/1", "https://b.test/2"]
    assert urls(lists.read_url_list(spark, str(tmp_path / "u.txt"))) == two == urls(lists.read_urls(spark, str(tmp_path / "t.txt")))
    assert sorted(urls(lists.read_urls(spark, str(tmp_path / "c.csv")))) == two
    assert urls(lists.read_urls(spark, str(tmp_path / "w.xlsx"))) == [*two, "https://c.test/3"] and urls(lists.read_urls(spark, str(tmp_path / "bad.xlsx"))) == []
    spark.dataSource.register(WorkbookSource)
    assert [r["url"] for r in spark.read.format("workbook").load(str(tmp_path / "w.xlsx")).orderBy("ord").collect()] == [*two, "https://c.test/3"]


def test_sources_of_folders_patterns_and_schemes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# T\n- [A](/a 't') [B](b)\nhttps://x.test/c [M](mailto:q)", encoding="utf-8")
    (tmp_path / "b.txt").write_text("- [D](d)", encoding="utf-8")
    (tmp_path / "c.md").write_text("- [E](e)", encoding="utf-8")
    spark.dataSource.register(LlmsSource)
    read = lambda path: sorted(r["url"] for r in spark.read.format("llms").option("base", "https://s.test/l/llms.txt").load(path).collect())
    assert read(str(tmp_path / "a.txt")) == ["https://s.test/a", "https://s.test/l/b", "https://x.test/c"]
    assert read(f"file://{tmp_path}/*.txt") == ["https://s.test/a", "https://s.test/l/b", "https://s.test/l/d", "https://x.test/c"]
    assert len(read(str(tmp_path))) == 5


def test_functions_for_sql(spark):
    templates.register_functions(spark)
    spark.createDataFrame([(1, "see [a](https://a.test/1) ![i](u) https://b.test/2.", bytearray(workbook())), (2, None, None)], "k long, t string, w binary").createOrReplaceTempView("texts")
    assert rows(spark.sql("select k, l.ord, l.text, l.url from texts, lateral markdown_links(t) l")) == [(1, 0, "a", "https://a.test/1")]
    assert rows(spark.sql("select k, l.url from texts, lateral text_urls(t) l")) == [(1, "https://a.test/1"), (1, "https://b.test/2")]
    assert rows(spark.sql("select l.value from texts, lateral workbook_cells(w) l"))[0] == ("5",)
    assert spark.sql("select render_template('{{a|upper}}!', map('a', 'x')) r, html_to_markdown('<b>y</b>') h").first()[:] == ("X!", "**y**")


def test_schedule():
    s = Schedule.load({"frequency": "hourly", "last_completed_at": 5})
    assert s == Schedule("off", 5) and s.with_frequency("weekly").completed(9).save() == {"frequency": "weekly", "last_completed_at": 9} and Schedule.load(None) == Schedule()


def test_clip_table_by_buckets(spark, tmp_path):
    table = ClipTable(spark, str(tmp_path / "clips"), 4)
    frame = lambda d: spark.createDataFrame(d, "url string, title string, markdown string, captured_at timestamp, error string")
    table.merge(frame([(f"https://a.test/{k}", "t", f"text {k}", datetime(2026, 1, 1), None) for k in range(40)]), 0)
    first = {r["url_key"]: r for r in table.read().collect()}
    table.merge(frame([("https://a.test/7#x", "new", "other", datetime(2026, 1, 2), None), ("https://a.test/8", None, None, datetime(2026, 1, 2), "failed")]), 1)
    second = {r["url_key"]: r for r in table.read().collect()}
    assert len(first) == len(second) == 40 and second["https://a.test/7"]["title"] == "new" and second["https://a.test/7"]["clipped"] == datetime(2026, 1, 1)
    assert {k for k in first if first[k] != second[k]} == {"https://a.test/7"}
    # Only the bucket of that address was written anew, and a batch that is run again changes nothing.
    assert len(list((tmp_path / "clips" / "batch-000000000001").glob("bucket=*"))) == 1
    table.merge(frame([("https://b.test/", "t", "x", datetime(2026, 1, 3), None)]), 1)
    assert table.read().count() == 40
    for n in range(2, 5):
        table.merge(frame([(f"https://a.test/{k}", "t", f"text {n}", datetime(2026, 2, n), None) for k in range(40)]), n)
    assert sorted(p.name for p in (tmp_path / "clips").glob("batch-*")) == ["batch-000000000003", "batch-000000000004"]


def test_discovery(spark, tmp_path):
    index = "<sitemapindex><sitemap><loc>https://s.test/2.xml</loc></sitemap><sitemap><loc>https://s.test/1.xml</loc></sitemap></sitemapindex>"
    pages = "<urlset><url><loc>https://s.test/a?x=1&amp;y=2</loc></url><url><loc> <![CDATA[https://s.test/b]]> </loc></url></urlset>"
    fetched = spark.createDataFrame([("https://s.test/1.xml", index), ("https://s.test/2.xml", pages)], "url string, body string")
    start = spark.createDataFrame([("https://s.test/1.xml",)], "url string")
    assert [r["url"] for r in lists.sitemap_pages(start, fetched).collect()] == ["https://s.test/a?x=1&y=2", "https://s.test/b"]
    assert lists.sitemap_pages(start, fetched, 1).count() == 1 and lists.sitemap_pages(start.where("false"), fetched).count() == 0
    llms = spark.createDataFrame([("https://s.test/llms.txt", "# T\n- [A](/a 't') [B](b)\nhttps://x.test/c [M](mailto:q)")], "url string, body string")
    assert [r["url"] for r in lists.llms_pages(llms).orderBy("ord").collect()] == ["https://s.test/a", "https://s.test/b", "https://x.test/c"]
    item = {"Id": 1, "Title": "", "FileRef": "/f", "GUID": "g", "Modified": "m", "FileLeafRef": "f.aspx"}
    answers = spark.createDataFrame([("c", 0, json.dumps({"value": [item]})), ("c", 1, json.dumps({"d": {"results": [item]}})), ("c", 2, "broken")], "collection_id string, request_no int, body string")
    got = lists.rest_pages(answers).orderBy("ord").collect()
    assert [(r["ord"], r["page"]["title"]) for r in got] == [(0, "f.aspx"), (100, "f.aspx")]
    assert lists.discover(llms.where("false"), start)[0] == "sitemap" and "skiptoken" in lists.rest_query("https://x", 100)
    (tmp_path / "s.xml").write_text(pages)
    spark.dataSource.register(SitemapSource)
    assert rows(spark.read.format("sitemap").load(str(tmp_path / "s.xml")).select("kind", "url")) == [("page", "https://s.test/a?x=1&y=2"), ("page", "https://s.test/b")]


def test_documents(spark):
    pages = spark.createDataFrame([("s", 2, "https://x.test/b c", "B]", "b c.md", "two"), ("s", 1, "https://x.test/a", None, "a.md", "one"), ("t", 1, "https://y.test", "T", "t.md", None)], "s string, ord int, url string, title string, path string, markdown string")
    index = {r["s"]: r["content"] for r in documents.index_document(pages, "s", "ord", F.col("s")).collect()}
    assert index["s"] == "# s\n\n2 pages.\n\n- [a.md](a.md)\n- [B\\]](b%20c.md)\n" and index["t"].startswith("# t\n\n1 page.")
    whole = {r["s"]: r["content"] for r in documents.aggregate_document(pages, "s", ["ord"]).collect()}
    assert whole["s"] == "# Site export\n\n2 pages.\n\n## Contents\n\n- [https://x.test/a](#1-httpsxtesta)\n- [B\\]](#2-b)\n\n## 1. https://x.test/a\n\nSource: https://x.test/a\n\none\n\n---\n\n## 2. B]\n\nSource: https://x.test/b c\n\ntwo\n\n---\n"
    clips = spark.createDataFrame([(1, "s", None, "a|b", "p", "u", "article", ["x|y"]), (2, "s", datetime(2026, 1, 2), None, "p", "u", "post", None)], "clip_id long, collection_id string, clipped timestamp, title string, clip_path string, url string, clip_type string, tags array<string>")
    table = documents.knowledge_index(clips, "collection_id").first()["content"]
    assert table.endswith("|  | p | u | 2026-01-02 | post |  |\n| a\\|b | p | u |  | article | x\\|y |\n") and "2 clips." in table
    report = documents.sync_report(spark.createDataFrame([("c", 3, 1, 1, 1, 1, 2)], "collection_id string, n_current long, n_updated long, n_unchanged long, n_retained long, n_failed long, n_removed long"), spark.createDataFrame([("c", "x.md")], "collection_id string, path string"), spark.createDataFrame([("c", "Name")], "collection_id string, collection_name string"), "2026-01-01").first()["content"]
    assert "Updated files: 1\n" in report and "No longer present: 1" in report and "- `x.md`" in report
    cat = documents.catalog_document(spark.createDataFrame([("c", "N|m", "website", "w/n m", "u", 2, None)], "collection_id string, name string, type string, folder string, source_url string, n_pages long, synced_at string")).first()
    assert "| [N\\|m](w/n%20m/index.md) | website | 2 |  |" in cat["content"] and json.loads(cat["json"])["collections"][0]["pageCount"] == 2
    records = documents.manifest_records(spark.createDataFrame([("c", "custom")], "collection_id string, collection_type string"), spark.createDataFrame([("c", "p.md", "u", "")], "collection_id string, path string, url string, title string"))
    text = documents.prompt(records, "collection_id", ["path"], "no such task").first()["content"]
    assert "| 1 | p.md | p.md | u |  |  |" in text and documents.TASKS["summary"] in text and "no files" in documents.empty_prompt()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("d/a.md", "ä", 1), ("b.md", "b", 0), ("c.md", None, 2)], "path string, content string, ord int")
    files.write_files(df.where("content is not null"), str(tmp_path / "out"))
    assert (tmp_path / "out/d/a.md").read_text(encoding="utf-8") == "ä"
    with pytest.raises(ValueError):
        files.safe_target(str(tmp_path), "../x")
    one, two = io.BytesIO(), io.BytesIO()
    assert files.write_zip(df, one, ["ord"]) == (2, 1) and files.write_zip(df, two, ["ord"]) == (2, 1) and one.getvalue() == two.getvalue()
    archive = zipfile.ZipFile(io.BytesIO(one.getvalue()))
    assert archive.namelist() == ["b.md", "d/a.md"] and archive.testzip() is None and archive.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert files.write_vault(df.where("ord = 1"), None, str(tmp_path / "dl")) == "downloads" and (tmp_path / "dl/a.md").exists()
    assert len(files.export(df.where("content is not null"), "both", str(tmp_path / "e"), ["ord"], "agg")) == 2
    table = spark.createDataFrame([('a"b', "x,y"), ("", "l\nm")], "p string, q string")
    assert [r["line"] for r in files.inventory_csv_lines(table).collect()] == ['"a""b","x,y"', ',"l\nm"']
    files.write_inventory_csv(table, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 2
    text = files.backup_settings({"a": 2, "zz": 1}, [{"pattern": "x"}])
    assert files.restore_settings(text, {"a": 1, "b": 3}) == ({"a": 2, "b": 3}, [{"pattern": "x"}])
    with pytest.raises(ValueError):
        files.restore_settings("[]", {})


def test_library_folders(tmp_path):
    root = str(tmp_path)
    files.write_manifest(root, "web/a", {"folder": "web/a", "files": ["old.md", {"path": "n.md", "url": "u", "title": "t", "contentHash": "h"}], "removedFromPreviousSync": ["gone.md", "x.md"]})
    for name in ("gone.md", "x.md"):
        (tmp_path / "web/a" / name).write_text(name)
    assert files.manifest_rows(files.read_manifest(root, "web/a")) == [("old.md", None, None, None), ("n.md", "u", "t", "h")] and files.read_manifest(root, "none") is None
    assert files.review_removed(root, "web/a", "gone.md", "archive", "2026-01-01") == 1 and (tmp_path / "web/a/_archive/2026-01-01/gone.md").exists() and not (tmp_path / "web/a/gone.md").exists()
    with pytest.raises(ValueError):
        files.review_removed(root, "web/a", "gone.md", "delete", "2026-01-01")
    for target in ("WEB/A", "web/a/b", "web"):
        with pytest.raises(ValueError):
            files.move_folder(root, "web/a", target)
    assert files.move_folder(root, "web/a", "lib/b") == 3 and files.read_manifest(root, "lib/b")["folder"] == "lib/b" and not (tmp_path / "web/a").exists()


def test_streaming_resumes(spark, tmp_path):
    source, table = tmp_path / "in", ClipTable(spark, str(tmp_path / "clips"))
    schema = "url string, html string, captured_at timestamp"

    def deliver(data):
        spark.createDataFrame(data, schema).write.mode("append").parquet(str(source))

    def run():
        q = stream_captures(spark, str(source), table, str(tmp_path / "cp"))
        q.awaitTermination(120)
        return {r["url_key"]: r for r in table.read().collect()}

    deliver([("https://a.test/1#x", "<p>one</p>", datetime(2026, 1, 1)), ("https://a.test/2", "<p>two</p>", datetime(2026, 1, 1))])
    first = run()
    assert set(first) == {"https://a.test/1", "https://a.test/2"}
    deliver([("https://a.test/1", "<p>changed</p>", datetime(2026, 1, 2)), ("https://a.test/3", "<p>three</p>", datetime(2026, 1, 2))])
    second = run()
    one = second["https://a.test/1"]
    assert len(second) == 3 and one["clip_id"] == first["https://a.test/1"]["clip_id"] and one["clipped"].day == 1 and one["updated_at"].day == 2
    assert second["https://a.test/2"] == first["https://a.test/2"]
    table.merge(spark.createDataFrame([], "url string, title string, markdown string, captured_at timestamp, error string"), 0)
    assert len(table.read().collect()) == 3
    captures = spark.createDataFrame([("https://a.test/3", "three"), ("https://a.test/2", "other"), ("https://n.test/", "")], "url string, markdown string")
    assert rows(classify_batch(captures, table.read())) == [("https://a.test/2", "changed"), ("https://a.test/3", "unchanged"), ("https://n.test/", "new")]
    assert Path(tmp_path / "clips/_current.json").exists()
