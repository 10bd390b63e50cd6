from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from papyrion.functions.hashing import fingerprint_markdown
from papyrion.operators import cliplog, collections, crawl, inventories, jobs, paths, posts, snapshots, sync, tags
from papyrion.operators.ordered import with_previous, with_rank
from papyrion.settings import Settings, migrate_collections
from tests.conftest import rows

PAGE = "struct<id:int,title:string,file_ref:string,guid:string,modified:string,url:string>"


def test_previous_and_rank_across_partitions(uncoalesced):
    random.seed(1)
    data = [(random.choice(["hot"] * 5 + ["a", None]), t, k) for k, t in enumerate(random.choices(range(50), k=400))]
    df = uncoalesced.createDataFrame(data, "g string, t int, id long")
    groups = defaultdict(list)
    for g, t, k in data:
        groups[g].append((t, k))
    before, rank = {}, {}
    for v in groups.values():
        v.sort()
        for i, (_, k) in enumerate(v):
            before[k], rank[k] = (v[i - 1][1] if i else None), i + 1
    got = {r["id"]: r["prev"] for r in with_previous(df, "g", ["t", "id"], "id", "prev").collect()}
    assert {k: None if v is None or v != v else int(v) for k, v in got.items()} == before
    assert {r["id"]: r["n"] for r in with_rank(df, "g", ["t", "id"], "n").collect()} == rank
    assert with_previous(df.where("false"), "g", ["t", "id"], "id", "prev").count() == with_rank(df.where("false"), "g", ["t", "id"], "n").count() == 0


def brute_changes(inventories_):
    """inventory_id, page_key, change_kind by plain loops."""
    from datetime import datetime, timezone

    def moment(m):
        if m is None:
            return None
        try:
            d = datetime.fromisoformat(m.strip().replace("Z", "+00:00"))
        except ValueError:
            return m.strip()
        return (d if d.tzinfo else d.replace(tzinfo=timezone.utc)).timestamp()

    def pages(ps):
        out = {}
        for p in ps:
            if p is None:
                continue
            key = next((f"{n}:{p[f].strip().lower()}" for n, f in (("path", 2), ("guid", 3), ("url", 5)) if p[f] and p[f].strip()), None)
            if key is not None:
                out.setdefault(key, ((p[1] or "").strip(), (p[5] or "").lower(), moment(p[4])))
        return out

    by, seen, out = defaultdict(list), set(), set()
    for i, c, t, ps in inventories_:
        if None not in (i, c, t, ps) and i not in seen:
            seen.add(i)
            by[c].append((t, i, pages(ps)))
    for snaps in by.values():
        snaps.sort(key=lambda x: x[:2])
        for (_, _, old), (_, i, new) in zip(snaps, snaps[1:], strict=False):
            out |= {(i, k, "added") for k in new.keys() - old.keys()} | {(i, k, "removed") for k in old.keys() - new.keys()} | {(i, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


SNAPS = f"inventory_id long, collection_id string, last_refreshed_at timestamp, pages array<{PAGE}>"


def test_snapshot_changes_by_brute_force(uncoalesced):
    from datetime import datetime, timedelta

    random.seed(2)
    t0, data = datetime(2026, 1, 1), []
    for k in range(60):
        pool = [(n, random.choice(["T", "T ", "U", None, ""]), random.choice([f"/p/{n}", f"/P/{n} ", None, " "]), random.choice([f"g{n}", None]), random.choice(["2026-01-01T00:00:00Z", "2026-01-01 00:00:00", "2026-01-01T02:00:00+02:00", "2026-01-02", None, "soon"]), f"https://x.test/{n}") for n in random.choices(range(40), k=random.choice([0, 3, 60]))]
        data.append((k, random.choice(["hot", "hot", "b", None]), t0 + timedelta(days=random.randrange(20)), random.choice([pool, pool, pool, pool + [None], None])))
    data += [data[3], data[7]]
    df = uncoalesced.createDataFrame(data, SNAPS).withColumn("page_key", F.lit("x")).withColumn("rows", F.lit(1))
    got = snapshots.snapshot_changes(df, chunk_rows=4)
    assert got.columns == ["inventory_id", "page_key", "change_kind"]
    assert {tuple(r) for r in got.collect()} == brute_changes(data) and got.count() == len(brute_changes(data))
    assert snapshots.snapshot_changes(df.where("false")).count() == 0


def test_snapshot_with_empty_list(spark):
    from datetime import datetime

    page = (1, "a", "/a", None, None, None)
    data = [(1, "c", datetime(2026, 1, 1), [page]), (2, "c", datetime(2026, 1, 2), []), (3, "c", datetime(2026, 1, 3), [page, page])]
    assert rows(snapshots.snapshot_changes(spark.createDataFrame(data, SNAPS))) == [(2, "path:/a", "removed"), (3, "path:/a", "added")]


def brute_unique(values):
    used, out = set(), []
    for p in values:
        base, dot, ext = p.rpartition(".")
        new, n = p, 0
        while new in used:
            n += 1
            new = f"{base}-{n}{dot}{ext}" if dot else f"{p}-{n}"
        used.add(new)
        out.append(new)
    return out


def test_unique_paths(uncoalesced):
    random.seed(3)
    values = ["a.md", "a.md", "a-1.md", "A.md", "d/a.md", "d/a.md"] + random.choices(["index.md"] * 4 + ["b.md", "b-1.md", "b-1-1.md", "c-2.md", "c.md"], k=120)
    df = uncoalesced.createDataFrame(list(enumerate(values)), "k long, p string")
    got = [r["u"] for r in paths.unique_paths(df, "p", ["k"], "u").orderBy("k").collect()]
    assert got == brute_unique(values) and len(set(got)) == len(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_unique_paths_among_numbered_ones(uncoalesced, seed):
    """Numbered paths block numbers, lose their own names, and pass both on to the paths numbered after them."""
    random.seed(seed)
    values = random.choices(["a.md", "a-1.md", "a-2.md", "a-3.md", "a-1-1.md", "a-1-2.md", "a-2-1.md", "a-1-1-1.md", "b.md", "a-5.md", "a-01.md", "c", "c-1", None], k=70)
    df = uncoalesced.createDataFrame(list(enumerate(values)), "k long, p string")
    got = {r["k"]: r["u"] for r in paths.unique_paths(df, "p", ["k"], "u").collect()}
    named = [(k, v) for k, v in enumerate(values) if v is not None]
    assert [got[k] for k, _ in named] == brute_unique([v for _, v in named]) and all(got[k] is None for k, v in enumerate(values) if v is None)
    assert paths.unique_paths(df.where("false"), "p", ["k"], "u").count() == 0


def test_crawl_of_many_seeds(spark):
    """Seeds beyond the cap aren't captured, failed ones don't count, and the order is kept."""
    seeds = spark.createDataFrame([(f"https://s.test/{k}", k) for k in range(40)], "url string, ord long")
    site = spark.createDataFrame([(f"https://s.test/{k}", [], None) for k in range(40) if k % 3], "url string, links array<string>, error string")
    got = crawl.crawl_site(seeds, site, crawl.CrawlOptions(max_pages=10), "https://s.test/").pages.collect()
    ok = [k for k in range(40) if k % 3][:10]
    assert {r["url"] for r in got if r["error"] is None} == {f"https://s.test/{k}" for k in ok}
    assert {r["url"] for r in got if r["error"]} == {f"https://s.test/{k}" for k in range(0, ok[-1], 3)}


def test_reconcile(spark):
    page = lambda n, title="t", ref=None: (n, title, ref or f"/p{n}", None, None, f"u{n}")
    schema = f"s string, ord int, page {PAGE}"
    old = spark.createDataFrame([("x", 0, page(1)), ("x", 1, page(2)), ("x", 2, page(3)), ("x", 3, page(3, "dup"))], schema)
    new = spark.createDataFrame([("x", 0, page(1)), ("x", 1, page(2, "new")), ("x", 2, page(4))], schema)
    changes = inventories.reconcile(old, new, ["s"])
    assert rows(changes.select("page_key", "change")) == [("path:/p1", "unchanged"), ("path:/p2", "updated"), ("path:/p3", "removed"), ("path:/p4", "new")]
    counts = inventories.refresh_summary(inventories.reconcile_counts(changes, ["s"])).first()
    assert counts["summary"] == "1 new, 1 updated, 1 no longer present." and counts["needs_confirmation"] is False
    stored = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    assert rows(inventories.replace_snapshot(stored, spark.createDataFrame([("x", 9)], "k string, v int"), "k")) == [("x", 9), ("y", 2)]


COLLECTION = "collection_id string, collection_name string, collection_type string, source_mode string, source_url string, web_url string, library_path string, urls array<string>, added_at timestamp"


def test_collections(spark):
    df = spark.createDataFrame([("a", "A", "website", "sitemap", None, "https://x.test/", None, ["https://y.test/p#f"], None), ("b", "B", "custom", "list", None, "https://x.test/docs", None, [], None), ("c", None, None, "crawl", "https://t.sharepoint.com/sites/q", None, "lib/Q", None, None)], COLLECTION)
    pages = spark.createDataFrame([(1, "https://x.test/docs/a"), (2, "https://x.test/docsx"), (3, "https://y.test/p"), (4, "https://z.test"), (5, "https://x.test/docs?q=/"), (6, None)], "k long, url string")
    assert rows(collections.match_collections(pages, df, "k")) == [(1, "b"), (2, "a"), (3, "a"), (5, "b")]
    normal = {r["collection_id"]: r for r in collections.normalize_collections(df).collect()}
    assert normal["c"]["collection_type"] == "sharepoint" and normal["c"]["collection_name"] == "q" and normal["c"]["urls"] == []
    presets = {r["collection_id"]: tuple(r)[1:] for r in collections.export_preset(df, spark.createDataFrame([("b", " https://x.test/1 ")], "collection_id string, url string")).collect()}
    assert presets["a"][0] == "list" and presets["b"] == ("list", "https://x.test/docs", 1, 1, "") and presets["c"] == ("crawl", "https://t.sharepoint.com/sites/q", 25, 0, "/SitePages/")
    assert rows(collections.unique_folders(collections.normalize_collections(df).withColumn("library_path", F.lit("Lib/X"))))[1][1] == "Lib/X-2"
    assert rows(collections.reject_duplicates(df, df.where("collection_id = 'a'").withColumn("web_url", F.lit("HTTPS://X.test/"))).select("collection_id")) == [("b",), ("c",)]
    assert rows(collections.refreshable(df).select("collection_id")) == [("a",)]
    merged = collections.upsert_custom_list(df, df.where("collection_id = 'b'").withColumn("collection_name", F.lit("b")).withColumn("urls", F.array(F.lit("u"))))
    assert merged.count() == 3 and merged.where("collection_id = 'b'").first()["urls"] == ["u"]
    assert collections.folder_taken(df.where("collection_id = 'c'"), "LIB/q", "a") and not collections.folder_taken(df.where("collection_id = 'c'"), "LIB/q", "c")


CLIP = "clip_id long, url string, title string, clip_path string, clip_type string, clipped timestamp, content_fingerprint string, preview_fingerprint string"


def test_clip_log(spark):
    from datetime import datetime

    clips = spark.createDataFrame([(1, "https://x.test/a#1", "old", "a.md", "article", datetime(2026, 1, 1), "f1", None), (2, "https://x.test/a", "new", "a2.md", "post", datetime(2026, 1, 2), "f2", ""), (3, "https://X.test/b", "b", "b.md", "article", None, None, None)], CLIP)
    assert [r["clip_id"] for r in cliplog.list_clips(clips).collect()] == [2, 1, 3]
    assert [r["clip_id"] for r in cliplog.list_clips(clips, F.lit("2026-01-01").cast("timestamp"), "article", 5).collect()] == [1]
    pages = spark.createDataFrame([("https://x.test/a#z", "f2"), ("https://x.test/b", "q"), ("https://x.test/c", "q"), ("https://l.test/", "q")], "url string, fingerprint string")
    assert rows(cliplog.find_clips(pages, clips).select("url", "clip_id")) == [("https://l.test/", None), ("https://x.test/a#z", 2), ("https://x.test/b", 3), ("https://x.test/c", None)]
    library = spark.createDataFrame([("https://l.test",)], "url string")
    assert {r["url"]: r["state"] for r in cliplog.page_state(pages, library, clips).collect()} == {"https://x.test/a#z": "current", "https://x.test/b": "known", "https://x.test/c": "unknown", "https://l.test/": "stored"}
    again = spark.createDataFrame([(9, "https://x.test/a", "newest", "z.md", "post", datetime(2026, 2, 1), "f9", None), (10, "https://n.test/", "n", "n.md", "post", None, None, None)], CLIP)
    got = {r["clip_id"]: r for r in cliplog.upsert_clips(clips, again).collect()}
    assert set(got) == {1, 2, 3, 10} and (got[2]["title"], got[2]["clip_path"], got[2]["clipped"].day, got[2]["content_fingerprint"]) == ("newest", "a2.md", 2, "f9")
    one = cliplog.activity(clips, spark.range(4)).first()
    assert tuple(one) == (3, 1, 4, "2026-01-02T00:00:00.000Z") and tuple(cliplog.activity(clips.where("false"), spark.range(0)).first()) == (0, 0, 0, "")
    assert cliplog.delete_clips(clips, spark.createDataFrame([(1,)], "clip_id long")).count() == 2


def test_tag_rules(spark):
    df = spark.createDataFrame([("https://a.test/x", "Big Title", "some ТЕКСТ here"), (None, None, None)], "url string, title string, text string")
    rules = [tags.TagRule("text", "текст", tags=("t", " t ", "")), tags.TagRule("title", r"^big\s", True, ("b", "t")), tags.TagRule("any", "(bad", True, ("never",)), tags.TagRule("any", "", False, ("never",))]
    got = tags.tag_documents(df, rules, {c: F.col(c) for c in df.columns}, own=F.array(F.lit("b"), F.lit(" "))).select("tags").collect()
    assert [r[0] for r in got] == [["b", "t"], ["b"]]
    assert tags.valid_patterns(spark, ["a", "("]) == (["a"], ["("])


def test_sync(spark):
    f = "collection_id string, path string, url string, title string, content string"
    first = spark.createDataFrame([("c", "a.md", "https://x.test/a", "A", "---\ncaptured: 1\n---\n\nA"), ("c", "b.md", "https://x.test/b", "B", "B"), ("c", "g.md", "https://x.test/g", "G", "G")], f)
    nothing = spark.createDataFrame([], "collection_id string, path string, url string, title string, content_hash string")
    plan = sync.sync_plan(first, nothing)
    assert {r["action"] for r in plan.collect()} == {"write"}
    previous = sync.manifest_files(plan).select(nothing.columns).unionByName(spark.createDataFrame([("c", "old.md", None, None, None)], nothing.schema))
    second = spark.createDataFrame([("c", "a.md", "https://x.test/a#s", "A", "---\ncaptured: 2\n---\n\nA")], f)
    expected = spark.createDataFrame([("c", "https://x.test/a"), ("c", "https://x.test/b")], "collection_id string, url string")
    errors = spark.createDataFrame([("c", "https://x.test/b", "")], "collection_id string, url string, error string")
    got = sync.sync_plan(second, previous, expected, errors)
    assert {r["path"]: (r["action"], r["capture_error"]) for r in got.collect()} == {"a.md": ("unchanged", None), "b.md": ("error", "Capture failed"), "g.md": ("removed", None), "old.md": ("removed", None)}
    assert {r["path"]: r["action"] for r in sync.sync_plan(second, previous, hash_scope="file").collect()}["a.md"] == "write"
    assert tuple(sync.sync_counts(got).first()) == ("c", 2, 0, 1, 1, 1, 2)
    pending = spark.createDataFrame([("c", "a.md"), ("c", "z.md")], "collection_id string, path string")
    assert rows(sync.pending_removals(got, pending)) == [("c", "g.md"), ("c", "old.md"), ("c", "z.md")]


def test_crawl(spark):
    base = "https://s.test"
    graph = {"/": ["/a", "/b", "https://other.test/x"], "/a": ["/c", "/"], "/b": ["/d#x", "/bad"], "/c": ["/e"], "/d": [], "/e": []}
    site = spark.createDataFrame([(base + u, [v if v.startswith("http") else base + v for v in links], "boom" if u == "/b2" else None) for u, links in graph.items()], "url string, links array<string>, error string")
    seeds = spark.createDataFrame([(base + "/", 0), (base + "/#again", 1)], "url string, ord long")
    urls = lambda state: [r["url"].removeprefix(base) for r in state.pages.where("error is null").orderBy("ord").collect()]
    full = crawl.crawl_site(seeds, site, crawl.CrawlOptions(follow_links=True), base)
    assert urls(full) == ["/", "/a", "/b", "/c", "/d#x", "/e"] or urls(full)[:4] == ["/", "/a", "/b", "/c"]
    assert [r["url"] for r in full.pages.where("error is not null").collect()] == [base + "/bad"]
    assert urls(crawl.crawl_site(seeds, site, crawl.CrawlOptions(max_pages=3, follow_links=True), base)) == ["/", "/a", "/b"]
    assert urls(crawl.crawl_site(seeds, site, crawl.CrawlOptions(max_depth=1, follow_links=True, exclude=["/b$", "(bad"]), base)) == ["/", "/a"]
    assert urls(crawl.crawl_site(seeds, site, crawl.CrawlOptions(follow_links=True, include=["/a"]), base)) == ["/", "/a"]
    state = crawl.start(seeds, crawl.CrawlOptions(follow_links=True))
    assert urls(crawl.advance(state, site, crawl.CrawlOptions(follow_links=True), base)) == ["/"]
    assert crawl.patterns("a\n\n b ") == ["a", "b"] and crawl.capture_concurrency(["https://x.test"], False, 5) == 2 and crawl.capture_concurrency([], True, 5) == 1


def test_jobs(spark):
    caps = spark.createDataFrame([("j", "u1", None, "x"), ("j", "u2", "e", None), ("j", "u2", "e", None)], "job_id string, url string, error string, markdown string")
    assert tuple(jobs.job_stats(caps).first()) == ("j", 1, 2) and rows(jobs.failed_urls(caps)) == [("j", "u2")]
    assert tuple(jobs.missing_bodies(caps.select("job_id", "url"), caps.where("markdown is not null")).first()) == ("j", 3, 2)
    log = spark.createDataFrame([("j", [str(k) for k in range(299)])], "job_id string, lines array<string>")
    got = jobs.append_log(log, spark.createDataFrame([("j", ["a", "b"]), ("k", ["c"])], log.schema)).orderBy("job_id").collect()
    assert len(got[0]["lines"]) == 300 and got[0]["lines"][-1] == "b" and got[0]["lines"][0] == "1" and got[1]["lines"] == ["c"]
    assert jobs.transition("running", "pause") == "paused" and jobs.transition("done", "pause") == "done"
    p = jobs.job_progress(spark.createDataFrame([("running", 3, 1, 10, 8, 4000), ("done", 3, 1, 10, 8, 4000), ("running", 0, 0, 0, 25, 0)], "status string, n_captured long, n_failed long, n_queued long, max_pages long, elapsed_ms long")).select("progress.*").collect()
    assert [(r["total"], r["percent"], r["eta_ms"]) for r in p] == [(9, 44, 5000), (4, 100, None), (0, 0, None)]
    q = jobs.SyncQueue(["a", "b", "a"])
    q.advance()
    assert jobs.SyncQueue.restore(q.saved(), ["a", "b"]).current() == "b" and jobs.SyncQueue.restore(q.saved(), ["a", "c"]).current() == "a"


def test_posts(spark):
    import json

    user = {"name": "Ann", "screen_name": "ann"}
    raw = {"id_str": "1", "created_at": "2026-01-02T00:00:00Z", "text": "😀 hi &amp; https://t.co/x   tail", "display_text_range": [0, 27], "user": user, "entities": {"urls": [{"url": "https://t.co/x", "expanded_url": "https://real.test"}]}, "mediaDetails": [{"type": "photo", "media_url_https": "https://p.test/1.jpg"}], "quoted_tweet": {"id_str": "2", "text": "q", "user": {"name": "Bob", "screen_name": "bob"}}}
    post = posts.normalize(raw)
    assert post["text"] == "😀 hi & https://real.test" and post["quoted"]["handle"] == "bob" and post["permalink"].endswith("/ann/status/1")
    shown = posts.to_markdown(post, [posts.normalize({"id_str": "3", "text": "more", "user": user})])
    assert shown.startswith("> **Ann** (@ann) · 2026-01-02\n>\n> 😀 hi") and ">> q" in shown and "![tweet image]" in shown and "follow-up" in shown
    assert posts.to_markdown(posts.normalize({"retweeted_status": raw, "user": {"screen_name": "zed"}})).startswith("> Reposted by **@zed**")
    focal = spark.createDataFrame([("1", json.dumps(raw), ["3", "4", "5"]), ("9", "broken", None)], "post_id string, payload string, reply_ids array<string>")
    replies = spark.createDataFrame([("5", json.dumps({"id_str": "5", "text": "five", "user": user})), ("3", json.dumps({"id_str": "3", "text": "three", "user": user})), ("4", "{")], "post_id string, payload string")
    got = {r["post_id"]: r["markdown"] for r in posts.threads(focal, replies).collect()}
    assert got["9"] is None and got["1"].index("> three") < got["1"].index("> five")
    parsed = focal.select(posts.parse_post("payload").alias("p")).select("p.handle").collect()
    assert [r[0] for r in parsed] == ["ann", None]
    df = spark.createDataFrame([("https://x.com/Ann/status/12?s=1",), ("https://x.com/Ann",)], "u string").select(posts.post_parts(F.col("u")).alias("p")).collect()
    assert tuple(df[0]["p"]) == ("Ann", "12") and df[1]["p"] is None and posts.syndication_token("1234567890123456789").isalnum()


def test_settings():
    got = Settings.load({"max_pages": 9999, "mode": "odd", "load_step_ms": "x", "unknown": 1})
    assert (got.max_pages, got.mode, got.load_step_ms) == (500, "auto", 450) and Settings.load(got.save()) == got
    assert migrate_collections({"sites": [{"id": "1", "name": "n", "url": "u"}]})[0]["web_url"] == "u" and migrate_collections(None) == []


@pytest.mark.parametrize("name", ["sync_plan", "page_capture", "link_distances", "rendered_templates"])
def test_queries_run(spark, data, name):
    from papyrion.plans.queries import QUERIES

    assert QUERIES[name](spark, data).count() > 0


def test_fingerprints_survive_layout(spark):
    df = spark.createDataFrame([("a \n\n\n b",), ("a\r\n\r\n b\t",)], "t string")
    assert df.select(fingerprint_markdown(F.col("t")).alias("f")).distinct().count() == 1
