from __future__ import annotations

import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrion.functions import compose, hashing, scalars, templates, text, urls


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


def many(spark, values, expr):
    return [r["r"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", expr(F.col("v")).alias("r")).orderBy("k").collect()]


def test_text(spark):
    assert one(spark, "  a﻿　b \n", text.clean_text) == "a b"
    assert one(spark, "a  \r\n\r\n\r\n\r\nb c\t\n", text.normalize_markdown) == "a\n\nb c"
    assert one(spark, "\n\n  a \n\n\n\nb\n", text.normalize_fingerprint_content) == "  a\n\nb"
    assert one(spark, "  ", text.non_blank) is None
    same = ["2026-01-01T02:00:00+02:00", "2026-01-01T00:00:00Z", "2026-01-01 00:00:00", "2026-01-01T00:00:00.000Z", "2026-01-01"]
    assert len(set(many(spark, same, text.parse_moment))) == 1
    assert many(spark, ["yesterday", None, ""], text.parse_moment) == [None] * 3


def test_urls(spark):
    got = many(spark, ["HTTPS://Ex.Test:443/A?b#c", "http://x.test:80", "http://x.test?q=1", "not a url", None, "http://u:p@h.test:8080/x#"], urls.comparable_url)
    assert got == ["https://ex.test/A?b", "http://x.test/", "http://x.test/?q=1", "not a url", None, "http://h.test:8080/x"]
    got = many(spark, ["https://a.test/", "https://a.test/x/y.html", "https://a.test/con/a%20b/", "https://a.test/a+b/%zz", "?"], urls.relative_markdown_path)
    assert got == ["index.md", "x/y.md", "_con/a b.md", "a+b/%zz.md", "index.md"]
    assert one(spark, "a b/ü(1).md", urls.encode_path_for_link) == "a%20b/%C3%BC(1).md"
    assert many(spark, ["Ünïcode's “Tëst” ﬁ ½", "日本", "a--b!!", None, "x" * 100], urls.slugify) == ["unicodes-test-fi-1-2", "page", "a-b", "page", "x" * 80]
    assert many(spark, ['a/b:c?"d"', " . ", "x.  "], urls.sanitize_filename) == ["a b c d", "page", "x"]
    assert one(spark, "..\\a//./Con/b.", urls.normalize_library_path) == "a/_Con/b"
    assert many(spark, ["a.MD", "a"], urls.with_markdown_extension) == ["a.MD", "a.md"]
    assert many(spark, ["https://t.sharepoint.com/sites/x", "https://a.atlassian.net/wiki/x", "https://b.test/display/X", "https://b.test"], urls.classify_collection_url) == ["sharepoint", "confluence", "confluence", "website"]
    site = one(spark, "https://Acme.sharepoint.com/sites/Team%20A/Pages/x.aspx", urls.sharepoint_site)
    assert (site["tenant"], site["site_path"], site["name"], site["error"]) == ("acme", "/sites/Team%20A", "Team A", None)
    assert one(spark, "https://x.test", urls.sharepoint_site)["error"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abAB:/?#.-% é", max_size=20), min_size=1, max_size=10))
def test_canonical_url_is_idempotent(spark, tails):
    values = [f"HTTP://Host.Test{t}" for t in tails]
    once = many(spark, values, urls.comparable_url)
    assert many(spark, once, urls.comparable_url) == once


def brute_fnv(value: str) -> str:
    h = 2166136261
    data = value.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[k : k + 2], "little")) * 16777619) & 0xFFFFFFFF
    return f"fnv1a-{h:08x}"


def test_hashes(spark):
    values = ["hello", "", "😀 astral", "x" * 3000, "é\n"]
    assert many(spark, [*values, None], hashing.fnv1a) == [*map(brute_fnv, values), None]
    assert brute_fnv("hello") == "fnv1a-4f9f2cab"
    assert len(set(many(spark, ["a\n\n\nb", "a  \r\n\r\nb\n"], hashing.fingerprint_markdown))) == 1
    assert one(spark, "123456789", hashing.crc32) == zlib.crc32(b"123456789") == 0xCBF43926
    df = spark.createDataFrame([(None, "a"), ("a", "a"), ("a", "b")], "s string, c string")
    assert [r[0] for r in df.select(hashing.compare_fingerprint(F.col("s"), F.col("c"))).collect()] == ["unknown", "current", "changed"]


def test_scalars(spark):
    assert many(spark, ["a|b\nc", None], scalars.escape_cell) == ["a\\|b c", ""]
    assert many(spark, ["2026-02-03T23:00:00-05:00", "soon|er", None], scalars.iso_day) == ["2026-02-04", "soon\\|er", ""]
    assert one(spark, "&amp;lt; &lt;&#39;", scalars.decode_entities) == "&lt; <'"
    assert one(spark, "1. Hello, World-x!", scalars.heading_anchor) == "1-hello-world-x"
    assert many(spark, ["7", "x", None, "99"], lambda c: scalars.clamp(c, 1, 10, 5)) == [7.0, 5.0, 5.0, 10.0]
    assert one(spark, 3661.2, scalars.format_clock, "double") == "01:01:02"
    df = spark.createDataFrame([(5, 3), (4, 3), (1, 0), (0, 0), (8, 7), (5, 9)], "b int, a int")
    assert [r[0] for r in df.select(scalars.reduction_needs_confirmation(F.col("b"), F.col("a"))).collect()] == [True, False, True, False, False, False]


def test_front_matter_and_documents(spark):
    df = spark.createDataFrame([("T: 1", "https://x.test/a", "", ["a", "true"], "# T: 1\n\nBody  \n\n\n\nEnd")], "title string, url string, author string, tags array<string>, body string")
    props = compose.default_properties({"title": F.col("title"), "url": F.col("url"), "author": F.col("author"), "tags": F.col("tags")})
    got = df.select(compose.compose_document(F.col("title"), F.col("body"), props), compose.compose_document(F.col("title"), F.col("body"), props, "list", False), compose.compose_document(F.col("title"), F.col("body"), props, "none")).first()
    assert got[0] == '---\ntitle: "T: 1"\nsource: "https://x.test/a"\ntags:\n  - a\n  - "true"\n---\n\n# T: 1\n\nBody\n\nEnd\n'
    assert got[1] == "Source: https://x.test/a\nTags: a, true\n\nBody\n\nEnd\n"
    assert got[2] == "# T: 1\n\nBody\n\nEnd\n"
    kb = df.select(compose.knowledge_base_front_matter({"title": F.col("title"), "url": F.col("url")}, F.lit("confluence"), F.col("body"))).first()[0]
    assert "type: confluence" in kb and "path: a.md" in kb and "description: " in kb
    assert many(spark, ["-x", "1a", "no", "plain", 'q"\\', " s"], compose.yaml_scalar) == ['"-x"', '"1a"', '"no"', "plain", '"q\\"\\\\"', '" s"']
    assert many(spark, ["# A\n[l](u) `c` *b*", "w" * 300, "ab " * 100], compose.auto_description) == ["A l b", "w" * 200 + "...", ("ab " * 67)[:200].rsplit(" ", 1)[0].strip() + "..."]
    assert many(spark, ["![i](u)\n\n# Ti  tle\n\nx", "# Other\n\nx", "text\n# Title"], lambda c: compose.drop_lead_heading(c, F.lit("ti tle"))) == ["![i](u)\n\n\nx", "# Other\n\nx", "text\n# Title"]
    assert one(spark, " a, ,b ", compose.parse_tags) == ["a", "b"]


def test_templates(spark):
    values = {"title": "Hello World!", "meta:og:image": "https://x/i.png", "x": "banana", "d": "2026-02-03T12:00:00Z", "e": ""}
    cases = {"# {{title}}": "# Hello World!", "a {{missing}} b": "a  b", "{{meta:og:image}}": "https://x/i.png", "{{title|slug}}": "hello-world", "{{e|default:none}}": "none", "{{x|truncate:3}}": "ban...", "{{x|replace:a,b}}": "bbnbnb", "{{d|date:YYYY/MM/DD}}": "2026/02/03", "{{x|date}}": "banana", "{{x|upper}}": "BANANA"}
    df = spark.createDataFrame([(t, values) for t in cases] + [(None, values)], "t string, v map<string,string>")
    assert [r[0] for r in df.select(templates.render_template("t", "v")).collect()] == [*cases.values(), None]
    refs = spark.createDataFrame([("{{selector:.byline}} {{title}} {{selector:.date|trim}}", "{{selector:.byline}}")], "a string, b string").select(templates.selector_refs(F.col("a"), F.col("b"))).first()[0]
    assert refs == [".byline", ".date"]
