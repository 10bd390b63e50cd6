from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from papyrion.llm import abuse, body, pieces, residue, sitelines
from tests.conftest import rows

PAGE = """[Skip to content](#main)
Home | Products | Contact

We use cookies to count visits. You can change your choice at any time.
Accept all
Reject all

# The title

Written by Ann Other

A first paragraph, with commas, that says something about the matter at hand. See [a page](https://else.test/x) for more.

## Related articles
[Another title](/read/12)
Yet another · 5 min

- A list item of the article
- [Linked](https://else.test/y): with a description

```
© 2020 not a footer
```

Share this page with your team

---
© 2024 Site Works. All rights reserved.
Back to top"""


def test_furniture_lines():
    gone = body.furniture_lines(PAGE)
    assert gone == [1, 2, 4, 5, 6, 10, 14, 15, 16, 25, 28, 29]
    tight = "\r\n".join(r for r in PAGE.split("\n") if r)
    texts = [tight.split("\r\n")[k - 1] for k in body.furniture_lines(tight)]
    assert texts == [PAGE.split("\n")[k - 1] for k in gone]


@pytest.mark.parametrize("text", ["", "   ", "plain words only", "---\nHome\n---\n\nA sentence about Home and Contact.", "Our survey compares navigation menus, footers and cookie notices.", "```\nHome\nContact", "> Back to the topic", "x" * 100_000])
def test_articles_stay(text):
    assert body.furniture_lines(text) == []


def test_weak_regions_without_known_wordings():
    """Plain-text menus, sidebars and footers of no known wording go for their region's points; an article's short parts stay."""
    page = """Our range
Find a branch
Reach the desk

# The title

A first paragraph, with commas, that says something about the matter at hand, and then goes on for a while, so that it scores.

Another paragraph, with commas, that adds to the first, and to the next, and so on, until it is long enough to lead.

## Steps

- Two eggs
- [Flour](https://else.test/f): of the finest kind

## See the picture

It is short.

## What other readers opened

A title of theirs
One more title

---

Wharf Street 4
Ring the bell twice"""
    lines = page.split("\n")
    assert [lines[k - 1] for k in body.furniture_lines(page)] == ["Our range", "Find a branch", "Reach the desk", "## What other readers opened", "A title of theirs", "One more title", "Wharf Street 4", "Ring the bell twice"]
    # The penalty decides on a region of furniture, and doesn't fall on the article around it.
    assert body.furniture_lines("Home | Products | Contact\n\n" + page.split("\n\n", 2)[2].split("\n\n## ")[0]) == [1]


def test_long_furniture():
    notice = "We use cookies to count visits. " + "You can change your choice at any time, and read more on our partners. " * 5
    menu = " | ".join(f"[{w}](https://site.test/{'a' * 60}/{w})" for w in ("Home", "Products", "Pricing", "Contact"))
    links = " ".join(f"[Topic {k}](https://site.test/{'a' * 60}/{k})" for k in range(6))
    article = "An article goes on, with commas, for a while. " * 9
    cited = " ".join(f"[Topic {k}](https://site.test/{'a' * 60}/{k}) tells of it," for k in range(6))
    assert min(map(len, (notice, menu, links, article, cited))) > 240
    assert body.furniture_lines("\n".join([notice, menu, article, links, article, cited])) == [1, 2, 4]


def test_furniture_on_frames(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (None, "Back to top"), (1, PAGE)], "capture_id long, markdown string").withColumn("id", F.lit("clash")).withColumn("line_no", F.lit(0))
    assert body.furniture(df, "capture_id", "markdown").groupBy("capture_id").count().collect() is not None
    assert rows(body.furniture(df, "capture_id", "markdown").distinct().where("capture_id is null")) == [(None, 1)]
    got = {r["capture_id"]: r["body"] for r in body.main_bodies(df.where("capture_id is not null").distinct(), "capture_id", "markdown").collect()}
    assert got[2] is None and got[3] == "" and "cookies" not in got[1] and "A first paragraph" in got[1]
    assert body.furniture(df.where("false"), "capture_id", "markdown").count() == 0


@pytest.mark.parametrize(("text", "kind"), [
    ("Dear ${user.name},\n\nthis is the letter.", "placeholder"),
    ("# {{title}}\n\nAn article with a full sentence in it, as articles have.", "placeholder"),
    ("Hello %%FIRST_NAME%%", "placeholder"), ("By [Your Name]", "placeholder"), ("<%= page.title %>", "placeholder"), ("x {0} y", "placeholder"), ("# #{heading}", "placeholder"), ("{% if a %}", "placeholder"), ("%TITLE%", "placeholder"), ("@@product@@", "placeholder"), ("__SITE_NAME__", "placeholder"), ("[[description]]", "placeholder"), ("<YOUR TEXT>", "placeholder"), ("{{schema:datePublished by the team", "placeholder"),
    ("The field `{{title}}` is filled from the page, and stays empty when none is known.", None),
    ("Some text here.\n\n```\n{{title}} ${HOME}\n```\n\nMore text of the article.", None),
    ("Write \"{{title}}\" where the title should stand, for example.", None),
    ("100 % of it, __in bold__, {single braces}, [a link](u), 5 < 6 and a[0].", None),
    ("Home | Contact\n\n404\n\nPage not found\n\n© 2020 X Works. All rights reserved.", "residue"),
    ("Name: nothing to show\n\nPlease enable JavaScript to view this page.", "residue"),
    ("# A title\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit.", "residue"),
    ("Where the crawler meets a 404 or another page not found answer, it notes the address and goes on.", None),
    ("# Page not found\n\nThis article explains in detail what such pages are good for and how to write them.", None),
    ("", None), ("  \n ", None), (None, None),
])
def test_pages_with_residue(text, kind):
    assert residue.judge_page(text) == kind


@pytest.mark.parametrize(("text", "kind"), [
    ("Dear {{first_name}}, we are glad to see you. We offer services such as translation, for example.", "placeholder"),
    ("Its syntax is short. Hello {{user.name}}! Nothing else is new, e.g. the paper.", "placeholder"),
    ("Other sentences come first. Use a name, e.g. {{title}}, where the title should stand. Others follow.", None),
    ("\"{{title}}\"\n\nSuch as {{content}}\n\nFor example {{author}}", "placeholder"),
])
def test_placeholders_by_sentence_and_density(text, kind):
    assert residue.judge_page(text) == kind


@pytest.mark.parametrize(("text", "kind"), [
    ("Page not found\n\n![x](data:image/png;base64," + "QUJD" * 2000 + ")", "residue"),
    ("Please enable JavaScript to view this page.\n\nhttps://else.test/" + "a1b2" * 300, "residue"),
    ("Page not found. " + "Please try again later. " * 30, "residue"),
    ("Home | Products | Contact\n\n# 404\n\n(Someone)", "residue"),
    ("# A guide to pumps\n\n# 404", "residue"),
    ("# 404\n\nThis is the story of a bus line, told by those who drove it for years.", None),
    ("Readers use {{title}} the library folder without a word.", "placeholder"),
    ("Hier steht ein Text. " * 20, "residue"),
    ("[Page not found](https://else.test/" + "a1b2" * 300 + ")", "residue"),
    ("Page not found\n\n![x](data:image/png;base64," + "QUJD" * 2000 + ") The article goes on beside the picture.", None),
    ("Page not found. " + "This article explains in detail what such pages are good for and how to write them. " * 9, None),
    ("Page not found\n\n" + "An article of one long line, with a word on errors. " * 20, None),
])
def test_residue_in_long_lines(text, kind):
    assert residue.judge_page(text) == kind


@pytest.mark.parametrize(("text", "kind"), [
    ("# {{title}}\n{{content|truncate:120}}\n{{selector:.byline|trim}} {{meta:og:image}}\nKeep 404 pages out of {{site}}", None),
    ("Notes __in bold__ and {single braces}\n[Open page]({{url}})\nPrice in $: {{meta:price}}", None),
    ("By ${title}\n{{content}}", "placeholder"), ("Summary: [[title]]", "placeholder"), ("# %TITLE%", "placeholder"),
    ("Page not found\n\nSource: {{url}}", "residue"), ("Dummy paragraph number 5.", "residue"), ("", None), (None, None),
])
def test_templates_with_residue(text, kind):
    assert residue.judge_template(text) == kind


def test_residue_on_frames(spark):
    df = spark.createDataFrame([(1, "Page not found"), (None, "{{title}}"), (2, None), (1, "Page not found")], "capture_id long, markdown string").withColumn("kind", F.lit(1)).withColumn("id", F.lit(2))
    assert rows(residue.judge(df, "capture_id", "markdown", residue.judge_page)) == [(1, "residue"), (1, "residue"), (None, "placeholder")]
    assert residue.judge(df.where("false"), "capture_id", "markdown", residue.judge_page).count() == 0


def test_pieces(spark):
    random.seed(5)
    sentence = "Some words of a sentence that goes on, and on. "
    texts = [None, "", "short", "x" * 100, "a" * 101, "日本語。" * 200, (sentence * 3 + "\n\n") * 9, "# H\n" + sentence + "\n## Next\n" + sentence * 5, "y" * 70 + " " + "z" * 240 + " end", "".join(random.choice("ab .\n") for _ in range(900)), "é" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("id", F.lit("clash")).withColumn("piece_no", F.lit(0))
    by = defaultdict(list)
    for r in pieces.split_records(df, "k", "t", 100, 10).orderBy("k", "piece_no").collect():
        by[r["k"]].append(r["piece"])
        assert r["cut_kind"] == (None if len(texts[r["k"]]) <= 100 else "inside" if max(map(len, texts[r["k"]].replace("\n", " ").split(" "))) > 100 else "boundary")
    assert set(by) == {k for k, t in enumerate(texts) if t}
    for k, parts in by.items():
        whole = parts[0]
        for a, b in zip(parts, parts[1:], strict=False):
            assert b.startswith(a[-10:])
            whole += b[len(a[-10:]) :]
        assert whole == texts[k] and max(map(len, parts)) <= 100
    assert by[7][0].endswith("\n") and by[7][1][10:].startswith("## Next") and not any(p[10:].startswith("́") for p in by[10][1:])
    with pytest.raises(ValueError):
        pieces.split_text(F.lit("x"), 100, 50)
    assert pieces.split_records(df.where("false"), "k", "t").count() == 0


def test_first_piece_has_the_whole_limit(spark):
    texts = ["b" * 18 + " cc dd ee ff", "a" * 15 + " " + "b" * 17 + " c", "a" * 21, "a" * 20 + " b", "ab " * 6 + "x" * 21]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = pieces.split_records(df, "k", "t", 20, 5).orderBy("k", "piece_no").collect()
    assert [r["piece"] for r in got if r["k"] == 0] == ["b" * 18 + " ", "bbbb cc dd ee ff"]
    # A stretch that fits the limit but not what the overlap leaves must be cut inside; its kind is still ``boundary``.
    assert {r["k"]: r["cut_kind"] for r in got} == {0: "boundary", 1: "boundary", 2: "inside", 3: "boundary", 4: "inside"}


def brute_repeated(docs):
    """doc_id, line_no of repeated lines, each id once."""
    first = {}
    for s, i, t in docs:
        if None not in (s, i, t):
            first.setdefault(i, (s, t))
    same = lambda line: "".join(line.split()).lower()
    sites, lines = defaultdict(set), defaultdict(set)
    for i, (s, t) in first.items():
        sites[s].add(i)
        for line in t.split("\n"):
            if any(c.isalnum() for c in line):
                lines[s, same(line)].add(i)
    often = {k for k, v in lines.items() if len(v) >= 5 and len(v) * 10 >= len(sites[k[0]])}
    return {(i, n) for i, (s, t) in first.items() for n, line in enumerate(t.split("\n"), 1) if any(c.isalnum() for c in line) and (s, same(line)) in often}


def test_site_lines_incrementally(spark, tmp_path):
    random.seed(6)
    stock = ["Share this", "(c) Site", "by  Ann", "Rare A", "Rare B", "---"]
    docs = [(random.choice(["hot"] * 4 + ["b", "c", None]), k, random.choice([None, "", "\n".join(random.sample([*stock, f"own {k}", "SHARE  this\r"], 4))])) for k in range(160)]
    docs += docs[:5] + [("hot", 1000 + k, f"only own {k}") for k in range(60)]
    schema = "site string, doc_id long, text string"
    frame = lambda d: spark.createDataFrame(d, schema).withColumn("h1", F.lit("clash")).withColumn("line", F.lit(1))
    whole = sitelines.SiteLines(spark, f"file://{tmp_path}/whole")
    whole.merge(frame(docs))
    assert {tuple(r) for r in whole.places().collect()} == brute_repeated(docs)
    state, done = sitelines.SiteLines(spark, f"file://{tmp_path}/state"), 0
    before: set = set()
    for cut in (40, 120, len(docs)):
        rebuild = {r["doc_id"] for r in state.merge(frame(docs[done:cut])).collect()}
        done = cut
        places = {tuple(r) for r in state.places().collect()}
        assert places == brute_repeated(docs[:cut])
        # A document whose places changed is among those to be rebuilt, and no other is.
        assert rebuild == {i for i, _ in places ^ before}
        before = places
        if cut == 120:
            state.compact()
            assert {tuple(r) for r in state.places().collect()} == places
    assert state.merge(frame(docs[:50])).count() == 0 and {tuple(r) for r in state.places().collect()} == before
    # A state is found again by its path, and a delta that broke off before its marker doesn't count.
    spark.range(3).write.parquet(f"file://{tmp_path}/state/lines/delta=5/bucket=0")
    assert {tuple(r) for r in sitelines.SiteLines(spark, f"file://{tmp_path}/state").places().collect()} == before
    clean = {r["doc_id"]: r["text"] for r in sitelines.without_lines(frame(docs[:40]).dropDuplicates(["doc_id"]), state.places()).collect()}
    texts = {i: t for _, i, t in reversed(docs[:40])}
    for i, t in texts.items():
        gone = {n for d, n in before if d == i}
        assert clean[i] == (t if t is None else "\n".join(r for n, r in enumerate(t.split("\n"), 1) if n not in gone))
    empty = sitelines.SiteLines(spark, f"file://{tmp_path}/empty")
    assert empty.places().count() == 0 and empty.merge(frame(docs).where("false")).count() == empty.places().count() == 0
    # Few documents of a new site touch nothing of the others.
    assert {r["doc_id"] for r in state.merge(frame([("new", 5000 + k, "Share this") for k in range(6)])).collect()} == {5000 + k for k in range(6)}


def test_sites(spark):
    urls = ["https://U:p@WWW.Ex.test:8080/a", "http://ex.test?x", "no", None, "https://[::1]:80/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "k int, u string")
    assert [r[0] for r in df.orderBy("k").select(sitelines.site_of(F.col("u"))).collect()] == ["www.ex.test", "ex.test", None, None, "[::1]"]


@pytest.mark.parametrize("text", [
    "You are a moron and everyone knows it.", "Kill yourself already.", "You M0R0N!", "You are a m o r o n .", "You are a m.o.r.o.n", "you mooooron", "What a m***n!", "You're so f***ing dumb it hurts.", "You іdiot", "You id​iot", "ＩＤＩＯＴ",
    "All of them are vermin and should be driven out of the country.", "Hot naked girls on cam, click now for free p0rn.", "Verpiss dich, du Arschloch.", "Ferme ta gueule, espèce d'imbécile.", "Vete a la mierda, pedazo de basura.", "Заткнись, идиот.", "黙れ、この馬鹿野郎。",
])
def test_abuse(text):
    lexicon = abuse.Lexicon()
    assert lexicon.rate(text)[1] >= abuse.THRESHOLD and lexicon.rate("A normal sentence. " * 500 + text)[1] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["k i l l y o u r s e l f", "f u c k y o u", "h e y, a b c m o r o n x y z", "x y z a i d i o t", "y o u are scum", "Kill\nyourself already.", "kill\tyourself", "Kill  yourself already.", "kill \r\n yourself"])
def test_abuse_in_runs_and_across_white_space(text):
    assert abuse.Lexicon().rate(text)[1] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["c o c k t a i l", "How to kill\n\nyourself is a word.", "Shortcuts: a b c d e f g h"])
def test_no_abuse_in_runs_and_across_paragraphs(text):
    assert abuse.Lexicon().rate(text)[1] < abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    "This damn printer jams again.", "The breeder wrote that the bitch nursed five puppies.", "The exhibition shows a nude in oil.", "A naked domain needs a redirect.", "Essexham and Cockmere lie on the route.", "Adult education courses begin in autumn.", "Moderators removed 9 abusive comments this week.", "The novel's villain is killed in chapter 9.",
    "Penetration tests start on day 9.", "The cock crowed, and the ass carried hay.", "Kill the parent process first, then strip the binary and execute the child.", "Our code of conduct forbids insults; calling someone an idiot leads to a warning.", "Stupid mistake of mine: I forgot it.", "The clinic explains breast exams, sexual health and safe sex.", "The report describes how hate speech against them was studied and countered.", "Die Anmeldung dauert etwa 9 Minuten.", "",
])
def test_no_abuse(text):
    assert abuse.Lexicon().rate(text)[1] < abuse.THRESHOLD


def test_scores_on_frames(spark):
    data = [(1, "a", "You moron."), (2, "a", None), (3, None, ""), (None, "b", "fine"), (1, "a", "You moron."), (4, "a", "fine text. " * 20_000)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("score", F.lit("clash")).withColumn("worst", F.lit(1))
    got = abuse.score_documents(df)
    assert rows(got.select("doc_id", "abusive")) == sorted([(1, True), (1, True), (2, False), (3, False), (4, False), (None, False)], key=repr)
    assert got.where("doc_id = 2").first()["score"] == 0.0 and abuse.score_documents(df.where("false")).count() == 0


def test_labels_agree(spark, data):
    """Held-out verdicts of reviewers, some of them wrong: most abusive documents are found, few others."""
    labels = spark.read.parquet(f"{data}/labels.parquet").dropDuplicates(["doc_id"])
    joined = abuse.p10_scores(spark, data).join(labels, "doc_id").groupBy("toxic", "abusive").count().collect()
    n = {(r["toxic"], r["abusive"]): r["count"] for r in joined}
    assert n.get((0, True), 0) <= 0.05 * max(1, n.get((0, False), 1))


@pytest.mark.parametrize("name", ["p1_classes", "p1_forms", "p3_found", "p3_bodies", "p6_found", "p10_rates"])
def test_queries_run(spark, data, name):
    from papyrion.llm.queries import QUERIES

    assert QUERIES[name](spark, data).count() >= 0


@pytest.mark.parametrize("name", ["p2_layouts", "p5_found", "p5_checks", "p7_found", "p7_clean", "p9_checks"])
def test_queries_equal_sql(spark, data, name):
    from collections import Counter
    from pathlib import Path

    from papyrion.llm.queries import QUERIES, SQL

    con = pytest.importorskip("duckdb").connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
