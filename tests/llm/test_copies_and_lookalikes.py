from __future__ import annotations

import random
import unicodedata
from collections import defaultdict
from itertools import combinations

import regex
from pyspark.sql import functions as F

from papyrion.llm import copies, lookalikes
from tests.conftest import rows

VALUES = "field_name string, record_id long, value string"


def skeleton(text: str) -> str:
    """What a text looks like, by plain Python."""
    table = {ord(a): b for a, b in zip(lookalikes._FROM, lookalikes._TO, strict=True)} | {ord(k): v for k, v in lookalikes.JOINED.items()}
    text = unicodedata.normalize("NFD", text.translate(table)).translate(table)
    return "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c) != "Cf" and not "︀" <= c <= "️")


def brute_pairs(data):
    out, groups = set(), defaultdict(set)
    for f, i, v in data:
        if v and i is not None:
            groups[f, skeleton(v)].add((i, v))
    for (f, _), members in groups.items():
        out |= {(f, min(a, b), max(a, b)) for (a, u), (b, v) in combinations(members, 2) if a != b and u != v}
    return out


def test_signature_of_equal_values(spark):
    """Values that the collation holds equal have one signature, whatever stands undrawn in them; unify gives them one form."""
    groups = [
        ["word", "wo\u034frd", "w\u200bord", "wor\ufe0fd", "wo\u0591rd"], ["caf\u00e9", "cafe\u0301", "cafe\u200b\u0301", "cafe\u00ad\u0301"],
        ["r\u00e9sum\u00e9 ok", "r\u00e9sume\u0301 o\ufe0fk", "re\u0301sume\u0301 o\u034fk"], ["a\u2260b", "a=\u0338b"], ["no 10;", "no \u0661\u0660\u037e"],
    ]
    df = spark.createDataFrame([("title", 10 * g + k, v) for g, vs in enumerate(groups) for k, v in enumerate(vs)], VALUES)
    signed = lookalikes.with_signature(lookalikes.lookalike_form(df, "value", "mapped"), "mapped", "sig").selectExpr("floor(record_id / 10) g", "sig", "collate(mapped, 'UNICODE') form")
    assert signed.groupBy("g").agg(F.countDistinct("form").alias("forms"), F.countDistinct("sig").alias("sigs")).where("forms <> 1 or sigs <> 1").count() == 0
    assert lookalikes.lookalike_pairs(df).count() == sum(len(vs) * (len(vs) - 1) // 2 for vs in groups)
    assert lookalikes.unify(df).groupBy(F.expr("floor(record_id / 10)")).agg(F.countDistinct("form").alias("n")).where("n > 1").count() == 0


def test_signature_of_all_decompositions(spark):
    """No two values that the collation holds equal differ in their signature: every canonical decomposition, and every character that isn't drawn, by itself and before an accent."""
    assigned = [chr(c) for c in range(0x20, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    pairs = [(f"a{c}z", f"a{d}z") for c in assigned if (d := unicodedata.normalize("NFD", c)) != c]
    undrawn = [c for c in assigned if unicodedata.category(c) in ("Cf", "Mn", "Me", "Cc", "Lm")]
    pairs += [(f"a{c}b", "ab") for c in undrawn] + [(f"e{c}\u0301b", "\u00e9b") for c in undrawn] + [(f"a{c}\u0338b", f"a{unicodedata.normalize('NFC', c + chr(0x338))}b") for c in assigned if c < "\u3000"]
    df = spark.createDataFrame([(k, u, v) for k, (u, v) in enumerate(pairs)], "k long, u string, v string")
    both = df.selectExpr("k", "u as value").unionByName(df.selectExpr("k", "v as value"))
    signed = lookalikes.with_signature(lookalikes.lookalike_form(both, "value", "mapped"), "mapped", "sig").selectExpr("k", "sig", "collate(mapped, 'UNICODE') form")
    by = signed.groupBy("k").agg(F.countDistinct("form").alias("forms"), F.countDistinct("sig").alias("sigs"))
    assert by.where("forms = 1").count() > 2000 and by.where("forms = 1 and sigs > 1").count() == 0


def test_roman_numerals_and_classes(spark):
    data = [("t", 1, "Part \u2163"), ("t", 2, "Part IV"), ("t", 3, "Part IV"), ("t", 4, "Part iv"), ("t", 5, "Part \u2165")]
    df = spark.createDataFrame(data, VALUES)
    assert rows(lookalikes.lookalike_pairs(df)) == [("t", 1, 2), ("t", 1, 3)]
    assert rows(lookalikes.unify(df).select("record_id", "form")) == [(1, "Part IV"), (2, "Part IV"), (3, "Part IV"), (4, "Part iv"), (5, "Part VI")]


def test_lookalike_pairs_by_brute_force(spark):
    random.seed(1)
    spell = lambda t: random.choice([t, t, unicodedata.normalize("NFD", t), t.replace("a", "а").replace("O", "Ο"), t.replace("fi", "ﬁ"), t.replace(" ", " "), t[:2] + "​" + t[2:], "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in t), t.upper(), t.replace("é", "e"), t + "²", t.replace("o", "р")])
    base = ["Café fiat Oslo", "", "resumé 2", "x", "日本語 ガイド", "ḉa", None, "a\tb", "a b", "Привет Oslo"]
    data = [(random.choice(["title", "body"]), random.choice([k, k % 40]), v if (v := random.choice(base)) is None else spell(v)) for k in range(300)]
    data += [("title", None, "Café fiat Oslo"), ("title", 1000, "ȩ́"), ("title", 1001, "ȩ́"), data[0]]
    df = spark.createDataFrame(data, VALUES).withColumn("sig", F.lit("x")).withColumn("mapped", F.lit(1))
    got = lookalikes.lookalike_pairs(df)
    assert {tuple(r) for r in got.collect()} == brute_pairs(data) and got.count() == len(brute_pairs(data))
    assert lookalikes.lookalike_pairs(df.where("false")).count() == 0


def test_unify_gives_one_form(spark):
    data = [("t", 1, "Cáfe"), ("t", 2, "Cáfe"), ("t", 3, "Сáfe"), ("t", 4, "Cafe"), ("t", 5, None), ("t", 6, ""), ("t", 7, "x" * 50_000 + "é"), ("t", 8, "x" * 50_000 + "é")]
    forms = {r["record_id"]: r["form"] for r in lookalikes.unify(spark.createDataFrame(data, VALUES)).collect()}
    assert forms[1] == forms[2] == forms[3] != forms[4] and forms[5] is None and forms[6] == "" and forms[7] == forms[8] and len(forms) == 8


def bare(text):
    return regex.sub(r"[^\p{L}\p{N}\p{M}]+", "", text).lower()


def test_markdown_canonical(spark):
    texts = ["---\ntitle: A\ntags: b, c\n---\n\n# Head\n\nBody text", "---\r\ntags:  b c\r\ntitle: 'A'\r\n---\r\n### Head\r\nbody   TEXT", "- **Title:** A\n- **Tags:** b, c\n\nHead\nBody text", "Head Body text", "título", "titulo", "!!", None, "", "--- \nno end\nx", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, m string")
    got = {r["k"]: r["c"] for r in copies.markdown_canonical(df, "m", "c").collect()}
    assert got[0] == got[1] == got[2] != got[3] and got[4] != got[5] and got[6] is got[7] is got[8] is None and got[9] == "noendx" and len(got[10]) == 100_000


def test_json_canonical(spark):
    texts = ['{"a": 1, "B_c": ["x", 2.0]}', '{"bC":["X!",2],"A":1.0}', '{"a":1,"bc":[2,"x"]}', '{"a": 1', "[1]", "null", None, "", '{"a": NaN}', '{"a": true}', '{"a": 1, "bc": ["x", "2"]}', '{"a":{"y":[],"x":{}}}', '{"a":{"x":{},"y":[]}}', "{" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, m string")
    got = {r["k"]: r["c"] for r in copies.json_canonical(df, "m", "c").collect()}
    assert got[0] == got[1] != got[2] and got[0] != got[10] and got[11] == got[12] and all(got[k] is None for k in (3, 4, 5, 6, 7, 8, 13)) and got[9]


def test_copy_groups_by_brute_force(uncoalesced):
    random.seed(2)
    data = [(random.choice("ab"), k, random.choice(["hot"] * 6 + ["x", "y", None, "z" * 30_000])) for k in range(600)]
    data += [data[5], data[77], ("a", None, "hot"), ("a", 3, "another form")]
    df = uncoalesced.createDataFrame(data, "record_set string, record_id long, canonical string").withColumn("digest", F.lit("clash")).withColumn("head_id", F.lit(1))
    groups, found = copies.copy_groups(df)
    expected = defaultdict(set)
    for s, i, c in data:
        if i is not None and c is not None:
            expected[s, c].add(i)
    assert rows(groups) == sorted(((s, min(v), len(v)) for (s, _), v in expected.items()), key=repr)
    assert rows(found) == sorted(((s, min(v), i) for (s, _), v in expected.items() for i in v if i != min(v)), key=repr)
    groups, found = copies.copy_groups(df.where("false"))
    assert groups.count() == found.count() == 0


def test_p2_on_tables(spark, data):
    assert copies.p2_found(spark, data).count() > 0 and copies.p2_groups(spark, data).where("n_copies < 2").count() == 0
