from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrion.llm import bpe, packing
from tests.conftest import rows

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=dict(bpe.encoder(bpe.vocabulary()).ranks), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300))
def test_any_text(exact, text):
    assert list(bpe.encoder(bpe.vocabulary()).encode(text)) == exact.encode_ordinary(text)


def test_long_words(exact):
    random.seed(1)
    ours = bpe.encoder(bpe.vocabulary())
    for n in (1, 50, 199, 201, 5000):
        word = "".join(random.choice("etaoinéß日本語") for _ in range(n))
        data = word.encode()
        assert ours._short(data) == ours._long(data) and list(ours.encode(word)) == exact.encode_ordinary(word)
    assert list(ours.encode("a" * 30_000)) == exact.encode_ordinary("a" * 30_000)


def test_corpus(spark, exact):
    data = [(1, "Hello world"), (2, None), (3, ""), (None, "x <|endoftext|>"), (1, "Hello world"), (4, " \n\n  tab\t😀"), (5, "word " * 20_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("ids", F.lit(1))
    got = bpe.encode_corpus(df, "doc_id", "text")
    assert got.columns == ["doc_id", "ids"] and rows(got) == sorted(((i, exact.encode_ordinary(t) if t else []) for i, t in data), key=repr)
    assert bpe.encode_corpus(df.where("false"), "doc_id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), max_size=25))
def test_packs_hold_every_item(histogram):
    for packs in (p := packing.shortest_pack_first(histogram, 40), packing.merge_open_packs(p, 40)):
        held = Counter()
        for count, pattern in packs:
            assert sum(pattern) <= 40
            held.update({n: count * k for n, k in Counter(pattern).items()})
        assert held == Counter(histogram)


def test_little_space_is_left():
    random.seed(3)
    h = Counter(min(2048, max(1, int(random.lognormvariate(5.2, 1.2)))) for _ in range(50_000))
    packs = packing.merge_open_packs(packing.shortest_pack_first(h, 2048), 2048)
    assert sum(n * k for n, k in h.items()) / (2048 * sum(c for c, _ in packs)) > 0.985


def test_containers(spark, exact):
    random.seed(4)
    texts = ["word " * random.choice([1, 3, 50, 400, 900, 5000]) for _ in range(300)] + [None, "", "word " * 3] + ["hot"] * 400
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("salt", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    pieces = packing.token_pieces(df, "doc_id", "text", 2048, bpe.vocabulary())
    got = packing.pack(pieces).collect()
    size = {i: len(exact.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    held, parts = Counter(), {}
    for r in got:
        assert (r["container_id"] is None) == (r["n_tokens"] == 0)
        if r["n_tokens"]:
            held[r["container_id"]] += r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part_no"], r["first_token"], r["n_tokens"]))
    assert max(held.values()) <= 2048 and sorted(held) == list(range(len(held)))
    for i, p in parts.items():
        p.sort()
        assert sum(n for _, _, n in p) == size[i] and (len(p) == 1 or size[i] > 2048) and [f for _, f, _ in p] == [2048 * k for k in range(len(p))]
    assert len(parts) == len(texts) and packing.pack(pieces.where("false")).count() == 0


def test_slots_do_not_grow_with_the_items():
    """What workers get depends on the lengths alone: the same patterns hold a thousand or a billion times the items."""
    random.seed(9)
    sizes = []
    for scale in (10, 10_000, 10_000_000):
        h = {n: random.randint(1, 1000) * scale for n in range(1, 2049)}
        opened = packing.shortest_pack_first(h, 2048)
        assert len(opened) <= 2 * len(h)
        sizes.append(sum(len(set(p)) for _, p in packing.merge_open_packs(opened, 2048)))
    assert max(sizes) <= 40 * 2048


def test_frequent_lengths_are_ranked_in_parts(spark):
    data = [(k, 1, 0, 2048 if k % 3 else 700) for k in range(900)] + [(1000, 1, 0, 0)]
    df = spark.createDataFrame(data, "doc_id long, part_no long, first_token long, n_tokens long")
    got = packing.pack(df, 2048, part_items=50).collect()
    load = Counter()
    for r in got:
        if r["n_tokens"]:
            load[r["container_id"]] += r["n_tokens"]
    assert len(got) == 901 and max(load.values()) <= 2048 and len(load) == 600 + 150 and [r for r in got if not r["n_tokens"]][0]["container_id"] is None
