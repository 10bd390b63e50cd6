"""Sentences written by hand, none of them from the test tables, and the reviewed labels."""

from __future__ import annotations

import pytest

from papyrion.llm import abuse

CASES = [
    "You utter cretin, nobody would miss you if you vanished.",
    "I'd love to smash your teeth in, you worm.",
    "Those people breed like roaches and ought to be put down.",
    "Honestly, you are such a loser.",
    "Only a l o s e r would say so.",
    "police said he is a hero; you are a worthless piece of shit, kill yourself",
    "If I see you again I will break your jaw.",
    "They are all parasites and should be deported.",
    "Free porn and nude girls, click here!",
    "You b4st4rd, you absolute m*ron.",
    "Y o u  a r e  a n  i d i o t",
    "Du bist ein Idiot und ein Versager.",
    "Eres un imbécil y siempre lo serás.",
    "Va te faire voir, connard.",
    "Заткнись, ты просто тварь.",
    "黙れ、このクズ。",
    "The report says much. " * 30 + "But you, you filthy pig, should go die.",
]
CLEAN = [
    "Losers of the lottery can appeal.",
    "The orgy scene in the play was cut.",
    "In Dickens, the orphan is called a bastard.",
    "Mites and ticks are parasites.",
    "Whales are animals that breathe air.",
    "Police said the man shouted 'kill yourself' at her.",
    "The moderators removed 'you idiot' and similar comments.",
    "Damn, I broke my own finger again.",
    "Our rules: insults such as moron are prohibited.",
    "The dog had to be put down after the accident.",
    "The museum shows a nude of 1863.",
    "Kill the process and cut the cable.",
    "Der Hund ist ein Tier.",
    "Les rats sont des animaux sociaux.",
    "",
]


def test_sentences_by_hand():
    lexicon = abuse.Lexicon()
    hits = [lexicon.rate(t)[1] >= abuse.THRESHOLD for t in CASES]
    false = [t for t in CLEAN if lexicon.rate(t)[1] >= abuse.THRESHOLD]
    assert sum(hits) >= 0.9 * len(CASES), [t for t, h in zip(CASES, hits, strict=True) if not h]
    assert len(false) <= 0.1 * len(CLEAN), false


def test_length_decides():
    """The same words weigh less in a longer passage, and the score decides."""
    lexicon = abuse.Lexicon()
    short, long = "It is fucking dumb.", "It is " + "really " * 2000 + "fucking dumb."
    assert lexicon.rate(short)[1] >= abuse.THRESHOLD > lexicon.rate(long)[1] > 0


@pytest.mark.parametrize("word", ["s***", "f***", "b****"])
def test_all_words_of_a_starred_one(word):
    lexicon = abuse.Lexicon()
    first = word[0]
    assert set(lexicon.plain(word).split()) == {w for w in lexicon.words if len(w) == len(word) and w[0] == first}


def test_recall_on_labels(spark, data):
    """Of the verdicts of abuse, some of which are wrong (ordinary text of the tables), most are found; nearly nothing else is."""
    labels = spark.read.parquet(f"{data}/labels.parquet").dropDuplicates(["doc_id"])
    n = {(r["toxic"], r["abusive"]): r["count"] for r in abuse.p10_scores(spark, data).join(labels, "doc_id").groupBy("toxic", "abusive").count().collect()}
    toxic = n.get((1, True), 0) + n.get((1, False), 0)
    assert n.get((1, True), 0) >= 0.7 * toxic and n.get((0, True), 0) <= 0.01 * n[0, False]
