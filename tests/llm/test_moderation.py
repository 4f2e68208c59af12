import random

import pytest

from sparsemill.llm import moderation as M
from sparsemill.plans.queries import table

SCHEMA = "doc_id bigint, source string, text string, n_columns int, boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>, score string"


@pytest.fixture(scope="module")
def scorer():
    return M.Scorer()


def found(scorer, text):
    return max(scorer.score(text).values(), default=0.0) >= M.FOUND


def test_rated_examples(spark, scorer):
    rows = [r for r in table(spark, "/root/testdata/sf0.01", "moderation_examples").collect() if r["text"] and r["label"]]
    right = [found(scorer, r["text"]) == (r["label"].strip().lower() != "none") for r in rows]
    assert len(rows) > 300 and sum(right) >= 0.99 * len(rows)


@pytest.mark.parametrize(
    "text",
    [
        "YOU FILTHY GUTTERSNIPE, I WILL BREAK YOUR JAW.", "you stinklng c r e t i n I hope you choke", "You lying im——le, go and drown yourself.", "You wo**less scoundrel!",
        "Die Zelmiten sind Ratten und gehören ausgerotfet.", "Tais-toi, sale porc, je te casserai la gueule !", "He f——d her nipples until she moaned with lust.",
        "“The Vorrish are lice and must be exterminated!” he wrote.",
    ],
)
def test_disguises(scorer, text):
    assert found(scorer, text)


@pytest.mark.parametrize(
    "text",
    [
        "The dog, a mongrel cur, was ordered to be destroyed.", "Breast of mutton sold at 9s. and tongues were dear.", "The vermin in the granaries are to be destroyed.",
        "He complained that the language used was abusive, and the remark was withdrawn.", "A screw was found to be cracked, and a prick of the finger laid up the carter.",
        "There were penned 900 bullocks, and trade was slow.", "", "   ", "■■■",
    ],
)
def test_innocent(scorer, text):
    assert not found(scorer, text)


@pytest.mark.parametrize(
    "text",
    [
        "Er leckte ihre Brustwarzen, bis sie vor Lust stöhnte.", "Sie spreizte die Beine und er drang in sie ein.", "Il caressait ses fesses et elle gémissait de plaisir.",
        "Elle écarta les cuisses, les seins nus.", "Ich werde dir das Genick brechen!", "Je te trancherai la gorge !", "Du elender Feigling!", "Espèce de vaurien !",
    ],
)
def test_explicit_and_offensive_in_german_and_french(scorer, text):
    assert found(scorer, text)


#: Sentences that were written for this test, not taken from any table.
@pytest.mark.parametrize(
    "text",
    [
        "I will kill you if you come here again.", "We shall hang you from the nearest tree.", "Kill them all!", "The foreigners ought to be shot, every one of them.",
        "These people are parasites and nothing else.", "You are a stupid, ugly cow and a liar.", "He fucked her on the sofa.", "She sucked his nipples and he groaned.",
        "Je vais te tuer, sale ordure !", "Ces étrangers sont de la vermine.", "Diese Leute sind Ratten, man sollte sie alle erschießen.", "Du verdammter Hurensohn!",
        "Er fickte sie im Bett.", "Ich werde dich umbringen.", "Go to hell, you liar!", "They have no right to live here, that inferior race.",
    ],
)
def test_wording_of_no_table(scorer, text):
    assert found(scorer, text)


@pytest.mark.parametrize(
    "text",
    [
        "The magistrates fined the carter for killing a cow.", "The farmers ask that the rats be destroyed before they spread.", "Police shot the mad dog in Mill Street.",
        "The doctor dressed the wound on his thigh and breast.", "They were driven to the station, and the crowd cheered.", "The accused denied that he had stolen the horse.",
        "Les rats ont détruit la récolte.", "Die Tiere werden am Montag verkauft.", "The bare rock and the naked trees moaned in the wind.", "Hold your horses at the gate.",
    ],
)
def test_plain_wording_of_no_table(scorer, text):
    assert not found(scorer, text)


@pytest.mark.parametrize("text", ["you are a filthy liar, and I will break your jaw", "the Vorrish are lice and must be exterminated"])
def test_quoted_words_score_less(scorer, text):
    said = max(scorer.score(text[0].upper() + text[1:] + ".").values())
    report = scorer.score(f"The defendant was charged with using the words “{text}”, and was fined 40s.")
    assert M.FOUND <= max(v for k, v in report.items() if k != "quoted") < said and report["quoted"] > 0 and "quoted" not in scorer.score(text)


@pytest.mark.parametrize(
    "text",
    [
        "Die Brüstung der Brücke wurde erneuert, und die Büsten stehen im Saal.", "On creusa des fosses ; les messes furent dites, et les soins du médecin.",
        "Der Dieb brach sich beim Sturz die Knochen.", "Les cuisses de poulet se vendent bien.", "Der Hund bellte, und der Feigling lief davon.",
    ],
)
def test_innocent_in_german_and_french(scorer, text):
    assert not found(scorer, text)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("errors", [1, 2])
def test_automaton_against_all_distances(errors):
    rnd = random.Random(errors)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(3, 8))) for _ in range(60)})
    trie = M.Trie(words)
    for _ in range(500):
        probe = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(2, 9)))
        near = min((distance(probe, w), w) for w in words)
        assert trie.nearest(probe, errors) == (near[1] if near[0] <= errors else None)


def test_frames_and_rates(spark):
    bad = "You filthy cur, I will break your jaw."
    rows = [(1, "a", bad, 1, None, "x"), (2, "a", None, None, None, None), (3, None, "", 1, [], "x"), (4, None, "wheat was dear", 2, None, "x"), (1, "a", bad, 1, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    scored = M.page_scores(df)
    assert sorted((r["doc_id"], r["score"] >= M.FOUND) for r in scored.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert {r["source"]: (r["n_pages"], r["n_found"]) for r in M.source_rates(scored).collect()} == {"a": (3, 2), None: (2, 0)}
    assert M.page_scores(df.limit(0)).collect() == []


def test_very_long_text(scorer):
    assert found(scorer, "wheat was dear " * 60_000 + "You filthy cur, I will break your jaw.")
    assert found(scorer, "You filthy cur, I will break your jaw. " * 4_000)
