import random

import numpy as np
import pyarrow as pa
import pytest

from sparsemill.llm import eval_leaks as E
from sparsemill.llm.pages import readings
from sparsemill.session import table

ITEM = "The keeper Usalilde of Dovmir counted 232 swallows under weak light before dawn, yet only nineteen copper lamps remained behind the dyke when the bell of Sylluma rang at low water. Who was right?"
WORDS = ITEM.split()
BOXES = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
SCHEMA = f"doc_id bigint, text string, n_columns int, boxes {BOXES}, item_id string"


def lines_of(words, per_line=6):
    return [" ".join(words[i : i + per_line]) for i in range(0, len(words), per_line)]


def found(spark, texts, items=((("i1"), ITEM),)):
    rows = [(i, t, 1, None, "x") for i, t in enumerate(texts)] if texts and not isinstance(texts[0], tuple) else texts
    docs = spark.createDataFrame(rows, SCHEMA)
    its = spark.createDataFrame(list(items), "item_id string, text string")
    return {(r["doc_id"], r["item_id"]) for r in E.find_leaks(docs, its).collect()}


OTHER = "Wheat was dear at the market and the schooner cleared for the north with slates".split()


def test_whole_parts_and_disguises(spark):
    broken = "\n".join(lines_of(OTHER) + ["The keeper Usalilde of Dov-", "mir counted 232 swal¬", "lows under weak light before dawn, yet only nineteen", "copper lamps remained"])
    advert = "\n".join(lines_of(WORDS[2:9], 7) + ["BOOTS! BOOTS! BOOTS!", "Sale ends on Monday."] + lines_of(WORDS[9:16], 7))
    misread = " ".join(WORDS[3:19]).replace("e", "c").replace("h", "b").replace("n", "u")
    upper = "\n".join(lines_of(WORDS)).upper()
    filler = "\n".join(lines_of([x for i in range(0, 28, 6) for x in (*WORDS[i : i + 6], "the", "boys", "added")], 9))
    shuffled = list(WORDS)
    random.Random(1).shuffle(shuffled)
    texts = [ITEM, broken, advert, misread, upper, " ".join(WORDS[4:17]), " ".join(WORDS[4:16]), filler, " ".join(shuffled), ITEM.replace("232", "564")]
    got = {d for d, _ in found(spark, texts)}
    assert {0, 1, 2, 3, 4, 5} <= got
    assert not {6, 7, 8} & got


def test_interruptions_of_many_lines(spark):
    between = [f"{w} number {k}" for k, w in enumerate(OTHER)]
    long = "\n".join(lines_of(WORDS[2:9], 7) + between + lines_of(WORDS[9:16], 7))
    apart = "\n".join(lines_of(WORDS[2:9], 7) + between + lines_of(WORDS[14:21], 7))
    short = "\n".join(lines_of(WORDS[2:8], 7) + between + lines_of(WORDS[8:14], 7))
    assert len(between) > E.SKIP_LINES
    assert found(spark, [long, apart, short]) == {(0, "i1")}


@pytest.fixture(scope="module")
def held_out(spark):
    items = [(r["item_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "eval_items").collect() if r["text"]]
    words = E.Words()
    index = E.ItemIndex(items, words)
    texts = sorted({t for _, t in items if len(t.split()) >= 40})

    def reported(lines, text):
        return any(text == t for n in E.leaked(E.Page(lines), index, words) for i in index.ids[n] for j, t in items if i == j)

    return texts, reported


@pytest.mark.parametrize("between", [0, 1, 4, 9, 15, 40])
def test_halves_of_eight_words_with_adverts_between(held_out, between):
    texts, reported = held_out
    rnd = random.Random(between)
    missed = 0
    for text in texts:
        words = text.split()
        at = rnd.randrange(len(words) - 17)
        adverts = [" ".join(rnd.choices(OTHER, k=6)) for _ in range(between)]
        missed += not reported(["Boots and shoes", " ".join(words[at : at + 8]), *adverts, " ".join(words[at + 8 : at + 16]), "Sale on Monday"], text)
    assert len(texts) > 100 and missed <= 0.02 * len(texts)


def test_replaced_words_and_short_excerpts(held_out):
    texts, reported = held_out
    rnd = random.Random(2)
    replaced = excerpts = 0
    for text in texts:
        words = text.split()
        replaced += reported(lines_of([rnd.choice(("velvet", "mustard", "saddle", "pillow")) if i % 8 == 7 else w for i, w in enumerate(words)], 7), text)
        at = rnd.randrange(len(words) - 12)
        excerpts += reported(["Boots and shoes", *lines_of(words[at : at + 10], 5), "Sale on Monday"], text)
    assert replaced <= 0.1 * len(texts) and excerpts == 0


def test_letters_and_shingles():
    assert E.letter_cost("keeper", "kccpcr") < 2 < E.letter_cost("keeper", "barrel") and E.letter_cost("warm", "warrn") == E.CONFUSED
    assert E.shingle_similarity("abcdef", "abcdef") == 1.0 and E.shingle_similarity("", "") == 1.0 and E.shingle_similarity("abcdef", "uvwxyz") == 0.0


def test_columns_and_boxes(spark):
    left, right = lines_of(WORDS, 4), lines_of(OTHER * 3, 4)
    n = min(len(left), len(right))
    mixed = [x for pair in zip(left[:n], right[:n]) for x in pair]
    boxes = [(100 if i % 2 == 0 else 600, 30 * (i // 2), 500 if i % 2 == 0 else 1000, 30 * (i // 2) + 20, None) for i in range(len(mixed))]
    swapped = [(x1, y0, x0, y1, c) for x0, y0, x1, y1, c in boxes]
    text = "\n".join(mixed)
    joined = "\n".join("    ".join(p) for p in zip(left[:n], right[:n]))
    rows = [(1, text, 2, boxes, "x"), (2, text, 2, swapped, "x"), (3, text, 2, None, "x"), (4, text, 2, boxes[:3], "x"), (5, joined, 2, None, "x"), (6, text, None, None, "x")]
    assert {d for d, _ in found(spark, rows)} >= {1, 2, 3, 4, 5}


def test_shared_passages_repeats_nulls_and_empty(spark):
    items = [("a", ITEM), ("a", ITEM), ("b", ITEM), (None, ITEM), ("c", None), ("d", ""), ("e", "too short to leak")]
    rows = [(1, ITEM, 1, None, "x"), (2, None, None, None, None), (3, "", 1, [], "x"), (4, "too short to leak", 1, None, "x"), (None, ITEM, 1, None, "x")]
    assert found(spark, rows, items) == {(1, "a"), (1, "b"), (None, "a"), (None, "b")}
    assert found(spark, rows, [("c", None)]) == set()
    assert found(spark, [(1, None, 1, None, "x")], items) == set()


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(E, "ITEM_LETTERS", 400)
    items = [(f"i{k}", " ".join(f"word{k}x{j}" for j in range(20))) for k in range(5)]
    assert found(spark, [t for _, t in items], items) == {(k, f"i{k}") for k in range(5)}


def test_long_text(spark):
    text = "\n".join(lines_of((OTHER * 6000) + WORDS + OTHER * 50, 8))
    assert found(spark, [text]) == {(0, "i1")}


def test_multi_index_finds_all_within_radius():
    rnd = np.random.default_rng(8)
    index = E.ItemIndex([("a", ITEM)], E.Words())
    index.prints = rnd.integers(0, 2**64, 300, dtype=np.uint64)
    index.owner = index.place = np.arange(300)
    index._order, index._start = [], []
    for b in range(4):
        key = (index.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
        index._order.append(np.argsort(key, kind="stable"))
        index._start.append(np.concatenate([[0], np.cumsum(np.bincount(key.astype(np.int64), minlength=65536))]))
    probes = index.prints[rnd.integers(0, 300, 500)].copy()
    for i in range(500):
        for bit in rnd.choice(64, rnd.integers(0, 6), replace=False):
            probes[i] ^= np.uint64(1) << np.uint64(bit)
    w, i = index.near(probes)
    distance = np.bitwise_count(probes[:, None] ^ index.prints[None, :])
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*map(list, np.nonzero(distance <= E.RADIUS))))


def test_pages_are_looked_up_together(monkeypatch):
    lookups = []
    near = E.ItemIndex.near
    monkeypatch.setattr(E.ItemIndex, "near", lambda self, prints: lookups.append(len(prints)) or near(self, prints))
    texts = [f"{ITEM} page{k}" if k % 100 == 7 else " ".join(f"{w}{k}" for w in OTHER) for k in range(300)]
    none = pa.nulls(300, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts), pa.array([1] * 300), none, none, none], names=["doc_id", "text", "n_columns", "x0", "x1", "y0"])
    items = type("Items", (), {"value": [("i1", ITEM)]})
    (out,) = E._finder(items, "together")(iter([batch]))
    assert out.to_pydict() == {"doc_id": [7, 107, 207], "item_id": ["i1"] * 3, "n_words": [len(WORDS)] * 3}
    assert len(lookups) <= 3


def test_grouped_pages_are_found_as_single_ones(monkeypatch):
    monkeypatch.setattr(E, "GROUP", 900)
    rnd = random.Random(4)
    ends = ["", " ", "\n", "one", "- \n", "\x01\n", "x-\ny", "\u00ad\n\u2028", "½ ﬁ \u0301 '’ ■", " ".join(OTHER * 20), "".join(OTHER * 20)]
    halves = [" ".join(WORDS[:16]), " ".join(WORDS[16:]), ITEM, "\n".join(lines_of(WORDS, 3)), "-\n".join(lines_of(WORDS, 1))]
    texts = [rnd.choice(ends) + rnd.choice(["", *halves]) + rnd.choice(ends) for _ in range(300)]
    words = E.Words()
    index = E.ItemIndex([("a", ITEM), ("b", " ".join(WORDS[10:30]))], words)
    single = {k: found for k, t in enumerate(texts) if (found := E.leaked(E.Page(t.split("\n")), index, E.Words()))}
    words.LIMIT = 150
    grouped = E.leaked_all(((k, E.Page(t.split("\n"))) for k, t in enumerate(texts)), index, words)
    assert len(single) > 100 and {k: found for k, found in grouped.items() if found} == single
    # A page of several readings.
    assert E.leaked_all([(5, E.Page(["", ITEM])), (5, E.Page(WORDS[:14])), (6, E.Page([""]))], index, words) == {5: {0: len(WORDS), 1: 20}}


def test_tokens_fold_as_pages_do():
    text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)} " for c in range(0x3000) if chr(c) != "\n")
    page, words = E.Page([text]), E.Words()
    names = {n: w for w in page.words for n in [words._known[w]]}
    assert [names[n] for t in page.raw.split() for n in words._tokens[t]] == page.words
    origins = [i for i, c in enumerate(page.raw) for x in E.FOLD[ord(c)] if x not in " \n\x01"]
    assert [page.origin(k) for k in range(len(page.text))] == origins


def test_many_pairs_are_compared_in_parts(monkeypatch):
    index = E.ItemIndex([(str(k), ITEM) if k % 2 else (str(k), f"{ITEM} {k}") for k in range(40)], E.Words())
    whole = index.near(index.prints)
    monkeypatch.setattr(E, "PAIRS", 7)
    assert len(whole[0]) > 500 and all(np.array_equal(a, b) for a, b in zip(whole, index.near(index.prints), strict=True))


@pytest.mark.parametrize("text", ["", "one", "a\n\nb", "x    y\nz    w"])
def test_readings_never_fail(text):
    for boxes in (None, [], [0], [None, None], [5, 900]):
        out = readings(text, boxes, boxes, boxes, 3)
        assert out and all(isinstance(x, str) for lines in out for x in lines)
