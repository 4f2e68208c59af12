import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import sparsemill.llm.term_frequency as C
from sparsemill.llm.term_frequency import BurstTrie, Routes, mark_useless, term_counts


def test_against_brute_force(spark):
    rnd = random.Random(3)
    docs = [[rnd.choice([rnd.randrange(50), rnd.randrange(2**32), 2**32 - 1, 0]) for _ in range(rnd.randrange(30))] for _ in range(800)]
    docs += [None, [], [None, -1, 2**32, 7, 7]]
    occurrences, records = Counter(), Counter()
    for doc in docs:
        ok = [t for t in doc or [] if t is not None and 0 <= t < 2**32]
        occurrences.update(ok)
        records.update(set(ok))
    df = spark.createDataFrame([(d, 1) for d in docs], "terms_ array<bigint>, route int").repartition(5)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts(df, "terms_").collect()}
    assert got == {t: (occurrences[t], records[t]) for t in occurrences}


def test_marks(spark):
    counts = spark.createDataFrame([(1, 9, 4), (2, 9, 5), (3, 90, 40), (4, 90, 41)], "term bigint, occurrences bigint, records bigint")
    total = spark.createDataFrame([(100,)], "n_records bigint")
    assert {r["term"]: r["mark"] for r in mark_useless(counts, total).collect()} == {1: "rare", 2: None, 3: None, 4: "common"}


def test_empty(spark):
    assert term_counts(spark.createDataFrame([], "t array<bigint>"), "t").collect() == []


@pytest.mark.parametrize("limit", [3, 4096])
def test_strings_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "TRIE_LIMIT", 50)
    monkeypatch.setattr(C, "GATHER", 200)
    rnd = random.Random(limit)
    docs = [[rnd.choice(["", "a", "ab", "abc", "é", "\x00", "the", "the " * rnd.randrange(3), f"w{rnd.randrange(300)}", "x" * 3000, None]) for _ in range(rnd.randrange(20))] for _ in range(600)]
    docs += [None, [], [None]]
    occurrences, records = Counter(), Counter()
    for doc in docs:
        ok = [t for t in doc or [] if t is not None]
        occurrences.update(ok)
        records.update(set(ok))
    df = spark.createDataFrame([(d, "x") for d in docs], "t array<string>, term string").repartition(4)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts(df, "t").collect()}
    assert got == {t: (occurrences[t], records[t]) for t in occurrences}


def test_trie_bursts_and_adds():
    rnd = random.Random(4)
    trie, want = BurstTrie(limit=8), Counter()
    for _ in range(40):
        keys = [bytes(rnd.choice(b"ab\xff\x00") for _ in range(rnd.randrange(7))) for _ in range(50)]
        trie.add(pa.array(keys, pa.binary()), np.ones(50, np.int64), np.ones(50, np.int64))
        want.update(keys)
    got = {k: o for t in trie.containers() for k, o in zip(t["key"].to_pylist(), t["occ"].to_pylist())}
    assert got == dict(want) and len(trie) == len(want)
    assert all(len(t) <= 8 and t["key"].to_pylist() == sorted(t["key"].to_pylist()) for t in trie.containers())


def test_routes_follow_the_terms():
    rnd = random.Random(5)
    many = [b"common-" + bytes([rnd.randrange(256), rnd.randrange(256)]) for _ in range(3000)]
    routes = Routes([*many, b"rare", b"seldom", b"", b"co"], 50)
    assert routes.of(b"rare") == b"r" and routes.of(b"") == b"" and len(routes.of(many[0])) >= 8 and routes.of(b"co") == b"co" and routes.of(b"comma") == b"comma"
    held = Counter(routes.of(k) for k in set(many))
    assert max(held.values()) <= 50
    keys = sorted({*many, b"rare", b"unseen", b"common-"})
    cut = list(routes.cut(pa.array(keys, pa.binary())))
    assert [k for r, a, b in cut for k in keys[a:b]] == keys and all(routes.of(k) == r for r, a, b in cut for k in keys[a:b])
