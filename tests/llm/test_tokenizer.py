import base64
import os
import random

import pytest

from sparsemill.llm import tokenizer_encode as T

tiktoken = pytest.importorskip("tiktoken")
SIGNS = "aB1 \n\t'  \x1c\x1d\x1f\x85​　½²Ⅳ٣éßſ漢字👩‍.,-'s'rèͅªºⅠⒶ" + " " * 6 + "\n" * 4


def reference():
    with open(os.path.join(T.VOCABULARY, T.FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_same_ids_and_round_trip():
    encoder, ref, rnd = T.Encoder(), reference(), random.Random(7)
    texts = ["", " ", "\n\n", "<|endoftext|> x", "a\r\nb\r\n", "foo \n bar\n\n  baz ", "x" * 5000, "Grün ﬁre ſ"]
    texts += ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(30))) for _ in range(5000)]
    for t in texts:
        got = ids(encoder.encode(t))
        assert got == ref.encode_ordinary(t)
        assert encoder.decode(got) == t


def test_memory_may_overflow(monkeypatch):
    monkeypatch.setattr(T, "CACHE_ENTRIES", 3)
    encoder, ref = T.Encoder(), reference()
    text = "The quick brown fox\njumps over the lazy dog " * 3
    assert ids(encoder.encode(text)) == ref.encode_ordinary(text)


def test_frame(spark):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (1, "Hello world", "x")]
    out = T.encode_texts(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in out) == sorted(
        (d is None, d or 0, reference().encode_ordinary(t or "")) for d, t, _ in rows
    )
    assert T.encode_texts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
