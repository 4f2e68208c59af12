"""Token ids of whole texts by a byte-level BPE vocabulary, through a sentencepiece model built from that vocabulary.

The vocabulary file (token bytes and ranks) is serialised as a sentencepiece BPE model: each byte becomes the character that stands for
it, each token a piece with the score -rank, so that the best-scored merge is the one of lowest rank; normalisation is the identity.
Texts are cut into pre-tokens by the vocabulary's pattern, pre-tokens are encoded once per worker and kept, and a text's ids are the
joined ids of its pre-tokens. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparsemill.session import map_arrow, spread_small

#: Folder with the public vocabulary files, of byte_bpe_50k.tiktoken (base64 token, rank) among others.
VOCABULARY = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
FILE = "byte_bpe_50k.tiktoken"

# Fixed values of the vocabulary: how a text is cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a worker's memory of pre-tokens; when full it starts anew (results do not depend on it).
CACHE_ENTRIES = 400_000


def byte_characters() -> list[str]:
    """The character of each byte: itself where it prints, else one from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _piece(text: str, score: float, kind: int = 1) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece ids equal ranks; free ids get unused pieces, the unknown piece comes last (bytes are never unknown)."""
    chars, by_rank = byte_characters(), {r: t for t, r in ranks.items()}
    size = max(by_rank) + 1
    pieces = [_piece("".join(chars[b] for b in by_rank[i]), -float(i)) if i in by_rank else _piece(f"<unused {i}>", 0.0, 5) for i in range(size)]
    none = (1 << 64) - 1
    trainer = _number(3, 2) + _number(40, size) + b"".join(_number(field, none) for field in (41, 42, 43))
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*pieces, _piece("<unk>", 0.0, 2), _block(2, trainer), _block(3, normalizer)])


class Encoder:
    """Encodes texts to packed int32 ids."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import regex
        import sentencepiece

        ranks = read_ranks(os.path.join(vocabulary, FILE))
        self._model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self._cut = regex.compile(PATTERN).findall
        self._chars = {i: c for i, c in enumerate(byte_characters())}
        self._bytes = {r: t for t, r in ranks.items()}
        self._newline = self._encode("\n")
        self._first, self._later, self._odd = _Memory(self._pieces), _Memory(lambda w: self._pieces(" " + w)), _Memory(self._encode)

    def _encode(self, pre_token: str) -> bytes:
        mapped = pre_token.encode("utf-8", "replace").decode("latin-1").translate(self._chars)
        return np.array(self._model.encode(mapped, num_threads=1), dtype="<i4").tobytes()

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._odd.__getitem__, self._cut(text)))

    def encode(self, text: str | None) -> bytes:
        """Packed ids; none for a null or empty text.

        A line break before anything but white space is a pre-token of its own, and a single space starts one, so such parts
        of a text are looked up whole; parts with other white space are cut by the pattern.
        """
        if not text:
            return b""
        out: list[bytes] = []
        blocks: list[str] = []
        for line in text.split("\n"):
            if blocks and (not line or line[0].isspace()):
                blocks[-1] += "\n" + line
            else:
                blocks.append(line)
        for i, block in enumerate(blocks):
            if i:
                out.append(self._newline)
            words = block.split(" ")
            if words == block.split():
                out.append(self._first[words[0]])
                out.extend(map(self._later.__getitem__, words[1:]))
            else:
                out.append(self._pieces(block))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self._bytes[i] for i in ids).decode("utf-8", "replace")


class _Memory(dict):
    """Remembers results up to ``CACHE_ENTRIES``; very long texts are not kept."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key: str) -> bytes:
        value = self._make(key)
        if len(key) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=2)
def worker_encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process, with its memory, for all tasks it runs."""
    return Encoder(vocabulary)


def encode_texts(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, ids array<int>)``, one row per input row and no shuffle. Empty and null texts give an empty list; names of special tokens
    are ordinary text; nothing is normalised or cut off.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            packed = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(packed), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    return map_arrow(spread_small(df.select(id_column, text)), run, f"`{id_column}` {kind}, ids array<int>")
