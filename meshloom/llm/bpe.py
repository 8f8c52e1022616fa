"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut at single spaces into units that no match of the pre-tokenizer crosses; each unit
new to the worker is encoded by the library, once, and kept in a bounded memory.  Texts where
white space meets in other ways are cut by a regular expression with the same property, and long
units go to the library directly.  The vocabulary's characters stand for bytes (a fixed table of
the byte-level scheme), which gives every token its bytes, hence byte offsets, character offsets
(characters that start before the token) and decoding; a character split over tokens is put
together again when the bytes are joined, and `decode_stream` holds its first bytes back.

Defined results: null text is empty and has no tokens; special tokens' names in a text are
ordinary text; ids of rows may be null or repeat; other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CACHE = 400_000
LONG = 64
#: White space as the pre-tokenizer's \s has it.
_WS = "\t-\r \x85\xa0  -     　"
#: Characters after which a space can belong to a run of white space that the pre-tokenizer splits elsewhere.
_RARE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UNITS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_of_character() -> dict[str, int]:
    """The byte-level scheme: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in out.values())})
    return out


class Codec:
    """One vocabulary file (tokenizers' JSON), with its tables."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            special = {x["id"] for x in json.load(f).get("added_tokens", [])}
        table = byte_of_character()
        vocab = self.tokenizer.get_vocab()
        self.bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if i in special else bytes(table[c] for c in token)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, units: list[str]) -> None:
        for u, e in zip(units, self.tokenizer.encode_batch_fast(units, add_special_tokens=False), strict=True):
            self.known[u] = tuple(e.ids)

    @staticmethod
    def units(text: str) -> list[str]:
        if "  " in text or text.endswith(" ") or _RARE.search(text):
            return _UNITS.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.units(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        fresh = {u for units in cut for u in units if u not in known}
        if fresh:
            self._learn(list(fresh))
        out = [list(chain.from_iterable(map(known.__getitem__, units))) for units in cut]
        for u in fresh:
            if len(u) > LONG:
                del known[u]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text token by token; bytes of a split character wait for the rest of it."""
        held = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in ids:
            yield held.decode(self.bytes[i])
        if tail := held.decode(b"", final=True):
            yield tail

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where each token starts: in bytes, and in characters (of its first byte's character)."""
        raw = np.frombuffer(text.encode(), np.uint8)
        size = self.size[np.array(ids, np.int64)]
        at = np.cumsum(size) - size
        return at, np.cumsum((raw & 0xC0) != 0x80)[at] - 1 if len(ids) else at


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _blocks(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text."""
    n = len(column)
    sizes = np.cumsum(column.cast(pa.large_binary()).fill_null(b"").to_pandas().map(len).to_numpy(np.int64)) if n else np.zeros(0, np.int64)
    i = 0
    while i < n:
        before = sizes[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield i, min(j, n)
        i = j


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """(id, ids) of each row; with_offsets adds byte_starts and char_starts, one each a token."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "ids", *(["byte_starts", "char_starts"] if with_offsets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for i, j in _blocks(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                ids = c.encode(texts)
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if with_offsets:
                    starts = [c.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                    lists += [pa.array([s[k].tolist() for s in starts], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists], names)

    extra = ", byte_starts array<long>, char_starts array<long>" if with_offsets else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>{extra}")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """(id, n_tokens, decoded) of rows (id, ids), decoded in bytes; with digests, hex SHA-256 of the
    decimal ids joined by spaces and of the bytes instead of the bytes."""
    import hashlib

    kind = encoded.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["decoded"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            column = batch.column(1)
            n, out = [], [[], []]
            for x in column:
                ids = x.values.to_numpy().tolist() if x.is_valid else []
                n.append(len(ids))
                raw = c.decode(ids)
                if digests:
                    out[0].append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                    out[1].append(hashlib.sha256(raw).hexdigest())
                else:
                    out[0].append(raw)
            rest = [pa.array(out[0], pa.string()), pa.array(out[1], pa.string())] if digests else [pa.array(out[0], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *rest], names)

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "decoded binary"))
