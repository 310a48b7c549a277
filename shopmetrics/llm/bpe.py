"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

A text is cut into halves until a half is a leaf, leaves are encoded by the vocabulary's own
encoder, and neighbours are joined: around the seam a window grows to the left and to the right
until it ends at a safe cut, the window is encoded anew, and the tokens outside it are kept. A
safe cut is a single blank between two characters that aren't white space. The pattern can have
a blank inside a match only as its first character or in a run of white space, and looks at most
one character past a match; so every match that begins before such a blank ends before it, one
begins at it, and neither side's matches depend on the other. Merges never cross matches, hence
the tokens on both sides are those of the whole text. Where there is no safe cut, the window
grows to the whole half, which is then encoded as one. Decoding joins bytes up the same tree.

Defined cases: a null text counts as empty and has no ids; rows are handled one by one, so
repeated ids, null ids, further columns and empty tables need nothing special.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import PIECE_BYTES, pieces, utf8

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LEAF_CHARS = 4096
LEAF_TOKENS = 1 << 16
SAFE_CUT = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _cut_before(text: str, first: int, seam: int) -> int:
    """The last safe cut in ``text[first:seam]`` found by a growing window, or ``first``."""
    width = 64
    while True:
        start = max(first, seam - width)
        last = None
        for last in SAFE_CUT.finditer(text, start, seam):  # noqa: B007
            pass
        if last is not None and last.start() > first:
            return last.start()
        if start == first:
            return first
        width *= 2


def _cut_after(text: str, seam: int, end: int) -> int:
    """The first safe cut after ``seam`` found by a growing window, or ``end``."""
    width = 64
    while True:
        stop = min(end, seam + width)
        for cut in SAFE_CUT.finditer(text, seam, stop):
            if cut.start() > seam:
                return cut.start()
        if stop == end:
            return end
        width *= 2


def encode(text: str, encode_leaf, leaf: int = LEAF_CHARS, first: int = 0, end: int | None = None) -> list[int]:
    """Ids of ``text[first:end]``, joined from the ids of its halves."""
    end = len(text) if end is None else end
    if end - first <= leaf:
        return encode_leaf(text[first:end])
    seam = (first + end) // 2
    left, right = encode(text, encode_leaf, leaf, first, seam), encode(text, encode_leaf, leaf, seam, end)
    a, b = _cut_before(text, first, seam), _cut_after(text, seam, end)
    del left[len(left) - len(encode_leaf(text[a:seam])) :]
    left += encode_leaf(text[a:b])
    left += right[len(encode_leaf(text[seam:b])) :]
    return left


def decode(ids: list[int], decode_leaf, leaf: int = LEAF_TOKENS) -> bytes:
    """Bytes of ``ids``, joined from the bytes of its halves."""
    if len(ids) <= leaf:
        return decode_leaf(ids)
    half = len(ids) // 2
    return decode(ids[:half], decode_leaf, leaf) + decode(ids[half:], decode_leaf, leaf)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) for every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_leaf = encoder(vocabulary).encode_ordinary
        for batch in batches:
            offsets = utf8(batch.column(1))[1]
            for a, b in pieces(offsets, PIECE_BYTES):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                ids = [encode(text or "", encode_leaf, leaf) for text in texts]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate([np.asarray(x, np.int32) for x in ids]), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF_TOKENS) -> DataFrame:
    """(doc_id, ids, decoded binary) for every row of ids; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_leaf = encoder(vocabulary).decode_bytes
        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            for a, b in pieces(ends.astype(np.int64), PIECE_BYTES):
                part = lists.slice(a, b - a)
                decoded = [decode(ids or [], decode_leaf, leaf) for ids in part.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), part, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
                )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(round_trip: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded documents."""
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return round_trip.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
