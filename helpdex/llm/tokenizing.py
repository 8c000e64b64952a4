"""Encoding of a corpus with a public byte-level BPE vocabulary, by a tree reduction over pieces of the texts.

A text is cut into halves until a part is at most LEAF characters, the leaves are encoded, and neighbours are joined up
the tree. The pre-tokenizer scans from left to right without memory, so in ``a + b`` every word of ``a`` but its last
(or last two, see open_from) stays as it is; from there words are scanned over a window that grows into ``b`` until one of them ends where a word of
``b`` itself ends. Beyond that point the scan repeats that of ``b``, so all tokens outside the window are proven stable
and only the window is encoded again. The join is associative; decoding concatenates bytes up the same tree.

Defined results: null and empty texts have an empty list of ids; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdex.sources.tables import table

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Longest text encoded in one step, in characters.
LEAF = 1024
#: Fixed value: the word pattern of the byte_bpe_50k vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD = regex.compile(WORDS)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a rank file, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Node(NamedTuple):
    """An encoded part of a text: its characters, ids, and from where its words could change (characters and ids)."""

    text: str
    ids: list[int]
    open_char: int
    open_id: int


def open_from(text: str) -> int:
    """Start of the last word, or of the one before if that is one character: "'l" and "l" can become "'ll"."""
    before, last, end = 0, 0, 0
    for m in WORD.finditer(text):
        before, last, end = last, m.start(), m.end()
    return last if end - last > 1 else before


def word_ids(text: str, encode, start: int = 0, stop: int | None = None) -> list[int]:
    """Ids of the words of ``text`` from ``start`` up to ``stop``, each encoded alone as white space depends on what follows."""
    spans = [m.span() for m in WORD.finditer(text, start)]
    return [i for a, b in spans if stop is None or b <= stop for i in encode(text[a:b])]


def leaf(text: str, encode) -> Node:
    start, ids = open_from(text), encode(text)
    return Node(text, ids, start, len(ids) - len(word_ids(text, encode, start)))


def join(a: Node, b: Node, encode) -> Node:
    """The encoding of ``a.text + b.text``, encoding only a window around the joint."""
    if not a.text or not b.text:
        return a if a.text else b
    tail = a.text[a.open_char :]
    grow = 64
    while True:
        head = b.text[:grow]
        whole = len(head) == len(b.text)
        # a word of the window that touches its end could go on beyond it, unless the window holds all of b
        own = {m.end() for m in WORD.finditer(head) if whole or m.end() < len(head) - 1}
        spans = [m.span() for m in WORD.finditer(tail + head)]
        met = next((e for _, e in spans if e - len(tail) in own and (whole or e < len(tail) + len(head) - 1)), None)
        if met is not None:
            break
        grow *= 2
    into = met - len(tail)
    window = word_ids(tail + head, encode, 0, met)
    skipped = len(word_ids(head, encode, 0, into))
    text = a.text + b.text
    ids = a.ids[: a.open_id] + window + b.ids[skipped:]
    if b.open_char >= into:
        return Node(text, ids, len(a.text) + b.open_char, len(ids) - (len(b.ids) - b.open_id))
    start = open_from(tail + b.text)
    return Node(text, ids, a.open_char + start, len(ids) - len(word_ids(tail + b.text, encode, start)))


def encode_tree(text: str, encode, leaf_chars: int = LEAF) -> Node:
    """Encode halves and join them; parts of up to ``leaf_chars`` characters are encoded at once."""
    if len(text) <= leaf_chars:
        return leaf(text, encode)
    half = len(text) // 2
    return join(encode_tree(text[:half], encode, leaf_chars), encode_tree(text[half:], encode, leaf_chars), encode)


def encode_text(text: str | None, encode, leaf_chars: int = LEAF) -> list[int]:
    if not text:
        return []
    return encode(text) if len(text) <= leaf_chars else encode_tree(text, encode, leaf_chars).ids


def decode_tree(ids: list[int], token_bytes, leaf_ids: int = 4096) -> bytes:
    """Bytes of a list of ids, concatenated up the tree."""
    if len(ids) <= leaf_ids:
        return b"".join(map(token_bytes, ids))
    half = len(ids) // 2
    return decode_tree(ids[:half], token_bytes, leaf_ids) + decode_tree(ids[half:], token_bytes, leaf_ids)


def encode_corpus(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF) -> DataFrame:
    """``(id_col, ids)`` of every row; repeated rows and ids stay. The vocabulary file must be at that path on every executor."""
    path = f"{tokenizer_dir}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            lists = [encode_text(x, encode, leaf_chars) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [id_col, "ids"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id_col, text)`` of encoded rows; a null or empty list is an empty text."""
    path = f"{tokenizer_dir}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = encoder(path).decode_single_token_bytes
        for batch in batches:
            texts = [decode_tree(x or [], token_bytes).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def p6_ids(spark, data_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k (see TESTDATA.md)."""
    return encode_corpus(table(spark, data_dir, "documents"))


def p6_round_trip(spark, data_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return decode_corpus(encode_corpus(table(spark, data_dir, "documents")))


def p6_token_counts(spark, data_dir: str) -> DataFrame:
    """Documents and tokens of each source."""
    docs = table(spark, data_dir, "documents").select("source", "text")
    sized = encode_corpus(docs, "source").select("source", F.size("ids").cast("long").alias("n"))
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))


SQL = {"p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p6_token_counts": p6_token_counts}
