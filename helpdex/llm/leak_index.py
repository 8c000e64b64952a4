"""Held-out passages inside training texts, found with an FM-index of each shard of the corpus.

Words are compared without case, diacritics, punctuation, markup and white space. A document holds a passage if

* at least EXACT words in a row of it are in the document, or
* at least FUZZY words in a row of it are, with no more than one in five of them changed, dropped or added. The first and
  the last of these words are in the document: a shorter quote doesn't become one of FUZZY words by words it lacks.

Every window of the second kind has a run of SEED unchanged words (at most L/5 edits cut L words into at most L/5 + 1
runs), and so has every one of the first. A window of more than REACH = 2 * FUZZY + 7 words has a shorter one: if two
unchanged words with only edits between them stand where both parts have FUZZY words, the part with the smaller share of
edits is one; else all but one of the words there are edits, which leaves so few for the rest that the window up to or from
that word is one. So it is enough to look up all runs of SEED words of the passages and to extend each hit to at most
REACH words with at most REACH / 5 edits: nothing is lost.

Each task builds, for its shard, a suffix array, the Burrows-Wheeler transform and a wavelet matrix, searches all seed
phrases backward at once, locates the hits by sampled suffix positions and extends them with a banded alignment.
Documents are never shuffled. The passages are broadcast in blocks of PASSAGES rows, a fixed bound.

Defined results: null and empty texts and passages without words take no part; passages shorter than EXACT words can't be
found; repeated documents and passages give one row per (item_id, doc_id).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpdex.sources.tables import table

EXACT, FUZZY, SEED = 12, 20, 4
#: Words in one index, passages in one broadcast, one in SAMPLED suffix positions kept.
SHARD_WORDS, PASSAGES, SAMPLED = 300_000, 5_000, 8
REACH = 2 * FUZZY + 7
EDITS = REACH // 5
OTHER = 1
GAP = EDITS + 2
WORD = re.compile(r"[^\W_]+(?:[​﻿­]+[^\W_]+)*")
LETTERS = str.maketrans({"ł": "l", "đ": "d", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "​": "", "﻿": "", "­": ""})


def folded(word: str) -> str:
    """``word`` in lower case without diacritics."""
    word = word.lower()
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word.translate(LETTERS)) if not unicodedata.combining(c))


def composed(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


class Passages(NamedTuple):
    """Passages as rows of word ids (padded with 0), their ids and lengths, the vocabulary, and the seed phrases with where they stand."""

    item_ids: list[int]
    words: np.ndarray
    lengths: np.ndarray
    vocabulary: dict[str, int]
    seeds: np.ndarray
    at_seed: np.ndarray
    at_item: np.ndarray
    at_word: np.ndarray


def prepare(rows: list[tuple[int, str]]) -> Passages:
    """Number the words of all passages (from 2; 1 is any other word) and list their distinct seed phrases."""
    vocabulary: dict[str, int] = {}
    ids, lists = [], []
    for item_id, text in rows:
        words = [vocabulary.setdefault(folded(w), len(vocabulary) + 2) for w in WORD.findall(composed(text or ""))]
        if len(words) >= EXACT:
            ids.append(item_id)
            lists.append(words)
    width = max(map(len, lists), default=0)
    matrix = np.zeros((len(lists), width), dtype=np.int32)
    for i, words in enumerate(lists):
        matrix[i, : len(words)] = words
    grams = [(tuple(words[j : j + SEED]), i, j) for i, words in enumerate(lists) for j in range(len(words) - SEED + 1)]
    distinct = {g: k for k, g in enumerate(dict.fromkeys(g for g, _, _ in grams))}
    order = sorted(range(len(grams)), key=lambda k: distinct[grams[k][0]])
    return Passages(
        ids, matrix, np.array(list(map(len, lists)), dtype=np.int64), vocabulary,
        np.array(list(distinct), dtype=np.int32).reshape(-1, SEED),
        np.array([distinct[grams[k][0]] for k in order], dtype=np.int64),
        np.array([grams[k][1] for k in order], dtype=np.int64), np.array([grams[k][2] for k in order], dtype=np.int64),
    )


class FmIndex:
    """Burrows-Wheeler transform of ``text`` in a wavelet matrix, with sampled suffix positions.

    Suffixes are sorted in full by doubling: the walk to a sampled position needs the exact order, not only that of
    the length of a phrase.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)  # ends the text; 0 is no word
        n = len(text)
        self.n = n
        rank, k = text.astype(np.int64), 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            if k < n:
                after[:-k] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key)
            ranked = key[order]
            steps = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = steps
            k *= 2
            if k >= n or steps[-1] == n - 1:
                break
        self.kept = order % SAMPLED == 0
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])
        self.positions = order[self.kept]
        last = text[order - 1]
        counts = np.bincount(text, minlength=symbols)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = last.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(n - self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands among the first ``upto`` of the transform."""
        low, high = np.zeros_like(upto), upto.copy()
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            bit = (symbol >> level) & 1
            a, b = ones[low], ones[high]
            low = np.where(bit, zeros + a, low - a)
            high = np.where(bit, zeros + b, high - b)
        return high - low

    def step(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer."""
        symbol, at, low = np.zeros(len(rows), dtype=np.int64), rows.astype(np.int64), np.zeros(len(rows), dtype=np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = (ones[at + 1] - ones[at]).astype(np.int64)
            symbol = symbol * 2 + bit
            a, b = ones[low], ones[at]
            low = np.where(bit, zeros + a, low - a)
            at = np.where(bit, zeros + b, at - b)
        return self.below[symbol] + at - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the rows that begin with each phrase."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column].astype(np.int64)
            low = self.below[symbol] + self.rank(symbol, low)
            high = np.maximum(self.below[symbol] + self.rank(symbol, high), low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walking to the next sampled one."""
        out = np.full(len(rows), -1, dtype=np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            known = self.kept[at]
            out[open_[known]] = (self.positions[self.kept_before[at[known]]] + steps) % self.n
            open_, at = open_[~known], at[~known]
            at = self.step(at) if len(at) else at
            steps += 1
        return out


def extend(text: np.ndarray, start: np.ndarray, words: np.ndarray, item: np.ndarray, first: np.ndarray, direction: int, lengths: np.ndarray) -> np.ndarray:
    """Best score of each hit's extension by 0..REACH-SEED passage words (rows), the last one kept, in one direction.

    A kept word scores 1, a changed or dropped one -4, an added one -5, so a window is within one edit in five exactly
    if its score is not negative.
    """
    width, most, none = 2 * EDITS + 1, REACH - SEED, np.int16(-10_000)
    # rows are diagonals or steps, columns hits; step k meets the words k - 1 - EDITS to k - 1 + EDITS from the start
    place = start[None, :] + direction * np.arange(-EDITS, most + EDITS)[:, None]
    seen = np.where((place >= 0) & (place < len(text)), text[np.clip(place, 0, len(text) - 1)], 0)
    offsets = np.arange(-EDITS, EDITS + 1)
    row = np.where(offsets >= 0, -5 * offsets, none).astype(np.int16)[:, None].repeat(len(start), axis=1)
    out = np.full((most + 1, len(start)), none, dtype=np.int16)
    out[0] = 0
    for k in range(1, most + 1):
        at = first + direction * (k - 1)
        word = np.where((at >= 0) & (at < lengths[item]), words[item, np.clip(at, 0, words.shape[1] - 1)], -1)
        kept = np.where(seen[k - 1 : k - 1 + width] == word, row + np.int16(1), none)
        out[k] = kept.max(axis=0)
        new = np.maximum(kept, row - np.int16(4))
        new[:-1] = np.maximum(new[:-1], row[1:] - np.int16(4))
        for d in range(1, width):
            np.maximum(new[d], new[d - 1] - np.int16(5), out=new[d])
        row = new
    return out


def hits(text: np.ndarray, passages: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(item, start, end, exact)`` of every leaked window in ``text``; positions are words."""
    empty = np.zeros(0, dtype=np.int64)
    if len(text) < EXACT or not len(passages.seeds):
        return empty, empty, empty, empty
    index = FmIndex(text, len(passages.vocabulary) + 2)
    low, high = index.search(passages.seeds)
    counts = high - low
    if not counts.sum():
        return empty, empty, empty, empty
    seed = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[seed]
    place = index.locate(rows)
    # each place with every passage that has the phrase
    begin = np.searchsorted(passages.at_seed, seed, "left")
    many = np.searchsorted(passages.at_seed, seed, "right") - begin
    which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    place, item, word = np.repeat(place, many), passages.at_item[which], passages.at_word[which]
    # neighbouring hits on one diagonal are one run
    order = np.lexsort((place, place - word, item))
    place, item, word = place[order], item[order], word[order]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (word[1:] != word[:-1] + 1)])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(place))) + SEED - 1
    place, item, word = place[at], item[at], word[at]
    exact = run >= EXACT
    right = extend(text, place + run, passages.words, item, word + run, 1, passages.lengths)
    left = extend(text, place - 1, passages.words, item, word - 1, -1, passages.lengths)
    best_right = np.concatenate([np.maximum.accumulate(right[::-1])[::-1], np.full((1, len(run)), -10_000, dtype=np.int16)])
    grow, each = np.arange(len(left))[:, None], np.arange(len(run))
    need = np.clip(FUZZY - run - grow, 0, len(left))
    total = left + np.take_along_axis(best_right, need, axis=0) + run
    a = total.argmax(axis=0)
    found = total[a, each] >= 0
    b = np.where(grow >= need[a, each], right, -10_000).argmax(axis=0)
    keep = exact | found
    start = np.where(found, place - a, place)
    end = np.where(found, place + run + b, place + run)
    return item[keep], start[keep], end[keep], exact[keep]


class Shard:
    """Documents as one row of word ids; long rows of other words are cut to GAP, and GAP of them part documents."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.docs: list[int] = []
        self.starts: list[int] = []
        self.offsets: list[np.ndarray] = []

    def add(self, doc: int, ids: np.ndarray, base: int) -> None:
        other = ids == OTHER
        runs = np.arange(len(ids)) - np.maximum.accumulate(np.where(other, -1, np.arange(len(ids))))
        kept = np.flatnonzero(~other | (runs <= GAP))
        self.docs.append(doc)
        self.starts.append(self.size)
        self.offsets.append(kept + base)
        self.parts += [ids[kept], np.full(GAP, OTHER, dtype=np.int32)]
        self.size += len(kept) + GAP

    def search(self, passages: Passages) -> list[tuple[int, int, int, int, bool]]:
        """(doc, item, first word, last word, exact) of each leaked window."""
        if not self.parts:
            return []
        item, start, end, exact = hits(np.concatenate(self.parts), passages)
        owner = np.searchsorted(self.starts, start + (end - start) // 2, "right") - 1
        out = []
        for i, s, e, x, d in zip(item.tolist(), start.tolist(), end.tolist(), exact.tolist(), owner.tolist()):
            places = self.offsets[d]
            a, b = max(s - self.starts[d], 0), min(e - 1 - self.starts[d], len(places) - 1)
            if a <= b:
                out.append((self.docs[d], i, int(places[a]), int(places[b]), bool(x)))
        return out


def _windows(batch: pa.RecordBatch, passages: Passages, ids: dict[str, int]) -> Iterator[tuple[int, int, int, int, bool]]:
    shard = Shard()
    for doc, text in enumerate(batch.column("text").to_pylist()):
        if not text:
            continue
        words = WORD.findall(composed(text))
        for w in set(words).difference(ids):
            ids[w] = passages.vocabulary.get(folded(w), OTHER)
        row = np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words))
        if np.count_nonzero(row != OTHER) < SEED:
            continue
        # a very long text is cut with an overlap longer than any window
        for base in range(0, len(row), SHARD_WORDS):
            shard.add(doc, row[base : base + SHARD_WORDS + 2 * REACH], base)
            if shard.size >= SHARD_WORDS:
                yield from shard.search(passages)
                shard = Shard()
    yield from shard.search(passages)


def leaks(documents: DataFrame, items: DataFrame, spans: bool = False) -> DataFrame:
    """``(item_id, doc_id)`` of every passage in every document; with ``spans`` also 1-based ``start_pos`` and ``end_pos``.

    Positions are characters of the text in composed (NFC) form.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    kind = documents.schema["doc_id"].dataType.simpleString()
    blocks = max(1, -(-items.count() // PASSAGES))
    numbered = items.select("item_id", "text").where(F.col("item_id").isNotNull()).distinct()
    out = None
    for block in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(prepare([(r["item_id"], r["text"]) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages, ids = shared.value, {}
            for batch in batches:
                if len(ids) > 500_000:
                    ids.clear()
                found = set(_windows(batch, passages, ids))
                if not spans:
                    pairs = sorted({(d, i) for d, i, _, _, _ in found})
                    at = pa.array([d for d, _ in pairs], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([passages.item_ids[i] for _, i in pairs], pa.int64()), batch.column("doc_id").take(at)], ["item_id", "doc_id"])
                    continue
                rows = []
                texts = batch.column("text")
                for d in sorted({d for d, *_ in found}):
                    places = [m.span() for m in WORD.finditer(composed(texts[d].as_py()))]
                    rows += [(d, i, places[a][0] + 1, places[b][1]) for x, i, a, b, _ in found if x == d]
                at = pa.array([d for d, *_ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([passages.item_ids[i] for _, i, _, _ in rows], pa.int64()), batch.column("doc_id").take(at), pa.array([a for *_, a, _ in rows], pa.int64()), pa.array([b for *_, b in rows], pa.int64())],
                    ["item_id", "doc_id", "start_pos", "end_pos"],
                )

        schema = f"item_id bigint, doc_id {kind}" + (", start_pos bigint, end_pos bigint" if spans else "")
        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Stretches to remove from each document: overlapping leaked windows merged, with the items in each."""
    each = leaks(documents, items, spans=True)
    gathered = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "item_id"))).alias("windows"))
    empty = "cast(array() as array<struct<start_pos: bigint, end_pos: bigint, items: array<bigint>>>)"
    merged = F.expr(f"""
        aggregate(windows, {empty}, (done, w) ->
            if(size(done) > 0 and w.start_pos <= element_at(done, -1).end_pos + 1,
               concat(slice(done, 1, size(done) - 1), array(named_struct(
                   'start_pos', element_at(done, -1).start_pos,
                   'end_pos', greatest(element_at(done, -1).end_pos, w.end_pos),
                   'items', array_union(element_at(done, -1).items, array(w.item_id))))),
               concat(done, array(named_struct('start_pos', w.start_pos, 'end_pos', w.end_pos, 'items', array(w.item_id))))))
    """)
    return gathered.select("doc_id", F.explode(merged).alias("s")).select("doc_id", "s.start_pos", "s.end_pos", F.array_sort("s.items").alias("items"))


def p7_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every (item, document) where the document holds the item, whole or in part (see TESTDATA.md)."""
    return leaks(table(spark, data_dir, "documents"), table(spark, data_dir, "eval_items"))


def p7_removal_spans(spark: SparkSession, data_dir: str) -> DataFrame:
    """What to remove from each affected document."""
    return removal_spans(table(spark, data_dir, "documents"), table(spark, data_dir, "eval_items"))


SQL: dict[str, str] = {}
QUERIES = {"p7_found": p7_found, "p7_removal_spans": p7_removal_spans}
