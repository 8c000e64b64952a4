"""Most similar vectors by additive quantisation.

A vector is written as a sum of LEVELS codewords, one from each of LEVELS full-dimensional residual codebooks, found by
beam search; its code, the norm of the sum and the cosine of vector and sum are stored. Two searches:

* ``near_pairs`` (similarity join): the codewords of the first, larger level are the cells. A vector is listed in its
  best cell and those almost as good, so similar vectors meet in a cell. Codewords that are much alike are one cell, so
  no boundary runs through a dense group; cells that hold more than CELL vectors are compared in blocks, spread over
  tasks. Within a cell, tables of the products of a vector with all codewords score the codes of the others by lookups;
  every pair whose score, given how far the code is from its vector, leaves the limit within SURE standard deviations is
  ranked again exactly, however many there are, and only the best of each vector leave the task. A dense group costs
  the square of its size in lookups and products, and rows in proportion to its size times its blocks.
* ``nearest`` (a stated query set against all rows): the same tables score every code of a block by lookups, the best are
  ranked again exactly.

The codebooks are fitted on at most about SAMPLE vectors (a documented bound, drawn by hash); every vector is indexed.
Exact copies are one class for the join, so a group of copies never makes pairs of all its members.

Defined results: vectors that are null, zero, of another width or hold NaN or infinite values take no part, nor do null
ids and kinds; ids written twice count once; length doesn't matter; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpdex.plans.skew import cut, join_to_groups
from helpdex.sources.tables import table

DIMS, LEVELS, WORDS, BEAM = 64, 8, 256, 8
SAMPLE, TOP = 16_000, 5
#: Cells of the join at most, rows of the sample for each, entries of a cell that is compared at once, rows of a tile.
CELLS, PER_CELL, CELL, TILE = 1_024, 16, 24_000, 1_024
#: Codewords so alike are one cell; a vector is listed in cells so much worse than its best; see recall in the tests.
MERGE, MARGIN = 0.8, 0.12
#: Partial codes kept while a vector of the join is encoded; standard deviations allowed between a score and the truth;
#: one in DENSE pairs of a tile from which the whole tile is ranked exactly at once, which is then cheaper.
JOIN_BEAM, SURE, DENSE = 4, 5.0, 24
#: Candidates kept beyond ``top`` until they are ranked in double precision.
SPARE = 3
#: Decimals of a cosine in lists of the nearest, so that equal directions tie.
DECIMALS = 6
QUERY_BLOCK, ROW_BLOCK, RERANK = 4_000, 50_000, 400


def fit(sample: np.ndarray, levels: int = LEVELS, words: int = WORDS, rounds: int = 8) -> np.ndarray:
    """Codebooks (levels, words, dims): k-means of the residuals, level by level, from a fixed start."""
    rng = np.random.default_rng(0)
    words = min(words, len(sample))
    rest, books = sample.astype(np.float32).copy(), []
    for _ in range(levels):
        book = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            nearest = (rest @ book.T - 0.5 * (book * book).sum(axis=1)).argmax(axis=1)
            n = np.bincount(nearest, minlength=words)
            total = np.zeros_like(book)
            np.add.at(total, nearest, rest)
            book[n > 0] = total[n > 0] / n[n > 0, None]
        books.append(book)
        rest -= book[(rest @ book.T - 0.5 * (book * book).sum(axis=1)).argmax(axis=1)]
    return np.array(books)


def beam_search(x: np.ndarray, books: np.ndarray | list[np.ndarray], beam: int) -> np.ndarray:
    """The best code of each vector, found with ``beam`` partial codes at a time."""
    n = len(x)
    codes, error, rest = np.zeros((n, 1, 0), dtype=np.int16), np.zeros((n, 1), dtype=np.float32), x[:, None, :]
    for book in books:
        paths = rest.shape[1]
        product = (rest.reshape(n * paths, -1) @ book.T).reshape(n, paths, -1)
        cost = (error[:, :, None] + (book * book).sum(axis=1) - 2 * product).reshape(n, -1)
        width = min(beam, cost.shape[1])
        best = np.argpartition(cost, width - 1, axis=1)[:, :width] if width < cost.shape[1] else np.broadcast_to(np.arange(width), (n, width))
        best = np.take_along_axis(best, np.take_along_axis(cost, best, axis=1).argsort(axis=1, kind="stable"), axis=1)
        error = np.take_along_axis(cost, best, axis=1)
        path, word = best // len(book), best % len(book)
        codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], axis=1), word[:, :, None].astype(np.int16)], axis=2)
        rest = np.take_along_axis(rest, path[:, :, None], axis=1) - book[word]
    return codes[:, 0, :]


def decoded(codes: np.ndarray, books: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """The sums of the codewords."""
    out = books[0][codes[:, 0]].copy()
    for level in range(1, len(books)):
        out += books[level][codes[:, level]]
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long float lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32, copy=False) if len(column) else np.zeros((0, DIMS), dtype=np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(chunks: DataFrame) -> DataFrame:
    """(id, kind, vec) of the rows that take part."""
    return chunks.select("id", "kind", "vec").where(
        F.col("id").isNotNull() & F.col("kind").isNotNull() & (F.size("vec") == DIMS) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    )


def unit_vectors(chunks: DataFrame) -> DataFrame:
    """(id, kind, key, unit) of every usable vector: scaled to length one, ``key`` equal for equal directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(matrix(batch.column("vec")))
            rounded = np.round(x, 5) + 0.0
            keys = [xxhash.xxh3_128_hexdigest(row.tobytes()) for row in rounded]
            flat = pa.array(x.astype(np.float32).ravel(), pa.float32())
            units = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, DIMS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), pa.array(keys, pa.string()), units], ["id", "kind", "key", "unit"])

    return usable(chunks).mapInArrow(run, "id bigint, kind string, key string, unit array<float>")


def drawn(units: DataFrame, id_col: str, sample: int = SAMPLE) -> np.ndarray | None:
    """About ``sample`` rows of (id_col, unit) as a matrix; None without rows."""
    total = units.count()
    share = min(1.0, sample / max(total, 1))
    rows = units.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(max(1, int(share * 1_000_000)))).select(id_col, "unit").collect()
    if not rows and total:
        rows = units.select(id_col, "unit").limit(sample).collect()
    return np.array([r["unit"] for r in sorted(rows)], dtype=np.float32) if rows else None


def codebooks(units: DataFrame, id_col: str, sample: int = SAMPLE) -> np.ndarray | None:
    """Codebooks fitted on about ``sample`` rows of (id_col, unit); None without rows."""
    rows = drawn(units, id_col, sample)
    return None if rows is None else fit(rows)


def centres(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, cell)``: the unit codewords of a one-level codebook and the cell of each, in the order of the cells.

    Codewords MERGE or more alike are one cell: codewords crowd into a dense group, and boundaries inside it would part
    its vectors from their nearest ones.
    """
    words = fit(sample, levels=1, words=min(CELLS, max(1, len(sample) // PER_CELL)))[0]
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-9)
    alike, used = words @ words.T, np.bincount((sample @ words.T).argmax(axis=1), minlength=len(words))
    cell, heads = np.zeros(len(words), dtype=np.int32), []
    for i in np.argsort(-used, kind="stable"):
        near = int(np.argmax(alike[i, heads])) if heads else -1
        if near >= 0 and alike[i, heads[near]] >= MERGE:
            cell[i] = near
        else:
            cell[i] = len(heads)
            heads.append(i)
    order = np.argsort(cell, kind="stable")
    return words[order], cell[order]


class Index(NamedTuple):
    """The codebooks (the first one are the unit words of the cells), and the first word of each cell."""

    books: list[np.ndarray]
    starts: np.ndarray


def indexed(sample: np.ndarray) -> Index:
    """Codebooks fitted on ``sample``: the words of the cells, then those of what is left, level by level."""
    words, cell = centres(sample)
    rest = sample - words[(sample @ words.T).argmax(axis=1)]
    return Index([words, *fit(rest, LEVELS - 1)], np.flatnonzero(np.diff(cell, prepend=-1)))


def encoded(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code, norm, close)`` of unit vectors: the code, the norm of its sum, and the cosine of vector and sum."""
    code = np.concatenate([np.zeros((0, LEVELS), dtype=np.int16), *(beam_search(x[k : k + 2_000], index.books, JOIN_BEAM) for k in range(0, len(x), 2_000))])
    total = decoded(code, index.books)
    norm = np.maximum(np.linalg.norm(total, axis=1), 1e-9)
    return code, norm.astype(np.float32), ((x * total).sum(axis=1) / norm).astype(np.float32)


LISTED = ("kind", "rep", "unit", "code", "norm", "close")


def listed(reps: DataFrame, index: Index) -> DataFrame:
    """(kind, rep, unit, code, norm, close, cells): every vector, its code, its best cell and those within MARGIN of it, BEAM at most."""
    shared = reps.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_ = shared.value
        most = min(BEAM, len(index_.starts))
        for batch in batches:
            x, sizes, cells = matrix(batch.column("unit")), [], []
            for k in range(0, len(x), 2_000):
                score = np.maximum.reduceat(x[k : k + 2_000] @ index_.books[0].T, index_.starts, axis=1)
                least = np.maximum(score.max(axis=1) - MARGIN, np.partition(score, len(index_.starts) - most, axis=1)[:, len(index_.starts) - most])
                row, column = np.nonzero(score >= least[:, None])
                sizes.append(np.bincount(row, minlength=len(score)))
                cells.append(column)
            ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *cells]).astype(np.int32)))
            code, norm, close = encoded(x, index_)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, LEVELS), pa.int32()), pa.array(code.ravel(), pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("rep"), batch.column("unit"), codes, pa.array(norm), pa.array(close), lists], [*LISTED, "cells"])

    return reps.select("kind", "rep", "unit").mapInArrow(run, "kind string, rep bigint, unit array<float>, code array<smallint>, norm float, close float, cells array<int>")


class Coded(NamedTuple):
    """Vectors of a cell: ``unit``, their codes in ``words`` (of each level those in use), and the least score that counts."""

    unit: np.ndarray
    code: np.ndarray
    words: list[np.ndarray]
    limit: np.ndarray

    def part(self, at: np.ndarray) -> Coded:
        return self._replace(unit=self.unit[at], code=self.code[at], limit=self.limit[at])

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Products of all words with ``queries``, level by level."""
        return [words @ queries.T for words in self.words]

    def candidates(self, tables: list[np.ndarray], start: int, stop: int) -> np.ndarray:
        """Which vectors from ``start`` to ``stop`` (rows) can reach the limit with which queries (columns), by lookups."""
        score = tables[0][self.code[start:stop, 0]]
        for level in range(1, len(tables)):
            score += tables[level][self.code[start:stop, level]]
        return score >= self.limit[start:stop, None]


def coded(unit: np.ndarray, code: np.ndarray, norm: np.ndarray, close: np.ndarray, books: list[np.ndarray], least: float) -> Coded:
    """A vector x at a cosine of ``least`` from q scores least * close on the average over directions of its error, times its norm."""
    used = [np.unique(code[:, level], return_inverse=True) for level in range(code.shape[1])]
    close = np.minimum(close, 1.0)
    slack = SURE * np.sqrt(max(1.0 - least * least, 0.0) * (1.0 - close * close) / (DIMS - 1))
    return Coded(unit, np.stack([at for _, at in used], axis=1), [book[words] for book, (words, _) in zip(books, used)], ((least * close - slack) * norm - 1e-4).astype(np.float32))


class Best:
    """The ``top`` best partners of each of ``n`` vectors so far; ``floor`` is what a further one must reach."""

    def __init__(self, n: int, least: float, top: int) -> None:
        self.top, self.floor = top, np.full(n, least, dtype=np.float32)
        self.kept, self.waiting = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))], 0

    def add(self, score: np.ndarray, own_at: int, other_at: int, axis: int = 0) -> None:
        """Take what counts of the scores of a tile, its own vectors along ``axis``."""
        n, others = score.shape[axis], score.shape[1 - axis]
        floor = self.floor[own_at : own_at + n]
        good = score >= np.expand_dims(floor, 1 - axis)
        if others > self.top and np.count_nonzero(good) > 2 * self.top * n:
            np.maximum(floor, np.partition(score, others - self.top, axis=1 - axis).take(others - self.top, axis=1 - axis), out=floor)
            good = score >= np.expand_dims(floor, 1 - axis)
        at = np.nonzero(good)
        if len(at[0]):
            self.kept.append((at[axis] + own_at, at[1 - axis] + other_at, score[at]))
            self.waiting += len(at[0])
            if self.waiting > 2 * self.top * len(self.floor):
                self.prune()

    def take(self, own: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        """Take what counts of single pairs."""
        good = score >= self.floor[own]
        self.kept.append((own[good], other[good], score[good]))
        self.waiting += int(np.count_nonzero(good))
        if self.waiting > 2 * self.top * len(self.floor):
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray]:
        """Keep the best and raise the floors; (own, other) of what is kept."""
        own, other, score = (np.concatenate(c) for c in zip(*self.kept))
        order = np.lexsort((-score, own))
        own, other, score = own[order], other[order], score[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        last = place == self.top - 1
        self.floor[own[last]] = score[last]
        self.kept, self.waiting = [tuple(c[place < self.top] for c in (own, other, score))], 0
        return self.kept[0][:2]


def best_within(x: Coded, y: Coded | None, least: float, top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(own, other) of the best partners of every row of ``x`` in ``y`` and the reverse; ``y`` None: of ``x`` in itself.

    The codes of ``y`` are scored with tables of ``x``, the candidates exactly.
    """
    same = y is None
    y = x if same else y
    ours = Best(len(x.unit), least, top)
    theirs = ours if same else Best(len(y.unit), least, top)
    for i in range(0, len(x.unit), TILE):
        queries = x.unit[i : i + TILE]
        tables = y.tables(queries)
        for j in range(i if same else 0, len(y.unit), TILE):
            hit = y.candidates(tables, j, j + TILE)
            if same and i == j:
                hit = np.tril(hit | hit.T, -1)
            count = np.count_nonzero(hit)
            if not count:
                continue
            if count * DENSE < hit.size:
                b, a = np.nonzero(hit)
                score = np.einsum("ij,ij->i", queries[a], y.unit[j + b])
                ours.take(i + a, j + b, score)
                theirs.take(j + b, i + a, score)
                continue
            score = queries @ y.unit[j : j + TILE].T
            if same and i == j:
                np.fill_diagonal(score, -2)
            else:
                theirs.add(score, j, i, axis=1)
            ours.add(score, i, j)
    return [ours.prune()] if same else [ours.prune(), theirs.prune()]


def scored_cells(entries: DataFrame, index: Index, least: float, top: int) -> DataFrame:
    """(a, b, cosine) of the ``top`` vectors most like ``a`` within each cell (kind, cell, left, right), ``least`` or more.

    ``left`` and ``right`` name blocks of an oversized cell; an entry stands in its own block (left = right) or, as a
    partner, in a block pair. Entries are sorted by cell, so each task reads its cells one after another. Whatever is
    among the best of all cells is among the best of its own, so only these short lists leave the task.
    """
    shared = entries.sparkSession.sparkContext.broadcast(index)

    def ranked(x: np.ndarray, rep: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v = x[own].astype(np.float64), x[other].astype(np.float64)
        cosine = np.minimum((u * v).sum(axis=1) / np.maximum(np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1), 1e-300), 1.0)
        order = np.lexsort((rep[other], -cosine, own))
        own, other, cosine = own[order], other[order], cosine[order]
        good = (np.arange(len(own)) - np.searchsorted(own, own) < top) & (cosine >= least)
        return rep[own[good]], rep[other[good]], cosine[good]

    def links(table_: pa.Table) -> pa.RecordBatch:
        x = matrix(table_.column("unit").combine_chunks())
        code = table_.column("code").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        rep, norm, close = (table_.column(c).to_numpy() for c in ("rep", "norm", "close"))
        block, left, right = (table_.column(c).to_numpy() for c in ("block", "left", "right"))
        names = table_.column("group").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s < 2:
                continue
            cell, ids = coded(x[s:e], code[s:e], norm[s:e], close[s:e], shared.value.books, least), rep[s:e]
            if left[s] == right[s]:
                for own, other in best_within(cell, None, least - 1e-5, top + SPARE):
                    out.append(ranked(cell.unit, ids, own, other))
            else:
                first, second = np.flatnonzero(block[s:e] == left[s]), np.flatnonzero(block[s:e] == right[s])
                (i, j), (k, m) = best_within(cell.part(first), cell.part(second), least - 1e-5, top + SPARE)
                out += [ranked(cell.unit, ids, first[i], second[j]), ranked(cell.unit, ids, second[k], first[m])]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            size += batch.num_rows
            if size >= 20_000:
                whole = pa.Table.from_batches(kept).combine_chunks()
                names = whole.column("group").to_numpy()
                end = int(np.flatnonzero(names != names[-1])[-1]) + 1 if names[0] != names[-1] else 0
                if end:
                    yield links(whole.slice(0, end))
                kept = whole.slice(end).to_batches()
                size = whole.num_rows - end
        if size:
            yield links(pa.Table.from_batches(kept).combine_chunks())

    grouped = entries.select(F.xxhash64("kind", "cell", "left", "right").alias("group"), *LISTED[1:], "block", "left", "right")
    spread = grouped.repartition("group").sortWithinPartitions("group", "rep")
    return spread.mapInArrow(run, "a bigint, b bigint, cosine double").dropDuplicates(["a", "b"])


def blocked(lists: DataFrame) -> DataFrame:
    """(LISTED, cell, block, left, right): each vector in its cells; every block of a cell over CELL meets every other."""
    sizes = lists.select("kind", F.explode("cells").alias("cell")).groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > CELL))
    entries = lists.select(*LISTED, F.explode("cells").alias("cell"))
    crowd_free = large.isEmpty()
    plain = entries if crowd_free else entries.join(large.select("kind", "cell"), ["kind", "cell"], "left_anti")
    out = plain.select(*LISTED, "cell", *(F.lit(0).alias(c) for c in ("block", "left", "right")))
    if crowd_free:
        return out
    crowded = join_to_groups(entries.withColumn("place", F.xxhash64("kind", "cell")), large.select(F.xxhash64("kind", "cell").alias("place"), "n"), "place", "n")
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    own = crowded.withColumn("block", F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = other.select(*LISTED, "cell", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    return out.unionByName(met)


def near_pairs(reps: DataFrame, least: float, top: int = TOP) -> DataFrame:
    """(a, b, cosine) of the (rep, kind, unit) rows: at least the ``top`` most like ``a`` of its kind, ``least`` or more."""
    sample = drawn(reps, "rep")
    if sample is None:
        return reps.sparkSession.createDataFrame([], "a bigint, b bigint, cosine double")
    index = indexed(sample)
    return scored_cells(blocked(cut(listed(reps, index))), index, least, top)


def similar(chunks: DataFrame, least: float, top: int = TOP) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of one kind, ``least`` or more alike, one among the ``top`` most similar of the other."""
    units = unit_vectors(chunks)
    classes = units.groupBy("kind", "key").agg(F.min("id").alias("rep"), F.first("unit").alias("unit"))
    reps = cut(classes)
    members = units.select("kind", "key", "id").distinct()
    by_class = Window.partitionBy("kind", "key").orderBy("id")
    first = members.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= top + 1)
    heads = first.groupBy("kind", "key").agg(F.array_sort(F.collect_list("id")).alias("heads"))
    sizes = members.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    groups = cut(sizes.join(heads, ["kind", "key"]).select(F.xxhash64("kind", "key").alias("place"), "rep", "n", "heads"))
    links = near_pairs(reps.select("rep", "kind", "unit"), least, top)
    nearest = links.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= top)
    small = groups.where(F.col("n") <= top)
    other = (
        nearest.join(small.select(F.col("rep").alias("a"), F.explode("heads").alias("id")), "a")
        .join(groups.select(F.col("rep").alias("b"), F.explode(F.slice("heads", 1, top)).alias("other")), "b")
        .select("id", "other", "cosine")
    )
    own = small.where("n > 1").select(F.explode("heads").alias("id"), "heads").select("id", F.explode("heads").alias("other"), F.lit(1.0).alias("cosine")).where("id != other")
    ranked = other.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other")))
    pairs = ranked.where(F.col("r") <= top).select("id", "other")
    crowd = join_to_groups(members.select(F.xxhash64("kind", "key").alias("place"), "id"), groups.where(F.col("n") > top), "place", "n")
    copies = crowd.select("id", F.explode(F.slice(F.expr("filter(heads, h -> h != id)"), 1, top)).alias("other"))
    all_pairs = pairs.unionByName(copies)
    return all_pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def nearest(chunks: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """(id, rank, neighbour, cosine): the ``top`` most similar rows of the same kind for the rows where ``is_query`` holds.

    Rows and queries are put into blocks of bounded size by hash, and every block of queries meets every block of rows
    of its kind in a task of its own.
    """
    known = cut(usable(chunks).dropDuplicates(["id"]))
    books = codebooks(unit_vectors(known), "id")
    if books is None:
        return known.sparkSession.createDataFrame([], "id bigint, rank int, neighbour bigint, cosine double")
    queries = known.where(is_query)
    row_blocks, query_blocks = max(1, -(-known.count() // ROW_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    every_query_block = F.sequence(F.lit(0), F.lit(query_blocks - 1))
    rows = known.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")).withColumn("qb", F.explode(every_query_block))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    shared = known.sparkSession.sparkContext.broadcast(books)

    def run(queries_: pd.DataFrame, rows_: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        if not len(queries_) or not len(rows_):
            return none
        books_ = shared.value
        q_exact, x_exact = scaled(np.stack(queries_["vec"].to_numpy())), scaled(np.stack(rows_["vec"].to_numpy()))
        q, x = q_exact.astype(np.float32), x_exact.astype(np.float32)
        q_id, x_id = queries_["id"].to_numpy(), rows_["id"].to_numpy()
        code = np.concatenate([beam_search(x[k : k + 2_000], books_, BEAM) for k in range(0, len(x), 2_000)])
        norm = np.maximum(np.linalg.norm(decoded(code, books_), axis=1), 1e-9).astype(np.float32)
        keep = min(len(x), max(RERANK, len(x) // 50))
        out = []
        for k in range(0, len(q), 64):
            part = q[k : k + 64]
            rough = np.zeros((len(part), len(x)), dtype=np.float32)
            for level, book in enumerate(books_):
                rough += (part @ book.T)[:, code[:, level]]
            rough /= norm
            for i in range(len(part)):
                at = np.argpartition(-rough[i], keep - 1)[:keep]
                at = at[x_id[at] != q_id[k + i]]
                cosine = np.round(x_exact[at] @ q_exact[k + i], DECIMALS)
                best = np.lexsort((x_id[at], -cosine))[:top]
                out.append(pd.DataFrame({"id": q_id[k + i], "neighbour": x_id[at][best], "cosine": np.minimum(cosine[best], 1.0)}))
        return pd.concat(out) if out else none

    blocks = ["kind", "rb", "qb"]
    each = asked.groupBy(*blocks).cogroup(rows.groupBy(*blocks)).applyInPandas(run, "id bigint, neighbour bigint, cosine double")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.where(F.col("rank") <= top).select("id", "rank", "neighbour", "cosine")


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chunks of one kind 0.9 or more alike, one among the other's 5 most similar (see TESTDATA.md)."""
    return similar(table(spark, data_dir, "chunks"), 0.9)


def p4_nearest(spark: SparkSession, data_dir: str) -> DataFrame:
    """The 5 most similar chunks of the same kind for every chunk whose id is divisible by 100, against all chunks."""
    return nearest(table(spark, data_dir, "chunks"), F.col("id") % 100 == 0).withColumn("rank", F.col("rank").cast("long"))


_USABLE = """
    WITH c AS (
        SELECT DISTINCT ON (id) id, kind, CAST(vec AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(vec, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS l FROM chunks
        WHERE id IS NOT NULL AND kind IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(vec, lambda y: y <> 0)) > 0),
    s AS (SELECT a.id, b.id AS neighbour, round(list_dot_product(a.v, b.v) / (a.l * b.l), 6) AS cosine FROM c a JOIN c b ON a.kind = b.kind AND a.id <> b.id {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS rank FROM s)
"""
SQL = {
    "p4_found": _USABLE.format(where="") + "SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM r WHERE rank <= 5 AND cosine >= 0.9",
    "p4_nearest": _USABLE.format(where="WHERE a.id % 100 = 0") + "SELECT id, rank, neighbour, cosine FROM r WHERE rank <= 5",
}
QUERIES = {"p4_found": p4_found, "p4_nearest": p4_nearest}
