"""Splitting oversized texts at natural boundaries, with overlap and without loss.

For each text the sizes of its tokens (here single characters, measured in characters or UTF-8 bytes) are prefix-summed
and the possible cuts of each level (paragraph, sentence, blank) form sorted arrays. A piece ends at the last boundary
under the limit, found by binary search, of the first level that has one there; the next piece begins up to ``overlap``
before that, moved forward to a word start if there is one. A part that fits only without the whole overlap is kept whole
and less is repeated. Where there is no boundary the text is cut hard at the limit. The finest level at which a text is
cut is its boundary: the first level that leaves no part over the limit.

Defined results: a null text has no piece; an empty or blank text has none either; a text within the limit is one piece;
repeated rows of one key and text give one set of pieces, and so do those of the null key; different texts of one key
(or of the null key) are all split; whole texts are processed, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdex.sources.tables import table

LIMIT, OVERLAP = 1200, 120
WHITE = " \t\n\f\r"
LEVELS = ("paragraph", "sentence", "blank")
STOPS = ".!?…"
EMPTY_LINE = re.compile(r"\n[ \t]*\n")
BLANK = re.compile(r"[ \t\n\f\r]+")
PIECE_SCHEMA = "item_table string, item_key string, item string, piece int, start_pos int, end_pos int, overlap int, boundary string, text string"
FOUND_SCHEMA = "item_table string, item_key string, item string, boundary string"


def trimmed(text: str) -> str:
    """CRLF as LF and outer white space removed."""
    return text.replace("\r\n", "\n").strip(WHITE)


def boundaries(text: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each level the sorted ends of its parts and the starts of the parts that follow; coarser cuts are in finer levels."""
    runs = [m.span() for m in BLANK.finditer(text)]
    paragraph = [b - a > 1 and EMPTY_LINE.search(text, a, b) is not None for a, b in runs]
    sentence = [p or (a > 0 and text[a - 1] in STOPS) for (a, _), p in zip(runs, paragraph)]
    spans = np.array(runs, dtype=np.int64).reshape(-1, 2)
    kept = (spans[np.array(keep, dtype=bool)] for keep in (paragraph, sentence, [True] * len(runs)))
    return {level: (cuts[:, 0], cuts[:, 1]) for level, cuts in zip(LEVELS, kept)}


def size_prefix(text: str, unit: str) -> np.ndarray:
    """Prefix sums of the sizes of the characters: ``[i]`` is the size of the first ``i``."""
    if unit == "chars":
        return np.arange(len(text) + 1, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])


def _word_start(word_starts: np.ndarray, first: int, before: int) -> int:
    """The first word start from ``first`` on and before ``before``, else ``first``."""
    k = int(np.searchsorted(word_starts, first, "left"))
    return int(word_starts[k]) if k < len(word_starts) and word_starts[k] < before else first


def _cuts(text: str, cuts: dict[str, tuple[np.ndarray, np.ndarray]], limit: int, overlap: int, unit: str) -> list[tuple[int, int, int, int]]:
    """``(start, end, overlap, level)`` of each piece; the level is a place in LEVELS, or their number after a hard cut."""
    total, size, word_starts = len(text), size_prefix(text, unit), cuts["blank"][1]
    # the end of the text ends a paragraph
    levels = [(np.append(cuts[level][0], total), np.append(cuts[level][1], total)) for level in LEVELS]
    out, start, done = [], 0, 0
    while done < total:
        back = _word_start(word_starts, max(start, int(np.searchsorted(size, size[done] - overlap, "left"))), done)
        full, most = (int(np.searchsorted(size, size[i] + limit, "right")) - 1 for i in (back, done))
        for level, (ends, starts) in enumerate(levels):
            k = int(np.searchsorted(ends, full, "right")) - 1
            if k < 0 or starts[k] <= done:
                k += 1  # no boundary leaves room for the whole overlap: the first that leaves less
            if ends[k] <= most:
                end = min(int(starts[k]), most)
                break
        else:
            level, end = len(LEVELS), max(full, done + 1)
        room = int(np.searchsorted(size, size[end] - limit, "left"))
        start = back if room <= back else _word_start(word_starts, min(room, done), done)
        out.append((start, end, done - start, level))
        done = end
    return out


def _finest(pieces: list[tuple[int, int, int, int]]) -> str:
    return (*LEVELS, "none")[max((level for *_, level in pieces), default=0)]


def first_level(text: str, cuts: dict[str, tuple[np.ndarray, np.ndarray]], limit: int, unit: str = "chars") -> str:
    """The first level whose parts are all within ``limit``, else ``none``: the finest at which the text has to be cut."""
    return _finest(_cuts(text, cuts, limit, 0, unit))


def cut_points(text: str, cuts: dict[str, tuple[np.ndarray, np.ndarray]], limit: int, overlap: int, unit: str = "chars") -> list[tuple[int, int, int]]:
    """``(start, end, overlap)`` of each piece; the pieces without their overlaps, joined, are the text."""
    return [piece[:3] for piece in _cuts(text, cuts, limit, overlap, unit)]


def _find(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep: list[int] = []
        levels: list[str] = []
        for i, raw in enumerate(batch.column("text").to_pylist()):
            text = trimmed(raw)
            if len(text) > limit:
                keep.append(i)
                levels.append(first_level(text, boundaries(text), limit))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(at) for c in ("item_table", "item_key", "item")), pa.array(levels, pa.string())], ["item_table", "item_key", "item", "boundary"]
        )


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int, unit: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, piece, starts, ends, repeats, levels, texts = [], [], [], [], [], [], []
        for i, raw in enumerate(batch.column("text").to_pylist()):
            text = trimmed(raw)
            if not text:
                continue
            pieces = _cuts(text, boundaries(text), limit, overlap, unit)
            level = _finest(pieces)
            for n, (a, b, o, _) in enumerate(pieces):
                at.append(i), piece.append(n), starts.append(a), ends.append(b), repeats.append(o), levels.append(level), texts.append(text[a:b])
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(rows) for c in ("item_table", "item_key", "item")), *(pa.array(x, pa.int32()) for x in (piece, starts, ends, repeats)), pa.array(levels, pa.string()), pa.array(texts, pa.string())],
            ["item_table", "item_key", "item", "piece", "start_pos", "end_pos", "overlap", "boundary", "text"],
        )


def oversized(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(item_table, item_key, boundary)`` of each distinct item over the limit after trimming.

    Only texts that can be over the limit leave the JVM. Rows with a null key are kept under the null key; there is a row for
    every distinct text, also where the key is null or several texts have the same one.
    """
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    long = items.select("item_table", "item_key", "text").where(F.length("text") > limit).withColumn("item", F.sha2("text", 256))
    return long.mapInArrow(lambda batches: _find(batches, limit), FOUND_SCHEMA).distinct().drop("item")


def split(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, unit: str = "chars") -> DataFrame:
    """Pieces of every item, positions 0-based in the trimmed text. ``overlap`` must be below half of ``limit``.

    Every distinct text is split, under its key, also where the key is null or several texts have the same one.
    """
    return pieces_of_texts(items, limit, overlap, unit).drop("item")


def pieces_of_texts(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, unit: str = "chars") -> DataFrame:
    """The pieces of ``split`` with ``item``, a hash of the text that tells the texts of one key apart."""
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and below half of the limit")
    if unit == "bytes" and limit < 8:
        raise ValueError("a limit in bytes must hold a few characters")
    known = items.select("item_table", "item_key", "text").where(F.col("text").isNotNull()).withColumn("item", F.sha2("text", 256)).dropDuplicates(["item_table", "item_key", "item"])
    fits = (F.octet_length("text") if unit == "bytes" else F.length("text")) <= limit
    text = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), r"\A[ \t\n\f\r]+|[ \t\n\f\r]+\z", "")
    short = (
        known.where(fits).select("item_table", "item_key", "item", text.alias("text")).where("text != ''")
        .select("item_table", "item_key", "item", F.lit(0).alias("piece"), F.lit(0).alias("start_pos"), F.length("text").alias("end_pos"), F.lit(0).alias("overlap"), F.lit("paragraph").alias("boundary"), "text")
    )
    long = known.where(~fits).mapInArrow(lambda batches: _split(batches, limit, overlap, unit), PIECE_SCHEMA)
    return long.unionByName(short)


def text_items(spark, data_dir: str) -> DataFrame:
    """(item_table, item_key, text) of articles and chunks."""
    articles = table(spark, data_dir, "articles").select(F.lit("articles").alias("item_table"), F.col("path").alias("item_key"), "text")
    chunks = table(spark, data_dir, "chunks").select(F.lit("chunks").alias("item_table"), F.col("id").cast("string").alias("item_key"), "text")
    return articles.unionByName(chunks)


def p3_found(spark, data_dir: str) -> DataFrame:
    """Every item over 1200 characters and the boundary that suffices for it (see TESTDATA.md)."""
    return oversized(text_items(spark, data_dir))


def p3_pieces(spark, data_dir: str) -> DataFrame:
    """All articles and chunks in pieces of at most 1200 characters with up to 120 repeated."""
    return split(text_items(spark, data_dir))


def p3_joined(spark, data_dir: str) -> DataFrame:
    """The hash of each item's text put together again from its pieces: shows that nothing is lost."""
    pieces = pieces_of_texts(text_items(spark, data_dir)).select("item_table", "item_key", "item", "piece", F.expr("substring(text, overlap + 1)").alias("own"))
    whole = pieces.groupBy("item_table", "item_key", "item").agg(F.array_sort(F.collect_list(F.struct("piece", "own"))).alias("parts"))
    return whole.select("item_table", "item_key", F.sha2(F.array_join("parts.own", ""), 256).alias("text_hash"))


_TRIM = r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\A[ \t\n\f\r]+|[ \t\n\f\r]+\z', '', 'g')"
_ITEMS = "SELECT 'articles' AS item_table, path AS item_key, text FROM articles UNION SELECT 'chunks', CAST(id AS VARCHAR), text FROM chunks"
SQL = {
    "p3_found": rf"""
        WITH t AS (SELECT item_table, item_key, {_TRIM} AS x FROM ({_ITEMS}) WHERE text IS NOT NULL),
        p AS (SELECT *, list_transform(string_split_regex(x, '\n[ \t]*\n'), lambda y: regexp_replace(y, '\A[ \t\n\f\r]+|[ \t\n\f\r]+\z', '', 'g')) AS paras FROM t WHERE length(x) > 1200)
        SELECT item_table, item_key, CASE
            WHEN list_max(list_transform(paras, lambda y: length(y))) <= 1200 THEN 'paragraph'
            WHEN list_max(list_transform(flatten(list_transform(paras, lambda y: string_split(regexp_replace(y, '([.!?…])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)))), lambda y: length(y))) <= 1200 THEN 'sentence'
            WHEN list_max(list_transform(string_split_regex(x, '[ \t\n\f\r]+'), lambda y: length(y))) <= 1200 THEN 'blank'
            ELSE 'none' END AS boundary
        FROM p
    """,
    "p3_joined": f"SELECT item_table, item_key, sha256({_TRIM}) AS text_hash FROM ({_ITEMS}) WHERE {_TRIM} <> ''",
}
QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_joined": p3_joined}
