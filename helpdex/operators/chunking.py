"""Cutting articles into chunks that follow paragraphs and sentences, and listing the entries of an index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpdex.functions.text import trimmed, with_title

CHUNK_CHARS = 1200
TEXT, QUESTION = "text", "question"
QUERY_PREFIX = "task: search result | query: "
DOC_PREFIX = "title: {title} | text: "
#: Unicode white space, as far as it is trimmed.
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = re.compile(r"\n[ \t]*\n")
_STOP = re.compile(r"(?<=[.!?…])[\t\n\f\r ]+")


def _bare(text: str) -> str:
    return text.strip(_BLANKS)


def _hard_parts(sentence: str, limit: int) -> Iterator[str]:
    """A sentence in parts of at most ``limit``; cut at the last blank if that keeps more than half, else at the limit."""
    while len(sentence) > limit:
        blank = max(sentence.rfind(c, 0, limit) for c in " \n\t")
        at = blank if blank > limit // 2 else limit
        yield _bare(sentence[:at])
        sentence = _bare(sentence[at:])
    yield sentence


def _packed(parts: Iterator[tuple[str, bool]], glue: str, limit: int) -> list[str]:
    """Neighbouring parts joined by ``glue`` as long as they fit; a part marked True stays alone."""
    out: list[str] = []
    open_ = ""
    for part, alone in parts:
        if open_ and (alone or len(open_) + len(glue) + len(part) > limit):
            out.append(open_)
            open_ = ""
        if alone:
            out.append(part)
        else:
            open_ = open_ + glue + part if open_ else part
    return out + [open_] if open_ else out


def _pieces(paragraph: str, limit: int) -> list[str]:
    if len(paragraph) <= limit:
        return [paragraph]

    def parts() -> Iterator[tuple[str, bool]]:
        for sentence in filter(None, map(_bare, _STOP.split(paragraph))):
            *hard, rest = _hard_parts(sentence, limit)
            yield from ((h, True) for h in hard)
            if rest:
                yield rest, False

    return _packed(parts(), " ", limit)


def chunks_of(text: str | None, limit: int = CHUNK_CHARS) -> list[str]:
    """Chunks of at most ``limit`` characters; no chunk for null, empty or blank texts."""
    paragraphs = filter(None, map(_bare, _GAP.split((text or "").replace("\r\n", "\n"))))
    return _packed(((p, False) for paragraph in paragraphs for p in _pieces(paragraph, limit)), "\n\n", limit)


def chunked(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """The chunks of each text as an array, computed in Arrow batches."""
    if limit < 100:
        raise ValueError("chunk_chars must be 100 or more")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, limit))

    return run(text)


def entries(articles: DataFrame, limit: int = CHUNK_CHARS, doc_prefix: str = DOC_PREFIX, query_prefix: str = QUERY_PREFIX) -> DataFrame:
    """(path, ord, kind, text, embed_text) of every article (path, title, text, questions, keywords).

    Body chunks come first, then each non-blank question, then one entry of all non-blank keywords; an article without
    a body chunk has no entries. ``embed_text`` has the prefix of its kind. Other columns are dropped.
    """

    def filled(items: Column) -> Column:
        return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), trimmed), lambda q: q.isNotNull() & (q != ""))

    def asked(items: Column) -> Column:
        return F.transform(items, lambda q: F.struct(F.lit(QUESTION).alias("kind"), q.alias("text"), F.concat(F.lit(query_prefix), q).alias("embed_text")))

    base = articles.select("path", "title", chunked(F.col("text"), limit).alias("body"), filled(F.col("questions")).alias("questions"), filled(F.col("keywords")).alias("keywords")).where(F.size("body") > 0)
    bodies = F.transform("body", lambda b: F.struct(F.lit(TEXT).alias("kind"), b.alias("text"), F.concat(with_title(doc_prefix, F.col("title")), b).alias("embed_text")))
    words = F.when(F.size("keywords") > 0, F.array(F.array_join("keywords", ", "))).otherwise(F.array().cast("array<string>"))
    listed = base.select("path", F.posexplode(F.concat(bodies, asked(F.col("questions")), asked(words))).alias("ord", "e"))
    return listed.select("path", "ord", "e.kind", "e.text", "e.embed_text")
