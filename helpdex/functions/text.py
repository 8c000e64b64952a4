"""Column expressions on text: trimming, tokens, splitting, labels, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a Java character class body.
BLANKS = r"\s\x0B\p{Z}\x{85}"
#: White space of the splitting rules: space, tab, LF, CR, FF.
WHITE = r"\t\n\f\r "
_MARK = "\u0001"


def trimmed(text: Column) -> Column:
    """``text`` without outer Unicode white space (``trim`` strips spaces only); null stays null."""
    return F.regexp_replace(text, rf"\A[{BLANKS}]+|[{BLANKS}]+\z", "")


def normal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n", "\n")


def paragraphs(text: Column) -> Column:
    """Trimmed, non-empty paragraphs in order: parts between lines without text. Null gives null."""
    return F.filter(F.transform(F.split(normal_newlines(text), "\n[ \t]*\n", -1), trimmed), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Sentences of a paragraph: cut after ``. ! ? …`` followed by white space, terminators kept, empty ones dropped."""
    marked = F.regexp_replace(paragraph, rf"([.!?…])[{WHITE}]+", f"$1{_MARK}")
    return F.filter(F.transform(F.split(marked, _MARK, -1), trimmed), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters and runs of digits of the lower-cased text that have three characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1)), lambda w: F.length(w) >= 3)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def label(title: Column, path: Column) -> Column:
    """The title, or the path where there is none."""
    return F.coalesce(F.nullif(title, F.lit("")), path)


def stem(path: Column) -> Column:
    """Base name of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def title_of(meta_title: Column, path: Column) -> Column:
    """The title of the front matter, or the file's stem."""
    return F.coalesce(F.nullif(meta_title, F.lit("")), stem(path))


def with_title(prefix: str, title: Column) -> Column:
    """A document prefix with every ``{title}`` filled in."""
    return F.replace(F.lit(prefix), F.lit("{title}"), title)
