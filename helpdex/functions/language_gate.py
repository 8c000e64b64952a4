"""The language gate: may a question be treated as Polish?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters and word lists that decide.
POLISH_LETTERS = "ąćęłńóśźż"
POLISH_WORDS = """się sie nie jak jest są czy co mi mnie mój moja moje mam ma mogę można trzeba
    dlaczego gdzie kiedy który która które jaki jaka jakie ten ta te tak już oraz lub ale
    po przy od za dla ze we w z na o pod nad bez przez u czemu działa nie działa jeśli
    komputer komputera drukarka hasło konto przeglądarka"""
OTHER_WORDS = """the is are was my how what why where when can cannot does doesn not and with of in
    for it this that you your have has from will won there please help
    an at by or if be been isn aren don didn can't should would could need needed needs
    keeps keep still only after before again without into out about which than then just
    get gets got use using open opens start starts work works load loads
    stuck shows show see send sends receive window website
    der die das und ist nicht wie ich mein le la les est pas comment je mon el los es no como mi"""


def _hits(words: Column, listed: str) -> Column:
    known = F.array(*map(F.lit, sorted(set(listed.split()))))
    return F.size(F.filter(words, lambda w: F.array_contains(known, w)))


def is_polish(text: Column) -> Column:
    """True if at least 7 of 10 letters are Latin and a Polish letter or no surplus of other languages' words is found.

    Null counts as an empty text; a text without letters is not Polish.
    """
    text = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}]|\P{L}", ""))
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"(\p{L}+)"), F.lit(1))
    by_words = _hits(words, OTHER_WORDS) <= _hits(words, POLISH_WORDS)
    return (letters > 0) & (latin * 10 >= letters * 7) & (low.rlike(f"[{POLISH_LETTERS}]") | by_words)
