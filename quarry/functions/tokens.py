"""Tokens of documents and queries.

Documents: runs of letters and numbers, lower-cased, accents folded.  Queries come in two readings: free text (each
token of two characters or more, once, sorted) and identifier phrases (``snake_case``, ``a-b``, ``x.y``: their tokens
must be adjacent).
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a token is (also valid RE2, so DuckDB reads it alike).
TOKEN = r"[\p{L}\p{N}]+"
#: Fixed value: identifier-shaped words.
IDENTIFIER = r"[0-9A-Za-z]+(?:[_\-.:][0-9A-Za-z]+)+"

_IDENTIFIER = re.compile(IDENTIFIER)
_WORDS = re.compile(r"[^\W_]+")


def _folded_letter(c: str) -> str:
    return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c.lower()) if not unicodedata.category(x).startswith("M")))


@functools.cache
def _changes() -> dict[str, str]:
    """What folding makes of each character that it changes ("" for marks), letters first: ``translate`` drops what has no partner.

    Made at the first use, so that Python workers, which import this module but fold nothing, don't pay for it.
    """
    every = map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)])
    return dict(sorted(((c, f) for c in every if (f := _folded_letter(c)) != c), key=lambda x: x[1] == ""))


@functools.cache
def _table() -> dict[int, str]:
    return str.maketrans(_changes())


#: Korean syllables written as separate letters (19 initials, 21 vowels, 27 finals) and those that still lack a final.
_INITIAL, _VOWEL, _FINAL = "\u1100-\u1112", "\u1161-\u1175", "\u11a8-\u11c2"
_OPEN = "".join(map(chr, range(0xAC00, 0xD7A4, 28)))
_LETTERS = f"[{_VOWEL}{_FINAL}]"
_PIECE = f"[{_INITIAL}][{_VOWEL}][{_FINAL}]?|[{_OPEN}][{_FINAL}]|[^{_INITIAL}{_OPEN}]+|[{_INITIAL}{_OPEN}]"


def fold(text: str) -> str:
    """Lower case without accents and other marks, Korean syllables whole (the sharp s stays): DuckDB's ``strip_accents(lower(text))``."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text.translate(_table()))


def _syllable(piece: Column) -> Column:
    """A piece of `_PIECE` as one syllable, if it is the letters of one."""
    code = lambda i: F.ascii(F.substring(piece, i, 1))
    final = F.when(F.length(piece) > 2, code(3) - 0x11A7).otherwise(F.lit(0))
    whole = F.when(piece.rlike(f"^[{_INITIAL}][{_VOWEL}]"), 0xAC00 + ((code(1) - 0x1100) * 21 + code(2) - 0x1161) * 28 + final).otherwise(code(1) + code(2) - 0x11A7)
    return F.when(piece.rlike(f"^(?:[{_INITIAL}][{_VOWEL}]|[{_OPEN}][{_FINAL}])"), F.decode(F.unhex(F.hex(whole)), "UTF-16BE")).otherwise(piece)


def folded(column: Column) -> Column:
    """`fold` as a JVM expression: one table for all characters, and texts that spell Korean letters apart get them joined."""
    plain = F.translate(column, "".join(_changes()), "".join(_changes().values()))
    return F.when(column.rlike(_LETTERS), F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(_PIECE), 0), _syllable), "")).otherwise(plain)


def tokens(column: Column) -> Column:
    """Tokens of a text in order, with repeats (null: none)."""
    return F.regexp_extract_all(folded(F.coalesce(column, F.lit(""))), F.lit(TOKEN), 0)


def query_tokens(query: str) -> list[str]:
    """Free-text reading of one query: distinct tokens longer than one character, folded as documents are, sorted."""
    return sorted({t for t in _WORDS.findall(fold(query)) if len(t) > 1})


def query_phrases(query: str) -> list[list[str]]:
    """Identifier reading: the token list of each identifier-shaped word that has two tokens or more, first mention first."""
    found = dict.fromkeys(tuple(t for t in _WORDS.findall(m.group().lower())) for m in _IDENTIFIER.finditer(query))
    return [list(p) for p in found if len(p) > 1]


def query_term_column(column: Column) -> Column:
    """`query_tokens` over a column of queries, folded by the documents' own expression: terms to join with an index."""
    return F.array_sort(F.array_distinct(F.filter(tokens(column), lambda t: F.length(t) > 1)))


def query_phrase_column(column: Column) -> Column:
    """`query_phrases` over a column of queries, each phrase as its tokens joined by one space."""
    words = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(IDENTIFIER), 0)
    phrases = F.transform(words, lambda w: F.array_join(F.regexp_extract_all(F.lower(w), F.lit("[0-9a-z]+"), 0), " "))
    return F.array_distinct(F.filter(phrases, lambda p: p.contains(" ")))
