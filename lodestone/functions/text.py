"""Text expressions: ASCII case folding, tokens, literals, snippets.

Everything here is a Column built from Spark functions, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed patterns: a quoted string of two characters at least, and a word that may be code.
QUOTED = r"""["']([^"']{2,})["']"""
CODE_WORD = r"[A-Za-z_][A-Za-z0-9_./]*"
#: Fixed limits of a rendered snippet.
SNIPPET_CHARS, SNIPPET_LINES = 800, 15


def ascii_lower(text: Column) -> Column:
    """Lower case for ASCII letters only, as substring search folds case."""
    return F.translate(text, UPPER, LOWER)


def contains_folded(text: Column, needle: Column) -> Column:
    """Whether ``needle`` occurs in ``text``, every character standing for itself, ASCII case aside."""
    return F.contains(ascii_lower(text), ascii_lower(needle))


def longest_first(items: Column) -> Column:
    """An array of strings by falling length; those of one length keep their order."""
    keyed = F.transform(items, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def query_tokens(query: Column) -> Column:
    """What a question literally names: quoted strings, then words that look like code; longest first."""
    words = F.regexp_extract_all(query, F.lit(CODE_WORD), F.lit(0))
    code = F.filter(words, lambda w: (F.length(w) >= 3) & (F.rlike(w, F.lit("[_/.]")) | (F.rlike(w, F.lit("[A-Z]")) & (F.rlike(w, F.lit("[a-z]")) | (w == F.upper(w))))))
    return longest_first(F.array_distinct(F.concat(F.regexp_extract_all(query, F.lit(QUOTED), F.lit(1)), code)))


def chunk_literals(text: Column, limit: int = 4) -> Column:
    """Quoted strings of a piece of code that may name something: the ``limit`` longest."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)))
    named = F.filter(found, lambda s: (F.length(s) >= 3) & ~F.rlike(s, F.lit(r"^\p{Nd}+$")) & F.rlike(s, F.lit(r"[\p{L}\p{N}]")))
    return F.slice(longest_first(named), 1, limit)


def snippet(text: Column, chars: int = SNIPPET_CHARS, lines: int = SNIPPET_LINES) -> Column:
    """The beginning of a text, indented for display, with dots if something was cut."""
    body = F.regexp_replace(F.substring(text, 1, chars), r"\n$", "")
    rows = F.split(body, "\n", -1)
    cut = (F.length(text) > chars) | (F.size(rows) > lines)
    shown = F.array_join(F.transform(F.slice(rows, 1, lines), lambda r: F.concat(F.lit("        "), r)), "\n")
    return F.concat(F.when(body == "", F.lit("")).otherwise(shown), F.when(cut, F.lit("\n        ...")).otherwise(F.lit("")))


def escape_like(text: Column) -> Column:
    """``text`` as a LIKE pattern that matches itself only, backslash being the escape."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")
