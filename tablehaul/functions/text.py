"""Small text helpers shared by the statement and run-log operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Every character that counts as white space, for trimming.
WHITE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Without white space at both ends (``trim`` alone only takes blanks)."""
    return F.btrim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    """Nothing but white space; only looks as far as the first other character."""
    return ~text.rlike(f"[^{WHITE}]")


def plain(text: Column) -> Column:
    """Stripped and lower case, null as the empty string: the form names are compared in."""
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def replace_all(text: Column, found: str, by: str) -> Column:
    return F.replace(text, F.lit(found), F.lit(by))


def folded(text: Column) -> Column:
    """Lower case as case-insensitive patterns see it, for a cheap search before a pattern runs.

    Four characters equal a plain letter when case is ignored but are not lowered to it.
    """
    for odd, letter in (("\u017f", "s"), ("\u212a", "k"), ("\u0130", "i"), ("\u0131", "i")):
        text = replace_all(text, odd, letter)
    return F.lower(text)


def quick_start(pattern: str) -> str:
    """The same pattern with a look at the next letter before each leading word boundary.

    Java decides a Unicode word boundary by looking up both neighbours at every
    place of the text; the letter rules out most places first.
    """
    return re.sub(r"(^|(?<=[(|]))\\b([A-Za-z])(?![*?{])", r"(?=\2)\\b\2", pattern)
