"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[ \t-\r]+"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: str) -> Column:
    """A text column without nulls."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(value: Column) -> Column:
    return F.translate(value, ASCII_UPPER, ASCII_LOWER)


def words(text: Column) -> Column:
    """The words of a text: runs of anything but the six white characters of ASCII."""
    return F.filter(F.split(text, WHITE, -1), lambda w: w != "")


def _sums(values: Column) -> Column:
    empty = F.array().cast("array<bigint>")
    return F.aggregate(values, empty, lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x)))


def running_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array<bigint>.

    Appending to an array copies it, so sums are built in blocks: the cost is
    ``BLOCK`` a value and not the length of the array.
    """

    def blocks(a: Column) -> Column:
        count = F.greatest(F.ceil(F.size(a) / F.lit(BLOCK)), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: _sums(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))

    def joined(parts: Column) -> Column:
        ends = _sums(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))))
        return let(
            ends,
            lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1))))),
        )

    return let(values, lambda a: let(blocks(a), joined))
