"""Where patterns match in texts, in built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tablehaul.llm.columns import let, running_sums

NEAR = 40


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    ``valid`` gets the matched text and drops what fails. ``score`` is what a valid
    match is worth; ``context`` (a pattern over lower-cased text) within ``NEAR``
    characters, not reaching over the next match of the kind, adds ``gain``.
    ``base`` spans are kept at any score. ``needs`` is a string that every match
    holds: texts without it are not searched.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    score: float = 1.0
    context: str | None = None
    gain: float = 0.0
    base: bool = False
    version: int = 1
    needs: str = ""


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,text:string,score:double>>"


def places(text: Column, kind: Kind, rank: int, least: float = 0.0) -> Column:
    """Leftmost non-overlapping matches of one kind as an array of spans.

    Splitting at the matches gives the lengths between them, so positions are
    running sums. They count code points; ``end`` is exclusive.
    """

    def scored(match: Column, before: Column, after: Column) -> Column:
        score = F.lit(kind.score)
        if kind.context:
            hit = F.lower(F.right(before, F.lit(NEAR))).rlike(kind.context) | F.lower(F.left(after, F.lit(NEAR))).rlike(kind.context)
            score = score + F.when(hit, F.lit(kind.gain)).otherwise(F.lit(0.0))
        return score

    def build(found: Column, pieces: Column, ends: Column) -> Column:
        return F.transform(
            found,
            lambda m, i: F.struct(
                (F.get(ends, i) - F.length(m)).cast("long").alias("start"),
                F.lit(rank).alias("rank"),
                F.get(ends, i).cast("long").alias("end"),
                F.lit(kind.name).alias("kind"),
                m.alias("text"),
                scored(m, F.get(pieces, i), F.get(pieces, i + 1)).alias("score"),
            ),
        )

    def located(found: Column) -> Column:
        return let(
            F.split(text, kind.pattern, -1),
            lambda pieces: let(
                running_sums(F.zip_with(found, pieces, lambda m, p: (F.coalesce(F.length(m), F.lit(0)) + F.coalesce(F.length(p), F.lit(0))).cast("long"))),
                lambda ends: build(found, pieces, ends),
            ),
        )

    spans = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), located)
    if kind.valid is not None:
        spans = F.filter(spans, lambda s: kind.valid(s["text"]))
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= least)
    search = text.rlike(kind.pattern)
    if kind.needs:
        search = text.contains(kind.needs) & search
    return F.when(search, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def ordered(spans: Column) -> Column:
    """By start, then in the order of the kinds."""
    return F.sort_array(spans)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
