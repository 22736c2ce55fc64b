"""Blank rows, column matching, schema growth and type inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablehaul.functions.encode import STYLES, cell_text
from tablehaul.functions.names import column_key, quoted

# One character that Python's str.strip() would keep.
VISIBLE = r"(?U)[^\s\x1c-\x1f]"


def has_content(schema: T.StructType) -> Column:
    """True where a cell is neither null nor a white-space-only string."""
    # Null tests first: with a key or a number in the row no text is looked at.
    fields = sorted(schema.fields, key=lambda f: isinstance(f.dataType, T.StringType))
    cells = [
        F.col(quoted(f.name)).rlike(VISIBLE) if isinstance(f.dataType, T.StringType)
        else F.col(quoted(f.name)).isNotNull()
        for f in fields
    ]
    # A null string makes rlike null, and "null OR true" is still true.
    return F.coalesce(reduce(Column.__or__, cells), F.lit(False))


def drop_blank_rows(df: DataFrame) -> DataFrame:
    return df.filter(has_content(df.schema)) if df.schema.fields else df


def matched_names(source: list[str], target: list[str], aliases: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(source name, target name) for the columns both sides have, in source order."""
    wanted: dict[str, str] = {}
    for t in target:
        other = wanted.setdefault(column_key(t, aliases), t)
        if other != t:
            raise ValueError(f"several target columns have one normal name: {[other, t]}")
    pairs = [(s, wanted[column_key(s, aliases)]) for s in source if column_key(s, aliases) in wanted]
    if not pairs:
        raise ValueError(f"no column in common: source {source}, target {target}")
    claimed: dict[str, list[str]] = {}
    for s, t in pairs:
        claimed.setdefault(t, []).append(s)
    clashes = {t: names for t, names in claimed.items() if len(names) > 1}
    if clashes:
        raise ValueError(f"several source columns match one target column: {clashes}")
    return pairs


def match_columns(src: DataFrame, target: T.StructType | list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Project ``src`` to the columns the target has too, under the target's names."""
    names = target.names if isinstance(target, T.StructType) else list(target)
    if not names:
        return src
    return src.select(*[F.col(quoted(s)).alias(t) for s, t in matched_names(src.columns, names, aliases)])


def add_missing_columns(tgt: DataFrame, src_schema: T.StructType, aliases: dict[str, str] | None = None) -> DataFrame:
    """``tgt`` plus a typed null column for every source column it lacks."""
    have = {column_key(name, aliases) for name in tgt.columns}
    new = [f for f in src_schema.fields if column_key(f.name, aliases) not in have]
    return tgt.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])


def append_evolving(tgt: DataFrame, src: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Union by normalised name; columns only one side has are null on the other."""
    grown = add_missing_columns(tgt, src.schema, aliases)
    return grown.unionByName(match_columns(src, grown.schema, aliases), allowMissingColumns=True)


def declared_kind(kind: T.DataType) -> str:
    """The general type name a Spark type is created as on a target."""
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return "NUMBER"
    if isinstance(kind, T.FractionalType):
        return "FLOAT"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP_NTZ"
    if isinstance(kind, T.DateType):
        return "DATE"
    if isinstance(kind, T.BinaryType):
        return "BINARY"
    return "VARCHAR"


# Text that reads as a type throughout, strictest type first.
_TEXT_KINDS = [
    ("BOOLEAN", r"^(?i:true|false)\z"),
    ("NUMBER", r"^[+-]?[0-9]+\z"),
    ("FLOAT", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?\z"),
    ("DATE", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"),
    ("TIMESTAMP_NTZ", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?\z"),
]


def infer_types(df: DataFrame, parse_text: bool = False) -> DataFrame:
    """(column_name, inferred_type, non_null) from one pass over ``df``.

    A column without values is VARCHAR. With ``parse_text`` a string column gets
    the strictest type that all of its values read as.
    """
    counts, rows = [], []
    for i, f in enumerate(df.schema.fields):
        col = F.col(quoted(f.name))
        counts.append(F.count(col).alias(f"n{i}"))
        kind = F.lit(declared_kind(f.dataType))
        if parse_text and isinstance(f.dataType, T.StringType):
            kind = F.lit("VARCHAR")
            for j, (name, pattern) in reversed(list(enumerate(_TEXT_KINDS))):
                counts.append(F.count_if(col.rlike(pattern)).alias(f"n{i}_{j}"))
                kind = F.when(F.col(f"n{i}_{j}") == F.col(f"n{i}"), F.lit(name)).otherwise(kind)
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.when(F.col(f"n{i}") == 0, F.lit("VARCHAR")).otherwise(kind).alias("inferred_type"),
                F.col(f"n{i}").alias("non_null"),
            )
        )
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def encode_cells(df: DataFrame, style: str = "sentinel") -> DataFrame:
    """Every column as staged text (no nulls left)."""
    return df.select(
        *[cell_text(F.col(quoted(f.name)), f.dataType, STYLES[style]).alias(f.name) for f in df.schema.fields]
    )
