"""String helpers with the mesh tools' semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \n\r\t\f\x0b"


def join(parts: Column, connector: str) -> Column:
    return F.array_join(parts, connector)


def split(text: Column, delimiter: str) -> Column:
    """Pieces between literal delimiters, empty ones dropped."""
    return F.filter(F.split(text, r"\Q" + delimiter + r"\E"), lambda x: x != "")


def lower(text: Column) -> Column:
    """ASCII letters only; other bytes stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def trim_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def trim_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def matches(text: Column, rule: str, plain: bool = False) -> Column:
    """Case-insensitive search; plain: the rule as it stands is looked for, case and all."""
    return text.contains(rule) if plain else text.rlike("(?i)" + rule)


def matches_any(text: Column, rules: list[str]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | matches(text, r)
    return out


def formatted(pattern: str, *columns: Column) -> Column:
    return F.format_string(pattern, *columns)


def composed_name(names: Column) -> Column:
    """Names joined by _ and cut to 31 characters."""
    return F.left(F.array_join(names, "_"), F.lit(31))
