"""Tokens, numbers and bits in text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column, separators: str = " \t", keep_empty: bool = False) -> Column:
    parts = F.split(c, f"[{re.escape(separators)}]", -1)
    return parts if keep_empty else F.filter(parts, lambda t: t != "")


def grouped_tokens(c: Column, separators: str = " \t", pairs: tuple[str, ...] = ("()", "[]", "{}", '""', "''")) -> Column:
    """Tokens in which a bracketed or quoted part stands whole, its separators included."""
    sep = re.escape(separators)
    whole = "|".join(f"{re.escape(p[0])}[^{re.escape(p[1])}]*{re.escape(p[1])}" for p in pairs)
    opens = re.escape("".join(p[0] for p in pairs))
    return F.regexp_extract_all(c, F.lit(f"((?:{whole}|[^{sep}{opens}])+)"), F.lit(1))


def nth_token(c: Column, n: int, separators: str = " \t") -> Column:
    """From 1; null if there are fewer."""
    return F.try_element_at(tokens(c, separators), F.lit(n))


def token_count(c: Column, separators: str = " \t") -> Column:
    return F.size(tokens(c, separators))


def has_token(c: Column, token: str, separators: str = " \t") -> Column:
    return F.array_contains(tokens(c, separators), token)


def to_int(c: Column) -> Column:
    """Null where the text is no number."""
    return F.trim(c).try_cast("long")


def to_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def zero_padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def bits_of(word: Column, n: int) -> Column:
    """Positions of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.getbit(word.cast("long"), b) == 1)


#: Scan-mode codes; fixed values.
SCAN_MODES = {16: "circ", 32: "ces", 128: "stationary", 512: "raster", 8192: "tsys", 32768: "liss"}


def scan_mode(feature: Column, modes: dict[int, str] = SCAN_MODES) -> Column:
    """Name of the lowest bit of ``modes`` that is set; null if none."""
    out = F.lit(None).cast("string")
    for code, name in sorted(modes.items(), reverse=True):
        out = F.when(feature.cast("long").bitwiseAND(F.lit(code)) != 0, name).otherwise(out)
    return out
