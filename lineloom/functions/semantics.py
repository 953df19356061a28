"""Text rules that decide exactness, as Column expressions.

Lengths count UTF-16 code units; white space and regex classes are Unicode's; letters
change case one to one, whatever the language.  All other modules use these forms.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "(?U)\\s"


def len16(value: Column) -> Column:
    """Length in UTF-16 code units."""
    # ASCII text, most of all, has as many units as bytes.
    units = F.octet_length(F.encode(value, "UTF-16BE")) / 2
    return F.when(F.octet_length(value) == F.length(value), F.length(value)).otherwise(units.cast("int"))


def trim_ws(value: Column) -> Column:
    # Most lines have no white space at their ends, which two characters tell.
    ends = F.concat(F.substring(value, 1, 1), F.substring(value, -1, 1))
    return F.when(ends.rlike(SPACE), F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")).otherwise(value)


def is_blank(value: Column) -> Column:
    return value.rlike("(?U)^\\s*$")


def squeeze_ws(value: Column) -> Column:
    """Each run of white space becomes one blank."""
    # In ASCII text the plain class is the same, and faster.
    ascii_only = F.octet_length(value) == F.length(value)
    return F.when(ascii_only, F.regexp_replace(value, "\\s+", " ")).otherwise(F.regexp_replace(value, "(?U)\\s+", " "))


def squeeze_blanks(value: Column) -> Column:
    return F.regexp_replace(value, " {2,}", " ")


@functools.cache
def _special(upper: bool, exempt: tuple[str, ...]) -> str:
    """A class of the letters that do not change case one to one whatever stands beside them."""
    found = [c for c in map(chr, range(0x80, 0x110000)) if len(c.upper() if upper else c.lower()) != 1]
    return "[" + "".join(rf"\x{{{ord(c):X}}}" for c in sorted({*found, *exempt})) + "]"


def _one_to_one(value: Column, change, upper: bool, exempt: tuple[str, ...], context: tuple[str, ...] = ()) -> Column:
    """``change`` of each letter by itself; ``exempt`` ones stay, those of ``context`` depend on others."""
    letter = lambda c: F.when((F.length(change(c)) == 1) & ~c.isin(*exempt), change(c)).otherwise(c)
    plain = (F.octet_length(value) == F.length(value)) | ~value.rlike(_special(upper, exempt + context))
    return F.when(plain, change(value)).otherwise(F.array_join(F.transform(F.split(value, ""), letter), ""))


def upper_inv(value: Column) -> Column:
    """Upper case, letter by letter; letters without a single counterpart stay."""
    return _one_to_one(value, F.upper, True, ("ı", "ſ"))


def lower_inv(value: Column) -> Column:
    return _one_to_one(value, F.lower, False, ("İ",), ("Σ",))


def key(value: Column, case_sensitive: bool) -> Column:
    """What equal lines have in common."""
    return value if case_sensitive else upper_inv(value)


def order_key(value: Column, case_sensitive: bool, strict: bool = False) -> Column:
    """What lines are ordered by; strict: by UTF-16 units beyond the basic plane too."""
    k = key(value, case_sensitive)
    return F.encode(k, "UTF-16BE") if strict else k


def pattern(regex: str, case_sensitive: bool) -> str:
    """A user's pattern with Unicode classes."""
    return ("(?U)" if case_sensitive else "(?iU)") + regex


def quote(literal: str) -> str:
    """A pattern that matches the literal."""
    return re.sub(r"([^A-Za-z0-9_\s\u0080-\U0010ffff])", r"\\\1", literal)


def validate(spark, regex: str, case_sensitive: bool = True) -> None:
    """Raise ValueError now if a pattern is not one, not when lines are read."""
    from pyspark.errors import IllegalArgumentException

    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern(regex, case_sensitive))
    except IllegalArgumentException as e:
        raise ValueError(f"not a regular expression: {regex!r}") from e
