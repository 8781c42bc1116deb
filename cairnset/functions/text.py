"""Column expressions on text, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace and characters that are not seen (format and control characters).
INVISIBLE = r"[\s\p{Z}\p{Cf}\p{Cc}]"
#: Quotes, brackets for citing, bars and list marks that may stand around a whole value.
MARKS = "\"'`\u00b4|\u201c\u201d\u201e\u201f\u2018\u2019\u201a\u201b\u00ab\u00bb\u2039\u203a<>{},;!"


def squeeze(c: Column) -> Column:
    """The text without whitespace and invisible characters; plain values are passed through."""
    return F.when(c.rlike("[^!-~]"), F.regexp_replace(c, INVISIBLE, "")).otherwise(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(INVISIBLE.replace("[", "[^", 1))


def letters_digits(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def sort_components(c: Column) -> Column:
    """Dot-separated components in sorted order."""
    return F.when(F.instr(c, ".") == 0, c).otherwise(F.array_join(F.array_sort(F.split(c, r"\.", -1)), "."))
