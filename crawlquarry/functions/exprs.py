"""Scalar expressions shared by the operators. All are built-in Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that the source notation counts as white space, as a regular-expression class that
#: both Java and RE2 understand.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


#: The same characters as they are.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind (SQL ``trim`` knows only U+0020)."""
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def has(c: Column) -> Column:
    """Neither null nor only white space; never null itself. Looks no further than the first other character."""
    return F.coalesce(c.rlike(SPACE.replace("[", "[^", 1)), F.lit(False))


def to_int(c: Column) -> Column:
    """Keep digits and minus signs, read the leading number; null where there is none or it overflows.
    ``2.4`` becomes 24: the point is dropped like any other mark."""
    kept = F.regexp_replace(c, "[^0-9-]", "")
    return F.nullif(F.regexp_extract(kept, "^-?[0-9]+", 0), F.lit("")).try_cast("int")


def to_bool(c: Column) -> Column:
    """Null where blank, true for the accepted words, false for anything else."""
    t = trimmed(c)
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("boolean")).otherwise(t.rlike("(?iu)^(true|yes|1|si|sì)$"))


def to_indexability(c: Column) -> Column:
    """INDEXABLE, NON_INDEXABLE or UNKNOWN; a blank cell is UNKNOWN, a missing one (null) stays null."""
    t = F.lower(trimmed(c))
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(t.rlike(r"non[-\s]?index"), "NON_INDEXABLE")
        .when(t.contains("index"), "INDEXABLE")
        .otherwise("UNKNOWN")
    )


def rounded(c: Column, tenths: bool = False) -> Column:
    """Half-up rounding as ``floor(x + 0.5)``, of units or of tenths."""
    return F.floor(c * 10 + 0.5) / 10 if tenths else F.floor(c + 0.5)


def squeezed(c: Column) -> Column:
    """Without byte-order marks, trimmed, inner white space as one space, lower case: the form in which headers meet."""
    return F.lower(F.regexp_replace(trimmed(F.replace(c, F.lit("\ufeff"), F.lit(""))), f"{SPACE}+", " "))
