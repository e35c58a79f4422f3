"""Key normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may surround a key, as a Java character class.
_BLANK = r"[\s   ﻿]"


def strip_blanks(value: Column) -> Column:
    """``value`` without surrounding white space of any kind (``trim`` drops only U+0020)."""
    return F.regexp_replace(value, f"^{_BLANK}+|{_BLANK}+$", "")


def whole_number(value: Column) -> Column:
    """The canonical digits of a whole-number key, else NULL.

    Surrounding blanks, leading zeros and a trailing ``.0`` do not count;
    anything else (NULL, '', 'nan', '12.5', '-3', 'phase') is no key.  The
    result is a string of any length, so no key overflows.
    """
    bare = F.regexp_extract(value, rf"^{_BLANK}*0*([0-9]+?)(?:\.0)?{_BLANK}*$", 1)
    return F.nullif(bare, F.lit(""))


def whole_number_long(value: Column) -> Column:
    """``whole_number`` as BIGINT; NULL for keys beyond 63 bits."""
    return whole_number(value).try_cast("bigint")
