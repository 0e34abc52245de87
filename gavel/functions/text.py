"""Lenient parsing, text clean-up and file-name rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Number grammars.
DECIMAL_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
PYTHON_FLOAT = (
    r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    r"|^[+-]?(?i:inf|infinity|nan)$"
)
PYTHON_INT = r"^[+-]?\d+(_\d+)*$"

# The characters a Python ``strip`` removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

INTEGER_TOLERANCE = 1e-9

#: The JSON parser's own limits, lifted: without them a text over 20 million characters is refused.
JSON_LIMITS = {
    name: str((1 << 31) - 1) for name in ("maxStringLen", "maxNumLen", "maxNestingDepth")
}


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def strip(text: Column) -> Column:
    """Trim all Unicode white space; reads only the ends of a text, however long it is."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def lenient_int(token: Column) -> Column:
    """Number or numeric text that is an integer within 1e-9; missing or empty is 0.

    NULL where the token is none of these, so callers can turn it into a reject.
    """
    number = F.when(token.rlike(DECIMAL_NUMBER), token.try_cast("double"))
    rounded = F.rint(number)
    whole = F.abs(number - rounded) <= INTEGER_TOLERANCE
    return F.when(empty_if_null(token) == "", F.lit(0).cast("bigint")).when(
        whole, rounded.try_cast("bigint")
    )


def python_float(text: Column) -> Column:
    """The value Python's ``float`` gives, NULL where it would refuse."""
    body = strip(text)
    return F.when(
        body.rlike(PYTHON_FLOAT), F.replace(body, F.lit("_"), F.lit("")).try_cast("double")
    )


def python_int(text: Column) -> Column:
    """The value Python's ``int`` gives, NULL where it would refuse or overflow 64 bits."""
    body = strip(text)
    return F.when(
        body.rlike(PYTHON_INT), F.replace(body, F.lit("_"), F.lit("")).try_cast("bigint")
    )


def float32(number: Column) -> Column:
    """Round through single precision, as limits are stored."""
    return number.cast("float").cast("double")


def is_safe_file_name(name: Column) -> Column:
    """No empty name, no separators, not the folder itself or its parent."""
    return (name != "") & ~name.rlike(r"[/\\]") & ~name.isin(".", "..")
