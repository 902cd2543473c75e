"""Text cells to numbers, as Catalyst expressions.

Accepted are optional sign, digits with one decimal point, an exponent, and spellings of infinity, with
white space around.  Everything else is missing, and so are finite spellings beyond a double's range.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
INFINITE = r"[+-]?(?i:inf|infinity)"
_BLANKS = " \t\r\n\f\x0b"
CLOCK = r"(\d+):([0-5]\d):([0-5]\d(?:\.\d+)?)"


def _stripped(cell: Column) -> Column:
    return F.btrim(cell, F.lit(_BLANKS))


def number(cell: Column) -> Column:
    """The cell's number, or null."""
    text = _stripped(cell)
    value = text.try_cast("double") if hasattr(text, "try_cast") else text.cast("double")
    finite = F.when(F.abs(value) != float("inf"), value)
    infinite = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(f"^({NUMBER})$"), finite).when(text.rlike(f"^({INFINITE})$"), infinite)


def decimal_number(cell: Column, decimal: str = ".") -> Column:
    """With a decimal comma, commas are points and a cell with a point is malformed."""
    if decimal == ".":
        return number(cell)
    return F.when(cell.contains("."), F.lit(None).cast("double")).otherwise(number(F.replace(cell, F.lit(decimal), F.lit("."))))


def clock_seconds(cell: Column) -> Column:
    """Elapsed H+:MM:SS[.f] in seconds, hours unbounded; null where it is no such clock."""
    text = _stripped(cell)
    whole = F.regexp_extract(text, f"^{CLOCK}$", 1).try_cast("double") * 3600 + F.regexp_extract(text, f"^{CLOCK}$", 2).try_cast("double") * 60
    return F.when(text.rlike(f"^{CLOCK}$"), whole + F.regexp_extract(text, f"^{CLOCK}$", 3).try_cast("double"))


def time_number(cell: Column, decimal: str = ".") -> Column:
    """A clock where the cell has a colon, else a number."""
    text = F.replace(cell, F.lit(decimal), F.lit(".")) if decimal != "." else cell
    return F.when(cell.contains(":"), clock_seconds(text)).otherwise(decimal_number(cell, decimal))


def is_malformed(cell: Column, value: Column) -> Column:
    """A cell with text that is no number."""
    return cell.isNotNull() & (_stripped(cell) != "") & value.isNull()


def nulled(value: Column) -> Column:
    """NaN as null, the one marker of a missing value."""
    return F.when(~F.isnan(value), value)


_NUMBER = re.compile(NUMBER)


def local_number(cell: str, decimal: str = ".") -> float | None:
    """The same grammar on the driver, for samples."""
    text = cell.strip()
    if decimal != ".":
        if "." in text:
            return None
        text = text.replace(decimal, ".")
    return float(text) if _NUMBER.fullmatch(text) else None
