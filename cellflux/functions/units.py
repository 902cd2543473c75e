"""Units: a closed, case-sensitive registry of spellings, scales and quantities."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column

from ..errors import InvalidUnitError, UnknownUnitError

#: Spellings by quantity and factor to the canonical unit.  The first one of each
#: line is the preferred spelling of its scale.
SPELLINGS: dict[str, list[tuple[float, tuple[str, ...]]]] = {
    "time": [
        (1.0, ("s", "sec", "secs", "second", "seconds")),
        (1e-3, ("ms", "msec", "msecs", "millisecond", "milliseconds")),
        (1e-6, ("us", "µs", "μs", "microsecond", "microseconds")),
        (60.0, ("min", "mins", "minute", "minutes")),
        (3600.0, ("h", "hr", "hrs", "hour", "hours")),
        (86400.0, ("d", "day", "days")),
    ],
    "current": [
        (1000.0, ("A", "amp", "amps", "ampere", "amperes")),
        (1.0, ("mA", "mamp", "mamps", "milliamp", "milliamps", "milliampere", "milliamperes")),
        (1e-3, ("uA", "µA", "μA", "microamp", "microamps", "microampere", "microamperes")),
        (1e-6, ("nA", "nanoamp", "nanoamps", "nanoampere", "nanoamperes")),
    ],
    "voltage": [
        (1.0, ("V", "volt", "volts")),
        (1e-3, ("mV", "millivolt", "millivolts")),
        (1e-6, ("uV", "µV", "μV", "microvolt", "microvolts")),
    ],
    "capacity": [
        (1000.0, ("Ah", "A.h", "A h", "ampere hour", "ampere-hour")),
        (1.0, ("mAh", "mA.h", "mA h", "milliampere hour", "milliampere-hour")),
        (1e-3, ("uAh", "µAh", "μAh")),
        (1.0 / 3.6, ("C", "coulomb", "coulombs")),
    ],
}
CANONICAL = {"time": "s", "current": "mA", "voltage": "V", "capacity": "mAh"}


@cache
def _table() -> dict[str, tuple[str, float, str]]:
    """Spelling to (quantity, factor, preferred spelling)."""
    return {name: (quantity, factor, names[0]) for quantity, scales in SPELLINGS.items() for factor, names in scales for name in names}


def _clean(unit: str) -> str:
    return unicodedata.normalize("NFC", unit).strip()


def canonical_unit(quantity: str) -> str:
    return CANONICAL[quantity]


def identify_unit(unit: str) -> tuple[str, str] | None:
    """(quantity, preferred spelling of equal scale), or None where it is not registered."""
    found = _table().get(_clean(unit))
    return (found[0], found[2]) if found else None


def conversion_factor(quantity: str, unit: str) -> float:
    found = _table().get(_clean(unit))
    if found is None:
        raise UnknownUnitError(f"{unit!r} is not a registered unit")
    if found[0] != quantity:
        raise InvalidUnitError(f"{unit!r} measures {found[0]}, not {quantity}")
    return found[1]


@cache
def known_spellings() -> tuple[str, ...]:
    """Longest first, then by text, so that a suffix search finds the longest unit."""
    return tuple(sorted(_table(), key=lambda s: (-len(s), s)))


def to_canonical(values: Column, quantity: str, unit: str) -> Column:
    """Values in ``unit`` scaled to the canonical unit: one literal factor in the projection."""
    factor = conversion_factor(quantity, unit)
    return values if factor == 1.0 else values * factor
