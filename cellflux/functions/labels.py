"""Column labels: normal form, and the unit a label names."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from .units import identify_unit, known_spellings

_BRACKETED = re.compile(r"(.*?)\s*[\[(]([^\])]+)[\])]\s*")
_DERIVED = re.compile(r"(m?A(h)?|C)/(g|kg|L|cm[2²]|m[2²])")


@dataclass(frozen=True)
class Label:
    """A label's own text, its normal form without the unit, and what the unit says."""

    raw: str
    name: str
    unit: str | None = None  # as written
    quantity: str | None = None
    spelling: str | None = None  # preferred, of equal scale
    derived: bool = False  # such as mAh/g


def normalize_label(label: object) -> str:
    text = unicodedata.normalize("NFC", str(label)).casefold()
    return " ".join(re.sub(r"[-/_.,:;\\|\[\](){}]", " ", text).split())


def _with_unit(raw: str, name: str, unit: str) -> Label:
    unit = unicodedata.normalize("NFC", unit.strip())
    quantity, spelling = identify_unit(unit) or (None, None)
    derived = quantity is None and _DERIVED.fullmatch(unit.replace(" ", "")) is not None
    return Label(raw, normalize_label(name), unit, quantity, spelling, derived)


def parse_label(label: object) -> Label:
    """A bracketed unit, else what follows a slash if it is a unit, else a registered last word."""
    raw = unicodedata.normalize("NFC", str(label)).strip()
    bracketed = _BRACKETED.fullmatch(raw)
    if bracketed and bracketed[1].strip():
        return _with_unit(raw, bracketed[1], bracketed[2])
    name, slash, unit = raw.partition("/")
    if slash and name.strip():
        found = _with_unit(raw, name, unit)
        if found.quantity or found.derived:
            return found
    for spelling in known_spellings():
        if raw.endswith(" " + spelling) and raw[: -len(spelling)].strip():
            return _with_unit(raw, raw[: -len(spelling)], spelling)
    return Label(raw, normalize_label(raw))
