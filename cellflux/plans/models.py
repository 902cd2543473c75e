"""What the driver knows of a file before any row is read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from ..errors import IncompatibleDataError

KEYS = ("time", "current", "voltage", "capacity", "charge_capacity", "discharge_capacity")


@dataclass(frozen=True)
class FormatInfo:
    format: str
    reader: str
    confidence: float
    evidence: tuple[str, ...] = ()


@dataclass(frozen=True)
class ReaderCapabilities:
    streaming: bool
    text_options: bool
    formats: tuple[str, ...]


@dataclass(frozen=True)
class ColumnMatch:
    """How one source column is understood."""

    source_column: str | int
    source_position: int
    quantity: str = "unknown"
    unit: str | None = None
    semantic: str | None = None
    interval_alignment: str | None = None
    state: str = "unresolved"  # or resolved, ambiguous, explicit
    confidence: float = 0.0
    evidence: tuple[str, ...] = ()


@dataclass(frozen=True)
class ReaderHint:
    """What a file format itself says of a column."""

    quantity: str
    unit: str | None
    semantic: str | None = None
    interval_alignment: str | None = None
    source_position: int | None = None
    source_column: str | None = None


@dataclass(frozen=True)
class InspectionResult:
    format: FormatInfo
    reader: str
    columns: tuple[ColumnMatch, ...]
    current_reconstruction_required: bool | None


@dataclass(frozen=True)
class ReadOptions:
    columns: Mapping[str, str | int] = field(default_factory=dict)
    units: Mapping[str, str] = field(default_factory=dict)
    capacity_kind: str | None = None
    capacity_interval: str | None = None
    autodetect: bool = True
    sep: str | None = None
    decimal: str | None = None
    encoding: str | None = None
    header: str | int | None = "infer"
    skiprows: int = 0

    @property
    def parses_text(self) -> bool:
        """Whether an option on the layout of text is set."""
        return (self.sep, self.decimal, self.encoding, self.header, self.skiprows) != (None, None, None, "infer", 0)


def _need(ok: bool, text: str) -> None:
    if not ok:
        raise IncompatibleDataError(text)


def _is_int(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def make_options(**given: object) -> ReadOptions:
    """Checked options; None stands for the default of mappings."""
    columns, units = given.get("columns") or {}, given.get("units") or {}
    _need(isinstance(columns, Mapping) and isinstance(units, Mapping), "columns and units are mappings")
    for key, selector in columns.items():
        _need(key in KEYS, f"columns: unknown key {key!r}")
        _need(_is_int(selector) and selector >= 0 or isinstance(selector, str) and selector != "", f"columns[{key!r}] is a name or a position")
    for key, unit in units.items():
        _need(key in KEYS, f"units: unknown key {key!r}")
        _need(isinstance(unit, str) and unit.strip() != "", f"units[{key!r}] is a unit's spelling")
    kind, interval = given.get("capacity_kind"), given.get("capacity_interval")
    _need(kind in (None, "cumulative_signed", "delta_signed"), f"capacity_kind: {kind!r}")
    _need(kind is None or "capacity" in columns, "capacity_kind needs columns['capacity']")
    _need(interval in (None, "previous", "next"), f"capacity_interval: {interval!r}")
    autodetect = given.get("autodetect", True)
    _need(isinstance(autodetect, bool), "autodetect is true or false")
    sep, decimal, encoding = given.get("sep"), given.get("decimal"), given.get("encoding")
    _need(sep is None or sep == "whitespace" or isinstance(sep, str) and len(sep) == 1 and sep not in "\r\n\"", f"sep: {sep!r}")
    _need(decimal in (None, ".", ","), f"decimal: {decimal!r}")
    _need(encoding is None or isinstance(encoding, str) and encoding.strip() != "", f"encoding: {encoding!r}")
    header, skiprows = given.get("header", "infer"), given.get("skiprows", 0)
    _need(header is None or header == "infer" or _is_int(header) and header >= 0, f"header: {header!r}")
    _need(_is_int(skiprows) and skiprows >= 0, f"skiprows: {skiprows!r}")
    return ReadOptions(dict(columns), dict(units), kind, interval, autodetect, sep, decimal, encoding, header, skiprows)
