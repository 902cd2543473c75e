"""Files of the known formats from arrays: fixtures for queries and tests, and exports for vendors' tools.

Every function returns a file's bytes.  Times are microseconds since 1970 (seconds for Bio-Logic).
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Sequence

import numpy as np

from . import mpr, neware


def delimited(labels: Sequence[str], columns: Sequence[Sequence[str]], separator: str = ",") -> bytes:
    return "".join(separator.join(r) + "\n" for r in [labels, *zip(*columns, strict=True)]).encode()


def mpt(labels: Sequence[str], columns: Sequence[Sequence[str]]) -> bytes:
    return b"EC-Lab ASCII FILE\nNb header lines : 3\n" + delimited(labels, columns, "\t")


def mpr_module(name: bytes, payload: bytes, version: int, date: bytes = b"03/09/21") -> bytes:
    return b"MODULE" + struct.pack("<10s25sII8s", name, name.strip(), len(payload), version, date) + payload


def mpr_file(columns: dict[int, np.ndarray], version: int = 3, modules: bytes = b"") -> bytes:
    """Measurements by field number, with further modules after them."""
    kind = np.dtype([tuple(f) for f in mpr._layout(list(columns))])
    table = np.zeros(len(next(iter(columns.values()))), kind)
    for name, values in zip(kind.names, columns.values(), strict=True):
        table[name] = values
    head = struct.pack("<IB", len(table), len(columns)) + struct.pack(f"<{len(columns)}H", *columns)
    data = head.ljust(405 if version == 2 else 406, b"\0") + table.tobytes()
    return mpr.MAGIC + mpr_module(b"VMP Set   ", b"set", 0) + mpr_module(b"VMP data  ", data, version) + modules


def _table(kind: neware.Kind, n: int, **fields: np.ndarray) -> bytes:
    table = np.zeros(n, kind.fields)
    table["index"] = np.arange(1, n + 1)
    for name, values in fields.items():
        table[name] = values
    raw = table.view(np.uint8).reshape(n, kind.fields.itemsize)
    raw[:, kind.mark_at : kind.mark_at + len(kind.mark)] = np.frombuffer(kind.mark, np.uint8)
    return raw.tobytes()


def _calendar(micros: np.ndarray) -> dict[str, np.ndarray]:
    at = (np.asarray(micros, np.int64) // 1_000_000).astype("datetime64[s]")
    days, months = at.astype("datetime64[D]"), at.astype("datetime64[M]")
    seconds = (at - days).astype(np.int64)
    return {
        "year": months.astype(np.int64) // 12 + 1970, "month": months.astype(np.int64) % 12 + 1, "day": (days - months).astype(np.int64) + 1,
        "hour": seconds // 3600, "minute": seconds // 60 % 60, "second": seconds % 60,
    }


def _nda_head(version: int, size: int) -> bytes:
    return (neware.NDA_MAGIC + bytes(8) + bytes([version])).ljust(size, b"\0")


def nda_29(micros: np.ndarray, counts: np.ndarray, voltage: np.ndarray, code: int) -> bytes:
    """Whole seconds, current in counts of a range, voltage in tenths of a millivolt."""
    return _nda_head(29, 2048) + _table(neware.NDA_29, len(micros), current=counts, voltage=voltage, range=np.full(len(micros), code), **_calendar(micros))


def nda_130(micros: np.ndarray, milliamperes: np.ndarray, volts: np.ndarray, newer: bool = False) -> bytes:
    micros = np.asarray(micros, np.int64)
    values = dict(milliamperes=milliamperes, volts=volts)
    if newer:
        body = _table(neware.Kind(neware.BTS_91, b"\x55\x07"), len(micros), seconds=micros // 1_000_000, nanos=micros % 1_000_000 * 1000, **values)
    else:
        body = _table(neware.Kind(neware.BTS_90, b"\x21\0\0\0\x55\x07"), len(micros), micros=micros, **values)
    return _nda_head(130, 1024) + body + b"\x81footer".ljust(60, b"\0")


def _ndc_head(kind: int, version: int, size: int = neware.BLOCK) -> bytes:
    return bytes([kind, 0, version]).ljust(size, b"\0")


def _blocks(records: bytes, size: int, first: int, per_block: int) -> bytes:
    step = size * per_block
    return b"".join((bytes(first) + records[at : at + step]).ljust(neware.BLOCK, b"\0") for at in range(0, len(records), step))


def _archive(**members: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members.items():
            archive.writestr(f"{name}.ndc", data)
    return out.getvalue()


def ndax_full(micros: np.ndarray, counts: np.ndarray, voltage: np.ndarray, code: int, version: int = 5) -> bytes:
    kind = neware.NDC_2 if version == 2 else neware.NDC_5
    body = _table(kind, len(micros), current=counts, voltage=voltage, range=np.full(len(micros), code), **_calendar(micros))
    if version == 2:
        return _archive(data=_ndc_head(1, 2, 517) + body)
    return _archive(data=_ndc_head(1, 5) + _blocks(body, kind.fields.itemsize, 125, 45))


def ndax_split(micros: np.ndarray, milliamperes: np.ndarray, volts: np.ndarray, timed: np.ndarray, version: int = 11, again: bytes = b"") -> bytes:
    """Slots of which only those in ``timed`` have a checkpoint; ``again``: further checkpoint records."""
    kind, trailer, to_volts, to_milliamperes = neware.SPLIT[version]
    slots = np.zeros(len(micros), neware.SLOT)
    slots["milliamperes"], slots["volts"] = np.asarray(milliamperes) / to_milliamperes, np.asarray(volts) / to_volts
    at = np.flatnonzero(timed)
    points = np.zeros(len(at), kind)
    when = np.asarray(micros, np.int64)[at]
    points["seconds"], points["millis"], points["index"] = when // 1_000_000, when % 1_000_000 // 1000, at + 1
    per_block = (neware.BLOCK - 132 - trailer) // kind.itemsize
    return _archive(
        data=_ndc_head(1, version) + _blocks(slots.tobytes(), slots.itemsize, 132, (neware.BLOCK - 136) // slots.itemsize),
        data_runInfo=_ndc_head(18, version) + _blocks(points.tobytes() + again, kind.itemsize, 132, per_block),
    )
