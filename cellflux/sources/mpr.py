"""Bio-Logic MPR containers: a chain of modules, one of which holds fixed-width records.

Field numbers whose type is not known raise; accessory fields of known width are passed over.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
from typing import BinaryIO

from ..errors import CorruptedFileError, UnsupportedFormatError
from .records import stamp

MAGIC = b"BIO-LOGIC MODULAR FILE\x1a".ljust(48) + bytes(4)
#: Field number to name and type, as open decoders of the format publish them.
FIELDS = {
    4: ("time/s", "<f8"), 5: ("control/V/mA", "<f4"), 6: ("Ewe/V", "<f4"), 7: ("dq/mA.h", "<f8"), 8: ("I/mA", "<f4"), 9: ("Ece/V", "<f4"), 11: ("<I>/mA", "<f8"),
    13: ("(Q-Qo)/mA.h", "<f8"), 16: ("Analog IN 1/V", "<f4"), 17: ("Analog IN 2/V", "<f4"), 19: ("control/V", "<f4"), 20: ("control/mA", "<f4"), 23: ("dQ/mA.h", "<f8"),
    24: ("cycle number", "<f8"), 26: ("Rapp/Ohm", "<f4"), 27: ("Ewe-Ece/V", "<f4"), 32: ("freq/Hz", "<f4"), 33: ("|Ewe|/V", "<f4"), 34: ("|I|/A", "<f4"),
    35: ("Phase(Z)/deg", "<f4"), 36: ("|Z|/Ohm", "<f4"), 37: ("Re(Z)/Ohm", "<f4"), 38: ("-Im(Z)/Ohm", "<f4"), 39: ("I Range", "<u2"), 69: ("R/Ohm", "<f4"), 70: ("P/W", "<f4"),
    74: ("|Energy|/W.h", "<f8"), 75: ("Analog OUT/V", "<f4"), 76: ("<I>/mA", "<f4"), 77: ("<Ewe>/V", "<f4"), 123: ("Energy charge/W.h", "<f8"), 124: ("Energy discharge/W.h", "<f8"),
    125: ("Capacitance charge/uF", "<f8"), 126: ("Capacitance discharge/uF", "<f8"), 131: ("Ns", "<u2"), 174: ("<Ewe>/V", "<f4"), 178: ("(Q-Qo)/C", "<f4"), 179: ("dQ/C", "<f4"),
    211: ("Q charge/discharge/mA.h", "<f8"), 212: ("half cycle", "<u4"), 213: ("z cycle", "<u4"), 434: ("(Q-Qo)/C", "<f4"), 435: ("dQ/C", "<f4"),
    467: ("Q charge/discharge/mA.h", "<f8"), 468: ("half cycle", "<u4"), 469: ("z cycle", "<u4"), 498: ("Q charge/mA.h", "<f8"), 499: ("Q discharge/mA.h", "<f8"),
}
#: Field numbers that share one byte of flags, and widths of accessory fields.
FLAGS = frozenset({1, 2, 3, 21, 31, 65})
ACCESSORY = {115: 8, 116: 8, 175: 4, 176: 4, 177: 4, 182: 8, 215: 4}
KNOWN = (b"VMP Set   ", b"VMP data  ", b"VMP LOG   ", b"VMP loop  ")


def _bad(text: str) -> CorruptedFileError:
    return CorruptedFileError(f"MPR: {text}")


def _modules(f: BinaryIO, size: int) -> dict[bytes, tuple[int, int, int, bytes]]:
    """Short name to (payload offset, length, version, date); payloads are skipped."""
    if f.read(len(MAGIC)) != MAGIC:
        raise _bad("not this format")
    out: dict[bytes, tuple[int, int, int, bytes]] = {}
    while mark := f.read(6):
        if mark != b"MODULE":
            raise _bad("something else where a module should begin")
        head = f.read(51)
        if len(head) < 51:
            raise _bad("truncated module header")
        name, _, length = struct.unpack_from("<10s25sI", head)
        if length == 0xFFFFFFFF:
            head += f.read(8)
            if len(head) < 59:
                raise _bad("truncated module header")
            length, version, _, date = struct.unpack_from("<III8s", head, 39)
        else:
            version, date = struct.unpack_from("<I8s", head, 39)
        at = f.tell()
        if at + length > size:
            raise _bad("truncated module")
        if name in KNOWN:
            if name in out:
                raise _bad(f"two modules {name!r}")
            out[name] = (at, length, version, date)
        f.seek(at + length)
    if KNOWN[0] not in out or KNOWN[1] not in out:
        raise _bad("settings or measurements are missing")
    return out


def _date(raw: bytes) -> dt.date:
    text = raw.decode("ascii", "replace").strip("\0 ")
    parts = re.fullmatch(r"(\d{1,2})[./-](\d{1,2})[./-](\d{2}|\d{4})", text)
    if not parts:
        raise _bad("unreadable date")
    month, day, year = (int(p) for p in parts.groups())
    try:
        return dt.date(year + 2000 if year < 100 else year, month, day)
    except ValueError as error:
        raise _bad("impossible date") from error


def _payload(f: BinaryIO, module: tuple[int, int, int, bytes], n: int) -> bytes:
    if module[1] < n:
        raise _bad("a module is too short")
    f.seek(module[0])
    return f.read(n)


def _layout(numbers: list[int]) -> list[list[str]]:
    fields: list[list[str]] = []
    names: dict[str, int] = {}
    flags = False
    for k, number in enumerate(numbers):
        if number in FLAGS:
            if not flags:
                fields.append(["flags", "u1"])
            flags = True
        elif number in ACCESSORY:
            fields.append([f"_accessory_{k}", f"V{ACCESSORY[number]}"])
        elif number in FIELDS:
            name, kind = FIELDS[number]
            names[name] = names.get(name, 0) + 1
            fields.append([name if names[name] == 1 else f"{name} {names[name]}", kind])
        else:
            raise UnsupportedFormatError(f"MPR field {number} is not known")
    return fields


def inspect_layout(path: str) -> dict:
    """Offset, number and fields of the records, from headers alone."""
    import numpy as np

    try:
        with open(path, "rb") as f:
            before = stamp(path)
            modules = _modules(f, before[2])
            data = modules[KNOWN[1]]
            rows, columns = struct.unpack_from("<IB", _payload(f, data, 6))
            if not columns:
                raise _bad("no fields")
            wide = data[2] in (2, 3)
            if wide:
                offset = 405 if data[2] == 2 else 406
                head = _payload(f, data, offset)
                if 5 + 2 * columns > 405:
                    raise _bad("the field list runs into the records")
                numbers, rest = list(struct.unpack_from(f"<{columns}H", head, 5)), head[5 + 2 * columns : 405]
            elif data[2] == 0:
                single = _payload(f, data, 6)[5] != 0
                offset = 100 if single else 1007
                head = _payload(f, data, offset)
                end = 5 + columns if single else 6 + 2 * columns
                numbers = list(head[5:end]) if single else list(head[6:end:2])
                rest = head[end:100] if single else head[end:1006]
                if end > offset:
                    raise _bad("the field list runs into the records")
            else:
                raise _bad(f"measurement version {data[2]}")
            if len(numbers) != columns or any(rest):
                raise _bad("broken field list")
            fields = _layout(numbers)
            if data[1] - offset != rows * np.dtype([tuple(x) for x in fields]).itemsize:
                raise _bad("the number of records does not fit the module")
            _auxiliary(f, modules)
            if stamp(path) != before:
                raise _bad("the file changed")
    except (OSError, struct.error, IndexError) as error:
        raise _bad(str(error)) from error
    return {"kind": "mpr", "path": path, "offset": data[0] + offset, "rows": rows, "fields": fields, "stamp": before}


def _auxiliary(f: BinaryIO, modules: dict[bytes, tuple[int, int, int, bytes]]) -> None:
    started = _date(modules[KNOWN[0]][3])
    if KNOWN[3] in modules:
        _, length, version, _ = modules[KNOWN[3]]
        if version or length < 4 or length % 4:
            raise _bad("broken loop module")
    if KNOWN[2] in modules:
        _date(modules[KNOWN[2]][3])
        prefix = _payload(f, modules[KNOWN[2]], 593)
        days = [d for at in (465, 469, 473, 585) if 40000 < (d := struct.unpack_from("<d", prefix, at)[0]) < 50000]
        if not days:
            raise _bad("no time in the log")
        if (dt.datetime(1899, 12, 30) + dt.timedelta(days=days[0])).date() != started:
            raise _bad("the log's date is not the settings' date")
