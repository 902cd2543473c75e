"""The structure of delimited text from a bounded sample of its head."""

from __future__ import annotations

import codecs
import csv
import io
from collections import Counter
from dataclasses import dataclass

from ..errors import CorruptedFileError, IncompatibleDataError, UnsupportedFormatError
from ..functions.numeric import CLOCK, local_number
from ..schema import CANONICAL_COLUMNS
from .models import ReadOptions
from .recognition import ELIGIBLE, candidate

#: How much of a file's head is looked at, and the separators that are tried.
SAMPLE_BYTES, SAMPLE_LINES = 131_072, 80
SEPARATORS = (",", ";", "\t", "whitespace")


@dataclass(frozen=True)
class TextPlan:
    encoding: str
    separator: str
    decimal: str
    skiprows: int
    header_record: int | None
    columns: tuple[str | int, ...]
    strip_last: bool = False  # every line may end with one more separator

    @property
    def width(self) -> int:
        return len(self.columns)

    @property
    def canonical(self) -> bool:
        return self.columns == CANONICAL_COLUMNS


def head(path: str, size: int = SAMPLE_BYTES) -> bytes:
    with open(path, "rb") as f:
        return f.read(size)


def decode_head(raw: bytes, encoding: str | None) -> tuple[str, str]:
    """(text, encoding): the given codec, a byte order mark, UTF-8, or else Windows-1252.  A character
    cut off by the sample's end is left out.  Binary content is refused."""
    if not raw:
        raise IncompatibleDataError("the file is empty")
    if encoding:
        tries = [encoding]
    elif raw.startswith(codecs.BOM_UTF8):
        tries = ["utf-8-sig"]
    elif raw.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        tries = ["utf-16"]
    else:
        tries = ["utf-8", "cp1252"]
    for name in tries:
        try:
            text = codecs.getincrementaldecoder(name)("strict").decode(raw, final=False)
        except LookupError as error:
            raise IncompatibleDataError(f"unknown encoding {name!r}") from error
        except UnicodeDecodeError:
            continue
        controls = sum(1 for c in text if ord(c) < 32 and c not in "\t\r\n\f\v")
        if "\0" not in text and controls <= max(1, len(text) // 1000):
            return text, name
        raise UnsupportedFormatError("binary content")
    raise CorruptedFileError(f"the text is not {' or '.join(tries)}")


def sample_lines(text: str, whole: bool, skiprows: int, header: object) -> list[str]:
    lines = text.splitlines(keepends=True)
    if not whole and len(lines) > 1 and not lines[-1].endswith(("\n", "\r")):
        lines.pop()
    most = max(SAMPLE_LINES, header + 10 if isinstance(header, int) else 0)
    return lines[skiprows : skiprows + most]


def split_records(lines: list[str], separator: str) -> list[list[str]]:
    """Records without blank ones."""
    if separator == "whitespace":
        rows = [line.split() for line in lines]
    else:
        rows = list(csv.reader(io.StringIO("".join(lines)), delimiter=separator))
    return [r for r in rows if r and not (len(r) == 1 and not r[0].strip())]


def _numeric(cell: str, decimal: str) -> bool:
    import re

    return local_number(cell, decimal) is not None or re.fullmatch(CLOCK, cell.strip()) is not None


def _share(row: list[str], decimal: str) -> float:
    filled = [c for c in row if c.strip()]
    return sum(_numeric(c, decimal) for c in filled) / len(filled) if filled else 0.0


def _score(rows: list[list[str]], decimal: str | None) -> float:
    """Numeric content, width and evenness of a sample's first rows under one separator."""
    rows = rows[:20]
    if not rows:
        return float("-inf")
    width, often = Counter(map(len, rows)).most_common(1)[0]
    if width < 2:
        return float("-inf")
    body = rows[1:] or rows
    share = max(sum(_share(r, d) for r in body) / len(body) for d in ([decimal] if decimal else [".", ","]))
    return 10 * share + min(width, 10) + often / len(rows)


def find_separator(lines: list[str], decimal: str | None) -> str:
    scores = {}
    for separator in SEPARATORS:
        try:
            scores[separator] = _score(split_records(lines, separator), decimal)
        except csv.Error:
            continue
    top = max(scores.values(), default=float("-inf"))
    if top == float("-inf"):
        raise UnsupportedFormatError("no separator gives columns")
    best = [s for s, v in scores.items() if v == top]
    if set(best) == {"\t", "whitespace"}:
        return "\t" if any("\t" in line for line in lines) else "whitespace"
    if len(best) > 1:
        raise IncompatibleDataError(f"separators {best} fit equally well; give sep")
    return best[0]


def find_decimal(rows: list[list[str]]) -> str:
    cells = [c for r in rows[:20] for c in r]
    return "," if sum(_numeric(c, ",") for c in cells) > sum(_numeric(c, ".") for c in cells) else "."


def has_header(rows: list[list[str]], decimal: str) -> bool:
    first = _share(rows[0], decimal)
    following = [_share(r, decimal) for r in rows[1:6]]
    if first >= 0.75:
        return False
    if first <= 0.25 and following and sum(following) / len(following) >= 0.5:
        return True
    known = sum(candidate(c, k, None, ())[0].confidence >= ELIGIBLE for k, c in enumerate(rows[0]))
    if known >= 2 and known / len(rows[0]) >= 0.25:
        return True
    raise IncompatibleDataError("it is unclear whether there is a header; give header")


def plan_text(path: str, options: ReadOptions) -> TextPlan:
    raw = head(path)
    text, encoding = decode_head(raw, options.encoding)
    lines = sample_lines(text, len(raw) < SAMPLE_BYTES, options.skiprows, options.header)
    if not any(line.strip() for line in lines):
        raise IncompatibleDataError("no records")
    body = lines
    if isinstance(options.header, int):  # a preamble says nothing of the separator
        filled = [k for k, line in enumerate(lines) if line.strip()]
        body = lines[filled[options.header] :] if options.header < len(filled) else lines
    separator = options.sep or find_separator(body, options.decimal)
    try:
        rows = split_records(lines, separator)
    except csv.Error as error:
        raise CorruptedFileError(f"broken record: {error}") from error
    data = rows[options.header + 1 :] if isinstance(options.header, int) else rows[1:]
    decimal = options.decimal or find_decimal(data or rows)
    header = options.header
    if header == "infer":
        header = 0 if has_header(rows, decimal) else None
    if header is not None and header >= len(rows):
        raise IncompatibleDataError("the header record is beyond the file's records")
    columns = tuple(c.strip() for c in rows[header]) if header is not None else tuple(range(len(rows[0])))
    if len(columns) < 2:
        raise IncompatibleDataError("fewer than two columns")
    if header is not None and header + 1 >= len(rows):
        raise IncompatibleDataError("no data record after the header")
    return TextPlan(encoding, separator, decimal, options.skiprows, header, columns)
