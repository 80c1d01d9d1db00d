"""Cells of one workbook, streamed row by row inside a task (Spark has no XLSX source)."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

# Number formats that show a date or a time, and the one that shows a duration.
DATE_FORMATS = (*range(14, 23), 45, 47)
DURATION_FORMATS = (46,)

_BOOK = "xl/workbook.xml"
_REF = re.compile(r"([A-Z]+)[0-9]+")


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _children(archive: zipfile.ZipFile, name: str) -> Iterator:
    if name in archive.namelist():
        yield from ElementTree.fromstring(archive.read(name)).iter()


def sheet_parts(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part name) in workbook order."""
    targets = {}
    for element in _children(archive, "xl/_rels/workbook.xml.rels"):
        if _tag(element) == "Relationship":
            target = element.get("Target", "")
            targets[element.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    sheets = []
    for element in _children(archive, _BOOK):
        if _tag(element) == "sheet":
            relation = next((v for k, v in element.attrib.items() if k.endswith("}id")), None)
            sheets.append((element.get("name"), targets.get(relation)))
    return sheets


class Workbook:
    def __init__(self, stream: IO[bytes]) -> None:
        self.archive = zipfile.ZipFile(stream)
        self.sheets = sheet_parts(self.archive)
        is_1904 = any(
            _tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in _children(self.archive, _BOOK)
        )
        self.epoch = dt.datetime(1904, 1, 1) if is_1904 else dt.datetime(1899, 12, 30)
        self._strings: list[str] | None = None
        self._styles: list[str] | None = None

    def rows(self, part: str) -> Iterator[tuple[int, list[tuple[str, str]]]]:
        """(row number, cells from column A on) for rows up to the last one with a value.

        Rows between two rows with values come out empty. Cells are (kind, text).
        """
        last, number = None, 0
        with self.archive.open(part) as stream:
            for _, element in ElementTree.iterparse(stream, events=("end",)):
                if _tag(element) != "row":
                    continue
                number = int(element.get("r") or number + 1)
                cells: list[tuple[str, str]] = []
                for place, cell in enumerate(element, start=1):
                    value = self._value(cell)
                    if value is None:
                        continue
                    column = _column(cell.get("r")) or place
                    cells += [("empty", "")] * (column - 1 - len(cells)) + [value]
                element.clear()
                if cells:
                    if last is not None:
                        yield from ((gap, []) for gap in range(last + 1, number))
                    last = number
                    yield number, cells

    def _value(self, cell) -> tuple[str, str] | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "text", _text(cell)
        raw = next((child.text for child in cell if _tag(child) == "v"), None)
        if raw is None:
            return None
        if kind == "s":
            return "text", self._shared(int(raw))
        if kind == "b":
            return "bool", "true" if raw.strip() == "1" else "false"
        if kind == "d":
            return ("date" if len(raw) == 10 else "datetime"), raw.rstrip("Z")
        if kind != "n":
            return "text", raw
        return self._number(float(raw), self._style(int(cell.get("s", 0))))

    def _number(self, value: float, style: str) -> tuple[str, str]:
        if style == "number":
            return "number", repr(value)
        span = dt.timedelta(milliseconds=round(value * 86_400_000))
        if style == "duration":
            return "text", str(span)
        moment = self.epoch + span
        if 0 <= value < 1:
            return "text", moment.time().isoformat()
        if value == int(value):
            return "date", moment.date().isoformat()
        return "datetime", moment.isoformat()

    def _shared(self, index: int) -> str:
        if self._strings is None:
            items = _children(self.archive, "xl/sharedStrings.xml")
            self._strings = [_text(item) for item in items if _tag(item) == "si"]
        return self._strings[index]

    def _style(self, index: int) -> str:
        if self._styles is None:
            self._styles = list(self._read_styles())
        return self._styles[index] if index < len(self._styles) else "number"

    def _read_styles(self) -> Iterator[str]:
        custom: dict[int, str] = {}
        for element in _children(self.archive, "xl/styles.xml"):
            if _tag(element) == "numFmt":
                custom[int(element.get("numFmtId"))] = element.get("formatCode", "")
            elif _tag(element) == "cellXfs":
                yield from (_style_kind(int(xf.get("numFmtId", 0)), custom) for xf in element)


def _style_kind(number: int, custom: dict[int, str]) -> str:
    if number in custom:
        code = re.sub(r'"[^"]*"|\\.|_.', "", custom[number].lower())
        if re.search(r"\[[hms]+\]", code):
            return "duration"
        return "date" if re.search("[dmyhs]", re.sub(r"\[[^\]]*\]|general", "", code)) else "number"
    return "date" if number in DATE_FORMATS else "duration" if number in DURATION_FORMATS else "number"


def _text(element) -> str:
    """Text of a cell or shared string: its runs joined, phonetic hints left out."""
    phonetic = {t for hint in element.iter() if _tag(hint) == "rPh" for t in hint.iter()}
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t" and t not in phonetic)


def _column(reference: str | None) -> int | None:
    match = _REF.fullmatch(reference or "")
    if not match:
        return None
    number = 0
    for letter in match[1]:
        number = number * 26 + ord(letter) - 64
    return number
