"""Rows of the first sheet of a workbook, read with the standard library."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The file of the sheet that the workbook lists first; where it lists none, the sheet file of the smallest number."""
    names = book.namelist()
    try:
        listed = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}sheets")[0]
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(x.get("Target") for x in links if x.get("Id") == listed.get(f"{_LINK}id"))
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path in names:
            return path
    except (KeyError, TypeError, IndexError, StopIteration):
        pass
    return min((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: int(re.sub(r"\D", "", n) or 0))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_NS}numFmt")}
    dates = {*range(14, 23), *range(45, 48)} | {k for k, code in own.items() if re.search("[ymdhs]", code.lower())}
    formats = root.find(f"{_NS}cellXfs")
    return set() if formats is None else {k for k, x in enumerate(formats) if int(x.get("numFmtId") or 0) in dates}


def _as_date(number: str, base: datetime.datetime) -> str:
    """The ISO text of a serial day number; a whole number has no time."""
    moment = base + datetime.timedelta(seconds=round(float(number) * 86400))
    return moment.strftime("%Y-%m-%d" if float(number).is_integer() else "%Y-%m-%d %H:%M:%S")


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Yield the rows of the first sheet as lists of text values, header first."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in root.iter(f"{_NS}si")]
        dates = _date_styles(book)
        since_1904 = b'date1904="1"' in book.read("xl/workbook.xml") if "xl/workbook.xml" in names else False
        base = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30)
        with book.open(_first_sheet(book)) as stream:
            for _, element in ElementTree.iterparse(stream):
                if element.tag != f"{_NS}row":
                    continue
                row: list[str | None] = []
                for cell in element.iter(f"{_NS}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    else:
                        node = cell.find(f"{_NS}v")
                        text = None if node is None else node.text
                        if text is not None and kind == "s":
                            text = shared[int(text)]
                        elif text is not None and kind in (None, "n") and int(cell.get("s") or 0) in dates:
                            text = _as_date(text, base)
                    row[at] = text
                yield row
                element.clear()
