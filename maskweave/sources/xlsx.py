"""Workbooks (.xlsx) by the public Office Open XML format: a ZIP archive of XML parts.

Reading gives every cell as text with its kind; writing replaces cells inside the
archive and leaves everything else in it as it is.  Only the standard library is
needed.
"""

from __future__ import annotations

import functools
import io
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from datetime import date, datetime, time, timedelta
from xml.etree import ElementTree as ET

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PART = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
# Numbers of built-in formats that show a date or a time.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
#: Archives that unpack to more than this are refused.
MOST_UNPACKED = 1 << 30


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def column_number(letters: str) -> int:
    """1 for A, 27 for AA."""
    return functools.reduce(lambda n, c: n * 26 + ord(c) - 64, letters, 0)


def address(ref: str) -> tuple[int, int]:
    """(row, column) of a reference such as B7."""
    letters, row = re.fullmatch(r"([A-Z]+)([0-9]+)", ref).groups()
    return int(row), column_number(letters)


@dataclass
class Sheet:
    """One sheet; cells: (row, column, search text, original, kind, formula)."""

    name: str
    number: int
    hidden: bool
    merges: list[str] = field(default_factory=list)
    cells: list[tuple] = field(default_factory=list)
    uncached: int = 0
    max_row: int = 0
    max_column: int = 0


# how values of the several types are searched


def _plain_number(x: float) -> str:
    whole = float(x).is_integer() and abs(x) < 1e15
    return f"{x:.0f}" if whole else f"{x:g}"


@functools.singledispatch
def shown(value: object) -> tuple[str, str]:
    """(search text, kind) of a cell's value; anything without a rule of its own is text."""
    text = str(value)
    return (text, "text") if text else ("", "empty")


shown.register(type(None), lambda value: ("", "empty"))
shown.register(bool, lambda value: ("", "bool"))
shown.register(int, lambda value: (f"{value:d}", "number"))
shown.register(float, lambda value: (_plain_number(value), "number"))
shown.register(date, lambda value: (value.isoformat(), "date"))
shown.register(time, lambda value: (value.isoformat("seconds"), "date"))


@shown.register(datetime)
def _(value: datetime) -> tuple[str, str]:
    day, clock = value.isoformat(" ", "seconds").split(" ")
    return (day if value.time() == time() else f"{day} {clock}"), "date"


def moment(serial: float, from_1904: bool) -> date | time:
    """The date, time or both that a serial number of days stands for."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    at = start + timedelta(milliseconds=round(serial * 86_400_000))
    return at.time() if 0 <= serial < 1 else at


class _Book:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        if sum(i.file_size for i in self.zip.infolist()) > MOST_UNPACKED:
            raise ValueError("a workbook that unpacks to more than the limit")
        self.names = set(self.zip.namelist())
        book = self.part("xl/workbook.xml")
        targets = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in self.part("xl/_rels/workbook.xml.rels").iter(_PART)}
        self.sheets = [(s.get("name"), targets[s.get(_REL)], s.get("state", "visible") != "visible") for s in book.iter(_tag("sheet"))]
        settings = book.find(_tag("workbookPr"))
        self.from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        strings = self.part("xl/sharedStrings.xml")
        self.strings = [] if strings is None else ["".join(t.text or "" for t in _texts(s)) for s in strings.iter(_tag("si"))]
        self.dates = self._date_styles()

    def part(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def _date_styles(self) -> list[bool]:
        """Of each cell style, whether it shows a date or a time."""
        styles = self.part("xl/styles.xml")
        if styles is None:
            return []
        own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(_tag("numFmt"))}
        used = styles.find(_tag("cellXfs"))
        ids = [int(x.get("numFmtId", 0)) for x in used] if used is not None else []
        return [i in DATE_FORMATS or bool(re.search("[dmyhs]", own.get(i, "").lower())) for i in ids]

    def value(self, cell: ET.Element) -> object:
        """What a cell holds; None if it holds nothing."""
        kind, v = cell.get("t", "n"), cell.find(_tag("v"))
        if kind == "inlineStr":
            return "".join(t.text or "" for t in _texts(cell))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return v.text.strip() == "1"
        if kind == "d":
            return datetime.fromisoformat(v.text)
        if kind in ("str", "e"):
            return v.text
        number = float(v.text)
        style = int(cell.get("s", 0))
        if style < len(self.dates) and self.dates[style]:
            return moment(number, self.from_1904)
        return int(v.text) if re.fullmatch(r"-?[0-9]+", v.text) else number


def _texts(e: ET.Element) -> list[ET.Element]:
    """The texts of a string, without phonetic hints."""
    hints = {id(t) for p in e.iter(_tag("rPh")) for t in p.iter(_tag("t"))}
    return [t for t in e.iter(_tag("t")) if id(t) not in hints]


def sheets(content: bytes) -> list[Sheet]:
    """All sheets of a workbook, hidden ones too, in their order.

    A formula (plain, array or data table) is searched in its cached value; one
    without a cached value is an empty cell and counted.
    """
    book, out = _Book(content), []
    for number, (name, part, hidden) in enumerate(book.sheets, 1):
        sheet, root = Sheet(name, number, hidden), book.part(part)
        sheet.merges = [m.get("ref") for m in root.iter(_tag("mergeCell"))]
        for c in root.iter(_tag("c")):
            row, column = address(c.get("r"))
            sheet.max_row, sheet.max_column = max(sheet.max_row, row), max(sheet.max_column, column)
            value, f = book.value(c), c.find(_tag("f"))
            text, kind = shown(value)
            formula = "=" + (f.text or "") if f is not None else value if isinstance(value, str) and value.startswith("=") else None
            if f is not None and value is None:
                sheet.uncached += 1
            elif kind != "empty":
                sheet.cells.append((row, column, text, str(value), "formula" if formula else kind, formula))
        out.append(sheet)
    return out


def rewritten(content: bytes, changed: dict[str, dict[tuple[int, int], str]]) -> bytes:
    """The workbook with cells replaced by texts: sheet name -> (row, column) -> text.

    A text is written as one, even if it begins with ``=``.  Every formula gives
    way to its cached value; one without is blanked, since it could bring an
    original back.  Cached calculation chains are left out.
    """
    book, out = _Book(content), io.BytesIO()
    by_part = {part: changed.get(name, {}) for name, part, _ in book.sheets}
    ET.register_namespace("", MAIN)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in book.zip.infolist():
            data = book.zip.read(item)
            if item.filename == "xl/calcChain.xml":
                continue
            if item.filename in by_part:
                data = _sheet_part(data, by_part[item.filename])
            elif item.filename in ("[Content_Types].xml", "xl/_rels/workbook.xml.rels"):
                data = re.sub(rb"<(?:Override|Relationship)\b[^>]*calcChain[^>]*/>", b"", data)
            z.writestr(item, data)
    return out.getvalue()


def _sheet_part(data: bytes, texts: dict[tuple[int, int], str]) -> bytes:
    root = ET.fromstring(data)
    for c in root.iter(_tag("c")):
        new, f = texts.get(address(c.get("r"))), c.find(_tag("f"))
        if f is not None:
            c.remove(f)
        if new is not None:
            for child in list(c):
                c.remove(child)
            c.set("t", "inlineStr")
            t = ET.SubElement(ET.SubElement(c, _tag("is")), _tag("t"))
            t.text = new
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    return ET.tostring(root, "utf-8", xml_declaration=True)


def workbook(tables: dict[str, list[list[object]]]) -> bytes:
    """A small new workbook: sheet name -> rows of texts, numbers, truth values and formulas (texts that begin with ``=``, without cached values)."""
    out, names = io.BytesIO(), list(tables)
    ET.register_namespace("", MAIN)
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    letters = lambda n: (letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i, _ in enumerate(names, 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(names, 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        for i, name in enumerate(names, 1):
            root = ET.Element(_tag("worksheet"))
            data = ET.SubElement(root, _tag("sheetData"))
            for r, values in enumerate(tables[name], 1):
                row = ET.SubElement(data, _tag("row"), r=str(r))
                for k, v in enumerate(values, 1):
                    if v is None or v == "":
                        continue
                    c = ET.SubElement(row, _tag("c"), r=f"{letters(k)}{r}")
                    if isinstance(v, bool):
                        c.set("t", "b")
                        ET.SubElement(c, _tag("v")).text = str(int(v))
                    elif isinstance(v, int | float):
                        ET.SubElement(c, _tag("v")).text = repr(v)
                    elif v.startswith("="):
                        ET.SubElement(c, _tag("f")).text = v[1:]
                    else:
                        c.set("t", "inlineStr")
                        ET.SubElement(ET.SubElement(c, _tag("is")), _tag("t")).text = v
            z.writestr(f"xl/worksheets/sheet{i}.xml", ET.tostring(root, "utf-8", xml_declaration=True))
    return out.getvalue()
