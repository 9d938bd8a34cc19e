"""Text of one zipped office document, used inside tasks."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
O_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
O_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
BREAKS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-"}
DATE_FORMATS = {*range(14, 23), 45, 46, 47}


def office_text(extension: str, content: bytes | None) -> str:
    readers = {".docx": _docx, ".xlsx": _xlsx, ".odt": _odt, ".ods": _ods}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return "\n".join(readers[extension](archive))
    except Exception:  # noqa: BLE001 - a damaged file yields no text
        return ""


def _paragraph(p: ET.Element) -> str:
    return "".join(
        (e.text or "") if e.tag == W + "t" else BREAKS.get(e.tag, "") for e in p.iter()
    )


def _docx(archive: zipfile.ZipFile):
    body = ET.fromstring(archive.read("word/document.xml")).find(W + "body")
    yield from filter(None, map(_paragraph, body.findall(W + "p")))
    for table in body.findall(W + "tbl"):
        above: list[str] = []
        for row in table.findall(W + "tr"):
            cells: list[str] = []
            for cell in row.findall(W + "tc"):
                merge = cell.find(f"{W}tcPr/{W}vMerge")
                span = cell.find(f"{W}tcPr/{W}gridSpan")
                text = "\n".join(map(_paragraph, cell.findall(W + "p")))
                if merge is not None and merge.get(W + "val", "continue") == "continue":
                    text = above[len(cells)] if len(cells) < len(above) else text
                cells += [text] * (int(span.get(W + "val")) if span is not None else 1)
            above = cells
            yield from filter(None, cells)


def _date_styles(archive: zipfile.ZipFile) -> list[bool]:
    """Which cell styles show a date or time."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    root = ET.fromstring(archive.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")): re.sub(r'\[[^\]]*\]|"[^"]*"', "", f.get("formatCode", ""))
        for f in root.iter(S + "numFmt")
    }
    formats = [int(x.get("numFmtId", 0)) for x in root.findall(f"{S}cellXfs/{S}xf")]
    return [
        f in DATE_FORMATS or bool(re.search("[dmyhs]", custom.get(f, ""), re.IGNORECASE))
        for f in formats
    ]


def _date(serial: float) -> str:
    if 0 <= serial < 1:
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(serial * 86400))
        return str(moment.time())
    return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(serial * 86400)))


def _cell_value(cell: ET.Element, shared: list[str], dates: list[bool]) -> str | None:
    kind, value = cell.get("t", "n"), cell.findtext(S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(S + "t"))
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return str(value == "1")
    if kind != "n":
        return value
    number = float(value) if re.search("[.eE]", value) else int(value)
    style = int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        return _date(float(number))
    return str(number)


def _xlsx(archive: zipfile.ZipFile):
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        for item in ET.fromstring(archive.read("xl/sharedStrings.xml")).findall(S + "si"):
            runs = item.findall(f"{S}r/{S}t") or item.findall(S + "t")
            shared.append("".join(t.text or "" for t in runs))
    dates = _date_styles(archive)
    targets = {
        r.get("Id"): r.get("Target")
        for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    }
    for sheet in ET.fromstring(archive.read("xl/workbook.xml")).iter(S + "sheet"):
        yield f"\n[{sheet.get('name')}]"
        target = targets[sheet.get(R + "id")]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for row in ET.fromstring(archive.read(path)).iter(S + "row"):
            values = [_cell_value(c, shared, dates) for c in row.findall(S + "c")]
            values = [v for v in values if v is not None]
            if values:
                yield " | ".join(values)


def _open_text(element: ET.Element) -> str:
    """Text of a paragraph with its spaces, tabs and line breaks."""
    out = [element.text or ""]
    for child in element:
        if child.tag == O_TEXT + "s":
            out.append(" " * int(child.get(O_TEXT + "c", 1)))
        elif child.tag == O_TEXT + "tab":
            out.append("\t")
        elif child.tag == O_TEXT + "line-break":
            out.append("\n")
        else:
            out.append(_open_text(child))
        out.append(child.tail or "")
    return "".join(out)


def _open_cells(row: ET.Element):
    for cell in row.findall(O_TABLE + "table-cell"):
        text = "\n".join(_open_text(p) for p in cell.findall(O_TEXT + "p"))
        if text:
            yield from [text] * int(cell.get(O_TABLE + "number-columns-repeated", 1))


def _odt(archive: zipfile.ZipFile):
    root = ET.fromstring(archive.read("content.xml"))
    in_tables = {p for t in root.iter(O_TABLE + "table") for p in t.iter(O_TEXT + "p")}
    for element in root.iter():
        if element.tag in (O_TEXT + "p", O_TEXT + "h") and element not in in_tables:
            text = _open_text(element)
            if text:
                yield text
    for row in root.iter(O_TABLE + "table-row"):
        yield from _open_cells(row)


def _ods(archive: zipfile.ZipFile):
    for sheet in ET.fromstring(archive.read("content.xml")).iter(O_TABLE + "table"):
        yield f"\n[{sheet.get(O_TABLE + 'name')}]"
        for row in sheet.iter(O_TABLE + "table-row"):
            cells = list(_open_cells(row))
            if cells:
                yield " | ".join(cells)
