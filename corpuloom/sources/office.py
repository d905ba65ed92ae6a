"""Text of office files, from their zipped XML, in tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import arrow_map

_TAG = re.compile(r"\{[^}]*\}")


def _name(element: ElementTree.Element) -> str:
    return _TAG.sub("", element.tag)


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _TAG.sub("", k) == name), None)


def _text(element: ElementTree.Element, leaves: tuple[str, ...]) -> str:
    """Texts of the leaves below, tabs and line breaks as such."""
    out = []
    for x in element.iter():
        name = _name(x)
        if name in leaves:
            out.append(x.text or "")
        elif name in ("tab",):
            out.append("\t")
        elif name in ("br", "line-break"):
            out.append("\n")
        if name in ("span", "a", "s", "line-break", "tab") and x is not element:
            out.append(x.tail or "")
    return "".join(out)


def _paragraphs(root: ElementTree.Element, paragraph: tuple[str, ...], leaves: tuple[str, ...]) -> list[str]:
    return [t for t in (_text(p, leaves).strip() for p in root.iter() if _name(p) in paragraph) if t]


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as a markdown table, the first as its head; empty edges are cut."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    width = max((len(r) for r in rows), default=0)
    while width and not any(len(r) >= width and r[width - 1].strip() for r in rows):
        width -= 1
    if not rows or not width:
        return ""
    shown = [[(r[i] if i < len(r) else "").replace("|", "\\|").replace("\n", " ") for i in range(width)] for r in rows]
    lines = [f"| {' | '.join(r)} |" for r in shown]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _docx(z: zipfile.ZipFile) -> tuple[str, int | None]:
    return "\n".join(_paragraphs(ElementTree.fromstring(z.read("word/document.xml")), ("p",), ("t",))), None


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx(z: zipfile.ZipFile) -> tuple[str, int | None]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = [_text(x, ("t",)) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _name(x) == "si"]
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    names = [_attribute(x, "name") or "" for x in book.iter() if _name(x) == "sheet"]
    sheets = _numbered(z, r"xl/worksheets/sheet(\d+)\.xml")
    out = []
    for i, part in enumerate(sheets):
        rows = []
        for row in (x for x in ElementTree.fromstring(z.read(part)).iter() if _name(x) == "row"):
            cells: list[str] = []
            for c in (x for x in row if _name(x) == "c"):
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                value = next((x.text or "" for x in c.iter() if _name(x) == "v"), "")
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = _text(c, ("t",))
                cells += [""] * (at - len(cells)) + [value]
            rows.append(cells)
        out.append(f"## {names[i] if i < len(names) else f'Sheet {i + 1}'}\n\n{table_markdown(rows)}".rstrip())
    return "\n\n".join(out), len(sheets)


def _pptx(z: zipfile.ZipFile) -> tuple[str, int | None]:
    slides = _numbered(z, r"ppt/slides/slide(\d+)\.xml")
    out = [f"## Slide {i}\n\n" + "\n".join(_paragraphs(ElementTree.fromstring(z.read(s)), ("p",), ("t",))) for i, s in enumerate(slides, 1)]
    return "\n\n".join(x.rstrip() for x in out), len(slides)


def _open_document(z: zipfile.ZipFile) -> tuple[str, int | None]:
    root = ElementTree.fromstring(z.read("content.xml"))
    leaves = ("p", "h", "span", "a")
    body = next((x for x in root.iter() if _name(x) in ("text", "spreadsheet", "presentation") and "office" in x.tag), root)
    kind = _name(body)
    if kind == "spreadsheet":
        tables = [x for x in body if _name(x) == "table"]
        out = []
        for i, t in enumerate(tables):
            rows = []
            for r in (x for x in t.iter() if _name(x) == "table-row"):
                cells = []
                for c in (x for x in r if _name(x) == "table-cell"):
                    cells += [" ".join(_paragraphs(c, ("p",), leaves))] * min(100, int(_attribute(c, "number-columns-repeated") or 1))
                rows.append(cells)
            out.append(f"## {_attribute(t, 'name') or f'Sheet {i + 1}'}\n\n{table_markdown(rows)}".rstrip())
        return "\n\n".join(out), len(tables)
    if kind == "presentation":
        pages = [x for x in body if _name(x) == "page"]
        out = [f"## Slide {i}\n\n" + "\n".join(_paragraphs(p, ("p", "h"), leaves)) for i, p in enumerate(pages, 1)]
        return "\n\n".join(x.rstrip() for x in out), len(pages)
    return "\n".join(_paragraphs(body, ("p", "h"), leaves)), None


READERS = {".docx": _docx, ".xlsx": _xlsx, ".pptx": _pptx, ".odt": _open_document, ".ods": _open_document, ".odp": _open_document}


def office_text(ext: str, data: bytes) -> tuple[str | None, int | None]:
    """Text (sheets as markdown tables, slides under headings) and the number of sheets or slides; None if unreadable."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return READERS[ext.lower()](z)
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError, ValueError, IndexError, TypeError):
        return None, None


def extract_office(files: DataFrame, data: str = "content") -> DataFrame:
    """path, text and pages of files (path, ext, bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [office_text(e or "", d or b"") for e, d in zip(batch["ext"].to_pylist(), batch["data"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([t for t, _ in got], pa.string()), pa.array([p for _, p in got], pa.int64())], ["path", "text", "pages"])

    return arrow_map(files.selectExpr("path", "ext", f"`{data}` AS data"), read, "path string, text string, pages bigint")
