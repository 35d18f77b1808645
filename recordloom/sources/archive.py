"""ZIP archives and XLSX workbooks of small reports, written on the driver."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime

from pyspark.sql import DataFrame

from ..operators.rules import Invalid


def clean_name(name: str) -> str:
    """An entry name with forward slashes and no root; what would lead a way up ends in _ instead."""
    parts = str(name).replace("\\", "/").lstrip("/").split("/")
    own = "/".join(p[:-2] + "_" if p.endswith("..") else p for p in parts)
    if not own:
        raise Invalid("an entry needs a name")
    return own


def unique_name(base: str, extension: str, taken: set[str]) -> str:
    """base.ext, base-2.ext, ... : the first that is free; it is taken then."""
    n, name = 1, f"{base}.{extension}"
    while name in taken:
        n += 1
        name = f"{base}-{n}.{extension}"
    taken.add(name)
    return name


def zip_files(files: list[tuple[str, str | bytes]], date: datetime | None = None, compress: bool = True) -> bytes:
    """An archive of files; the same input gives the same bytes. A name that is there twice is refused."""
    at = date or datetime(1980, 1, 1)
    stamp = max((at.year, at.month, at.day, at.hour, at.minute, at.second), (1980, 1, 1, 0, 0, 0))
    out, names = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            name = clean_name(name)
            if name in names:
                raise Invalid(f'the entry "{name}" is there twice')
            names.add(name)
            entry = zipfile.ZipInfo(name, stamp)
            data = data.encode() if isinstance(data, str) else data
            entry.compress_type = zipfile.ZIP_DEFLATED if compress and data else zipfile.ZIP_STORED
            z.writestr(entry, data)
    return out.getvalue()


def column_letters(i: int) -> str:
    """A, B, ... Z, AA, ... of a 0-based column."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_name(raw: str, taken: set[str], index: int) -> str:
    """A legal sheet name of at most 31 characters, not there yet in any case."""
    base = " ".join(re.sub(r"[\[\]:*?/\\]", " ", str("" if raw is None else raw)).split())[:31] or f"Sheet{index + 1}"
    name, n = base, 1
    while name.lower() in taken:
        n += 1
        name = base[: 31 - len(f" ({n})")] + f" ({n})"
    taken.add(name.lower())
    return name


def _escape(value) -> str:
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _cell(at: str, value, style: int) -> str:
    s = f' s="{style}"' if style else ""
    if value is None or value == "":
        return f'<c r="{at}"{s}/>' if style else ""
    if isinstance(value, bool):
        return f'<c r="{at}"{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"{s}><v>{value!r}</v></c>'
    return f'<c r="{at}"{s} t="inlineStr"><is><t xml:space="preserve">{_escape(value)}</t></is></c>'


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _sheet(rows: list[list], percent: set[int]) -> str:
    rows = rows or [["(empty)"]]
    widths = [min(60, max(8, 2 + max(len(str(r[i])) for r in rows if i < len(r)))) for i in range(max(map(len, rows)))]
    columns = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
    body = "".join(f'<row r="{r + 1}">' + "".join(_cell(f"{column_letters(c)}{r + 1}", v, 1 if r == 0 else 2 if c in percent else 0) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
    frozen = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    return f'{HEAD}<worksheet xmlns="{MAIN}">{frozen}<cols>{columns}</cols><sheetData>{body}</sheetData></worksheet>'


def workbook(sheets: list[tuple[str, list[list], set[int]]], date: datetime | None = None) -> bytes:
    """An XLSX file of (name, rows with the header first, columns shown as per cent)."""
    taken: set[str] = set()
    names = [sheet_name(n, taken, i) for i, (n, *_) in enumerate(sheets)]
    listed = "".join(f'<sheet name="{_escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
    links = "".join(f'<Relationship Id="rId{i + 1}" Type="{REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
    styles = (
        f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="10" applyNumberFormat="1"/></cellXfs></styleSheet>'
    )
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
    files = [
        ("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
         f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>'),
        ("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{links}<Relationship Id="rId{len(names) + 1}" Type="{REL}/styles" Target="styles.xml"/></Relationships>'),
        ("xl/styles.xml", styles),
        *((f"xl/worksheets/sheet{i + 1}.xml", _sheet(rows, percent)) for i, (_, rows, percent) in enumerate(sheets)),
    ]
    return zip_files(files, date)


#: Rows that one sheet of a report shows at most; reports list samples, tables go to files.
SHEET_ROWS = 5_000
RATIOS = {"precision", "recall", "f1", "rate", "pair_completeness", "reduction_ratio", "auto_merge_precision", "auto_merge_recall", "review_precision", "recall_after_perfect_review"}


def report(sheets: dict[str, DataFrame], date: datetime | None = None) -> bytes:
    """A workbook of small report tables."""
    out = []
    for name, df in sheets.items():
        rows = [[", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) if isinstance(v, dict) else v for v in r] for r in df.limit(SHEET_ROWS).collect()]
        out.append((name, [df.columns, *rows], {i for i, c in enumerate(df.columns) if c in RATIOS}))
    return workbook(out, date)
