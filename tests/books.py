"""Writes small .xlsx files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        names = list(sheets)
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        for k, n in enumerate(names, 1):
            rows = []
            for r, row in enumerate(sheets[n], 1):
                cells = []
                for c, v in enumerate(row):
                    at = f"{chr(65 + c)}{r}"
                    if isinstance(v, tuple):  # a date's serial number
                        cells.append(f'<c r="{at}" s="1"><v>{v[0]}</v></c>')
                    elif isinstance(v, int | float):
                        cells.append(f'<c r="{at}"><v>{v}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                rows.append(f'<row r="{r}">{"".join(cells)}</row>')
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
    return out.getvalue()
