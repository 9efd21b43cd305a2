"""Tabular extracts: reading and writing by suffix, workbooks without a library."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from metrigraph.sources.contracts import header

MEMBER_BYTES, RATIO = 64 << 20, 200


def load(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A frame of strings from csv, tsv, json lines, json or xlsx."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".csv", ".txt", ".tsv", ".tab"):
        sep = "\t" if suffix in (".tsv", ".tab") else ","
        return spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"')
    if suffix in (".jsonl", ".ndjson"):
        return spark.read.option("primitivesAsString", True).json(path)
    if suffix == ".json":
        return spark.read.option("primitivesAsString", True).json(path, multiLine=True)
    if suffix in (".xlsx", ".xlsm"):
        body = spark.read.format("binaryFile").load(path).select("content").first()[0]
        sheets = read_workbook(body)
        rows = sheets[sheet] if sheet else next(iter(sheets.values()))
        names = [header(c) or f"column_{i + 1}" for i, c in enumerate(rows[0])] if rows else ["column_1"]
        data = [(*r, *[None] * (len(names) - len(r)))[: len(names)] for r in rows[1:] if any(r)]
        return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in data], ", ".join(f"`{n}` string" for n in names))
    raise ValueError(f"no reader for {suffix!r}")


def read_workbook(body: bytes) -> dict[str, list[list[str | None]]]:
    """Rows of every sheet; members that are too large, or expand too much, are refused."""
    import io

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    book = zipfile.ZipFile(io.BytesIO(body))
    for info in book.infolist():
        if info.file_size > MEMBER_BYTES or info.file_size > RATIO * max(1, info.compress_size):
            raise ValueError(f"workbook member {info.filename} is too large")
    names = book.namelist()
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{{{ns['m']}}}t"))
    shared = [text(e) for e in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in names else []
    links = {e.get("Id"): e.get("Target") for e in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out: dict[str, list[list[str | None]]] = {}
    for s in ET.fromstring(book.read("xl/workbook.xml")).find("m:sheets", ns):
        target = links[s.get(f"{{{ns['r']}}}id")].lstrip("/")
        rows = []
        for row in ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{ns['m']}}}row"):
            cells: list[str | None] = []
            for c in row:
                place = 0
                for ch in re.match("[A-Z]*", c.get("r") or "")[0]:
                    place = place * 26 + ord(ch) - 64
                place = place or len(cells) + 1
                cells += [None] * (place - len(cells))
                v = c.find("m:v", ns)
                kind = c.get("t")
                cells[place - 1] = text(c) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else ("true" if v.text == "1" else "false") if kind == "b" else v.text
            rows.append(cells)
        out[s.get("name")] = rows
    return out


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """df's columns, in this order, as one csv file with a header: for registers that people read."""
    df.select(*(columns or df.columns)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of rows; texts are written inline, numbers and booleans as such."""
    import io
    from xml.sax.saxutils import escape

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        plain = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(plain)}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
