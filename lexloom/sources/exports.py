"""Sinks: JSON lines, CSV with a header even when empty, spreadsheet-safe cells, iCalendar, audit events."""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import ical_text, safe_cell


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def safe_cells(df: DataFrame) -> DataFrame:
    """All cells as strings that no spreadsheet takes for formulas."""
    return df.select(*(safe_cell(F.col(c)).alias(c) for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """One header per file; an empty result still gives a file with it."""
    safe = safe_cells(df)
    (safe.coalesce(1) if safe.isEmpty() else safe).write.mode("overwrite").option("header", True).csv(path)


def ical_event(uid: Column, due: Column, obligor: Column, action: Column, section: Column, deadline: Column, condition: Column) -> Column:
    """One VEVENT; the id is given, so that the same obligations give the same calendar."""
    day = F.date_format(due, "yyyyMMdd")
    text = lambda c: ical_text(F.coalesce(c, F.lit("")))
    more = F.when(F.length(condition) > 0, F.concat(F.lit("Condition: "), text(condition), F.lit("\\n"))).otherwise("")
    return F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), uid),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), day),
        F.concat(F.lit("DTEND;VALUE=DATE:"), day),
        F.concat(F.lit("SUMMARY:"), ical_text(F.concat(F.coalesce(obligor, F.lit("")), F.lit(": "), F.substring(F.coalesce(action, F.lit("")), 1, 60)))),
        F.concat(F.lit("DESCRIPTION:Section: "), text(section), F.lit("\\nDeadline: "), text(deadline), F.lit("\\n"), more),
        F.lit("END:VEVENT"),
    )


def ical(events: DataFrame, by: str, order: str, event: str, name: str = "Obligations") -> DataFrame:
    """(by, calendar): one calendar for each document from its events."""
    head = F.lit(f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//lexloom//EN\r\nX-WR-CALNAME:{name}\r\nCALSCALE:GREGORIAN\r\nMETHOD:PUBLISH")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, event))), lambda x: x[event]), "\r\n")
    return events.groupBy(by).agg(F.concat(head, F.lit("\r\n"), body, F.lit("\r\nEND:VCALENDAR")).alias("calendar"))


AUDIT_SCHEMA = "event_id string, ts timestamp, event_type string, document_id string, user_id string, fields array<string>, confidence double, metadata string"


def append_audit(events: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Append events; with the known ones given, those already there are left out, so a retry adds nothing twice."""
    new = events if known is None else events.join(known.select("event_id"), "event_id", "left_anti")
    new.dropDuplicates(["event_id"]).write.mode("append").json(path)


def read_audit(spark, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


# ---- workbooks ------------------------------------------------------------------------------------------------------

#: Rows that one sheet of the format can hold.
SHEET_ROWS = 1_048_576
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _sheet(columns: list[str], rows) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, int | float) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f"<c><v>{v!r}</v></c>"
        plain = "".join(c for c in str(v) if c in "\t\n\r" or ord(c) >= 32)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(plain)}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [columns, *rows])
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_SHEET}"><sheetData>{lines}</sheetData></worksheet>'


def sheet_names(names: list[str]) -> list[str]:
    """At most 31 characters, none that the format forbids, all different."""
    out: list[str] = []
    for n in names:
        base, k = re.sub(r"[\[\]:*?/\\]", "_", n)[:31] or "Sheet", 1
        name = base
        while name.lower() in {o.lower() for o in out}:
            k += 1
            name = f"{base[: 31 - len(str(k)) - 1]}~{k}"
        out.append(name)
    return out


def write_excel(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each frame, texts safe from formulas. The file is written by the driver, so a frame of more rows than
    a sheet holds raises ValueError; summaries are aggregated before, where the data are."""
    names = sheet_names(list(sheets))
    pages = []
    for df in sheets.values():
        kinds = dict(df.dtypes)
        safe = df.select(*(safe_cell(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns)).limit(SHEET_ROWS)
        rows = safe.collect()
        if len(rows) >= SHEET_ROWS:
            raise ValueError(f"more than {SHEET_ROWS - 1} rows for a sheet")
        pages.append(_sheet(df.columns, rows))
    n = range(1, len(pages) + 1)
    book = "".join(f'<sheet name={quoteattr(x)} sheetId="{i}" r:id="r{i}"/>' for i, x in zip(n, names, strict=True))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_SHEET}" xmlns:r="{_REL}"><sheets>{book}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, page in zip(n, pages, strict=True):
            z.writestr(f"xl/worksheets/sheet{i}.xml", page)


def contract_summary(documents: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row per document (doc, ...) with the number of its rows in each part (doc, ...)."""
    out = documents
    for name, df in parts.items():
        out = out.join(df.groupBy("doc").agg(F.count("*").alias(name)), "doc", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


# ---- audit events ---------------------------------------------------------------------------------------------------


def audit_events(df: DataFrame, event_type: str, document_id: Column, ts: Column, user_id: Column | None = None, fields: Column | None = None, confidence: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Events of AUDIT_SCHEMA, one per row: ingestion, extraction, review_requested, review_completed, deletion or error. The id is made of
    what the event says, so a retry makes the same event."""
    null = F.lit(None)
    cols = {"ts": ts.cast("timestamp"), "event_type": F.lit(event_type), "document_id": document_id.cast("string"), "user_id": (user_id if user_id is not None else null).cast("string"), "fields": (fields if fields is not None else null).cast("array<string>"), "confidence": (confidence if confidence is not None else null).cast("double"), "metadata": (metadata if metadata is not None else null).cast("string")}
    rows = df.select(*(c.alias(n) for n, c in cols.items()))
    return rows.select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("event_id"), *cols)
