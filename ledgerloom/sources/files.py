"""Files that Spark's readers don't split as needed: statements as CSV or XLSX, and vCards. One small file is one row until it is parsed."""

from __future__ import annotations

import io
import zipfile
import zlib
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import let, nullif_empty, trimmed


def parse_csv(text: str) -> list[list[str]]:
    """Rows of cells. A quote opens or closes a quoted stretch wherever it stands; carriage returns outside go; blank lines go."""
    rows, row, cell = [], [], []
    stretches = text.split('"')  # every other one is quoted
    for k, part in enumerate(stretches):
        if k % 2:
            cell.append(part)
        elif not part and 0 < k < len(stretches) - 1:
            cell.append('"')  # two quotes in a row within a quoted stretch
        else:
            for n, line in enumerate(part.replace("\r", "").split("\n")):
                if n:
                    rows.append([*row, "".join(cell)])
                    row, cell = [], []
                first, *others = line.split(",")
                cell.append(first)
                for other in others:
                    row.append("".join(cell))
                    cell = [other]
    if any(cell) or row:
        rows.append([*row, "".join(cell)])
    return [r for r in rows if len(r) > 1 or r[0].strip()]


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_xlsx(data: bytes) -> list[list[str]]:
    """Cells of the first sheet as text, missing ones empty; cells styled as dates become yyyy-mm-dd, formulas their results."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        read = lambda name: ElementTree.fromstring(z.read(name))
        joined = lambda node: "".join(t.text or "" for t in node.iter(f"{_SHEET}t"))
        shared = [joined(s) for s in read("xl/sharedStrings.xml").iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        dates = set()
        if "xl/styles.xml" in z.namelist():
            styles = read("xl/styles.xml")
            own = {int(n.get("numFmtId")) for n in styles.iter(f"{_SHEET}numFmt") if any(x in n.get("formatCode").lower() for x in ("yy", "dd", "mmm"))}
            formats = styles.find(f"{_SHEET}cellXfs")
            dates = {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in own | set(range(14, 23))}
        sheet, rows = read(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))), []
        for line in sheet.iter(f"{_SHEET}row"):
            row: list[str] = []
            for c in line.iter(f"{_SHEET}c"):
                place = 0
                for letter in filter(str.isalpha, c.get("r", "")):
                    place = place * 26 + ord(letter) - 64
                row += [""] * (place - 1 - len(row))
                value = c.find(f"{_SHEET}v")
                text = "" if value is None else value.text or ""
                if c.get("t") == "s":
                    text = shared[int(text)]
                elif c.get("t") == "inlineStr":
                    text = joined(c)
                elif text and int(c.get("s", 0)) in dates:
                    text = (pd.Timestamp("1899-12-30") + pd.Timedelta(days=float(text))).strftime("%Y-%m-%d")
                row.append(text)
            rows.append(row)
        return [r for r in rows if any(x.strip() for x in r)]


def _exploded(files: DataFrame, cells: Column) -> DataFrame:
    return files.select("file", F.posexplode(cells).alias("row_index", "cells"))


#: Stands before a digit that tells what a quoted stretch has there, so that the stretch may be split like the rest.
_MARK = "\x01"
_QUOTED = {_MARK: "0", ",": "1", "\n": "2", "\r": "3"}


def _csv_cells(value: Column) -> Column:
    """`parse_csv` as an expression, so that no file leaves Spark's own memory: outside quotes lines and commas split; what a quoted
    stretch has of them is marked before, and put back cell by cell."""
    marked = lambda t, chars: reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(_MARK + _QUOTED[c])), chars, t)
    bare = lambda t: F.replace(marked(t, [_MARK]), F.lit("\r"), F.lit(""))
    stretches = F.split(value, '"', -1)
    joined = let(stretches, lambda all_: F.array_join(F.transform(all_, lambda t, k: F.when(k % 2 == 1, marked(t, _QUOTED)).when((t == "") & (k > 0) & (k < F.size(all_) - 1), '"').otherwise(bare(t))), ""))
    text = F.when(value.contains('"'), joined).otherwise(bare(value))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.contains(",") | ~line.rlike(r"(?U)\A(?:[\s\x1c-\x1f]|\x01[23])*+\z"))
    back = lambda t: reduce(lambda t, c: F.replace(t, F.lit(_MARK + _QUOTED[c]), F.lit(c)), reversed(_QUOTED), t)
    return F.transform(lines, lambda line: F.transform(F.split(line, ",", -1), lambda c: F.when(c.contains(_MARK), back(c)).otherwise(c)))


def statement_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_index, cells) of the CSV files at path; rows may differ in length."""
    return csv_rows(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def csv_rows(texts: DataFrame) -> DataFrame:
    """The same for a table (file, value) of whole texts."""
    return _exploded(texts, _csv_cells(F.col("value")))


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, cells) of the workbooks at path; cells are null where a file can't be read, so that it doesn't stop the others.

    Spark's reader leaves out files of no octets.
    """

    def cells(data: bytes) -> list[list[str]] | None:
        try:
            return parse_xlsx(bytes(data))
        except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, LookupError, ValueError, OverflowError, EOFError):
            return None

    rows = F.pandas_udf(lambda column: column.map(cells), "array<array<string>>")
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), rows("content").alias("cells"))


def statement_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_index, cells) of the workbooks that can be read; `unreadable` names the others."""
    return _exploded(workbooks(spark, path), F.col("cells"))


def unreadable(books: DataFrame) -> DataFrame:
    """(file) of those of `workbooks` to be looked at by hand or tried again."""
    return books.filter("cells IS NULL").select("file")


def _unescaped(v: Column) -> Column:
    v = F.regexp_replace(v, r"(?i)\\n", "\n")
    for mark in (",", ";", "\\"):
        v = F.replace(v, F.lit("\\" + mark), F.lit(mark))
    return F.trim(v)


def all_cards(texts: DataFrame) -> DataFrame:
    """(file, nth, name, phones, emails) of every vCard in a table (file, value); the name is null where a card has none.

    Folded lines are joined; the name is FN, or else given, middle and family name of N.
    """
    unfolded = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\n[ \t]", "")
    bodies = F.regexp_extract_all(unfolded, F.lit(r"(?ims)^[ \t]*BEGIN:VCARD[ \t]*$((?:(?!^[ \t]*BEGIN:VCARD[ \t]*$).)*?)^[ \t]*END:VCARD[ \t]*$"), F.lit(1))
    df = texts.select("file", F.posexplode(bodies).alias("nth", "body"))
    lines = F.filter(trimmed(F.split("body", "\n")), lambda x: x.contains(":"))
    split = r"\A((?:\\.|[^:\\])*):(.*)\z"
    fields = F.transform(lines, lambda x: F.struct(F.upper(F.substring_index(F.call_function("regexp_extract", x, F.lit(split), F.lit(1)), ";", 1)).alias("k"), _unescaped(F.call_function("regexp_extract", x, F.lit(split), F.lit(2))).alias("v")))
    df = df.withColumn("fields", F.filter(fields, lambda f: f["v"] != ""))
    values = lambda key: F.transform(F.filter("fields", lambda f: f["k"] == key), lambda f: f["v"])
    last = lambda key: F.try_element_at(values(key), F.lit(-1))
    parts = trimmed(F.split(last("N"), ";"))
    from_n = F.array_join(F.filter(F.array(*[F.get(parts, F.lit(i)) for i in (1, 2, 0)]), lambda p: p.isNotNull() & (p != "")), " ")
    return df.select("file", "nth", F.coalesce(last("FN"), nullif_empty(F.trim(from_n))).alias("name"), values("TEL").alias("phones"), values("EMAIL").alias("emails"))


def cards(texts: DataFrame) -> DataFrame:
    """`all_cards` but for those without a name."""
    return all_cards(texts).filter("name IS NOT NULL")


def vcards(spark: SparkSession, path: str) -> DataFrame:
    return cards(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))
