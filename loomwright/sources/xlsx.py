"""Workbooks: the first sheet of .xlsx files as rows of strings, and rows as workbooks, by the standard library alone.

A workbook is one zip of XML, so it is read by one task; many workbooks are read side by side.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a sheet, its header among them.
MOST_ROWS = 1_048_576


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[list[str]]:
    """The rows of a sheet as texts, '' for an empty cell; numbers as they are written, whole ones without '.0'."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in e.iter() if _tag(t) == "t"))
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if _tag(e) != "row":
                    continue
                row: list[str] = []
                for at, c in enumerate(x for x in e if _tag(x) == "c"):
                    i = _column(c.get("r")) if c.get("r") else at
                    row += [""] * (i + 1 - len(row))
                    kind, value = c.get("t"), next((v.text or "" for v in c if _tag(v) == "v"), "")
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    row[i] = value
                yield row
                e.clear()


def read_xlsx(spark: SparkSession, path: str, columns: list[str] | None = None, typed: bool = False) -> DataFrame:
    """Rows of the first sheets of the workbooks at path, in columns by the header row, with row_idx in input order.

    All are strings and missing cells '' (typed: missing cells null and columns cast to what all their values are). A named column that is not
    there is an error. The header is that of the first workbook; others may have their columns in another order.
    """
    files = spark.read.format("binaryFile").load(path)
    first = files.orderBy("path").select("content").first()
    header = next(sheet_rows(first.content), []) if first else []
    names = columns or [h for h in header if h]
    missing = [c for c in names if c not in header]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"]):
                rows = sheet_rows(content)
                head = next(rows, [])
                at = [head.index(c) if c in head else -1 for c in names]
                part: list = []
                for n, r in enumerate(rows):
                    part.append((p, n, *[r[i] if 0 <= i < len(r) else "" for i in at]))
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=["path", "n", *map(str, range(len(names)))])
                        part = []
                yield pd.DataFrame(part, columns=["path", "n", *map(str, range(len(names)))])

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("n", T.LongType()), *[T.StructField(str(i), T.StringType()) for i in range(len(names))]])
    rows = files.select("path", "content").mapInPandas(run, schema)
    sizes = {r.path: r.n for r in rows.groupBy("path").agg(F.count("*").alias("n")).collect()}  # a row a workbook
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    start = F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n))])[F.col("path")] if before else F.lit(0)
    out = rows.select((start + F.col("n")).cast("long").alias("row_idx"), *[F.col(str(i)).alias(c) for i, c in enumerate(names)])
    if not typed:
        return out
    full = out.select("row_idx", *[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])
    fits = full.agg(*[F.struct(*[F.coalesce(F.bool_and(F.col(f"`{c}`").try_cast(k).isNotNull() | F.col(f"`{c}`").isNull()), F.lit(False)).alias(k) for k in ("bigint", "double")]).alias(f"c{i}") for i, c in enumerate(names)]).first() if names else None
    kind = lambda i: "bigint" if fits[f"c{i}"]["bigint"] else "double" if fits[f"c{i}"]["double"] else "string"
    return full.select("row_idx", *[F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(names)])


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: Characters that XML has no place for.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def _cell(v: object) -> str:
    if v is None or v != v:
        return "<c/>"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"<c><v>{v}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub("", str(v)))}</t></is></c>'


def write_xlsx(df: DataFrame, folder: str) -> None:
    """Each partition of df as one workbook, or several where it has more rows than a sheet, in a folder that all executors share; no index column."""
    names = df.columns
    Path(folder).mkdir(parents=True, exist_ok=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, part, n, z, out = TaskContext.get().partitionId(), 0, 0, None, None
        head = "<row>" + "".join(map(_cell, names)) + "</row>"

        def close() -> None:
            out.write(b"</sheetData></worksheet>")
            out.close()
            z.close()
            at = Path(folder, f"part-{task:05}-{part:03}.xlsx")
            at.with_suffix(".tmp").rename(at)  # a task that runs again replaces its workbook

        for f in frames:
            for r in f.astype(object).where(f.notna(), None).itertuples(index=False):
                if z is None:
                    z = zipfile.ZipFile(Path(folder, f"part-{task:05}-{part:03}.tmp"), "w", zipfile.ZIP_DEFLATED)
                    for name, text in _PARTS.items():
                        z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
                    out = z.open("xl/worksheets/sheet1.xml", "w")
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{head}'.encode())
                    n = 1
                out.write(("<row>" + "".join(map(_cell, r)) + "</row>").encode())
                n += 1
                if n == MOST_ROWS:
                    close()
                    part, z = part + 1, None
        if z is not None:
            close()
        yield pd.DataFrame({"n": [part]})

    df.mapInPandas(run, "n int").write.format("noop").mode("overwrite").save()
