"""Readers and writers of the formats the pipeline meets, all as distributed scans and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header as strings, empty cells as ''; a missing column is an error."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').na.fill("")
    return df.select(*columns) if columns else df


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """CSV with types inferred, blank cells as null."""
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"', nullValue="")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object a line; a bad line is an error (strict) or skipped; blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array in one file, or JSON lines, told apart by the first character."""
    first = spark.read.text(path).where(r"value rlike '\\S'").limit(1).collect()
    array = bool(first) and first[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).json(path, multiLine=array)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, columns: list[str], path: str, sep: str = "\t") -> None:
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def write_csv_bom(df: DataFrame, path: str) -> None:
    """CSV whose header starts with a byte-order mark, for spreadsheet programs."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").csv(path, header=True)


def json_array(df: DataFrame, order: str) -> DataFrame:
    """(value): the rows as one JSON array in the order of a column. The array is one value: for small results."""
    row = F.struct(F.col(order).alias("o"), F.to_json(F.struct(*df.columns)).alias("j"))
    return df.agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["j"]), ","), F.lit("]")).alias("value"))


def cached(df: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """df kept as parquet under a key of its texts: written once, read when the same texts come again.

    The key is the sum of the digests of the texts (order-free, mergeable), not a string of all of them.
    """
    spark = df.sparkSession
    s = df.agg(F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    path = f"{folder}/{name}-{s.n}-{abs(int(s.h or 0)) % (1 << 63):x}"
    try:
        return spark.read.parquet(path)
    except Exception:  # not there yet
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


class _Rows(HTMLParser):
    """The cells of table rows."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        self.cell = tag in ("td", "th") or self.cell
        if tag in ("td", "th") and self.rows:
            self.rows[-1].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.cell = False

    def handle_data(self, data: str) -> None:
        if self.cell and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def html_table_rows(pages: DataFrame, key: str, html: str, least: int = 3) -> DataFrame:
    """(key, row_no, cells): table rows of each page with at least `least` cells, trimmed."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, h in zip(f[key], f[html]):
                p = _Rows()
                p.feed(h or "")
                out += [(k, i, [c.strip() for c in r]) for i, r in enumerate(p.rows) if len(r) >= least]
            yield pd.DataFrame(out, columns=[key, "row_no", "cells"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, row_no int, cells array<string>")


class _Selected(HTMLParser):
    """Texts of the cells of rows of a class inside containers of a class."""

    def __init__(self, container: str, row: str) -> None:
        super().__init__()
        self.container, self.row = container, row
        self.depth: list[bool] = []  # open div elements: whether each is a container
        self.rows: list[list[str]] = []
        self.in_row = self.cell = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = (dict(attrs).get("class") or "").split()
        if tag == "div":
            self.depth.append(self.container in classes)
        elif tag == "tr":
            self.in_row = any(self.depth) and self.row in classes
            if self.in_row:
                self.rows.append([])
        elif tag == "td" and self.in_row:
            self.rows[-1].append("")
            self.cell = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "div" and self.depth:
            self.depth.pop()
        elif tag == "tr":
            self.in_row = self.cell = False
        elif tag == "td":
            self.cell = False

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.rows[-1][-1] += data


def html_selected_rows(pages: DataFrame, key: str, html: str, container: str = "hideable", row: str = "item", least: int = 3) -> DataFrame:
    """(key, row_no, cells): rows of class `row` inside div elements of class `container`, with at least `least` cells, trimmed."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, h in zip(f[key], f[html]):
                p = _Selected(container, row)
                p.feed(h or "")
                out += [(k, i, [c.strip() for c in r]) for i, r in enumerate(p.rows) if len(r) >= least]
            yield pd.DataFrame(out, columns=[key, "row_no", "cells"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, row_no int, cells array<string>")


def taxonomy(pages: DataFrame, html: str) -> DataFrame:
    """(code, name) of a taxonomy's headings, as `<h4>code <span>(name)</span></h4>`; of a repeated code one name."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<h4[^>]*>(.*?)</h4>"), 1)
    parts = pages.select(F.explode(found).alias("h")).select(F.regexp_extract("h", r"(?s)^\s*([^<\s]+)", 1).alias("code"), F.regexp_extract("h", r"(?s)<span[^>]*>(.*?)</span>", 1).alias("name"))
    clean = parts.where("code <> ''").select("code", F.trim(F.regexp_replace(F.trim("name"), r"^\(|\)$", "")).alias("name"))
    return clean.groupBy("code").agg(F.min("name").alias("name"))


def read_settings(text: str) -> dict:
    """Run parameters of a YAML text of nested mappings and lists of plain values, by indentation; comments and quotes go.

    Anchors, block texts and flow mappings are no run parameters here and raise an error.
    """

    def value(s: str) -> object:
        s = s.strip()
        if s and s[0] in "&*|>{":
            raise ValueError(f"not a plain value: {s}")
        if s[:1] == "[" and s[-1:] == "]":
            return [value(x) for x in s[1:-1].split(",") if x.strip()]
        if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
            return s[1:-1]
        if s.lower() in ("", "null", "~"):
            return None
        if s.lower() in ("true", "false"):
            return s.lower() == "true"
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s

    lines = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#(?=([^\"']|\"[^\"]*\"|'[^']*')*$).*$", "", raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, indent: int) -> tuple[object, int]:
        listed = lines[at][1].startswith("- ") or lines[at][1] == "-"
        out: list | dict = [] if listed else {}
        while at < len(lines) and lines[at][0] == indent:
            body = lines[at][1]
            if listed and body[:1] != "-":  # the list's own mapping goes on
                break
            if listed:
                out.append(value(body[1:]))
                at += 1
                continue
            name, mark, rest = body.partition(":")
            if not mark:
                raise ValueError(f"no mapping: {body}")
            at += 1
            if not rest.strip() and at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
                out[name.strip().strip("\"'")], at = block(at, lines[at][0])
            else:
                out[name.strip().strip("\"'")] = value(rest)
        return out, at

    if not lines:
        return {}
    got, at = block(0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"indentation: {lines[at][1]}")
    return got


def write_json_array(df: DataFrame, path: str) -> None:
    """Each partition as a file that is one JSON array, written row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for b in batches:
            lines = []
            for j in b.column(0).to_pylist():
                lines.append(lead + j)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], ["value"])

    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("j")).mapInArrow(run, "value string").write.text(path)
