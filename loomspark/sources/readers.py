"""Readers of raw records: CSV, workbook, JSON, text; and of stored tables."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from .mapping import FILE, ROW

XML = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def numbered(df: DataFrame) -> DataFrame:
    """Adds the file's name and a row number that follows the file's order."""
    return df.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias(FILE), F.monotonically_increasing_id().alias(ROW)).withColumn(ROW, F.col(ROW) + 1)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every column as text; values are cast by the mapping, so no pass infers types."""
    return numbered(spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False, **options).csv(path))


def read_json(spark: SparkSession, path: str, multi_line: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """An array of records, or lines with multi_line=False (which can be split over tasks)."""
    reader = spark.read.option("multiLine", multi_line)
    return numbered((reader.schema(schema) if schema else reader).json(path))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One document a file: title (the file's stem) and raw_text."""
    df = numbered(spark.read.text(path, wholetext=True))
    return df.select(F.regexp_replace(FILE, r"\.[^.]*$", "").alias("title"), F.col("value").alias("raw_text"), FILE, ROW)


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """The first sheet's rows as text, from the workbook's XML."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{XML}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{XML}si")]
        dates = _date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for row in ElementTree.fromstring(z.read(first)).iter(f"{XML}row"):
            out: list[str | None] = []
            for cell in row.iter(f"{XML}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(out)
                out += [None] * (at - len(out))
                out.append(_value(cell, shared, dates))
            yield out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(data: bytes) -> set[int]:
    """Numbers of the cell styles that show dates."""
    root = ElementTree.fromstring(data)
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{XML}numFmt")}
    ids = [int(x.get("numFmtId", 0)) for x in next(root.iter(f"{XML}cellXfs"), ())]
    return {k for k, n in enumerate(ids) if 14 <= n <= 22 or re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")), re.I)}


def _value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind, v = cell.get("t"), cell.find(f"{XML}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{XML}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    if kind is None and int(cell.get("s", 0)) in dates:
        import datetime

        return (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(v.text))).isoformat(sep=" ", timespec="seconds")
    return v.text


class WorkbookSource(DataSource):
    """Format `workbook`: the first sheet of one .xlsx file, the first row its header."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def rows(self) -> Iterator[list[str | None]]:
        with open(self.options["path"], "rb") as f:
            yield from sheet_rows(f.read())

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(h or f"column_{k}", T.StringType()) for k, h in enumerate(next(self.rows(), []))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        source, width = self, len(schema.fields)

        class Reader(DataSourceReader):
            def read(self, partition) -> Iterator[tuple]:
                rows = source.rows()
                next(rows, None)
                for r in rows:
                    if any(v not in (None, "") for v in r):
                        yield tuple((r + [None] * width)[:width])

        return Reader()


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of .xlsx files (one or many), through Spark's binary reader, so any store that Spark reads will do."""
    files = spark.read.format("binaryFile").load(path)
    head = files.select("content").orderBy("path").first()
    names = [h or f"column_{k}" for k, h in enumerate(next(sheet_rows(bytes(head["content"])), []))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())])

    def parsed(batches):
        import pandas as pd

        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                rows = sheet_rows(bytes(content))
                own = next(rows, [])
                at = [own.index(n) if n in own else None for n in names]
                out = [[r[k] if k is not None and k < len(r) else None for k in at] + [os.path.basename(file), n + 1] for n, r in enumerate(x for x in rows if any(v not in (None, "") for v in x))]
                yield pd.DataFrame(out, columns=schema.names)

    return files.select("path", "content").mapInPandas(parsed, schema)


READERS = {".csv": read_csv, ".json": read_json, ".txt": read_text, ".xlsx": read_workbook}


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Raw records of a file or folder, by its suffix; ValueError for others (.xls among them)."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported source type: {suffix or path}")
    return READERS[suffix](spark, path, **options)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary from JSON lines or Parquet."""
    from ..schemas import DICTIONARY

    return spark.read.schema(DICTIONARY).json(path) if path.endswith((".json", ".jsonl")) else spark.read.schema(DICTIONARY).parquet(path)


def read_term_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A lexicon file as entries: one term a line, or term<tab>target [target ...]; equal terms count once whatever their case."""
    from ..schemas import DICTIONARY

    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim(F.get(parts, F.lit(0))).alias("source"), F.explode_outer(F.split(F.get(parts, F.lit(1)), " ")).alias("target"))
    once = rows.groupBy(F.lower("source").alias("k"), "target").agg(F.min("source").alias("source"))
    made = {"id": F.concat(F.lit(f"{kind}-"), F.sha2(F.concat_ws("\t", "source", "target"), 256).substr(1, 12)), "kind": F.lit(kind), "collection": F.lit("builtin"), "table_id": F.lit(kind), "source": F.col("source"), "target": F.when(F.trim("target") != "", F.trim("target")), "enabled": F.lit(True), "hits": F.lit(0), "ordinal": F.xxhash64("source", "target")}
    return once.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DICTIONARY.fields))


def stopwords(spark: SparkSession, language: str = "english") -> DataFrame:
    """Spark's own stop words as dictionary entries."""
    from pyspark.ml.feature import StopWordsRemover

    from ..operators.dictionary import entries

    words = sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords(language)})
    return entries(spark, [("stopwords", w, None) for w in words])
