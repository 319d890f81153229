"""Workbooks, text documents and slides as rows: one file is read by one task, with any file system that Spark reads.

Workbook sheets become records by their header row; documents and slides become ordered anchors (blocks and slides). PDF
files need a parser that is not here. A broken file gives no rows but its error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.tables import bounded_batches

#: bytes of a file, unpacked, that are read; a larger one is an error (packed files may hold far more than they are)
MOST_BYTES = 512 << 20


def _name(element) -> str:
    return element.tag.rpartition("}")[2]


def _open(content: bytes) -> zipfile.ZipFile:
    whole = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in whole.infolist()) > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes unpacked")
    return whole


def _xml(whole: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(whole.read(name)) if name in whole.namelist() else None


def _targets(whole: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Parts that a part refers to, by the id of the reference."""
    folder, _, name = part.rpartition("/")
    root = _xml(whole, f"{folder}/_rels/{name}.rels")
    found = {}
    for r in root if root is not None else ():
        steps: list[str] = [] if r.get("Target", "").startswith("/") else folder.split("/")
        for step in r.get("Target", "").strip("/").split("/"):
            steps = steps[:-1] if step == ".." else [*steps, step]
        found[r.get("Id")] = "/".join(steps)
    return found


def _reference(element) -> str | None:
    return next((v for k, v in element.attrib.items() if k.endswith("}id")), None)


def _column(cell: str) -> int:
    number = 0
    for c in re.match("[A-Z]*", cell)[0]:
        number = number * 26 + ord(c) - 64
    return number - 1


def read_sheets(content: bytes) -> list[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells as texts) of the rows of a workbook that hold anything."""
    whole, out = _open(content), []
    shared = _xml(whole, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in item.iter() if _name(t) == "t") for item in shared] if shared is not None else []
    targets = _targets(whole, "xl/workbook.xml")
    for sheet in (e for e in _xml(whole, "xl/workbook.xml").iter() if _name(e) == "sheet"):
        root = _xml(whole, targets.get(_reference(sheet), ""))
        for at, row in enumerate(e for e in (root.iter() if root is not None else ()) if _name(e) == "row"):
            cells: list[str | None] = []
            for k, cell in enumerate(c for c in row if _name(c) == "c"):
                place = _column(cell.get("r", "")) if cell.get("r") else k
                value = next((v.text for v in cell if _name(v) == "v"), None)
                if cell.get("t") == "s" and value is not None:
                    value = strings[int(value)]
                elif cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter() if _name(t) == "t")
                elif cell.get("t") == "b" and value is not None:
                    value = str(value == "1")
                cells += [None] * (place + 1 - len(cells))
                cells[place] = value
            if any(c is not None for c in cells):
                out.append((sheet.get("name", ""), int(row.get("r") or at + 1), cells))
    return out


def _paragraph(element) -> str:
    """Text of a paragraph, with its breaks and tabs."""
    return "".join({"t": e.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(_name(e), "") for e in element.iter())


def _table(element) -> str:
    """Rows of a table, one a line, cells parted by a bar."""
    inside = lambda e, name: [x for x in e if _name(x) == name]
    cell = lambda c: "\n".join(_paragraph(p) for p in c.iter() if _name(p) == "p").strip()
    return "\n".join(" | ".join(cell(c) for c in inside(row, "tc")) for row in inside(element, "tr"))


def _document(whole: zipfile.ZipFile) -> list[str]:
    body = next(iter(_xml(whole, "word/document.xml")))
    texts = (_paragraph(e) if _name(e) == "p" else _table(e) for e in body if _name(e) in ("p", "tbl"))
    return [t for t in (t.strip() for t in texts) if t]


def _shapes(element) -> Iterator[str]:
    """Texts of the shapes, groups and tables of a slide, in order."""
    for e in element:
        if _name(e) == "txBody":
            yield "\n".join(_paragraph(p) for p in e if _name(p) == "p")
        elif _name(e) == "tbl":
            yield _table(e)
        else:
            yield from _shapes(e)


def _slides(whole: zipfile.ZipFile) -> list[str]:
    targets, out = _targets(whole, "ppt/presentation.xml"), []
    for slide in (e for e in _xml(whole, "ppt/presentation.xml").iter() if _name(e) == "sldId"):
        part = targets[_reference(slide)]
        notes = [p for p in _targets(whole, part).values() if "notesSlide" in p]
        parts = [t for p in (part, *notes) if p in whole.namelist() for t in _shapes(_xml(whole, p))]
        out.append("\n".join(t for t in (t.strip() for t in parts) if t))
    return out


def read_anchors(content: bytes) -> tuple[str, list[str]]:
    """(kind, texts of its anchors in order): the blocks of a document that are not empty, or all slides."""
    whole = _open(content)
    if "word/document.xml" in whole.namelist():
        return "docx", _document(whole)
    if "ppt/presentation.xml" in whole.namelist():
        return "pptx", _slides(whole)
    raise ValueError("neither a document nor slides")


def _files(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells, error) of all workbooks in a folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for of, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(of, *r, None) for r in read_sheets(content)]
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, IndexError, AttributeError) as bad:
                    rows = [(of, None, None, None, f"{type(bad).__name__}: {bad}")]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells", "error"])

    return _files(spark, path).mapInPandas(run, "path string, sheet string, row int, cells array<string>, error string")


def sheet_records(rows: DataFrame, sheet: str) -> DataFrame:
    """(path, row, record) of a sheet: each row after the first by the names of the first, trimmed; a missing cell is empty."""
    named = rows.where((F.col("sheet") == sheet) & F.col("cells").isNotNull())
    first = named.groupBy("path").agg(F.min_by("cells", "row").alias("_names"), F.min("row").alias("_first"))
    names = F.transform("_names", lambda n: F.trim(F.coalesce(n, F.lit(""))))
    pairs = F.transform(names, lambda n, i: F.struct(n.alias("key"), F.trim(F.coalesce(F.get("cells", i), F.lit(""))).alias("value")))
    used = F.filter(pairs, lambda p: p["key"] != "")
    distinct = F.filter(used, lambda p, i: F.array_position(F.transform(used, lambda q: q["key"]), p["key"]) == i + 1)
    return named.join(first, "path").where("row > _first").select("path", "row", F.map_from_entries(distinct).alias("record"))


# Names of the columns of a sheet of sources, of its sheets of directions and their keywords.
SOURCE_COLUMNS = {"group": "Группа", "name": "Источник", "type": "Тип", "url": "Ссылка", "rating": "Рейтинг источника", "frequency": "Частота мониторинга", "role": "Роль в дайджесте", "directions": "Покрываемые направления"}


def source_seeds(records: DataFrame) -> DataFrame:
    """Sources (name, source_type, url, enabled, parse_strategy, category, update_frequency, priority) of the records of a sheet; of one name the last row."""
    cell = lambda key: F.nullif(F.coalesce(F.element_at("record", SOURCE_COLUMNS[key]), F.lit("")), F.lit(""))
    url = F.when(cell("url").contains("://"), cell("url")).otherwise(F.concat(F.lit("https://"), cell("url")))
    kind = F.coalesce(cell("type"), F.lit("Unknown"))
    rows = records.where(cell("name").isNotNull()).select(
        "path", "row", cell("name").alias("name"), kind.alias("source_type"), url.alias("url"), F.lit(True).alias("enabled"), F.when(F.lower(kind).startswith("telegram"), "telegram").otherwise("rss").alias("parse_strategy"),
        F.nullif(F.concat_ws(" | ", cell("group"), cell("role"), cell("directions")), F.lit("")).alias("category"), cell("frequency").alias("update_frequency"), F.coalesce(cell("rating").try_cast("double"), F.lit(1.0)).alias("priority"),
    )
    names = [c for c in rows.columns if c not in ("path", "row", "name")]
    return rows.groupBy("name").agg(F.max_by(F.struct(*names), F.struct("path", "row")).alias("s")).select("name", "s.*")


def _list(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[;\n]"), lambda v: F.trim(v)), lambda v: v != "")


def _distinct(values: Column) -> Column:
    """Each value once, whatever its case; the first spelling stays."""
    return F.filter(values, lambda v, i: F.array_position(F.transform(values, F.lower), F.lower(v)) == i + 1)


def direction_tags(directions: DataFrame, keywords: DataFrame) -> DataFrame:
    """Tags (name, name_en, description, keywords, keywords_en, sort_order) of a sheet of directions with the keywords of another."""
    cell = lambda key: F.nullif(F.coalesce(F.element_at("record", key), F.lit("")), F.lit(""))
    told = keywords.groupBy(F.element_at("record", "ID направления").alias("id")).agg(F.max_by("record", "row").alias("k"))
    rows = directions.select("path", "row", cell("ID").alias("id"), cell("Направление RU").alias("ru"), cell("Direction EN").alias("en"), cell("Что покрывает").alias("description"))
    joined = rows.where("id IS NOT NULL").join(told, "id", "left")
    return joined.select(F.coalesce("ru", "en").alias("name"), F.col("en").alias("name_en"), "description", _distinct(_list(F.element_at("k", "Ключевые слова RU"))).alias("keywords"), _distinct(_list(F.element_at("k", "Keywords EN"))).alias("keywords_en"), (F.col("row") + 8).alias("sort_order"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Tags (sort_order, name, description, keywords, keywords_en, negative_keywords) of Markdown files: "## N. Name" and bold labels with a paragraph each."""
    text = spark.read.text(path, wholetext=True).select(F.concat(F.lit("\n"), F.regexp_replace("value", "\r\n?", "\n")).alias("t"))
    parts = text.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?s)\n## (\d+\. .*?)(?=\n## \d+\. |\z)"), F.lit(1))).alias("p"))
    grab = lambda label: F.trim(F.regexp_replace(F.regexp_extract("p", rf"(?s)\*\*{label}\*\*[ \t]*\n\s*(.+?)(?=\n\n\*\*|\n\n## |\z)", 1), r"\s+", " "))
    words = lambda label: F.filter(F.transform(F.split(grab(label), ","), lambda w: F.trim(w)), lambda w: F.regexp_replace(w, "[-—– ]", "") != "")
    number, name = F.regexp_extract("p", r"^(\d+)\. ", 1).cast("int"), F.trim(F.regexp_extract("p", r"^\d+\. ([^\n]*)", 1))
    return parts.select(number.alias("sort_order"), name.alias("name"), grab("Описание для AI").alias("description"), words("Ключевые слова RU").alias("keywords"), words("Keywords EN").alias("keywords_en"), words("Стоп-слова").alias("negative_keywords"))


def seeded_tags(tags: DataFrame, seeds: DataFrame, *, retire: bool = False) -> DataFrame:
    """Tags (name, description, keywords, keywords_en, negative_keywords, sort_order, enabled) after a seed.

    A tag of the seed exists afterwards: what it has stays, and keywords are added to its own. Tags that are not in the seed stay as they
    are, or, with ``retire``, are switched off. Nothing is removed, as articles refer to tags.
    """
    lists = ["keywords", "keywords_en", "negative_keywords"]
    s = seeds.select("name", *[F.col(c).alias(f"_{c}") for c in ("description", *lists, "sort_order")], F.lit(True).alias("_seed"))
    joined = tags.join(s, "name", "full")
    none = F.array().cast("array<string>")
    merged = [_distinct(F.concat(F.coalesce(c, none), F.coalesce(f"_{c}", none))).alias(c) for c in lists]
    enabled = F.when(F.col("enabled").isNull(), True).when(F.lit(retire) & F.col("_seed").isNull(), False).otherwise(F.col("enabled"))
    return joined.select("name", F.coalesce(F.nullif("description", F.lit("")), "_description").alias("description"), *merged, F.coalesce("sort_order", "_sort_order").alias("sort_order"), enabled.alias("enabled"))


def document_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, number, text, error) of the anchors of documents and slides in a folder, numbered from 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for of, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    kind, texts = read_anchors(content)
                    rows = [(of, kind, n, t, None) for n, t in enumerate(texts, 1)]
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, StopIteration, TypeError) as bad:
                    rows = [(of, None, None, None, f"{type(bad).__name__}: {bad}")]
                yield pd.DataFrame(rows, columns=["path", "kind", "number", "text", "error"])

    return _files(spark, path).mapInPandas(run, "path string, kind string, number int, text string, error string")
