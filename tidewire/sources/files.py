"""File sources and sinks of the newsroom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_feedback_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feedback tables with a header; rows without a comment, and those of separators alone, are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    named = rows.toDF(*[c.lstrip("﻿").strip().lower() for c in rows.columns])
    return named.where(F.trim(F.coalesce(F.col("comment"), F.lit(""))) != "")


def read_markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, cells) of the body rows of pipe tables."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    rows = lines.where(F.trim("text").rlike(r"^\|.*\|$") & ~F.trim("text").rlike(r"^\|[\s:|-]+\|$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(F.regexp_replace(c, r"[*`]", "")))
    return rows.select("file", "line", cells.alias("cells"))


def write_jsonl(frame: DataFrame, path: str) -> None:
    """One JSON object a line."""
    frame.select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def source_kind(content: Column) -> Column:
    """Kind of a document by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "ooxml").when(head.startswith("D0CF11E0"), "ole2").otherwise("unknown")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, kind) of binary documents."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), source_kind(F.col("content")).alias("kind"))
