"""Reading a directory of articles: files, text, front matter; what can't be read goes to a quarantine."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "markdown", "txt", "rst", "pdf")
META = "struct<id: string, title: string, category: string, language: string, questions: array<string>, keywords: array<string>, source_name: string, source_url: string>"
READ = f"path string, text string, hash string, meta {META}, reason string"
_FIELDS = {"id": "id", "title": "title", "category": "category", "language": "language", "sourceName": "source_name", "sourceUrl": "source_url"}
_LISTS = {"questions": "questions", "keywords": "keywords"}


def split_front_matter(text: str) -> tuple[dict | None, str]:
    """``(meta, body)``; meta is None and the text untouched without a leading block. Raises ValueError on a bad block."""
    import yaml

    plain = text.replace("\r\n", "\n").removeprefix("﻿")
    if not plain.startswith("---\n"):
        return None, text
    head, closed, tail = plain[4:].partition("\n---")
    if not closed:
        raise ValueError("front matter: no closing line")
    rest, _, body = tail.partition("\n")
    if rest.strip():
        raise ValueError("front matter: text after the closing ---")
    try:
        values = yaml.safe_load(head)
    except yaml.YAMLError as e:
        raise ValueError(f"front matter: {e}") from e
    if values is None:
        values = {}
    if not isinstance(values, dict):
        raise ValueError("front matter: not a mapping")
    meta: dict = {}
    for key, name in _FIELDS.items():
        value = values.get(key)
        if isinstance(value, list | dict):
            raise ValueError(f"front matter: {key} must be a text")
        meta[name] = "" if value is None else str(value)
    for key, name in _LISTS.items():
        value = values.get(key) or []
        if not isinstance(value, list) or any(isinstance(v, list | dict) for v in value):
            raise ValueError(f"front matter: {key} must be a list of texts")
        meta[name] = ["" if v is None else str(v) for v in value]
    return meta, body


def pdf_text(content: bytes) -> str:
    """Text of a PDF by the pdftotext program; pages are parted by blank lines."""
    if not shutil.which("pdftotext"):
        raise ValueError("pdftotext is not installed")
    done = subprocess.run(["pdftotext", "-enc", "UTF-8", "-layout", "-", "-"], input=content, capture_output=True)
    if done.returncode:
        raise ValueError(f"pdftotext: {done.stderr[:300].decode(errors='replace')}")
    return done.stdout.decode("utf-8").replace("\f", "\n\n")


def _read(path: str, content: bytes) -> tuple[str | None, dict | None, str | None]:
    try:
        text = pdf_text(content) if path.lower().endswith(".pdf") else content.decode("utf-8")
    except UnicodeDecodeError:
        return None, None, "not valid UTF-8"
    except ValueError as e:
        return None, None, str(e)
    try:
        meta, body = split_front_matter(text)
    except ValueError as e:
        return None, None, str(e)
    return body, meta, None


def scan(spark: SparkSession, directory: str) -> DataFrame:
    """(path, text, hash, meta, reason) of all supported files below ``directory``; reason is set where a file can't be read.

    Paths are relative with ``/``. Files in hidden directories are skipped. The hash is the SHA-256 of the raw bytes.
    Spark's file listing also leaves out names that begin with ``_`` or ``.``.
    """
    root = os.path.abspath(directory).rstrip("/") if "://" not in directory else directory.rstrip("/")
    wanted = rf"(?i)\.({'|'.join(EXTENSIONS)})$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", rf"^(?:[a-z0-9+]+:/*)?\Q{root.split('://')[-1].lstrip('/')}\E/", "")
    listed = files.where(F.col("path").rlike(wanted)).select(relative.alias("path"), "content").where(~F.col("path").rlike(r"(^|/)\.[^/]*/"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [_read(p, c) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame({"path": batch["path"], "text": [r[0] for r in read], "hash": batch["hash"], "meta": [r[1] for r in read], "reason": [r[2] for r in read]})

    return listed.withColumn("hash", F.sha2("content", 256)).mapInPandas(run, READ)


def readable(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("reason").isNull()).drop("reason")


def skipped(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("reason").isNotNull()).select("path", "reason")
