"""Scans of documents in files, and of lines of JSON."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest upload, largest ratio of a packed file.
MOST_BYTES, MOST_RATIO = 20_000_000, 100

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs and table cells in body order, white space squeezed, first occurrence of each line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    seen: dict[str, None] = {}
    for part in body if body is not None else ():
        for p in [part] if part.tag == f"{_W}p" else part.iter(f"{_W}p"):
            line = re.sub(r"\s+", " ", "".join(t.text or "" for t in p.iter(f"{_W}t"))).strip()
            if line:
                seen.setdefault(line)
    return "\n".join(seen)


def _kind(path: Column, content: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    magic = F.hex(F.substring(content, 1, 4))
    return F.when((ext == "docx") & (magic == "504B0304"), "docx").when(ext.isin("txt", "md"), "text").otherwise("unsupported")


def read_documents(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files under ``path`` to (path, kind, text, reject_reason): txt, md and docx; others are rejected with a reason.

    Scans of images and PDF need models or libraries that are no part of this engine;
    ``parse_with`` takes such a function.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("struct<text:string,reason:string>")
    def parse(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for k, c in zip(kind, content, strict=True):
            try:
                if k == "docx":
                    with zipfile.ZipFile(io.BytesIO(c)) as z:
                        big = sum(i.file_size for i in z.infolist()) > MOST_RATIO * max(1, len(c))
                    out.append((None, "packed too tightly") if big else (docx_text(c), None))
                else:
                    out.append((c.decode("utf-8", errors="ignore"), None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                out.append((None, f"unreadable: {type(e).__name__}"))
        return pd.DataFrame(out, columns=["text", "reason"])

    rows = files.select("path", "length", _kind(F.col("path"), F.col("content")).alias("kind"), "content")
    bad = F.when(F.col("length") > most_bytes, "too large").when(F.col("kind") == "unsupported", "unsupported type")
    good = rows.where(bad.isNull()).withColumn("x", parse("kind", "content")).select("path", "kind", F.col("x.text").alias("text"), F.col("x.reason").alias("reject_reason"))
    return good.unionByName(rows.where(bad.isNotNull()).select("path", "kind", F.lit(None).cast("string").alias("text"), bad.alias("reject_reason")))


def parse_with(files: DataFrame, parser, kind: str) -> DataFrame:
    """A hook: ``parser`` (bytes to text) for one kind of file, batch by batch."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(parser)

    return files.where(F.col("kind") == kind).withColumn("text", run("content"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON, all fields as strings; missing ones empty."""
    fields = ("id", "scenario", "industry", "query", "cv_text", "jd_text")
    schema = ", ".join(f"{f} string" for f in fields)
    return spark.read.schema(schema).json(path).select(*[F.coalesce(f, F.lit("")).alias(f) for f in fields])


def first_source(*columns: str) -> Column:
    """The first filled of several sources."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns], F.lit(""))


def merge_fetched(fetched: Column, own: Column) -> Column:
    """Inline text first, then the fetched page, each under its title; either alone as it is."""
    f, o = F.trim(F.coalesce(fetched, F.lit(""))), F.trim(F.coalesce(own, F.lit("")))
    both = F.concat(F.lit("【用户补充的岗位信息（优先）】\n"), o, F.lit("\n\n【链接页面正文（仅作补充）】\n"), f)
    return F.when((f != "") & (o != ""), both).otherwise(F.concat(o, f))
