"""Readers: records, texts, uploads and side tables, always with an explicit schema."""

from __future__ import annotations

import importlib
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import upload_errors

PERSON = "array<struct<name:string,role:string,description:string>>"
#: The schema of a record; ``download_url`` and ``validation`` may be missing from a file.
RECORD = (
    "schema_version string, source struct<pdf_path:string,file_name:string,page_count:int,text_extraction_engine:string,download_url:string>, "
    "parser struct<status:string,warnings:array<string>,failed_extractors:array<string>>, "
    "document struct<document_type:string,case_type:string,case_number:string,related_case_numbers:array<string>,title:string,decision_date:string,decision_date_raw:string,summary:string>, "
    "sections array<struct<heading:string,slug:string,text:string,start_line:int,end_line:int>>, "
    f"parties struct<applicants:{PERSON},legal_counsels:{PERSON},respondents:{PERSON},experts:{PERSON},witnesses:{PERSON},amicus_curiae:{PERSON}>, "
    "legal_basis struct<object_of_review:array<string>,constitutional_articles:array<string>,procedural_articles:array<string>,evidence:array<string>>, "
    "proceedings array<string>, outcome struct<decision_type:string,dictum:array<string>,summary:string>, adjudicators struct<judges:array<string>,clerks:array<string>>, "
    "relations struct<joined_cases:array<string>,referenced_cases:array<string>>, "
    "validation struct<schema_errors:array<string>,business_rule_errors:array<string>,review_flags:array<string>,needs_manual_review:boolean>"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads exists."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path with all below it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_records(spark: SparkSession, path: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """Records of JSON files with ``case_id`` (the file's stem), ``file_name`` and ``path``. A missing folder gives an empty table; of a list, missing files are left out."""
    paths = [p for p in ([path] if isinstance(path, str) else path) if path_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], f"case_id string, file_name string, path string, {RECORD}")
    reader = spark.read.schema(RECORD).option("multiLine", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json")
    rows = reader.json(paths).select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("path"))
    return rows.select(F.regexp_replace("file_name", r"\.json$", "").alias("case_id"), "file_name", "path", *[c for c in rows.columns if c not in ("file_name", "path")])


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): whole JSON files as text, for checks that need to tell a missing key from a null."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file_name, path, text) of whole text or HTML files."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def input_label(path: str | Sequence[str]) -> str:
    """What a report calls its input: the folder, or that it was a list."""
    return path if isinstance(path, str) else "<explicit-list>"


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, file_name, length, hash, content) of binary files, with the SHA-256 of each. One file is taken if it has the pattern's suffix, in any case."""
    if is_file(spark, path):
        pattern = "*" if path.lower().endswith(pattern.lstrip("*").lower()) else pattern
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.sha2("content", 256).alias("hash"), "content")


def split_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and rejected ones with their errors."""
    checked = files.withColumn("errors", upload_errors(F.col("path"), F.col("length"), F.col("content")))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0).drop("content")


def pdf_texts(files: DataFrame, most_pages: int = 500) -> DataFrame:
    """(file_name, pdf_path, text, page_count, engine, error) of PDF files; pages are joined by an empty line.

    Needs ``pypdf`` or ``PyPDF2`` on the workers; the first that reads a file gives its text. A file that neither reads, that is encrypted, has more than
    ``most_pages`` pages or no text has a null text and an error, and fails nothing else.
    """
    import pandas as pd

    def one(content: bytes) -> tuple:
        error = "no PDF library"
        for engine in ("pypdf", "PyPDF2"):
            try:
                reader = importlib.import_module(engine).PdfReader(io.BytesIO(content))
                if reader.is_encrypted:
                    return None, None, engine, "encrypted"
                if len(reader.pages) > most_pages:
                    return None, len(reader.pages), engine, "too many pages"
                text = "\n\n".join(page.extract_text() or "" for page in reader.pages)
                return (text, len(reader.pages), engine, None) if text.strip() else (None, len(reader.pages), engine, "no text")
            except ImportError:
                continue
            except Exception as failure:  # noqa: BLE001 - a broken file can raise anything
                error = f"unreadable: {failure}"
        return None, None, None, error

    @F.pandas_udf("struct<text:string,page_count:int,engine:string,error:string>")
    def extract(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(c) for c in contents], columns=["text", "page_count", "engine", "error"]).astype({"page_count": "Int32"})

    return files.select("file_name", F.col("path").alias("pdf_path"), extract("content").alias("p")).select("file_name", "pdf_path", "p.*")


def keyed_json(spark: SparkSession, path: str, value_schema: str, key: str = "case_number") -> DataFrame:
    """Rows of a JSON file that holds one object of key -> value."""
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias(key, "v"))
    return entries.select(key, "v.*")


def listed_json(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """(file, idx, ...) of JSON files that hold a list of objects, in order."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.select("file", F.posexplode(F.from_json("value", f"array<struct<{row_schema}>>")).alias("idx", "v")).select("file", "idx", "v.*")
