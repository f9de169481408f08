"""What tables in plain folders need of a file system: listing, renaming, and creating a file only if it isn't there."""

from __future__ import annotations

import os
import urllib.parse
import uuid

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def local_path(path: str) -> str | None:
    """The plain path of a ``file:`` address or of one without a scheme; None for other stores."""
    address = urllib.parse.urlsplit(path)
    return urllib.parse.unquote(address.path) if address.scheme == "file" else path if not address.scheme else None


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, where = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers n of the names ``<prefix>n`` in a folder, ascending."""
    return sorted(int(n[len(prefix) :].split("-")[0]) for n in names_in(spark, path) if n.startswith(prefix) and n[len(prefix) :].split("-")[0].isdigit())


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to a place that doesn't exist yet; its parents are made."""
    fs, where = _hadoop(spark, target)
    if fs.exists(where):
        raise FileExistsError(target)
    fs.mkdirs(where.getParent())
    if not fs.rename(_hadoop(spark, source)[1], where):
        raise OSError(f"{source} could not be renamed to {target}")


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text unless it exists; whether it was created. Of several writers exactly one succeeds, and readers see all of the text or nothing.

    The text is written beside the place and linked (local folders) or renamed without overwriting (others) into it.
    """
    folder, _, name = path.rpartition("/")
    beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    plain = local_path(path)
    if plain is not None:
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        with open(own := local_path(beside), "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, plain)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    jvm = spark.sparkContext._jvm
    fs, where = _hadoop(spark, beside)
    fs.mkdirs(where.getParent())
    out = fs.create(where, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(where, _hadoop(spark, path)[1], options)
    except Exception as failure:
        fs.delete(where, False)
        if fs.exists(_hadoop(spark, path)[1]):
            return False
        raise failure
    return True


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, where = _hadoop(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
