"""Archiving an inbox: files are moved to the folder of their outcome, under names that are free there, by tasks on the executors.

First the names are fixed and written down as intents; then every task moves the files of its own rows. A batch that is tried again finds its
intents, finishes what is half done, and moves nothing twice.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import path_exists

MOVES = "hash string, path string, target string, archived_path string, state string"
#: A name with a number: stem, number, suffix.
NUMBERED = r"^(.+)__(\d{1,9})(\.[^.]*)?$"


def numbered_name(name: Column, number: Column) -> Column:
    """The name itself for 1, else with ``__2``, ``__3``, ... before its suffix."""
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return F.when(number == 1, name).otherwise(F.concat(stem, F.lit("__"), number.cast("string"), suffix))


def free_names(files: DataFrame, held: DataFrame) -> DataFrame:
    """Files (target, file_name, path, ..) with ``archived_name``: the first of the name, ``name__2``, ``name__3``, ... that is free in the target.

    ``held`` has (target, file_name) of what the targets hold. Files of one name take free names in the order of their paths; a name that another file of the
    batch has as its own isn't free.
    """
    own = files.select("target", "file_name").distinct()
    names = held.select("target", "file_name").union(own)
    number, stem = F.regexp_extract("file_name", NUMBERED, 2), F.concat(F.regexp_extract("file_name", NUMBERED, 1), F.regexp_extract("file_name", NUMBERED, 3))
    used = names.where(number != "").select("target", stem.alias("file_name"), number.cast("long").alias("k")).where("k > 1").union(held.select("target", "file_name", F.lit(1).cast("long")))
    taken = used.join(own, ["target", "file_name"], "left_semi").groupBy("target", "file_name").agg(F.sort_array(F.collect_set("k")).alias("_taken"))
    rows = files.withColumn("_j", F.row_number().over(Window.partitionBy("target", "file_name").orderBy("path")).cast("long")).join(taken, ["target", "file_name"], "left")
    # Of sorted taken numbers t1, t2, ..., those with ti - i < j come before the j-th free one.
    before = F.size(F.filter(F.coalesce("_taken", F.array().cast("array<long>")), lambda t, i: t - i - 1 < F.col("_j")))
    return rows.withColumn("archived_name", numbered_name(F.col("file_name"), F.col("_j") + before)).drop("_j", "_taken")


def held_names(spark: SparkSession, targets: Mapping[str, str]) -> DataFrame:
    """(target, file_name) of the files that lie in the folders of the targets; their content isn't read."""
    out = spark.createDataFrame([], "target string, file_name string")
    for target, folder in targets.items():
        if path_exists(spark, folder):
            found = spark.read.format("binaryFile").load(folder).select(F.lit(target).alias("target"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"))
            out = out.union(found)
    return out


def address(place: str) -> str:
    """A path as an address, ``file:///..`` for plain ones: addresses have blanks and other odd characters of names escaped, as Spark gives them."""
    place = place.rstrip("/")
    return place if "://" in place else place.replace("file:", "file://", 1) if place.startswith("file:") else f"file://{urllib.parse.quote(place)}"


def _move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Move each row's file unless that is done. A rename is atomic, so of two tasks with one row one finds it done."""
    for rows in batches:
        states = []
        for source, to in zip(rows["path"], rows["archived_path"], strict=True):
            store, source = pyarrow.fs.FileSystem.from_uri(address(source))
            _, to = pyarrow.fs.FileSystem.from_uri(address(to))
            here, there = (info.type != pyarrow.fs.FileType.NotFound for info in store.get_file_info([source, to]))
            if here and not there:
                store.create_dir(to.rpartition("/")[0], recursive=True)
                try:
                    store.move(source, to)
                except FileNotFoundError:  # another try of this task was faster
                    pass
                here, there = False, store.get_file_info(to).type != pyarrow.fs.FileType.NotFound
            states.append("moved" if there and not here else "name taken" if there else "missing")
        yield rows.assign(state=states)


def fix_intents(files: DataFrame, targets: Mapping[str, str], out: str, name: str) -> DataFrame:
    """Write down where each file (hash, path, target) of a batch goes, unless that has been done; returns it as written."""
    spark, place = files.sparkSession, f"{out}/intents/batch={name}"
    targets = {target: address(folder) for target, folder in targets.items()}
    if not path_exists(spark, f"{place}/_SUCCESS"):
        folders = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
        named = free_names(files.select("hash", "path", "target", F.element_at(F.split("path", "/"), -1).alias("file_name")), held_names(spark, targets))
        named.select("hash", "path", "target", F.concat_ws("/", folders[F.col("target")], "archived_name").alias("archived_path")).write.mode("overwrite").parquet(place)
    return spark.read.schema("hash string, path string, target string, archived_path string").parquet(place)


def archive(files: DataFrame, targets: Mapping[str, str], out: str, name: str) -> DataFrame:
    """Move the files (hash, path, target) of a batch into the folders of ``targets``; returns MOVES.

    Paths and folders are addresses (``file:/..``, ``hdfs://..``) of one store that Arrow can open on the executors. ``state`` is ``moved``, ``missing`` if the file is in neither
    place, or ``name taken`` if someone else has put a file there meanwhile; nothing is overwritten.
    """
    spark, place = files.sparkSession, f"{out}/moves/batch={name}"
    intents = fix_intents(files, targets, out, name)
    intents.mapInPandas(_move, MOVES).write.mode("overwrite").parquet(place)
    return spark.read.schema(MOVES).parquet(place)


def read_moves(spark: SparkSession, out: str) -> DataFrame:
    """All moves, with the ``batch`` of each."""
    place = f"{out}/moves"
    return spark.read.schema(f"{MOVES}, batch string").parquet(place) if path_exists(spark, place) else spark.createDataFrame([], f"{MOVES}, batch string")

