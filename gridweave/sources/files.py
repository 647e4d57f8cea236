"""Manifests of drawing files, what changed since the last scan, and scan results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Table
from .store import written

c = F.col
SUFFIXES = ("pdf", "dxf", "dwg", "xlsx", "xls")


def wanted(path: Column) -> Column:
    """A drawing file: known suffix, no backup in the path, no name beginning with . or ~."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(name).rlike(r"\.(" + "|".join(SUFFIXES) + ")$") & ~F.contains(F.lower(path), F.lit("backup")) & ~name.rlike(r"^[.~]")


def drawing_of(path: Column) -> Column:
    """The file's name without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(wanted(c("path"))).withColumnRenamed("modificationTime", "modified")


def _manifest(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("drawing_id", drawing_of(c("path")))
    best = rows.groupBy("drawing_id").agg(F.max("path").alias("best"))
    return rows.join(best, "drawing_id").withColumn("duplicate_id", c("path") != c("best")).drop("best")


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Path, modified, length, sha256, drawing_id and duplicate_id of all drawing files below a folder.

    Contents are hashed where they are read and go no further.  Two files of one stem share
    a drawing_id; the greatest path is the one that counts, the others are duplicates.
    """
    return _manifest(_files(spark, folder).select("path", "modified", "length", F.sha2("content", 256).alias("sha256")))


MANIFEST = "drawing_id string, path string, modified timestamp, length long, sha256 string, duplicate_id boolean"


def rescan(spark: SparkSession, folder: str, known: Table, force: bool = False) -> DataFrame:
    """S1, S2 as an incremental source: the manifest with the status of each file, and ``known`` (MANIFEST by drawing_id) brought up to it.

    Files are listed without their contents; one that has kept its path, time and length
    keeps its hash.  Only contents of files from the oldest changed time on are read (the
    reader drops files by time), and hashed if they changed.  A file that was touched but
    holds the same bytes is skipped like an untouched one.  Files that are gone stay in ``known``.
    """
    listed = written(_files(spark, folder).select("path", "modified", "length"), "listed")
    before = written(known.read(), "known")
    same = ["path", "modified", "length"]
    kept = listed.join(before.select(*same, "sha256"), same)
    changed = listed.join(before.select(*same), same, "left_anti")
    oldest = changed.agg(F.min("modified")).first()[0]
    rows = kept
    if oldest is not None:
        read = _files(spark, folder).filter(c("modified") >= F.lit(oldest)).join(changed.select("path"), "path", "left_semi")
        rows = kept.unionByName(read.select(*same, F.sha2("content", 256).alias("sha256")))
    own = _manifest(rows).filter("not duplicate_id")
    delta = written(hash_delta(own, before.select("drawing_id", c("sha256").alias("file_hash")), force), "delta")
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    moved = delta.select(names).join(before.select("drawing_id", *same), ["drawing_id", *same], "left_anti")
    known.replace(moved.select(names))
    return delta


def write_files(rows: DataFrame, folder: str) -> int:
    """Files from rows (name, content binary) below a folder that all executors see; how many. A name that is there is written anew."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("name", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def hash_delta(manifest: DataFrame, drawings: DataFrame, force: bool = False) -> DataFrame:
    """Manifest rows with status new, updated or skipped; an unknown id is new; force skips none."""
    known = drawings.select("drawing_id", "file_hash", F.lit(True).alias("known"))
    rows = manifest.join(known, "drawing_id", "left")
    same = c("file_hash").eqNullSafe(c("sha256")) & F.lit(not force)
    return rows.withColumn("status", F.when(c("known").isNull(), "new").when(same, "skipped").otherwise("updated")).drop("known", "file_hash")


def scan_results(delta: DataFrame) -> DataFrame:
    """S3: how many files of each status."""
    return delta.groupBy("status").agg(F.count("*").alias("n"))
