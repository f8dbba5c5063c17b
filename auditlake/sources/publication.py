"""Files published whole or not at all.

Texts are written by Spark to a folder beside the target, given their names by the driver, read back and held against their
checksums, and only then does the folder take the target's place by renames. A reader sees the old files or the new ones; a
failure at any step leaves the old ones and removes what was begun. All paths go through Hadoop's file systems, so the target may
be in any store that Spark writes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file's name: letters, digits, '.', '_' and '-', no leading or trailing '.', and no name that a system keeps for itself.
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*[A-Za-z0-9_-]$|^[A-Za-z0-9]$"
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])([.].*)?$"
MANIFEST = "publication-manifest.json"
#: Files of one publication: their names come to the driver.
MOST_FILES = 50_000


class PublicationError(RuntimeError):
    """Nothing was published; the message starts with a stable code."""


@dataclass(frozen=True)
class Published:
    """target, whether files were there before, and name, bytes, sha256 of each file."""

    target: str
    replaced: bool
    files: tuple[tuple[str, int, str], ...]


class Store:
    """The driver's view of a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(path))]

    def make(self, path: str) -> None:
        self.fs.mkdirs(self.path(path))

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise PublicationError(f"rename_failed: {old}")

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def checked(files: DataFrame) -> list[tuple[str, int, str]]:
    """name, bytes, sha256 of files (name, text), with a line end after each text that has none; raises for names that can't be."""
    whole = whole_text()
    rows = files.select("name", F.octet_length(whole).cast("long").alias("bytes"), F.sha2(whole, 256).alias("sha256")).limit(MOST_FILES + 1).collect()
    if len(rows) > MOST_FILES:
        raise PublicationError("too_many_files")
    bad = files.where(F.coalesce(~F.col("name").rlike(SAFE_NAME) | F.col("name").rlike(RESERVED) | (F.lower("name") == MANIFEST) | F.col("text").isNull(), F.lit(True))).select("name").limit(1).collect()
    if bad:
        raise PublicationError(f"invalid_logical_filename: {bad[0]['name']}")
    if len({r["name"].lower() for r in rows}) < len(rows):
        raise PublicationError("duplicate_logical_filename")
    return sorted((r["name"], r["bytes"], r["sha256"]) for r in rows)


def whole_text():
    return F.when(F.endswith("text", F.lit("\n")), F.col("text")).otherwise(F.concat("text", F.lit("\n")))


def publish(files: DataFrame, target: str, replace: bool = False, dry_run: bool = False) -> Published:
    """Writes files (name, text; both without nulls) as target/name, with a manifest beside them.

    target: a folder that isn't there yet, or with replace one whose files all give way. dry_run checks everything and writes
    nothing. Each text is one file, so a text must fit into a task. files is computed again for the write: it should be a
    written table, or one that comes out the same. Raises PublicationError, or what the write raised.
    """
    spark = files.sparkSession
    expected, target = checked(files), target.rstrip("/")
    store, there = Store(spark, target), False
    there = store.exists(target)
    if there and not replace:
        raise PublicationError("target_exists")
    result = Published(target, there, tuple(expected))
    if dry_run:
        return result
    parent, _, own = target.rpartition("/")
    mark = uuid.uuid4().hex
    stage, old = f"{parent}/.{own}.staged-{mark}", f"{parent}/.{own}.replaced-{mark}"
    try:
        store.make(f"{stage}/files")
        # The writer ends each text with a line end: those that have one leave it out here.
        body = F.regexp_replace("text", "\n\\z", "")
        files.select("name", body.alias("value")).write.partitionBy("name").text(f"{stage}/parts")
        for folder in store.names(f"{stage}/parts") if expected else []:
            if folder.startswith("name="):
                parts = [p for p in store.names(f"{stage}/parts/{folder}") if p.startswith("part-")]
                if len(parts) != 1:
                    raise PublicationError(f"write_failed: {folder}")
                store.move(f"{stage}/parts/{folder}/{parts[0]}", f"{stage}/files/{folder.removeprefix('name=')}")
        verify(spark, f"{stage}/files", expected)
        store.write(f"{stage}/files/{MANIFEST}", json.dumps({"files": [{"name": n, "bytes": b, "sha256": s} for n, b, s in expected]}, indent=1) + "\n")
        if there:
            store.move(target, old)
        try:
            store.move(f"{stage}/files", target)
        except Exception:
            if there:
                store.move(old, target)
            raise
    finally:
        store.remove(stage)
    if there:
        store.remove(old)
    return result


def verify(spark: SparkSession, folder: str, expected: list[tuple[str, int, str]]) -> None:
    """Raises unless the folder holds just these files with these checksums."""
    found = spark.read.format("binaryFile").load(folder).where(F.element_at(F.split("path", "/"), -1) != MANIFEST) if expected else None
    rows = [] if found is None else found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256")).collect()
    if sorted((r["name"], r["length"], r["sha256"]) for r in rows) != expected:
        raise PublicationError("integrity_mismatch")


def verified(spark: SparkSession, target: str) -> list[tuple[str, int, str]]:
    """The files of a publication as its manifest tells; raises where the folder differs from it."""
    text = "\n".join(r["value"] for r in spark.read.text(f"{target.rstrip('/')}/{MANIFEST}").collect())
    expected = sorted((f["name"], f["bytes"], f["sha256"]) for f in json.loads(text)["files"])
    verify(spark, target, expected)
    return expected
