"""Exports and imports: guarded CSV, JSON, Markdown, manifest, delimited files."""

from __future__ import annotations

import csv
import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 100_000
#: First characters that a spreadsheet may take for a formula, by export. Fixed values.
GUARDS = {"plain": "=+@-", "images": "=+@-\t\r"}


def guarded(value: Column, kind: str = "plain", trim: bool = False) -> Column:
    """Text with an apostrophe in front where it could be a formula; trim also looks behind leading spaces."""
    signs = "".join("\\" + c if c in "-]^\\" else c for c in GUARDS[kind])
    seen = F.ltrim(value) if trim else value
    return F.when(seen.rlike(f"^[{signs}]"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_export(df: DataFrame, columns: list[str], order: list[str], path: str, most: int = MAX_ROWS) -> bool:
    """Writes ordered columns as CSV, at most so many rows; returns whether rows were left out."""
    own = df.select(*columns, *(c for c in order if c not in columns)).orderBy(*order)
    cut = own.limit(most + 1).count() > most
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    own.limit(most).select(*(guarded(F.col(c)).alias(c) if c in text else F.col(c) for c in columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return cut


def json_export(df: DataFrame, order: list[str], most: int = MAX_ROWS) -> str:
    """A JSON document of rows with sorted keys and the truncation fact."""
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).limit(most + 1).collect()]
    return json.dumps({"rows": rows[:most], "truncated": len(rows) > most}, sort_keys=True, separators=(",", ":"), default=str, ensure_ascii=False)


def markdown_export(title: str, sections: dict[str, DataFrame]) -> str:
    """A Markdown summary of small aggregated tables."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
        out += ["| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(MAX_ROWS).collect()]
    return "\n".join(out) + "\n"


def manifest(files: dict[str, bytes]) -> str:
    """Byte counts and SHA-256 of files, by name."""
    return json.dumps([{"name": n, "bytes": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, b in sorted(files.items())], separators=(",", ":"))


#: Header names that mean the same. Fixed values.
ALIASES = {"source_url": ("source_url", "source", "url", "old_url", "from"), "destination_url": ("destination_url", "destination", "target", "new_url", "to")}


def read_delimited(spark: SparkSession, path: str, first_line: str | None = None) -> DataFrame:
    """source_url, destination_url of a CSV or TSV file with a header, or of a file with one URL a line."""
    head = first_line if first_line is not None else spark.read.text(path).first()[0]
    separator = "\t" if "\t" in head else ","
    names = [n.strip().lower() for n in next(csv.reader([head], delimiter=separator))]
    if not set(names) & {a for x in ALIASES.values() for a in x}:
        return spark.read.text(path).select(F.trim("value").alias("source_url"), F.lit(None).cast("string").alias("destination_url")).where("source_url <> ''")
    raw = spark.read.option("header", True).option("sep", separator).csv(path)
    raw = raw.toDF(*names)
    pick = lambda k: F.coalesce(*(F.col(a) for a in ALIASES[k] if a in names), F.lit(None).cast("string")).alias(k)
    return raw.select(pick("source_url"), pick("destination_url"))


def file_manifest(folder: str) -> str:
    return manifest({p.name: p.read_bytes() for p in sorted(Path(folder).iterdir()) if p.is_file()})
