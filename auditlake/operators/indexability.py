"""Robots directives of headers and pages, and where they contradict each other."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.sources.html import PARAMETER_DIRECTIVES, directives

#: Directives that can't be an agent's name. Fixed values.
KNOWN = frozenset("all none index noindex follow nofollow noarchive nosnippet noimageindex notranslate indexifembedded".split()) | PARAMETER_DIRECTIVES
RECORD = T.StructType([T.StructField("agent", T.StringType()), T.StructField("directives", T.ArrayType(T.StringType())), T.StructField("warning", T.StringType())])


def parse_header(value: str | None) -> dict:
    """One X-Robots-Tag value: agent (null for all), directives, warning."""
    text = (value or "").strip()
    if not text:
        return {"agent": None, "directives": [], "warning": "empty_x_robots_tag"}
    name, colon, rest = text.partition(":")
    name = name.strip().lower()
    if not colon or name in KNOWN or "," in name:
        return {"agent": None, "directives": directives(text), "warning": None}
    if not re.fullmatch(r"[a-z0-9_-]+", name):
        return {"agent": None, "directives": [], "warning": "invalid_x_robots_tag"}
    return {"agent": name, "directives": directives(rest), "warning": None}


@F.pandas_udf(T.ArrayType(RECORD))
def x_robots(values: pd.Series) -> pd.Series:
    """The records of a page's X-Robots-Tag values (an array of strings)."""
    return pd.Series([None if v is None else [parse_header(x) for x in v] for v in values])


def conflicts(pages: DataFrame) -> DataFrame:
    """page_id, conflict. pages: page_id, meta (array of directives for all agents), records (as x_robots gives them)."""
    every = F.flatten(F.transform(F.filter("records", lambda r: r["agent"].isNull()), lambda r: r["directives"]))
    own = F.flatten(F.transform(F.filter("records", lambda r: r["agent"].isNotNull()), lambda r: r["directives"]))
    has = lambda c, x: F.array_contains(c, x)
    against = lambda a, b: (has(F.col("meta"), a) & has(F.col("header"), b)) | (has(F.col("meta"), b) & has(F.col("header"), a))
    names = lambda c: F.transform(F.filter(c, lambda d: d.contains(":")), lambda d: F.split_part(d, F.lit(":"), F.lit(1)))
    parameters = lambda c: F.filter(c, lambda d: d.contains(":"))
    tests: tuple[tuple[str, Column], ...] = (
        ("meta_header_index_conflict", against("index", "noindex")), ("meta_header_follow_conflict", against("follow", "nofollow")),
        ("parameter_conflict", F.arrays_overlap(names(F.col("meta")), names(F.col("header"))) & (F.size(F.array_except(parameters(F.col("header")), parameters(F.col("meta")))) > 0)),
        ("crawler_specific_difference", (F.size("own") > 0) & (F.size(F.array_except("own", "header")) > 0)),
    )
    df = pages.select("page_id", "meta", every.alias("header"), own.alias("own"))
    return df.select("page_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests)))).alias("conflict"))
