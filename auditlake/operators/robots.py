"""robots.txt: parsing to rules, and allow or deny decisions for URLs by joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES_SCHEMA = "origin string, group_index int, agent string, line int, allow boolean, pattern string, delay double, sitemap string"

#: State of an origin's policy by its response. Fixed values.
ORIGIN_STATE_SQL = """CASE WHEN fetch_failed OR status IS NULL THEN 'fetch_failed' WHEN status = 200 AND media NOT LIKE 'text/%' THEN 'invalid' WHEN status = 200 THEN 'parsed' WHEN status IN (204, 400, 404) THEN 'no_policy'
 WHEN status IN (401, 403) THEN 'forbidden' WHEN status = 429 OR status BETWEEN 500 AND 599 THEN 'temporary' ELSE 'fetch_failed' END"""


def parse_robots(body: str | None) -> list[dict]:
    """Rows of rules: agents in a row share the rules after them; a rule before any agent is dropped."""
    rows: list[dict] = []
    agents: list[str] = []
    group, in_rules = -1, False
    for line, raw in enumerate((body or "").lstrip("﻿").splitlines(), 1):
        name, colon, value = raw.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        row = {"group_index": group, "agent": None, "line": line, "allow": None, "pattern": None, "delay": None, "sitemap": None}
        if name == "sitemap":
            rows.append(row | {"group_index": -1, "sitemap": value})
        elif name == "user-agent":
            if in_rules or not agents:
                agents, group, in_rules = [], group + 1, False
            agents.append(value.lower())
            rows.append(row | {"group_index": group, "agent": value.lower()})
        elif name in ("allow", "disallow") and agents:
            in_rules = True
            if value:
                rows += [row | {"group_index": group, "agent": a, "allow": name == "allow", "pattern": value} for a in agents]
        elif name == "crawl-delay" and agents:
            in_rules = True
            if re.fullmatch(r"\d+(\.\d+)?", value):
                rows += [row | {"group_index": group, "agent": a, "delay": float(value)} for a in agents]
    return rows


def rules(files: DataFrame) -> DataFrame:
    """Rows of RULES_SCHEMA of files (origin, body)."""
    names = [x.split()[0] for x in RULES_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [{"origin": o} | r for o, t in zip(b["origin"], b["body"], strict=True) for r in parse_robots(t)]
            yield pd.DataFrame(found, columns=names).astype({"group_index": "Int32", "line": "Int32", "allow": "boolean", "delay": "Float64"})

    return files.select("origin", "body").mapInPandas(run, RULES_SCHEMA)


def pattern_regex(pattern: Column) -> Column:
    """An anchored regular expression of a rule's pattern: * is any text, a $ at the end anchors."""
    safe = F.regexp_replace(pattern, r"([\\.+?^{}()|\[\]])", r"\\$1")
    safe = F.regexp_replace(safe, r"\*", ".*")
    inner = F.regexp_replace(safe, r"\$(?=.)", r"\\\$")
    return F.concat(F.lit("^"), inner)


def decisions(urls: DataFrame, policy: DataFrame, agent: str = "crawler", origins: DataFrame | None = None) -> DataFrame:
    """url_id, allowed, reason, pattern. urls: url_id, origin, target (path with query).

    The group whose agent is longest among those inside our token applies, * least; the longest matching pattern wins,
    allow before disallow, then the earlier line. origins: origin, state of ORIGIN_STATE_SQL; without it all are parsed.
    """
    token = F.lit(agent.lower())
    named = policy.where("agent is not null").withColumn("specific", F.when(F.col("agent") == "*", 0).when(F.contains(token, F.col("agent")), F.length("agent")))
    chosen = named.where("specific is not null").groupBy("origin").agg(F.max_by("group_index", F.struct("specific", -F.col("group_index"))).alias("group_index"), F.max("specific").alias("specific"))
    own = named.join(chosen, ["origin", "group_index", "specific"], "left_semi").where("pattern is not null")
    own = own.select("origin", "line", "allow", "pattern", pattern_regex(F.col("pattern")).alias("regex"), F.length(F.regexp_replace("pattern", r"[*$]", "")).alias("strength"))
    # Rules of an origin are few; the join is by origin, not by a comparison of all with all.
    hits = urls.join(own, "origin").where(F.expr("regexp(target, regex)"))
    best = hits.groupBy("url_id").agg(F.max_by(F.struct("allow", "pattern"), F.struct("strength", "allow", -F.col("line"))).alias("b"))
    out = urls.join(best, "url_id", "left").join(chosen.select("origin", F.lit(True).alias("grouped")), "origin", "left")
    if origins is None:
        state = F.lit("parsed")
    else:
        out = out.join(origins.select("origin", "state"), "origin", "left")
        state = F.coalesce("state", F.lit("no_policy"))
    reason = (
        F.when(state == "no_policy", "no_policy").when(state == "forbidden", "policy_forbidden").when(state == "temporary", "policy_temporarily_unavailable").when(state != "parsed", "policy_unavailable")
        .when(F.col("grouped").isNull(), "no_matching_group").when(F.col("b").isNull(), "no_matching_rule").when(F.col("b.allow"), "allowed_by_rule").otherwise("disallowed_by_rule")
    )
    return out.select("url_id", reason.isin("no_policy", "no_matching_group", "no_matching_rule", "allowed_by_rule").alias("allowed"), reason.alias("reason"), F.col("b.pattern").alias("pattern"))
