"""Registered orders, sequences, pages of any order, history."""

import datetime as dt

import pytest

from auditlake.operators import history, orders


def test_every_order_is_named_once(spark):
    assert len(orders.ORDERS) == 31 and all(c.removeprefix("-") for o in orders.ORDERS.values() for c in o)
    assert {o for o in orders.ORDERS if o.endswith("_audits")} == {f"{k}_audits" for k in ("image", "internal", "link", "metadata", "sitemap")}


@pytest.mark.parametrize("order", sorted(orders.ORDERS))
def test_sequence_and_pages_agree(spark, order):
    names = [c.removeprefix("-") for c in orders.ORDERS[order]]
    values = {"severity_rank": "int", "category": "string", "code": "string", "action": "string"}
    rows = [tuple(None if (i + j) % 7 == 3 and j < len(names) - 1 else (i * (j + 3) % (4 if j < len(names) - 1 else 31)) if values.get(n, "long") != "string" else "abcd"[i * (j + 3) % 4] for j, n in enumerate(names)) for i in range(31)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {values.get(n, 'long')}" for n in names)).repartition(3)

    def place(row):
        out = []
        for c, v in zip(orders.ORDERS[order], row, strict=True):
            sign = -1 if c.startswith("-") else 1
            out.append((v is None, 0 if v is None else sign * (ord(v) if isinstance(v, str) else v)))
        return out

    want = sorted(rows, key=place)
    assert [tuple(r)[:-1] for r in sorted(orders.sequenced(df, order, "seq_").collect(), key=lambda r: r["seq_"])] == want
    seen, after = [], None
    while got := [tuple(r) for r in orders.page(df, order, after, 13).collect()]:
        seen, after = seen + got, got[-1]
    assert seen == want


def test_severity_has_a_rank(spark):
    df = spark.createDataFrame([("low", "a", "x", "u1"), ("critical", "b", "x", "u1"), ("high", "a", "y", "u2"), ("high", "a", "x", "u3")], "severity string, category string, code string, url_identity string")
    got = [tuple(r) for r in orders.sequenced(df, "metadata_issues").orderBy("sequence").select("severity", "code").collect()]
    assert got == [("critical", "x"), ("high", "x"), ("high", "y"), ("low", "x")]
    assert [r["severity"] for r in orders.page(df, "metadata_issues", (4, "a", "x", "u3"), 5).collect()] == ["high", "low"]
    with pytest.raises(ValueError, match="other columns"):
        orders.page(df, "metadata_issues", (4,), 5)
    with pytest.raises(ValueError, match="out of range"):
        orders.page(df, "metadata_issues", None, 0)


def test_history_filters_and_pages(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    runs = spark.createDataFrame([("r1", "completed", 0), ("r2", "failed", 2), ("r3", "running", 1), ("r4", "completed", 3), ("r5", "completed", 1)], "run_id string, lifecycle string, warning_count int")
    jobs = spark.createDataFrame([("r1", "j1", 1, at(1)), ("r1", "j9", 9, at(9)), ("r2", "j2", 2, at(2)), ("r3", "j3", 3, None), ("r4", "j4", 4, at(4))], "run_id string, job_id string, created_sequence int, terminal_at timestamp")
    own = history.runs_with_jobs(runs, jobs)
    assert {(r["run_id"], r["job_id"], r["terminal"]) for r in own.collect()} == {("r1", "j9", True), ("r2", "j2", True), ("r3", "j3", False), ("r4", "j4", True)}
    stages = spark.createDataFrame([("r1",), ("r1",), ("r3",), (None,)], "run_id string")
    pick = lambda **k: {r["run_id"] for r in history.history(own, history.Filters(**k), {"stage": (stages, "run_id")}).collect()}
    assert pick(equal={"lifecycle": "completed"}) == {"r1", "r4"} and pick(since={"terminal_at": at(2)}, before={"terminal_at": at(4)}) == {"r2", "r4"}
    assert pick(exists={"stage": True}) == {"r1", "r3"} and pick(exists={"stage": False}) == {"r2", "r4"} and pick(positive={"warning_count": False}) == {"r1"} and pick(positive={"warning_count": True}) == {"r2", "r3", "r4"}
    for wrong in ({"equal": {"nothing": 1}}, {"exists": {"nothing": True}}):
        with pytest.raises(ValueError, match="unknown filter"):
            history.history(own, history.Filters(**wrong))
    order = ("-terminal_at", "-run_id")
    first = history.history_page(own, history.Filters(), order, size=2).collect()
    assert [r["run_id"] for r in first] == ["r1", "r4"]
    assert [r["run_id"] for r in history.history_page(own, history.Filters(), order, (first[-1]["terminal_at"], "r4"), 5).collect()] == ["r2", "r3"]
    assert [r["run_id"] for r in history.history_page(own, history.Filters(), order, (None, "r4"), 5).collect()] == ["r3"]
