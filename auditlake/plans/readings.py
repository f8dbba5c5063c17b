"""Queries over sequences, pages and history, on the tables with the most rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.register import register
from auditlake.operators import history, orders
from auditlake.plans.queries import DUCK_LINKS
from auditlake.plans.registry import query
from auditlake.plans.site import DUCK_BASE
from auditlake.sources.evidence import EvidenceStore

#: An order of documents: few languages, many equal lengths.
DOCUMENT_ORDER = ("lang", "-n_chars", "source", "doc_id")


@query("""SELECT doc_id, lang, row_number() OVER (ORDER BY lang NULLS LAST, n_chars DESC NULLS LAST, source NULLS LAST, doc_id NULLS LAST) - 1 AS sequence,
  row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, source NULLS LAST, doc_id NULLS LAST) - 1 AS place FROM documents""")
def sequenced_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in one order of all documents, and within its language, of which one has most documents."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select(*(c.removeprefix("-") for c in DOCUMENT_ORDER))
    placed = orders.sequenced(orders.sequenced(rows, DOCUMENT_ORDER), DOCUMENT_ORDER[1:], "place", ["lang"])
    return placed.select("doc_id", "lang", "sequence", "place")


#: Customers as runs and orders as their jobs; open orders haven't ended.
JOBS = "SELECT o_custkey AS run_id, o_orderkey AS job_id, o_orderkey AS created_sequence, o_orderdate AS submitted_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS ended_at, o_orderpriority AS priority FROM {orders}"
RUNS = "SELECT c_custkey AS run_id, CASE WHEN c_custkey % 7 = 3 THEN 'running' ELSE 'completed' END AS lifecycle, c_nationkey AS warning_count FROM {customer}"


@query(f"""WITH job AS (SELECT * FROM ({JOBS.format(orders="orders")}) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_sequence DESC) = 1), own AS (SELECT * FROM ({RUNS.format(customer="customer")}) JOIN job USING (run_id)),
  kept AS (SELECT * FROM own WHERE lifecycle = 'completed' AND warning_count > 0 AND submitted_at >= TIMESTAMP '1993-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = job_id AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = job_id AND l_quantity > 49)),
  ranked AS (SELECT *, row_number() OVER (ORDER BY ended_at DESC NULLS LAST, run_id DESC) AS r FROM kept),
  told AS (SELECT 'first' AS page, run_id, job_id, ended_at FROM ranked WHERE r <= 40
    UNION ALL SELECT 'ended', run_id, job_id, ended_at FROM (SELECT * FROM kept, (SELECT max(ended_at) AS newest FROM kept) WHERE ended_at < newest ORDER BY ended_at DESC, run_id DESC LIMIT 40)
    UNION ALL SELECT 'open', run_id, job_id, ended_at FROM (SELECT * FROM kept WHERE ended_at IS NULL AND run_id < 100000 ORDER BY run_id DESC LIMIT 40))
  SELECT page, run_id, job_id, strftime(ended_at, '%Y-%m-%d') AS ended FROM told""")
def history_pages(spark: SparkSession, d: str) -> DataFrame:
    """The newest runs that pass the filters, the page after the newest end, and a page among those that haven't ended."""
    table = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    runs = history.runs_with_jobs(spark.sql(RUNS, customer=table("customer")), spark.sql(JOBS, orders=table("orders")))
    lines = table("lineitem").select(F.col("l_orderkey").alias("job_id"), "l_returnflag", "l_quantity")
    wanted = history.Filters(equal={"lifecycle": "completed"}, since={"submitted_at": "1993-01-01"}, positive={"warning_count": True}, exists={"returned": True, "bulky": False})
    related = {"returned": (lines.where("l_returnflag = 'R'"), "job_id"), "bulky": (lines.where("l_quantity > 49"), "job_id")}
    kept = history.history(runs, wanted, related)
    order = ("-ended_at", "-run_id")
    newest = kept.agg(F.max("ended_at").alias("t")).first()["t"]
    pages = {"first": orders.page(kept, order, None, 40), "open": orders.page(kept, order, (None, 100_000), 40)}
    pages["ended"] = orders.page(kept.where("ended_at IS NOT NULL"), order, (newest, -1), 40)
    out = None
    for name, rows in pages.items():
        one = rows.select(F.lit(name).alias("page"), "run_id", "job_id", F.date_format("ended_at", "yyyy-MM-dd").alias("ended"))
        out = one if out is None else out.unionByName(one)
    return out


# -- SQL text alone

EVIDENCE_SQL = """
SELECT page_id, try_element_at(titles, 1) AS title, CAST(size(titles) AS BIGINT) AS n_titles, count(l.href) AS links, count(DISTINCT l.resolved) AS targets, count_if(l.anchor = '') AS bare, nfkc_casefold(try_element_at(titles, 1)) AS title_key
FROM html_evidence(TABLE(SELECT page_id, url, html FROM {pages})) LATERAL VIEW OUTER explode(links) each AS l
GROUP BY page_id, titles
"""


@query(f"""WITH base AS ({DUCK_BASE}), {DUCK_LINKS}, per AS (SELECT page_id, count(*) AS links, count(DISTINCT resolved) AS targets, count(*) FILTER (WHERE anchor = '') AS bare FROM occurrences GROUP BY page_id)
  SELECT page_id, title, n_titles, coalesce(links, 0) AS links, coalesce(targets, 0) AS targets, coalesce(bare, 0) AS bare, replace(lower(title), 'ß', 'ss') AS title_key FROM base LEFT JOIN per USING (page_id)""")
def evidence_by_sql(spark: SparkSession, d: str) -> DataFrame:
    """Title and links of each page, asked for in SQL alone through the registered table function."""
    register(spark)
    return spark.sql(EVIDENCE_SQL, pages=spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html"))


# -- evidence that is kept


@query(f"""WITH base AS ({DUCK_BASE}), {DUCK_LINKS}, per AS (SELECT page_id, count(*) AS links FROM occurrences GROUP BY page_id), titled AS (SELECT title, count(*) AS n FROM base GROUP BY title)
  SELECT page_id, 1 AS version, title, coalesce(links, 0) AS links, n AS same_title FROM base LEFT JOIN per USING (page_id) JOIN titled USING (title)""")
def evidence_retained(spark: SparkSession, d: str) -> DataFrame:
    """The pages' evidence, parsed and written once as a run of its own, and read twice: for each page, and for how many share its title."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html", F.col("page_id").alias("discovery_order"))
    rows = EvidenceStore(spark).retain(f"run-{uuid.uuid4().hex}", pages)
    own = rows.select("page_id", "version", F.try_element_at("evidence.titles", F.lit(1)).alias("title"), F.size("evidence.links").cast("long").alias("links"))
    titled = rows.select(F.try_element_at("evidence.titles", F.lit(1)).alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("same_title"))
    return own.join(titled, "title").select("page_id", "version", "title", "links", "same_title")
