"""Page evidence that is parsed and written once for each run, with its version, and read by every analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from auditlake.operators.ordering import indexed
from auditlake.shared import shared_dir, written
from auditlake.sources import html

#: Of the columns that retain() writes; a change of what a parse means raises it.
VERSION = 1
#: Pages of a run that an audit keeps where a limit is asked for. Fixed value.
MAX_PAGES = 100_000


class EvidenceStore:
    """A folder of runs. Each run is a table of its own, written whole before it is seen under its name."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/evidence").rstrip("/")

    def path(self, run: str) -> str:
        return f"{self.root}/run={run}"

    def retain(self, run: str, pages: DataFrame, most: int | None = None, order: str = "discovery_order") -> DataFrame:
        """Parses the run's pages (page_id, url, html, the order and any facts) once and writes them with run_id, version and place.

        most: only so many pages are kept, the first in the order (MAX_PAGES in an audit); None keeps all. The place of a page is
        counted by ranges, so no task sorts the run, and pages beyond the limit aren't parsed. A run that is there is an error.
        """
        if most is not None:
            kept = indexed(written(pages.select("page_id", order), "discovered"), [F.asc_nulls_last(order), "page_id"], (), "place").where(F.col("place") < most)
            pages = pages.join(kept.select("page_id"), "page_id", "left_semi")
        parsed = html.parsed(pages).withColumns({"run_id": F.lit(run), "version": F.lit(VERSION)})
        parsed.write.mode("error").parquet(self.path(run))
        return self.read(run)

    def read(self, run: str, version: int = VERSION) -> DataFrame:
        """The run's evidence; columns that a reader doesn't name aren't read. A run that isn't there, or of another version, is an error."""
        try:
            rows = self.spark.read.parquet(self.path(run))
        except AnalysisException as gone:
            raise ValueError(f"no evidence of run {run}") from gone
        other = rows.where(~F.col("version").eqNullSafe(F.lit(version))).select("version").limit(1).collect()
        if other:
            raise ValueError(f"run {run} has evidence of version {other[0]['version']}, not {version}")
        return rows

    def summary(self, run: str) -> DataFrame:
        """run_id, pages, links, images, blocks, recovered of a run, from the written table."""
        rows = self.read(run)
        return rows.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("pages"), *(F.sum(F.size(f"evidence.{c}")).cast("long").alias(c) for c in ("links", "images", "blocks")), F.count_if("evidence.recovered").alias("recovered"),
        )
