"""Makes the library's functions available to SQL text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from auditlake.functions import text, urls
from auditlake.sources.html import EVIDENCE, read_page

#: What html_evidence gives for each row of its table: the page's key and address, and the fields of its evidence.
COLUMNS = "page_id bigint, url string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVIDENCE.fields)


@F.arrow_udtf(returnType=COLUMNS)
class HtmlEvidence:
    """html_evidence(TABLE(SELECT page_id, url, html ...)): one parse of each page, a batch of rows at a time."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        keys, addresses, pages = (batch.column(i).to_pylist() for i in range(3))
        for at in range(0, len(keys), 256):
            found = [read_page(u or "", h) for u, h in zip(addresses[at : at + 256], pages[at : at + 256], strict=True)]
            columns = [pa.array(keys[at : at + 256], pa.int64()), pa.array(addresses[at : at + 256], pa.string())]
            columns += [pa.array([f[field.name] for f in found], to_arrow_type(field.dataType)) for field in EVIDENCE.fields]
            yield pa.Table.from_arrays(columns, names=["page_id", "url", *(f.name for f in EVIDENCE.fields)])


def register(spark: SparkSession) -> None:
    """normalize_url, resolve_url, governed_url, nfkc_casefold, sequence_ratio and the table function html_evidence. May be called again."""
    urls.register(spark)
    text.register(spark)
    spark.udtf.register("html_evidence", HtmlEvidence)
