"""auditlake: site-audit analytics on Spark DataFrames."""
