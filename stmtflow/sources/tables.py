"""Co-located storage: tables bucketed by the document key.

Documents, model responses and corrections all join on ``doc_id``. Written with the
same number of buckets on that key, Spark reads them already hash-partitioned and
sorted, so the joins, the per-document window of ``first_valid_attempt`` and the
review joins run without moving document text across the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "doc_id") -> DataFrame:
    """Store ``df`` as a Parquet table bucketed and sorted by ``key``; returns the table."""
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
       .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)
