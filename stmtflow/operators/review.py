"""Human review: join corrections to review requests, list what still waits.

Text and type always come from the original request; only the record comes from
the reviewer. Both operators are plain key joins on ``doc_id``, so AQE picks a
broadcast join when the corrections side is small at run time and a sort-merge
join otherwise; skewed keys are split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validation import is_empty_object, parse_object, validate_frame
from ..schemas import BILL_RECORD, RecordSchema


def check_corrections(joined: DataFrame, corrected_col: str = "corrected",
                      schema: RecordSchema = BILL_RECORD) -> DataFrame:
    """Validate joined corrections: ``correction_missing`` (Python falsiness of the
    decoded dict), ``errors`` and ``record``."""
    staged = (joined.withColumn("_v", parse_object(F.col(corrected_col), schema))
                    .withColumn("correction_missing", is_empty_object(F.col(corrected_col))))
    out = validate_frame(staged, "_v", schema, present=F.col(corrected_col).isNotNull(), barrier=True)
    return out.drop("_v")


def first_corrections(corrections: DataFrame, id_col: str = "doc_id", corrected_col: str = "corrected",
                      order_col: str | None = None) -> DataFrame:
    """One correction per request: ``(id, corrected, n_corrections)``.

    A request waits for one answer. Of several corrections the first by ``order_col`` counts (nulls last; then,
    and without it, the one whose text is least, null last); ``n_corrections`` tells how many there were.
    Partial minima go into the shuffle, so a request with very many corrections is one row a task.
    """
    by = [F.col(order_col).isNull().alias("p"), F.col(order_col).alias("o")] if order_col else []
    first = F.struct(*by, F.col(corrected_col).isNull().alias("n"), F.col(corrected_col).alias("c"))
    return (corrections.groupBy(id_col).agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("n_corrections"))
            .select(id_col, F.col("_first.c").alias(corrected_col), "n_corrections"))


def apply_corrections(queue: DataFrame, corrections: DataFrame, id_col: str = "doc_id",
                      corrected_col: str = "corrected", schema: RecordSchema = BILL_RECORD, order_col: str | None = None) -> DataFrame:
    """Inner join of review requests with their first corrections, then ``check_corrections``.

    ``n_corrections`` is kept: with more than one, the others were left out (see ``first_corrections``).
    """
    joined = queue.join(first_corrections(corrections, id_col, corrected_col, order_col), id_col, "inner")
    return check_corrections(joined, corrected_col, schema)


def pending_reviews(queue: DataFrame, corrections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Review requests with no correction yet (the human task still waits)."""
    return queue.join(corrections.select(id_col), id_col, "left_anti")
