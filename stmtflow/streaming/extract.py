"""Extraction inside the stream: documents alone go in, records and review requests come out.

Each micro-batch is extracted on its own, by the rules (native expressions) or by a model. The answers of
the model are stored per batch and attempt before anything is made of them, so a batch that is run
again, because a later step failed or the driver was lost, reads them and asks nothing twice; only an attempt
whose own write did not end is asked anew. Batches are written as ``stream_ingest`` writes them,
one folder each, so that a batch that runs again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.extract import extract_records
from ..operators.responses import first_valid_response, model_extract
from ..operators.routing import document_status, route_branch
from ..schemas import BILL_RECORD, MODEL_MAX_RETRIES, RecordSchema
from ..session import materialize, shared_path
from .pipeline import ingested, read_stream, start_stream

# (documents of a batch, its number) -> (doc_id, record): documents without a record go to review.
Extract = Callable[[DataFrame, int], DataFrame]


def by_rules(batch: DataFrame, batch_id: int, schema: RecordSchema = BILL_RECORD) -> DataFrame:
    """Records by the extraction rules; a document in which no rule finds a value has none."""
    records = extract_records(batch.where(~is_blank(F.col("text"))), schema=schema)
    found = F.coalesce(*[F.col("record")[n].cast("string") for n in schema.names if n != "line_items"],
                       F.col("record")["line_items"].cast("string") if "line_items" in schema.names else F.lit(None))
    return records.where(found.isNotNull()).select("doc_id", "record")


def by_model(make_extractor: Callable[[], Callable[[str], str | None]], answers_path: str, attempts: int = MODEL_MAX_RETRIES + 1,
             concurrency: int = 1, deadline: float | None = None, schema: RecordSchema = BILL_RECORD) -> Extract:
    """Records by a model, asked at most ``attempts`` times; answers are kept at ``<answers_path>/batch_id=<n>/attempt=<k>``."""
    def extract(batch: DataFrame, batch_id: int) -> DataFrame:
        answers = model_extract(batch, make_extractor, attempts=attempts, schema=schema, concurrency=concurrency, deadline=deadline,
                                store=f"{answers_path}/batch_id={batch_id}")
        return first_valid_response(answers, attempts, schema).select("doc_id", "record")

    return extract


def extract_batch(batch: DataFrame, batch_id: int, extract: Extract, out_path: str) -> None:
    """One micro-batch: extracted, given status and route, written by branch."""
    processed = document_status(batch.join(extract(batch, batch_id), "doc_id", "left")).withColumn("branch", route_branch())
    processed.write.mode("overwrite").partitionBy("branch").parquet(f"{out_path}/batch_id={batch_id}")


def stream_extract(docs: DataFrame, extract: Extract, out_path: str, checkpoint: str, available_now: bool = True,
                   processing_time: str | None = None):
    """Start the extraction stream over ``docs`` (doc_id, document_path, document_type_hint, text); returns the query.

    ``streaming.pipeline.ingested`` reads what it has written: records in branch ``success``, review
    requests in branch ``failure``, documents without path or text in ``unrouted``.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        extract_batch(batch, batch_id, extract, out_path)

    return start_stream(docs.sparkSession, docs.writeStream.foreachBatch(write_batch), checkpoint, available_now, processing_time)


def stored_answers(spark: SparkSession, answers_path: str) -> DataFrame:
    """All answers that ``by_model`` has stored: doc_id, attempt, response, error, batch_id."""
    return spark.read.option("basePath", answers_path).parquet(f"{answers_path}/batch_id=*/attempt=*")


def stream_extract_once(spark: SparkSession, docs: DataFrame, make_extractor=None, batches: int = 1,
                        **options) -> tuple[DataFrame, DataFrame | None]:
    """Run the stream over stored ``docs`` to its end: what it wrote, and the stored answers (None with the rules).

    ``batches`` splits the documents over about as many micro-batches: of the files that the tasks of ``docs`` write,
    each takes an equal share, so that no task holds a whole micro-batch.
    """
    base = shared_path(spark, "streams", "extract", unique=True)
    files = len(materialize(docs, f"{base}/in").inputFiles())
    if files < batches:  # few rows: the files are too few to deal out
        files = len(materialize(docs.repartition(batches, "doc_id"), f"{base}/in").inputFiles())
    extract = by_rules if make_extractor is None else by_model(make_extractor, f"{base}/answers", **options)
    stream = read_stream(spark, f"{base}/in", docs.schema, None if batches == 1 else max(1, -(-files // batches)))
    stream_extract(stream, extract, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return ingested(spark, f"{base}/out"), None if make_extractor is None else stored_answers(spark, f"{base}/answers")
