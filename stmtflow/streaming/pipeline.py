"""Structured Streaming forms of the pipeline.

* ``stream_ingest``: documents arrive as files; each micro-batch is joined to the
  extraction results (a stream-static join), gets its status and route, and is written
  once, partitioned by branch, with all that the stores and the review need.
* ``stream_corrections``: review requests and reviewer corrections are two streams
  joined on ``doc_id``; the join state holds keys and corrections, not texts, which are
  fetched from the stored requests after the join. A request waits without limit, as the human
  task does in the reference.
* ``stream_append``: accepted rows are appended per micro-batch under
  ``batch_id=<n>``; a replayed batch overwrites its own folder, so the sink is
  idempotent. Ids continue densely from the last id that a small manifest keeps per batch.

Sources read whatever has arrived unless the caller bounds a micro-batch with
``max_files_per_trigger``. The ``*_once`` helpers run a stream to completion with
``availableNow`` from inputs stored under the shared checkpoint folder; they back the registered
queries and tests (batch and stream must agree).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.review import apply_corrections
from ..operators.routing import build_storage_payload, document_status, route_branch, validate_corrected, validate_direct
from ..operators.store import assign_ids, constraint_error, number_rows, table_rows
from ..plans.pipeline import extraction_results
from ..schemas import BILLS_TABLE, STATUS_COMPLETED
from ..session import CODEC, materialize, path_exists, shared_path, shuffles_removed, stored

STREAM_BILLS = T.StructType(BILLS_TABLE.fields + [T.StructField("batch_id", T.LongType(), True)])
MANIFEST = "batch_id bigint, last_id bigint"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def start_stream(spark: SparkSession, writer, checkpoint: str, available_now: bool, processing_time: str | None):
    """Start a stream whose micro-batches store what they make; the shuffles of each are removed when it ends."""
    writer = writer.option("checkpointLocation", checkpoint)
    with shuffles_removed(spark):  # a stream keeps the settings of its start
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)).start()


def stream_ingest(spark: SparkSession, docs_path: str, docs_schema: T.StructType,
                  results: DataFrame, out_path: str, checkpoint: str,
                  max_files_per_trigger: int | None = None, available_now: bool = True,
                  processing_time: str | None = None):
    """Start the ingest stream; returns the ``StreamingQuery``.

    ``results`` is the static ``(doc_id, record)`` frame. A stream-static
    join re-reads the static side for every micro-batch, so pass a stored table
    (``session.materialize`` or a bucketed table), not a plan that validates all
    responses again each time. Each batch is written once as
    ``out_path/batch_id=<n>/branch=<success|failure|unrouted>`` (overwrite, so a
    replayed batch replaces itself): document, record, status, route and reason.
    """
    docs = read_stream(spark, docs_path, docs_schema, max_files_per_trigger)
    processed = document_status(docs.join(results, "doc_id", "left")).withColumn("branch", route_branch())

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("branch").parquet(f"{out_path}/batch_id={batch_id}", compression=CODEC)

    return start_stream(spark, processed.writeStream.foreachBatch(write_batch), checkpoint, available_now, processing_time)


def ingested(spark: SparkSession, out_path: str) -> DataFrame:
    """What the ingest stream has written so far (with ``batch_id`` and ``branch``)."""
    return spark.read.option("basePath", out_path).parquet(f"{out_path}/batch_id=*")


def _ingest_into(spark: SparkSession, base: str, docs: DataFrame, responses: DataFrame, batches: int = 1) -> str:
    files = len(materialize(docs, f"{base}/in", CODEC).inputFiles())
    results = materialize(extraction_results(responses), f"{base}/results", CODEC)
    stream_ingest(spark, f"{base}/in", docs.schema, results, f"{base}/out", f"{base}/checkpoint",
                  None if batches == 1 else max(1, -(-files // batches))).awaitTermination()
    return f"{base}/out"


def stream_ingest_once(spark: SparkSession, docs: DataFrame, responses: DataFrame, batches: int = 1) -> DataFrame:
    """``batches`` splits the documents over at most as many micro-batches, by the files that the tasks of ``docs`` write:
    only the texts of one of them lie in a shuffle at a time."""
    return ingested(spark, _ingest_into(spark, shared_path(spark, "streams", "ingest", unique=True), docs, responses, batches))


def stream_corrections(queue: DataFrame, corrections: DataFrame, requests: DataFrame, out_path: str, checkpoint: str,
                       available_now: bool = True, processing_time: str | None = None):
    """Start the correction stream; returns the query.

    ``queue`` and ``corrections`` are streams; only their keys and the corrected JSON enter the join
    state. Each batch of matches is joined to ``requests`` (the stored review requests, read
    again per batch) for text, type and path, validated, and written to ``out_path/batch_id=<n>``.
    """
    matched = queue.select("doc_id").join(corrections.select("doc_id", "corrected"), "doc_id", "inner")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        apply_corrections(requests, batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}", compression=CODEC)

    return start_stream(queue.sparkSession, matched.writeStream.foreachBatch(write_batch), checkpoint, available_now, processing_time)


def _corrections_into(spark: SparkSession, base: str, requests: DataFrame, corrections: DataFrame) -> str:
    stored = materialize(requests, f"{base}/queue", CODEC)
    materialize(corrections, f"{base}/corrections", CODEC)
    stream_corrections(read_stream(spark, f"{base}/queue", requests.schema),
                       read_stream(spark, f"{base}/corrections", corrections.schema),
                       stored, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return f"{base}/out"


def stream_corrections_once(spark: SparkSession, queue: DataFrame, corrections: DataFrame) -> DataFrame:
    return ingested(spark, _corrections_into(spark, shared_path(spark, "streams", "corrections", unique=True), queue, corrections))


def last_id_before(spark: SparkSession, table: str, batch_id: int) -> int:
    """Last id of the batches before this one, from the manifest (one small file per batch).

    Only a manifest that does not exist yet means 0; any failure to read it is raised.
    """
    manifest = f"{table}_manifest"
    if not path_exists(spark, manifest):
        return 0
    rows = spark.read.schema(MANIFEST).option("basePath", manifest).parquet(f"{manifest}/batch_id=*")
    return int(rows.where(F.col("batch_id") < batch_id).agg(F.max("last_id")).first()[0] or 0)


def append_batch(batch: DataFrame, batch_id: int, table: str, order_col: str = "doc_id", reread: bool = False) -> None:
    """Write one micro-batch of table-layout rows with dense ids after earlier batches.

    The batch is computed once and stored, then numbered and written; with ``reread``, for a batch that is only read from
    files, no copy of it is stored: its keys are numbered first, then it is read again and written.
    """
    spark = batch.sparkSession
    rows = batch if reread else stored(batch)
    base = last_id_before(spark, table, batch_id)
    written = f"{table}/batch_id={batch_id}"
    with shuffles_removed(spark):
        numbered = (assign_ids if reread else number_rows)(rows, order_col, base).withColumn("created_at", F.current_timestamp())
        numbered.select(*[f.name for f in BILLS_TABLE.fields]).write.mode("overwrite").parquet(written, compression=CODEC)
    n = spark.read.schema(BILLS_TABLE).parquet(written).count()
    # After the rows: a batch that fails before this line is replayed whole, with the same ids.
    (spark.range(1).select(F.lit(base + n).cast("bigint").alias("last_id")).coalesce(1)
     .write.mode("overwrite").parquet(f"{table}_manifest/batch_id={batch_id}"))


def stream_append(rows: DataFrame, table: str, checkpoint: str, available_now: bool = True,
                  processing_time: str | None = None, reread: bool = False):
    """Start the append stream for table-layout rows (with ``doc_id``); returns the query. ``reread``: see ``append_batch``."""
    return start_stream(rows.sparkSession, rows.writeStream.foreachBatch(lambda b, i: append_batch(b, i, table, reread=reread)),
                        checkpoint, available_now, processing_time)


def read_stream_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(STREAM_BILLS).option("basePath", table).parquet(f"{table}/batch_id=*")


def stream_append_once(spark: SparkSession, stored: DataFrame) -> DataFrame:
    base = shared_path(spark, "streams", "append", unique=True)
    rows = stored.drop("branch")
    materialize(rows, f"{base}/in", CODEC)
    stream_append(read_stream(spark, f"{base}/in", rows.schema), f"{base}/table", f"{base}/checkpoint", reread=True).awaitTermination()
    return read_stream_table(spark, f"{base}/table")


def accepted_rows(ingest_out: DataFrame, corrected: DataFrame) -> DataFrame:
    """Table-layout rows (with ``doc_id`` and ``branch``) that the two stores accept."""
    direct = build_storage_payload(ingest_out.where(F.col("branch") == "success"))
    direct = validate_direct(direct.withColumn("store_error", constraint_error("payload.record", "payload.document_type")))
    reviewed = validate_corrected(corrected.withColumn("store_error", constraint_error("record", "document_type_hint")))
    ok = F.col("store_status") == STATUS_COMPLETED
    return (table_rows(direct.where(ok), "payload.record", "payload.full_ocr_text", "payload.document_type")
            .withColumn("branch", F.lit("direct"))
            .unionByName(table_rows(reviewed.where(ok), "record", "full_ocr_text", "document_type_hint")
                         .withColumn("branch", F.lit("corrected"))))


def stream_all_once(spark: SparkSession, docs: DataFrame, responses: DataFrame, corrections: DataFrame) -> DataFrame:
    """Ingest, corrections and append one after another, each reading only what the one before wrote."""
    base = shared_path(spark, "streams", "all", unique=True)
    out = ingested(spark, _ingest_into(spark, f"{base}/ingest", docs, responses))
    requests = out.where(F.col("branch") == "failure").select(
        "doc_id", F.col("text").alias("full_ocr_text"), "document_type_hint", F.col("document_path").alias("original_document_path"))
    corrected = ingested(spark, _corrections_into(spark, f"{base}/corrections", requests, corrections))
    return stream_append_once(spark, accepted_rows(out, corrected))
