"""Review requests and corrections as one stream with a memory per document.

Every request and correction that arrives changes the state of its document, and every change comes
out as a row ``(doc_id, state, corrected)``:

* ``waiting``: a request has come and no correction yet;
* ``corrected``: the first correction has met its request, whichever came before the other;
* ``repeated``: one more correction for the same request, which has its answer already;
* ``expired``: with a limit, a request that has waited so long; it stays pending, for somebody else to take up;
* ``late``: a correction that came after its request had expired;
* ``unrequested``: with a limit, a correction that has waited so long for a request.

The memory holds keys and corrections, never texts. Without a limit a request waits for ever, as the human task of
the workflow does, and its key is kept. With a limit timers end every wait, and a document is forgotten one
limit after its last change, so the memory is that of two limits. Time is that of the cluster's clock,
not of the rows: no row is ever too late to be seen. Timers keep the stream open, so a stream with
a limit runs by ``processing_time`` and not to the end of the data at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.review import apply_corrections
from ..session import CODEC, materialize, shared_path
from .pipeline import ingested, read_stream, start_stream

WAITING, CORRECTED, REPEATED, EXPIRED, LATE, UNREQUESTED = "waiting", "corrected", "repeated", "expired", "late", "unrequested"
EARLY = "early"  # a correction before its request: kept, not reported
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ReviewProcessor(StatefulProcessor):
    """State of one document: phase, the correction that waits for its request, and when the wait ends."""

    def __init__(self, limit_ms: int | None):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.review = handle.getValueState("review", "phase string, corrected string, due bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        asked, corrections = False, []
        for row in rows:
            if row["kind"] == "request":
                asked = True
            else:
                corrections.append((row["place"] is None, row["place"], row["corrected"] is None, row["corrected"]))
        corrections = [c[3] for c in sorted(corrections, key=lambda c: (c[0], c[1] or "", c[2], c[3] or ""))]
        phase, kept, _ = self.review.get() if self.review.exists() else (None, None, None)
        before = phase
        if phase in (None, EARLY):
            if phase is None and corrections:
                phase, kept = EARLY, corrections.pop(0)
            if asked and phase == EARLY:
                phase = CORRECTED
                yield Row(doc_id=key[0], state=CORRECTED, corrected=kept)
                kept = None
            elif asked:
                phase = WAITING
                yield Row(doc_id=key[0], state=WAITING, corrected=None)
        elif phase == WAITING and corrections:
            phase = CORRECTED
            yield Row(doc_id=key[0], state=CORRECTED, corrected=corrections.pop(0))
        for more in corrections:
            yield Row(doc_id=key[0], state=LATE if phase == EXPIRED else REPEATED, corrected=more)
        if phase != before:
            self.enter(phase, kept, timerValues)

    def enter(self, phase: str, kept: str | None, timerValues) -> None:
        due = None
        if self.limit_ms is not None:
            due = timerValues.getCurrentProcessingTimeInMs() + self.limit_ms
            self.handle.registerTimer(due)
        self.review.update((phase, kept, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.review.exists():
            return
        phase, kept, due = self.review.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return  # the timer of an earlier phase
        if phase == WAITING:
            self.enter(EXPIRED, None, timerValues)
            yield Row(doc_id=key[0], state=EXPIRED, corrected=None)
        else:
            self.review.clear()
            if phase == EARLY:
                yield Row(doc_id=key[0], state=UNREQUESTED, corrected=kept)

    def close(self) -> None:
        pass


def review_states(queue: DataFrame, corrections: DataFrame, limit_seconds: float | None = None, order_col: str | None = None) -> DataFrame:
    """Streams of requests (doc_id) and corrections (doc_id, corrected) -> every change as (doc_id, state, corrected).

    Of corrections that arrive in one micro-batch the first by ``order_col`` counts (nulls last; then, and without it, by their text).
    """
    place = F.col(order_col).cast("string") if order_col else F.lit(None).cast("string")
    both = (queue.select("doc_id", F.lit("request").alias("kind"), F.lit(None).cast("string").alias("corrected"), F.lit(None).cast("string").alias("place"))
            .unionByName(corrections.select("doc_id", F.lit("correction").alias("kind"), F.col("corrected").cast("string").alias("corrected"), place.alias("place"))))
    out = T.StructType([T.StructField("doc_id", both.schema["doc_id"].dataType), T.StructField("state", T.StringType()), T.StructField("corrected", T.StringType())])
    limit_ms = None if limit_seconds is None else int(limit_seconds * 1000)
    return both.groupBy("doc_id").transformWithState(statefulProcessor=ReviewProcessor(limit_ms), outputStructType=out, outputMode="Append",
                                                     timeMode="None" if limit_ms is None else "ProcessingTime")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which keyed state with timers needs; others are not touched."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def stream_reviews(queue: DataFrame, corrections: DataFrame, requests: DataFrame, out_path: str, checkpoint: str,
                   limit_seconds: float | None = None, order_col: str | None = None, available_now: bool = True,
                   processing_time: str | None = None):
    """Start the review stream; returns the query.

    ``queue`` and ``corrections`` are streams, ``requests`` the stored review requests, which give text, type and path. Each
    micro-batch is written twice: all changes as ``<out_path>/states/batch_id=<n>``, and the corrected
    documents, validated, as ``<out_path>/corrected/batch_id=<n>``.
    """
    if limit_seconds is not None and available_now:
        raise ValueError("a stream with a limit waits for its timers: give processing_time, with available_now=False")
    states = review_states(queue, corrections, limit_seconds, order_col)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out_path}/states/batch_id={batch_id}", compression=CODEC)
        stored = spark.read.schema(batch.schema).parquet(f"{out_path}/states/batch_id={batch_id}")  # the state is asked once a batch
        done = stored.where(F.col("state") == CORRECTED).select("doc_id", "corrected")
        apply_corrections(requests, done).write.mode("overwrite").parquet(f"{out_path}/corrected/batch_id={batch_id}", compression=CODEC)

    with rocksdb_state(queue.sparkSession):
        return start_stream(queue.sparkSession, states.writeStream.outputMode("append").foreachBatch(write_batch), checkpoint, available_now, processing_time)


def still_pending(states: DataFrame) -> DataFrame:
    """(doc_id, state) of the requests without a correction: ``waiting`` or ``expired``, from all changes so far."""
    is_in = lambda s: F.max((F.col("state") == s).cast("int"))
    per = states.groupBy("doc_id").agg(is_in(WAITING).alias("w"), is_in(CORRECTED).alias("c"), is_in(EXPIRED).alias("e"))
    return per.where("w = 1 AND c = 0").select("doc_id", F.when(F.col("e") == 1, EXPIRED).otherwise(WAITING).alias("state"))


def stream_reviews_once(spark: SparkSession, requests: DataFrame, corrections: DataFrame, order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the review stream over stored inputs to their end: (all changes, corrected documents)."""
    base = shared_path(spark, "streams", "reviews", unique=True)
    stored = materialize(requests, f"{base}/queue", CODEC)
    materialize(corrections, f"{base}/corrections", CODEC)
    stream_reviews(read_stream(spark, f"{base}/queue", requests.schema), read_stream(spark, f"{base}/corrections", corrections.schema),
                   stored, f"{base}/out", f"{base}/checkpoint", order_col=order_col).awaitTermination()
    return ingested(spark, f"{base}/out/states"), ingested(spark, f"{base}/out/corrected")
