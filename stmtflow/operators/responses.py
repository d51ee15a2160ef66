"""Model-response operators: batch model calls, strict validation, bounded retries.

The model itself is outside Spark. ``model_extract`` runs a caller-supplied
function over Arrow batches (one client per task, created once per partition, several calls at
once if asked, each within a deadline); its output is JSON text, which ``validate_response`` checks strictly against a
record schema with native expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import is_blank
from ..functions.validation import parse_object, validate_frame
from ..schemas import BILL_RECORD, INVOICE_RECORD, MODEL_MAX_RETRIES, RecordSchema
from ..session import cut, stored_once
from .calls import as_answered


ANSWERS_AT_ONCE = 256  # rows of an output batch


def _call(make_extractor, attempt: int, schema: T.StructType, concurrency: int, deadline: float | None):
    """One call per document, rows as the answers come; an exception or a missed deadline becomes the row's ``error``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fn = make_extractor()
        key_type = to_arrow_type(schema[0].dataType)

        def rows() -> Iterator:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        def record(held: list) -> pa.RecordBatch:
            keys, answers, errors = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array([attempt] * len(held), pa.int32()), pa.array(answers, pa.string()), pa.array(errors, pa.string())],
                names=[f.name for f in schema])

        held: list = []
        for answered in as_answered(fn, rows(), concurrency, deadline):
            held.append(answered)
            if len(held) >= ANSWERS_AT_ONCE:
                yield record(held)
                held = []
        if held:
            yield record(held)

    return run


def model_extract(df: DataFrame, make_extractor: Callable[[], Callable[[str], str | None]],
                  id_col: str = "doc_id", text_col: str = "text", attempts: int = MODEL_MAX_RETRIES + 1,
                  schema: RecordSchema = BILL_RECORD, concurrency: int = 1, deadline: float | None = None,
                  store: str | None = None) -> DataFrame:
    """Run a black-box extractor over documents: ``(doc_id, attempt, response, error)``.

    ``make_extractor`` is called once per task (client set-up cost is paid per
    partition, not per row) and returns ``fn(text) -> json_text``. Blank documents
    are filtered natively before the Python stage. An exception becomes an ``error`` value for
    that document only. ``concurrency`` calls of a task run at once (``fn`` is then called from several threads),
    and a call without an answer after ``deadline`` seconds (the reference waits ``MODEL_TIMEOUT_SECONDS``) is an ``error``
    too; see ``operators.calls``. With a deadline there is one task a core at most, so that a task's hanging calls are waited
    for together and not task after task. ``attempts`` rounds: each calls the model once for the documents that have no
    valid record yet (it raised, or the strict validation against ``schema`` refused its answer), and
    stores its answers in the shared folder, so a call is never repeated by a later plan. With ``store``,
    round k is Parquet at ``<store>/attempt=<k>``, and one that is complete there is read and not asked again. ``doc_id``
    keeps the type of ``id_col``; keys must be unique.
    """
    todo = df.where(~is_blank(F.col(text_col))).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out_schema = T.StructType([todo.schema["doc_id"], T.StructField("attempt", T.IntegerType()),
                               T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
    rounds = None
    for attempt in range(1, attempts + 1):
        # Batches of the session's byte limit (spark.sql.execution.arrow.maxBytesPerBatch) hold whole documents.
        asked = todo if deadline is None else todo.coalesce(max(1, todo.sparkSession.sparkContext.defaultParallelism))
        answers = asked.mapInArrow(_call(make_extractor, attempt, out_schema, concurrency, deadline), out_schema)
        if store:
            answers = stored_once(answers, f"{store}/attempt={attempt}")
        elif attempts > 1:
            answers = cut(answers)
        rounds = answers if rounds is None else rounds.unionByName(answers)
        if attempt < attempts:
            checked = validate_response(answers, schema=schema, barrier=True)
            open_ids = cut(checked.where(F.size("errors") > 0).select("doc_id"))
            if open_ids.isEmpty():
                break
            todo = todo.join(open_ids, "doc_id", "left_semi")
    return rounds


def validate_response(df: DataFrame, response_col: str = "response",
                      schema: RecordSchema = BILL_RECORD, record_col: str = "record",
                      errors_col: str = "errors", barrier: bool = False) -> DataFrame:
    """Add ``errors`` (array of ``field: code``; empty when valid) and ``record``
    (typed struct, NULL unless valid). Unknown keys are dropped. ``barrier`` keeps later
    filters on the record above the validation (see ``validate_frame``)."""
    staged = df.withColumn("_v", parse_object(F.col(response_col), schema))
    out = validate_frame(staged, "_v", schema, present=F.col(response_col).isNotNull(),
                         errors_col=errors_col, record_col=record_col, barrier=barrier)
    return out.drop("_v")


def validate_invoice(df: DataFrame, response_col: str = "response", **kw) -> DataFrame:
    """``validate_response`` with the invoice schema."""
    return validate_response(df, response_col, INVOICE_RECORD, **kw)


def first_valid_attempt(attempts: DataFrame, max_attempts: int = MODEL_MAX_RETRIES + 1,
                        id_col: str = "doc_id", attempt_col: str = "attempt",
                        record_col: str = "record") -> DataFrame:
    """Of attempts ``1..max_attempts`` per document keep the first valid record.

    Returns ``(doc_id, attempt, record)`` for documents with a valid attempt. The
    ``row_number() = 1`` is planned as a per-key group limit, so each document keeps
    at most one row per map task before the shuffle. Documents with no valid attempt are
    absent (left-join to keep them). The attempt limit is a filter on the input, which Spark
    moves below a validation without barrier; ``first_valid_response`` puts it there itself.
    """
    # Valid attempts sort first; filtering on the record only after the window keeps
    # Catalyst from pushing that predicate into (and so re-running) the validation.
    w = Window.partitionBy(id_col).orderBy(F.col(record_col).isNull(), F.col(attempt_col))
    ranked = (attempts.where(F.col(attempt_col) <= max_attempts)
              .withColumn("_rn", F.row_number().over(w)))
    return (ranked.where((F.col("_rn") == 1) & F.col(record_col).isNotNull())
                  .select(id_col, attempt_col, record_col))


def first_valid_response(responses: DataFrame, max_attempts: int = MODEL_MAX_RETRIES + 1,
                         schema: RecordSchema = BILL_RECORD) -> DataFrame:
    """``first_valid_attempt`` of raw responses: attempts past the limit are never parsed."""
    within = responses.where(F.col("attempt") <= max_attempts)
    return first_valid_attempt(validate_response(within, schema=schema, barrier=True), max_attempts)


def error_detail(errors_col: str = "errors"):
    """Readable validation detail for reasons and logs."""
    n = F.size(errors_col)
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(" validation error: ")).otherwise(
        F.lit(" validation errors: ")), F.array_join(errors_col, "; "))
