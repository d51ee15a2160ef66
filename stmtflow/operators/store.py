"""The target table: contract, constraints, JSON encoding, ids and appends.

The table is Parquet with a fixed schema (``schemas.BILLS_TABLE``). It is
append-only with no unique key, as in the reference: rerunning an append
duplicates rows. Ids are dense and increasing, assigned in ``doc_id`` order from
one past the current maximum, without collecting rows or using an unpartitioned
window (see ``assign_ids`` for keys, ``number_rows`` for rows to be written).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import (
    ACCOUNT_MAX_CHARS, AMOUNT_FIELDS, AMOUNT_TYPE, BILL_RECORD, BILLS_TABLE, BILLS_TABLE_DDL,
    DOCUMENT_TYPE_MAX_CHARS,
)
from ..session import CODEC, cut, shuffles_removed, stored


def encode_line_items(items) -> Column:
    """List -> JSON text with item nulls kept; NULL or empty list -> NULL."""
    items = F.col(items) if isinstance(items, str) else items
    return F.when(F.size(items) > 0, F.to_json(items, {"ignoreNullFields": "false"}))


def record_to_row(record_col: str = "record", text_col: str = "full_ocr_text",
                  type_col: str = "document_type") -> list[Column]:
    """The table columns (without ``id`` and ``created_at``) from a record struct."""
    r = F.col(record_col)
    cols = []
    for f in BILL_RECORD.spark_type().fields:
        if f.name == "line_items":
            cols.append(encode_line_items(r["line_items"]).alias("line_items"))
        elif f.name in AMOUNT_FIELDS:
            cols.append(r[f.name].try_cast(AMOUNT_TYPE).alias(f.name))
        else:
            cols.append(r[f.name].alias(f.name))
    cols.append(F.col(text_col).alias("raw_ocr_text"))
    cols.append(F.col(type_col).alias("document_type"))
    return cols


def constraint_error(record_col: str = "record", type_col: str = "document_type") -> Column:
    """Why the target would refuse the row, or NULL.

    Amounts beyond NUMERIC(10,2) (after half-up rounding) or not finite; NaN or
    infinite item amounts (not valid JSON); account over 255 and type over 100
    characters.
    """
    r = F.col(record_col)
    checks = []
    for name in AMOUNT_FIELDS:
        v = r[name]
        checks.append(F.when(v.isNotNull() & v.try_cast(AMOUNT_TYPE).isNull(),
                             F.lit(f"numeric field overflow: {name}")))
    item_bad = F.exists(F.coalesce(r["line_items"], F.array()), lambda it: F.isnan(it["amount"])
                        | (F.abs(it["amount"]) == F.lit(float("inf"))))
    checks.append(F.when(item_bad, F.lit("invalid number in line_items")))
    checks.append(F.when(F.length(r["account_number"]) > ACCOUNT_MAX_CHARS,
                         F.lit(f"value too long for account_number ({ACCOUNT_MAX_CHARS})")))
    checks.append(F.when(F.length(F.col(type_col)) > DOCUMENT_TYPE_MAX_CHARS,
                         F.lit(f"value too long for document_type ({DOCUMENT_TYPE_MAX_CHARS})")))
    return F.coalesce(*checks)


def enforce_store_constraints(df: DataFrame, record_col: str = "record",
                              type_col: str = "document_type") -> DataFrame:
    """Add ``store_error``: rows the target table would refuse are marked, not dropped."""
    return df.withColumn("store_error", constraint_error(record_col, type_col))


def assign_ids(df: DataFrame, order_col: str = "doc_id", start: int | Column = 0,
               id_col: str = "id", parts: int | None = None) -> DataFrame:
    """Dense ids ``start+1 ..`` in ``order_col`` order; keys of any orderable type, NULL last.

    Only keys are numbered; rows get their id by a join on the key:
    1. distinct keys with their row counts (partial counts before the shuffle) are
       range-partitioned, so parts are balanced by the keys themselves, and stored once in the
       shared folder: every later step sees the same parts, also after a lost executor;
    2. rows per part -> running offsets, a window over a table of ``parts`` rows (its
       broadcast is bounded by that number);
    3. a running sum within each part gives every key its first id.
    The join is a plain equality, so rows that are partitioned by the key already stay where they are; NULL
    has its first id after all others. Rows that share a key are numbered among themselves by a hash of the row. The input is read
    twice (keys, ids): store a costly one first (``session.cut``). A key that only the second reading has is an error.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.groupBy(F.col(order_col).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut(keys.repartitionByRange(n, F.col("_k").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("_t"), F.max("_n").alias("_most"), F.sum(F.when(F.col("_k").isNotNull(), F.col("_n"))).alias("_named"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_part").orderBy(F.col("_k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    start_col = (start if isinstance(start, Column) else F.lit(start)).cast("long")
    first = ranged.join(F.broadcast(offsets), "_part").where(F.col("_k").isNotNull()).select(
        "_k", (start_col + F.col("_off") + F.coalesce(F.sum("_n").over(within), F.lit(0)) + 1).alias("_first"))
    most, named = totals.agg(F.max("_most"), F.sum("_named")).first()
    joined = df.join(first, F.col(order_col) == F.col("_k"), "left")
    found = F.when(F.col(order_col).isNull(), start_col + F.lit(named or 0) + 1).otherwise(
        F.coalesce("_first", F.raise_error(F.lit("the keys changed between two readings of the rows")).cast("long")))
    nth = F.lit(0)
    if (most or 0) > 1:
        nth = F.row_number().over(Window.partitionBy(order_col).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))) - 1
    return joined.withColumn(id_col, found + nth).drop("_k", "_first")


def range_bounds(df: DataFrame, order_col: str, parts: int) -> list:
    """At most ``parts`` - 1 keys that cut the rows into about equal ranges, from a sample of about 64 keys a part."""
    n = df.count()
    share = min(1.0, 64.0 * parts / max(n, 1))
    keys = df.select(F.col(order_col).alias("_k")).where(F.col("_k").isNotNull())
    # By a hash of the key, so that a run after a lost executor takes the same sample.
    keys = keys.where(F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < share * (1 << 30)) if share < 1 else keys
    held = [r["_k"] for r in keys.distinct().orderBy("_k").collect()]  # about 64 * parts keys
    return sorted({held[i * len(held) // parts] for i in range(1, parts)}) if held else []


def number_rows(df: DataFrame, order_col: str = "doc_id", start: int = 0, id_col: str = "id", parts: int | None = None) -> DataFrame:
    """Dense ids ``start+1 ..`` in ``order_col`` order, those of ``assign_ids``, given to the rows where they lie.

    Rows go to their key's range, which is the only exchange of their texts; how many rows each range holds is
    counted before, from the keys alone, so every range knows its first id and numbers its rows by a running count.
    ``df`` is read three times (sample, counts, rows): store a costly one first. Rows of equal key are ordered by a hash
    of the row and share a range.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(df, order_col, n)
    kind = df.schema[order_col].dataType
    limits = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(T.ArrayType(kind))
    key = F.col(order_col)
    rows = df.withColumn("_part", F.when(key.isNull(), len(bounds) + 1).otherwise(F.size(F.filter(limits, lambda b: b <= key))))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_off"))  # one row a range
    within = Window.partitionBy("_part").orderBy(key.asc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    numbered = rows.repartition(n, "_part").withColumn("_nth", F.row_number().over(within))
    return (numbered.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
            .withColumn(id_col, F.col("_off") + F.col("_nth")).drop("_part", "_of", "_off", "_nth"))


def ensure_bills_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Create the table at ``path`` if absent (an existing table is left untouched).

    With ``name``, also registers it in the catalog via
    ``CREATE TABLE IF NOT EXISTS .. USING parquet LOCATION``.
    """
    spark.createDataFrame([], BILLS_TABLE).write.mode("ignore").parquet(path)
    if name:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({BILLS_TABLE_DDL}) USING parquet LOCATION '{path}'")
    return spark.read.schema(BILLS_TABLE).parquet(path)


def current_max_id(spark: SparkSession, path: str) -> int:
    """Largest stored id (0 for an empty table): one scalar from a scan of the id column alone."""
    row = spark.read.schema(BILLS_TABLE).parquet(path).agg(F.max("id").alias("m")).first()
    return int(row["m"] or 0)


def table_rows(df: DataFrame, record_col: str = "record", text_col: str = "full_ocr_text",
               type_col: str = "document_type", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Accepted rows in table layout (plus ``keep`` columns, without id)."""
    return df.select(*keep, *record_to_row(record_col, text_col, type_col))


def append_rows(rows: DataFrame, path: str, order_col: str = "doc_id", reread: bool = False) -> DataFrame:
    """Append rows already in table layout (no ``id``/``created_at``) and return them,
    read back from disk, with their new ids.

    The rows are computed once, stored and numbered from there. With ``reread``, for rows whose keys are cheap to compute
    by themselves, nothing is stored beside the table: the keys are numbered first (``assign_ids``, the same ids), then the
    rows are computed and written with them; rows that are partitioned by ``order_col`` are not exchanged either.
    """
    spark = rows.sparkSession
    rows = rows if reread else stored(rows)
    ensure_bills_table(spark, path)
    base = current_max_id(spark, path)
    with shuffles_removed(spark):
        numbered = assign_ids(rows, order_col, base) if reread else number_rows(rows, order_col, base)
        with_ids = numbered.withColumn("created_at", F.current_timestamp())
        with_ids.select(*[f.name for f in BILLS_TABLE.fields]).write.mode("append").parquet(path, compression=CODEC)
    return spark.read.schema(BILLS_TABLE).parquet(path).where(F.col("id") > base)


def append_bills(df: DataFrame, path: str, order_col: str = "doc_id",
                 record_col: str = "record", text_col: str = "full_ocr_text",
                 type_col: str = "document_type") -> DataFrame:
    """Append accepted records and return them with their new ids (read back from disk).

    Rows with a ``store_error`` are not written. One writer per table at a time;
    the stream sink (``streaming.stream_append``) makes replays idempotent.
    """
    accepted = df.where(F.col("store_error").isNull()) if "store_error" in df.columns else df
    return append_rows(table_rows(accepted, record_col, text_col, type_col, keep=(order_col,)), path, order_col)


def export_records_json(df: DataFrame, record_col: str = "record", id_col: str = "doc_id",
                        path: str | None = None, mode: str = "error") -> DataFrame:
    """Records as indented JSON text with nulls kept: ``(id, json)``.

    With ``path`` also written there as JSON lines, each with its id and the (multi-line) JSON as one
    string field; an existing path is an error unless ``mode`` says otherwise.
    """
    out = df.select(F.col(id_col), F.to_json(F.col(record_col),
                                             {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))
    if path:
        out.write.mode(mode).json(path)
    return out
