"""Strict typed validation of JSON text against a ``RecordSchema``.

``from_json`` is too lenient (it turns the number 123 into the string "123", accepts
``2018-2-3`` and rejects ``"12.5"`` for a double), so each field is read as a VARIANT,
its JSON type is taken from ``schema_of_variant`` and the accept/convert rules are
applied per type. Missing keys and JSON ``null`` both give NULL; unknown keys are
ignored. Every expression is native; nothing runs in Python per row.

Error codes follow the usual validation vocabulary: ``json_invalid``, ``model_type``,
``string_type``, ``float_type``, ``float_parsing``, ``date_type``,
``date_parsing`` (year 0), ``date_from_datetime_parsing``, ``date_from_datetime_inexact``, ``list_type``.
"""

from __future__ import annotations

import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DATE, FLOAT, STRING, ListOf, RecordSchema
from .text import col_of

# No repeated groups: text of any length is matched by loops, not by recursion.
JSON_SPACE = r"\t\n\x0b\x0c\r \x85\p{Z}"
FLOAT_STRING_RE = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf|infinity)$"
ISO_DATE_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_ZONE = r"(?:[Zz]|[+\-\u2212](?:[01][0-9]|2[0-3]):?[0-5][0-9])?$"
ISO_MIDNIGHT_RE = ISO_DATE_RE + r"(?:$|[Tt _]00:00(?::00(?:[.,]0+)?)?" + _ZONE + ")"
ISO_DATETIME_RE = ISO_DATE_RE + r"[Tt _](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.,][0-9]+)?)?" + _ZONE
EPOCH_STRING_RE = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
# Seconds of the first and the last day that a date can hold (years 1 to 9999).
EPOCH_FIRST, EPOCH_LAST = -62_135_596_800.0, 253_402_300_799.0
# Numbers above this magnitude are epoch milliseconds, below it epoch seconds.
EPOCH_MS_THRESHOLD = 2e10
NUMERIC_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def _type_of(x: Column) -> Column:
    """JSON type name of a variant; ``ABSENT`` for a missing key, ``VOID`` for null."""
    return F.coalesce(F.schema_of_variant(x), F.lit("ABSENT"))


def _is_numeric(t: Column) -> Column:
    return t.isin(*NUMERIC_TYPES) | t.startswith("DECIMAL")


def _absent(t: Column) -> Column:
    return t.isin("ABSENT", "VOID")


def _as(x: Column, spark_type: str) -> Column:
    return F.try_variant_get(x, "$", spark_type)


def _plain(x: Column, t: Column) -> Column:
    """What a JSON string, or a number as it is written, says; other types NULL.

    To be kept in a column where it is used more than once: each conversion of a single variant value builds an
    expression and its settings anew.
    """
    return F.when((t == "STRING") | _is_numeric(t), _as(x, "string"))


def _day(s: Column) -> Column:
    """The day that a text begins with, NULL for none."""
    return F.when(s.rlike(ISO_DATE_RE) & ~s.startswith("0000"), F.substring(s, 1, 10).try_cast("date"))


def _check_string(x: Column, t: Column, plain: Column, day: Column | None):
    err = F.when(~(_absent(t) | (t == "STRING")), F.lit("string_type"))
    return err, F.when(t == "STRING", plain)


def _check_float(x: Column, t: Column, plain: Column, day: Column | None):
    s = F.regexp_replace(plain, rf"^[{JSON_SPACE}]+|[{JSON_SPACE}]+$", "")
    digits = F.translate(s, "_", "")  # single underscores inside the number are ignored
    str_ok = (t == "STRING") & ~(s.startswith("_") | s.endswith("_") | s.contains("__")) & digits.rlike(FLOAT_STRING_RE)
    err = (F.when(_absent(t) | _is_numeric(t) | (t == "BOOLEAN") | str_ok, F.lit(None).cast("string"))
           .when(t == "STRING", F.lit("float_parsing"))
           .otherwise(F.lit("float_type")))
    value = (F.when(t == "BOOLEAN", F.when(_as(x, "boolean"), F.lit(1.0)).otherwise(F.lit(0.0)))
             .when(_is_numeric(t), plain.try_cast("double"))
             .when(str_ok, F.regexp_replace(digits, r"(?i)^[+-](?=nan$)", "").try_cast("double")))
    return err, value


def _epoch_date(n: Column):
    """(in range, is midnight, date) for epoch seconds, or milliseconds above the threshold."""
    seconds = F.when(F.abs(n) > F.lit(EPOCH_MS_THRESHOLD), n / F.lit(1000.0)).otherwise(n)
    known = F.coalesce(~F.isnan(n) & seconds.between(EPOCH_FIRST, EPOCH_LAST), F.lit(False))
    exact = known & ((seconds % F.lit(86_400.0)) == 0)
    return known, exact, F.when(exact, F.date_from_unix_date((seconds / 86_400.0).cast("int")))


def _check_date(x: Column, t: Column, plain: Column, day: Column | None):
    s = plain
    is_str = t == "STRING"
    year_zero = is_str & s.rlike(r"^0000-[0-9]{2}-[0-9]{2}$")
    day = _day(s) if day is None else day
    iso_ok = is_str & day.isNotNull() & ((F.length(s) == 10) | s.rlike(ISO_MIDNIGHT_RE))
    iso_inexact = is_str & day.isNotNull() & s.rlike(ISO_DATETIME_RE) & ~iso_ok
    epoch_str = is_str & s.rlike(EPOCH_STRING_RE)
    n = F.when(_is_numeric(t) | epoch_str, s.try_cast("double"))
    known, exact, epoch_day = _epoch_date(n)
    is_num = _is_numeric(t) | epoch_str
    err = (F.when(_absent(t) | iso_ok | (is_num & exact), F.lit(None).cast("string"))
           .when(iso_inexact | (is_num & known), F.lit("date_from_datetime_inexact"))
           .when(year_zero, F.lit("date_parsing"))
           .when(is_str | is_num, F.lit("date_from_datetime_parsing"))
           .otherwise(F.lit("date_type")))
    value = F.when(iso_ok, day).when(is_num & exact, epoch_day)
    return err, value


_SCALAR_CHECKS = {STRING: _check_string, FLOAT: _check_float, DATE: _check_date}


def _staged_item(e: Column, item: RecordSchema) -> Column:
    """One list element with its JSON type and each field's variant and type, computed once."""
    parts = [e.alias("v"), _type_of(e).alias("t")]
    for name, _ in item.fields:
        x = F.try_variant_get(e, f"$.{name}", "variant")
        parts += [x.alias(f"x_{name}"), _type_of(x).alias(f"t_{name}")]
    return F.struct(*parts)


# Types of items without any error, by the kind of the field; of other kinds each value is looked at.
_EVEN_TYPES = {STRING: "(?:STRING|VOID)", FLOAT: r"(?:BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\)|VOID)"}


def _even_list(t: Column, item: RecordSchema) -> Column:
    """Whether the type of a whole list says that its objects hold nothing but fitting values (there may be nulls beside them)."""
    if not all(kind in _EVEN_TYPES for _, kind in item.fields):
        return F.lit(False)
    fields = "".join(rf"(?:(?:, )?{name}: {_EVEN_TYPES[kind]})?" for name, kind in sorted(item.fields))
    return t.rlike(rf"^ARRAY<(?:VOID|OBJECT<{fields}>)>$")


def _stager(item: RecordSchema):
    return lambda e: _staged_item(e, item)


def _check_list(items: Column, t: Column, item: RecordSchema, even: Column):
    """``items``: the staged elements (see ``_staged_item``); ``t``: the list's JSON type; ``even``: the values of a list
    whose type alone shows that its objects are right, for which there are no ``items``."""

    def check(e: Column, name: str, kind) -> tuple[Column, Column]:
        x, t = e[f"x_{name}"], e[f"t_{name}"]
        return _SCALAR_CHECKS[kind](x, t, _plain(x, t), None)

    def item_error(e: Column) -> Column:
        errs = [F.concat(F.lit(f"{name}: "), check(e, name, kind)[0]) for name, kind in item.fields]
        first = F.try_element_at(F.array_compact(F.array(*errs)), F.lit(1))
        return F.when(~e["t"].startswith("OBJECT"), F.lit("model_type")).otherwise(first)

    def item_value(e: Column) -> Column:
        return F.struct(*[check(e, name, kind)[1].alias(name) for name, kind in item.fields])

    is_arr = t.startswith("ARRAY")
    item_err = (F.when(even.isNotNull(), F.when(F.exists(even, lambda e: e.isNull()), F.lit("model_type")))
                .otherwise(F.try_element_at(F.array_compact(F.transform(items, item_error)), F.lit(1))))
    err = (F.when(_absent(t), F.lit(None).cast("string"))
           .when(is_arr, item_err)
           .otherwise(F.lit("list_type")))
    return err, F.when(even.isNotNull(), even).when(is_arr, F.transform(items, item_value))


def parse_object(text, schema: RecordSchema | None = None) -> Column:
    """Parse JSON text to VARIANT; NULL for invalid JSON or anything after the first value.

    The parser stops behind a complete value, so the text is parsed as the first of exactly two
    elements of a list, the second one a mark of our own. With ``schema``, what it refuses is read once more by
    ``tolerant_object``; texts that it accepts pay nothing for that.
    """
    strict = _strict_value(col_of(text))
    return strict if schema is None else F.coalesce(strict, tolerant_object(text, schema))


def tolerant_object(text, schema: RecordSchema) -> Column:
    """The fields of ``schema`` in an object that repeats keys (the last one counts) or holds a bare NaN or Infinity; else NULL.

    Only these two liberties: the text has to be one object and nothing else, as a mark of our own behind it shows. Objects within a field may hold such numbers, but no repeated keys.
    """
    text = col_of(text)
    fields = ", ".join(f"`{name}`: variant" for name in schema.names)
    rows = F.from_json(F.concat(F.lit("["), text, F.lit(', {"end of text": "end"}]')), f"array<struct<{fields}, `end of text`: string>>",
                       {"allowSingleQuotes": "false"})
    # Through a list of one, so that the text is parsed once for all that is asked of it.
    found = F.transform(F.array(rows), lambda r: F.when((F.size(r) == 2) & (F.get(r, 1)["end of text"] == "end"), F.to_variant_object(F.get(r, 0))))
    return F.when(text.rlike(r"\A[ \t\n\r]*\{"), F.get(found, 0))


def _strict_value(text: Column) -> Column:
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "end of text"]')))
    whole = (F.to_json(F.try_variant_get(pair, "$[1]", "variant")) == '"end of text"') & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


_built: dict[tuple, tuple] = {}


def _expressions(variant_col: str, schema: RecordSchema) -> tuple[list[list[Column]], Column, Column]:
    """Columns of the projections before the last two, the errors and the values, all by name.

    Thousands of calls into the JVM go into them and they depend on no frame, so they are built once per process.
    """
    key = (variant_col, schema.name, schema.fields, id(SparkContext._gateway))
    if key in _built:
        return _built[key]
    v = F.col(variant_col)
    fields, types = [F.schema_of_variant(v).alias("_top")], []
    plains, days = [], []
    for name, kind in schema.fields:
        x, t = F.col(f"_x_{name}"), F.col(f"_t_{name}")
        fields.append(F.try_variant_get(v, f"$.{name}", "variant").alias(f"_x_{name}"))
        types.append(_type_of(x).alias(f"_t_{name}"))
        if isinstance(kind, ListOf):
            values = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in kind.item.spark_type().fields)
            plains.append(F.when(_even_list(t, kind.item), F.from_json(F.to_json(x), f"array<struct<{values}>>")).alias(f"_e_{name}"))
            days.append(F.when(F.col(f"_e_{name}").isNull(), F.transform(_as(x, "array<variant>"), _stager(kind.item))).alias(f"_i_{name}"))
        else:
            plains.append(_plain(x, t).alias(f"_p_{name}"))
            if kind == DATE:
                days.append(F.when(t == "STRING", _day(F.col(f"_p_{name}"))).alias(f"_d_{name}"))
    errs, values = [], []
    for fld, (name, kind) in zip(schema.spark_type().fields, schema.fields):
        x, t = F.col(f"_x_{name}"), F.col(f"_t_{name}")
        if isinstance(kind, ListOf):
            err, value = _check_list(F.col(f"_i_{name}"), t, kind.item, F.col(f"_e_{name}"))
        else:
            err, value = _SCALAR_CHECKS[kind](x, t, F.col(f"_p_{name}"), F.col(f"_d_{name}") if kind == DATE else None)
        errs.append(F.concat(F.lit(f"{name}: "), err))
        values.append(value.cast(fld.dataType).alias(name))
    errors = (F.when(v.isNull(), F.array(F.lit("json_invalid")))
              .when(~F.col("_top").startswith("OBJECT"), F.array(F.lit("model_type")))
              .otherwise(F.array_compact(F.array(*errs))))
    _built[key] = [fields, types, plains, days], errors, F.struct(*values)
    return _built[key]


def validate_frame(df: DataFrame, variant_col: str, schema: RecordSchema, present: Column | None = None,
                   errors_col: str = "errors", record_col: str = "record", barrier: bool = False) -> DataFrame:
    """Add ``errors`` (array of ``field: code``, empty when valid) and ``record``
    (typed struct, NULL unless valid) for a parsed VARIANT column.

    Projections: each field's variant, their JSON types, the plain texts of strings
    and numbers (and the values of lists whose type shows that they fit), days and the elements of other lists; then
    the checks and converted values, and the record. Each
    costly expression is therefore evaluated once per row; Catalyst keeps the
    stages apart because their outputs are used more than once. ``present`` marks
    rows that had any input at all (otherwise ``json_invalid``). ``barrier``: see below.
    """
    keep = [c for c in df.columns]
    stages, errors, values = _expressions(variant_col, schema)
    staged = df
    for columns in stages:
        staged = staged.select("*", *columns)
    if present is not None:
        errors = F.when(~present, F.array(F.lit("json_invalid"))).otherwise(errors)
    checked = staged.select(*keep, errors.alias(errors_col), values.alias("_values"))
    out = checked.select(*keep, errors_col, F.when(F.size(errors_col) == 0, F.col("_values")).alias(record_col))
    if not barrier:
        return out
    # The observed metrics (rows, valid rows) double as an optimizer barrier: filters on
    # columns derived from the record are not pushed below it, which would otherwise
    # substitute (and multiply) the whole validation expression into the predicate. It also
    # holds back filters on keys, so only callers that branch on the record ask for it.
    return out.observe(f"validated_{schema.name}_{uuid.uuid4().hex[:12]}",
                       F.count(F.lit(1)).alias("rows"),
                       F.count(F.col(record_col)).alias("valid_rows"))


def falsy_variant(v: Column) -> Column:
    """Python falsiness of a decoded JSON value: absent, null, ``{}``, ``[]``, ``""``, 0 or false."""
    t = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    falsy = (F.when(t == "STRING", _as(v, "string") == "")
             .when(t.startswith("ARRAY"), F.size(_as(v, "array<variant>")) == 0)
             .when(t == "BOOLEAN", ~_as(v, "boolean"))
             .when(_is_numeric(t), _as(v, "double") == 0)
             .otherwise(F.lit(False)))
    return (t == "VOID") | (t == "OBJECT<>") | F.coalesce(falsy, F.lit(False))


def is_empty_object(text) -> Column:
    """Python falsiness of decoded JSON text; text that is no JSON is not empty."""
    text = col_of(text)
    v = F.try_parse_json(text)
    return text.isNull() | (v.isNotNull() & falsy_variant(v))
