"""Rule-based structured extraction of bill records from Markdown.

The rules are data: ``(field, rank, pattern, group)``; a pattern never crosses a ``---``
page break. All matches of a rule are taken (``regexp_extract_all``) and typed, and a
field takes the first match that has a value of its type, of the lowest rank that has one:
a label without a readable value never hides another. Layouts that share a rank are
alternatives of one pattern, so they compete by position. The whole extraction is one
projection of native expressions: no shuffle, no window, no Python. Documents are never
grouped, so a large document costs one task only its own size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PAGE_BREAK_RE, col_of, normalize_account, normalize_date, parse_money
from ..schemas import BILL_RECORD
from .markdown import SEPARATOR_ROW_RE, row_cells

MONEY = r"(-?\$[0-9][0-9,]*\.[0-9]{2})"
LONG_DATE = r"([A-Za-z]+\.?[ \t]+[0-9]{1,2},[ \t]*[0-9]{4})"
# One character class, not a repeated group: a run of any length is matched by a loop.
BLANK_LINES = r"[ \t]*\n[ \t\n]*"


@dataclass(frozen=True)
class Rule:
    field: str
    rank: int
    pattern: str
    group: int = 1


# Ranked rules for the bill layout; lower rank wins, then the earlier place.
BILL_RULES: tuple[Rule, ...] = (
    Rule("account_number", 1, r"(?im)^[ \t]*(?:your[ \t]+)?account[ \t]+(?:number|no\.?|#)[ \t]*:[ \t]*([0-9][0-9 ]*[0-9])[ \t]*$"),
    Rule("account_number", 2, r"(?im)^#+[ \t]*account[ \t]+(?:number|no\.?)" + BLANK_LINES + r"([0-9][0-9 ]*[0-9])[ \t]*$"),
    # The name heads the pages after the first: a heading right below a page break.
    Rule("customer_name", 1, r"(?m)^---[ \t]*\n#[ \t]+([^\n]*?)[ \t]*$"),
    Rule("service_address", 1, r"(?im)^[ \t]*(?:service[ \t]+(?:address|location)|premises)[ \t]*:[ \t]*([^\n]*?)[ \t]*$"),
    Rule("service_address", 2, r"(?im)^#+[ \t]*service[ \t]+(?:address|location)" + BLANK_LINES + r"([^\n]*?)[ \t]*$"),
    Rule("billing_address", 1, r"(?im)^[ \t]*(?:billing|mailing)[ \t]+address[ \t]*:[ \t]*([^\n]*?)[ \t]*$"),
    Rule("billing_address", 2, r"(?im)^#+[ \t]*(?:billing|mailing)[ \t]+address" + BLANK_LINES + r"([^\n]*?)[ \t]*$"),
    Rule("billing_date", 1, r"(?im)^[ \t]*bill(?:ing)?[ \t]+date[ \t]*:[ \t]*([^\n]*?)[ \t]*$"),
    Rule("billing_period_start_date", 1, r"(?im)^[ \t]*for[ \t]+the[ \t]+(?:billing[ \t]+)?period[ \t]*:?[ \t]*(.+?)[ \t]+to[ \t]+.+?[ \t]*$"),
    Rule("billing_period_end_date", 1, r"(?im)^[ \t]*for[ \t]+the[ \t]+(?:billing[ \t]+)?period[ \t]*:?[ \t]*.+?[ \t]+to[ \t]+(.+?)[ \t]*$"),
    Rule("due_date", 1, r"(?im)^[ \t|#]*total[ \t]+amount[ \t]+due[ \t]+by[ \t]+" + LONG_DATE),
    Rule("due_date", 2, r"(?im)^#+[ \t]*please[ \t]+pay[ \t]+by" + BLANK_LINES + r"([^\n]*?)[ \t]*$"),
    Rule("due_date", 3, r"(?im)^[ \t]*(?:payment[ \t]+)?due[ \t]+date[ \t]*:[ \t]*([^\n]*?)[ \t]*$"),
    # A total that names its due date outranks a bare "Total amount due" heading.
    Rule("total_amount_due", 1, r"(?im)^\|[ \t]*total[ \t]+amount[ \t]+due[ \t]+by[^|\n]*\|[ \t]*" + MONEY),
    Rule("total_amount_due", 2, r"(?im)^#+[ \t]*total[ \t]+amount[ \t]+due[ \t]+by[^\n]*" + BLANK_LINES + MONEY),
    Rule("total_amount_due", 3, r"(?im)^(?:#+[ \t]*total[ \t]+amount[ \t]+due[ \t]*\n[ \t\n]*|\|[ \t]*total[ \t]+amount[ \t]+due[ \t]*\|[ \t]*)" + MONEY),
    Rule("previous_balance", 1, r"(?im)^\|[^|\n]*balance[ \t]+from[ \t]+(?:your[ \t]+)?last[ \t]+bill[ \t]*\|[ \t]*" + MONEY),
    Rule("previous_balance", 2, r"(?im)^\|[ \t]*previous[ \t]+balance[ \t]*\|[ \t]*" + MONEY),
    Rule("payments_received", 1, r"(?im)^\|[^|\n]*payments?[ \t]+received[^|\n]*\|[ \t]*" + MONEY),
    Rule("current_charges", 1, r"(?im)^\|[ \t]*total[ \t]+(?:current[ \t]+)?charges[ \t]*\|[ \t]*" + MONEY),
    Rule("current_charges", 2, r"(?im)^\|[ \t]*(?:plus[ \t]+)?this[ \t]+month.s[ \t]+charges[ \t]+and[ \t]+credits[ \t]*\|[ \t]*" + MONEY),
    Rule("raw_text_summary", 1, r"(?im)^[ \t]*(?:bill[ \t]+)?summary[ \t]*:[ \t]*([^\n]*?)[ \t]*$"),
)

# Sections whose heading names charges hold the line items, up to the one that states their total.
CHARGES_SECTION_RE = r"(?ims)^#+[ \t]*([^\n]*charges[^\n]*?)[ \t]*\n(.*?)(?=^#|^---[ \t]*$|\z)"
ITEM_ROW_RE = r"(?m)^\|[ \t]*([^|\n]*?)[ \t]*\|[ \t]*" + MONEY + r"[ \t]*\|[ \t]*$"
ITEM_EXCLUDE_RE = r"(?i)^\s*(?:sub-?[ \t]*)?total\b"
PAST_SECTION_RE = r"(?i)^#+[^\n]*\b(?:past|previous|prior|last)\b"
CLOSING_ROW_RE = r"(?im)^\|[ \t]*(?:total[ \t]+(?:current[ \t]+)?charges|(?:plus[ \t]+)?this[ \t]+month.s[ \t]+charges[ \t]+and[ \t]+credits)[ \t]*\|"
# A row of three cells or more, or one with a marked bar: its columns are told apart by their roles.
WIDE_ROW_RE = r"(?m)^\|[^|\n]*(?:\\|\|[^|\n]*(?:\\|\|[^|\n]*\|))"
AMOUNT_HEADER_RE = r"(?i)\b(?:amount|charges?|total|cost|price)\b"
TEXT_HEADER_RE = r"(?i)\b(?:description|item|service|details?|product|charge type)\b"
MONEY_CELL_RE = "^" + MONEY + "$"
WORD_RE = r"[A-Za-z]{2}"

# How each field's winning text becomes a typed value.
_DATE_FIELDS = {"billing_date", "billing_period_start_date", "billing_period_end_date", "due_date"}
_MONEY_FIELDS = {"total_amount_due", "previous_balance", "current_charges"}


def _rules_by_field(rules) -> dict[str, list[Rule]]:
    grouped: dict[str, list[Rule]] = {}
    for r in sorted(rules, key=lambda r: r.rank):
        grouped.setdefault(r.field, []).append(r)
    return grouped


def _typed(field: str, raw: Column) -> Column:
    """The value of a match, NULL if it is not of the field's type (or empty)."""
    if field in _DATE_FIELDS:
        return normalize_date(raw)
    if field in _MONEY_FIELDS:
        return parse_money(raw).cast("double")
    if field == "payments_received":
        return F.abs(parse_money(raw)).cast("double")  # printed as a credit, kept positive
    if field == "account_number":
        return F.nullif(normalize_account(raw), F.lit(""))
    return F.nullif(raw, F.lit(""))


def resolve_field(text: Column, field: str, rules: list[Rule]) -> Column:
    """Typed value of the winning candidate: lowest rank that has one, then the earliest match."""
    per_rule = []
    for rule in rules:
        matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        values = F.transform(matches, lambda raw: _typed(field, raw))
        per_rule.append(F.get(F.array_compact(values), 0))
    return F.coalesce(*per_rule)


SUM_FIELDS = ("total_amount_due", "current_charges", "previous_balance", "payments_received")
CENTS = "decimal(18,2)"


def amount_candidates(text: Column, field: str, rules: list[Rule]) -> Column:
    """All different amounts that the rules of a field find, by rank and then by place."""
    found = []
    for rule in rules:
        values = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda raw: parse_money(raw).cast(CENTS))
        found.append(F.array_compact(F.transform(values, F.abs) if field == "payments_received" else values))
    return F.array_distinct(F.concat(*found))


def balanced_amounts(text: Column, rules=BILL_RULES) -> Column:
    """The amounts of a bill that fit each other, as a struct of ``SUM_FIELDS`` (decimals); NULL if none do.

    previous balance - payments + current charges = total. Of all combinations of candidates that
    satisfy this the one with the least places in the candidates' orders is taken (their sum, then the total's place, then the others').
    A bill without a previous balance or without payments counts them as zero, and they stay NULL. Both sides
    of the equation are built as pairs and meet by equal sums, so the work grows with the square of the
    candidates of a field and not with the fourth power.
    """
    grouped = _rules_by_field(rules)
    candidates = F.struct(*[amount_candidates(text, f, grouped.get(f, [])).alias(f) for f in SUM_FIELDS])

    def pairs(a: Column, b: Column) -> Column:
        """(sum, place, a's place, b's place, a, b) of every pair; an empty list is one of a NULL that counts as zero."""
        placed = lambda values: F.transform(F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(None).cast(CENTS))),
                                            lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        zero = lambda v: F.coalesce(v, F.lit(0).cast(CENTS))
        return F.flatten(F.transform(placed(a), lambda x: F.transform(placed(b), lambda y: F.struct(
            (zero(x["v"]) - zero(y["v"])).cast("decimal(20,2)").alias("sum"), (x["i"] + y["i"]).alias("place"), x["i"].alias("i"), y["i"].alias("j"),
            x["v"].alias("a"), y["v"].alias("b")))))

    def fitting(c: Column) -> Column:
        sides = F.struct(pairs(c["total_amount_due"], c["current_charges"]).alias("left"),
                         pairs(c["previous_balance"], c["payments_received"]).alias("right"))

        def best(t: Column) -> Column:
            sums = F.array_intersect(F.transform(t["left"], lambda x: x["sum"]), F.transform(t["right"], lambda x: x["sum"]))
            least = lambda side, s: F.array_min(F.filter(side, lambda x: x["sum"] == s))  # noqa: E731 - equal sums: by place
            both = F.transform(sums, lambda s: bind(F.struct(least(t["left"], s).alias("l"), least(t["right"], s).alias("r")), lambda x: F.struct(
                (x["l"]["place"] + x["r"]["place"]).alias("place"), x["l"]["i"].alias("i"), x["l"].alias("l"), x["r"].alias("r"))))
            return bind(F.array_min(both), lambda x: F.when(x.isNotNull(), F.struct(
                x["l"]["a"].alias("total_amount_due"), x["l"]["b"].alias("current_charges"), x["r"]["a"].alias("previous_balance"),
                x["r"]["b"].alias("payments_received"))))

        return F.when((F.size(c["total_amount_due"]) > 0) & (F.size(c["current_charges"]) > 0), bind(sides, best))

    return bind(candidates, fitting)


def label_candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     rules=BILL_RULES) -> DataFrame:
    """Every match of every rule with a value: ``(id, field, rank, page, nth, value)``.

    Pages are numbered from 1 and ``nth`` numbers a rule's matches on its page from 1. A page
    after the first is searched with the break above it, where some rules start.
    """
    pages = df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), PAGE_BREAK_RE, -1)).alias("_p", "_t"))
    pages = pages.select(id_col, (F.col("_p") + 1).alias("page"),
                         F.when(F.col("_p") == 0, F.col("_t")).otherwise(F.concat(F.lit("---"), "_t")).alias("_t"))
    found = F.array(*[F.struct(F.lit(r.field).alias("field"), F.lit(r.rank).alias("rank"),
                               F.regexp_extract_all("_t", F.lit(r.pattern), F.lit(r.group)).alias("values"))
                      for r in rules])
    return (pages.select(id_col, "page", F.explode(found).alias("c")).where(F.size("c.values") > 0)
            .select(id_col, "c.field", "c.rank", "page", F.posexplode("c.values").alias("nth", "value"))
            .where(F.col("value") != "")
            .select(id_col, "field", "rank", "page", (F.col("nth") + 1).alias("nth"), "value"))


def charge_sections(text) -> Column:
    """Texts of the sections that hold the line items, heading line included.

    All whose heading names charges, but for those of an earlier time, up to the first that states the total of
    the charges: sections after it break the same charges down.
    """
    found = F.filter(F.regexp_extract_all(col_of(text), F.lit(CHARGES_SECTION_RE), F.lit(0)), lambda s: ~s.rlike(PAST_SECTION_RE))
    return bind(found, lambda all_: bind(
        F.array_position(F.transform(all_, lambda s: s.rlike(CLOSING_ROW_RE)), True),
        lambda n: F.when(n > 0, F.slice(all_, F.lit(1), n.cast("int"))).otherwise(all_)))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def charges_heading(section) -> Column:
    """Lower-cased heading of a charges section."""
    return F.lower(F.regexp_extract(col_of(section), r"^#+[ \t]*([^\n]*?)[ \t]*\n", 1))


def _item(description: Column, amount: Column) -> Column:
    return F.struct(description.alias("description"), parse_money(amount).cast("double").alias("amount"))


def two_column_items(section) -> Column:
    """Items of a section whose table has a description and an amount column."""
    section = col_of(section)
    descs = F.regexp_extract_all(section, F.lit(ITEM_ROW_RE), F.lit(1))
    amounts = F.regexp_extract_all(section, F.lit(ITEM_ROW_RE), F.lit(2))
    return F.transform(F.arrays_zip(descs.alias("d"), amounts.alias("a")), lambda r: _item(r["d"], r["a"]))


def wide_items(section) -> Column:
    """Items of a section whose tables have any columns, by the roles of these.

    A first row above a separator that holds no amount is the header. The amount column is the last one that the
    header names so, else the one with the most amounts (the rightmost of them; there a row without an amount in it
    gives its last one). The description column is the first that the header names so, else the one with the most words.
    """
    def roles(t: Column) -> Column:
        head, body = t["header"], t["body"]
        columns = F.sequence(F.lit(0), F.greatest(F.array_max(F.transform(F.concat(body, F.array(head)), lambda r: F.size(r))), F.lit(1)) - 1)
        count = lambda j, regex: F.size(F.filter(body, lambda r: F.coalesce(F.get(r, j).rlike(regex), F.lit(False))))
        named = lambda regex: F.filter(columns, lambda j: F.coalesce(F.get(head, j).rlike(regex), F.lit(False)))
        voted = F.array_max(F.transform(columns, lambda j: F.struct(count(j, MONEY_CELL_RE).alias("n"), j.alias("j"))))["j"]
        amount_at = F.filter(named(AMOUNT_HEADER_RE), lambda j: count(j, MONEY_CELL_RE) > 0)

        def descriptions(amount: Column) -> Column:
            others = F.filter(named(TEXT_HEADER_RE), lambda j: j != amount)
            words = F.array_max(F.transform(F.filter(columns, lambda j: j != amount),
                                            lambda j: F.struct(count(j, WORD_RE).alias("n"), (-j).alias("j"))))
            return F.when(F.size(others) > 0, F.get(others, 0)).otherwise(-words["j"])

        return bind(F.coalesce(F.try_element_at(amount_at, F.lit(-1)), voted),
                    lambda amount: F.struct(amount.alias("amount"), descriptions(amount).alias("text"), (F.size(amount_at) > 0).alias("named"), body.alias("body")))

    def items(t: Column) -> Column:
        def item(r: Column) -> Column:
            own = F.get(r, t["amount"])
            money = F.when(own.rlike(MONEY_CELL_RE), own).when(
                ~t["named"], F.try_element_at(F.filter(r, lambda c: c.rlike(MONEY_CELL_RE)), F.lit(-1)))
            text = F.get(r, t["text"])
            return _item(F.when(text.rlike(MONEY_CELL_RE), F.get(F.filter(r, lambda c: c.rlike(WORD_RE)), 0)).otherwise(text), money)

        return F.filter(F.transform(t["body"], item), lambda x: (x["description"] != "") & x["amount"].isNotNull())

    def table(lines: Column) -> Column:
        rows = F.transform(F.filter(lines, lambda x: ~x.rlike(SEPARATOR_ROW_RE)), row_cells)
        headed = F.coalesce(F.get(lines, 1).rlike(SEPARATOR_ROW_RE), F.lit(False))
        return bind(F.struct(rows.alias("rows"), headed.alias("headed")), lambda t: bind(
            F.when(t["headed"] & ~F.exists(F.get(t["rows"], 0), lambda c: c.rlike(MONEY_CELL_RE)), F.get(t["rows"], 0)),
            lambda head: F.struct(F.coalesce(head, F.array().cast("array<string>")).alias("header"),
                                  F.when(head.isNull(), t["rows"]).otherwise(F.slice(t["rows"], 2, F.greatest(F.size(t["rows"]) - 1, F.lit(0)))).alias("body"))))

    # Tables of a section are parted by anything that is no pipe row.
    tables = F.filter(F.split(F.regexp_replace(col_of(section), r"(?m)^(?!\|).*$", ""), r"\n{2,}"), lambda t: t.contains("|"))
    per_table = F.transform(tables, lambda t: items_of(t, table, roles, items))
    return F.flatten(per_table)


def items_of(text: Column, table, roles, items) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("|"))
    return bind(table(lines), lambda t: bind(roles(t), items))


def charge_item_array(sections) -> Column:
    """``array<struct<description, amount>>`` of charges sections (maybe empty).

    Rows whose description starts with "Total" or "Subtotal", or repeats the section heading, are
    sums, not items. Sections with two columns are read by one pattern, others by column roles.
    """
    def kept(section: Column) -> Column:
        found = F.when(section.rlike(WIDE_ROW_RE), wide_items(section)).otherwise(two_column_items(section))
        return bind(F.struct(charges_heading(section).alias("head"), found.alias("items")), lambda t: F.filter(
            t["items"], lambda r: ~r["description"].rlike(ITEM_EXCLUDE_RE) & (F.lower(r["description"]) != t["head"])))

    return F.flatten(F.transform(col_of(sections), kept))


def charge_items(text) -> Column:
    """Line items of a document text, NULL when there are none."""
    items = charge_item_array(charge_sections(text))
    return F.when(F.size(items) > 0, items)


def _staged_items(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_items``; the section pattern and the items each run once per row (projections Catalyst keeps apart)."""
    return (df.withColumn("_sec", charge_sections(F.col(text_col)))
              .withColumn("_items", charge_item_array(F.col("_sec"))).drop("_sec"))


def line_items(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Flat charge rows: ``(id, item, description, amount)``, item numbered from 1.

    The outer form of explode keeps Spark from testing the list for elements before, which would compute it three times.
    """
    staged = _staged_items(df.select(id_col, text_col), text_col)
    return (staged.select(F.col(id_col), F.posexplode_outer("_items").alias("_i", "_it")).where(F.col("_i").isNotNull())
              .select(id_col, (F.col("_i") + 1).alias("item"),
                      F.col("_it.description").alias("description"), F.col("_it.amount").alias("amount")))


def _record_fields(text: Column, items: Column, rules, schema, sums: Column | None = None) -> list[Column]:
    grouped = _rules_by_field(rules)
    fields = []
    for name, dtype in ((f.name, f.dataType) for f in schema.spark_type().fields):
        if name == "line_items":
            value = F.when(F.size(items) > 0, items)
        elif name in grouped:
            value = resolve_field(text, name, grouped[name])
            if sums is not None and name in SUM_FIELDS:
                value = F.when(sums.isNotNull(), sums[name].cast("double")).otherwise(value)
        else:
            value = F.lit(None)
        fields.append(value.cast(dtype).alias(name))
    return fields


def extract_record(text, rules=BILL_RULES, schema=BILL_RECORD) -> Column:
    """The bill record struct for one document text column, NULL fields where absent."""
    text = col_of(text)
    return F.struct(*_record_fields(text, charge_item_array(charge_sections(text)), rules, schema))


def extract_bills(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = (), rules=BILL_RULES, schema=BILL_RECORD, reconcile: bool = False) -> DataFrame:
    """One bill record per document, flattened to the record's columns.

    Two projections: the item array is computed once, then tested and used. With ``reconcile`` the amounts are chosen
    together (``balanced_amounts``) where some combination of candidates balances, else each by its rank; a column
    ``balanced`` says which.
    """
    staged = _staged_items(df.select(F.col(id_col), *[F.col(k) for k in keep],
                                     F.col(text_col).alias("_text")), "_text")
    if not reconcile:
        return staged.select(id_col, *keep, *_record_fields(F.col("_text"), F.col("_items"), rules, schema))
    staged = staged.withColumn("_sums", balanced_amounts(F.col("_text"), rules))
    return staged.select(id_col, *keep, *_record_fields(F.col("_text"), F.col("_items"), rules, schema, F.col("_sums")),
                         F.col("_sums").isNotNull().alias("balanced"))


def extract_records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep: tuple[str, ...] = (), rules=BILL_RULES, schema=BILL_RECORD,
                    record_col: str = "record", reconcile: bool = False) -> DataFrame:
    """Like ``extract_bills`` but with the fields packed into one ``record`` struct."""
    flat = extract_bills(df, id_col, text_col, keep=keep, rules=rules, schema=schema, reconcile=reconcile)
    return flat.select(id_col, *keep, F.struct(*[F.col(n) for n in schema.names]).alias(record_col))
