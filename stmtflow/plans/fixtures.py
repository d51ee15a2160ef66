"""Inputs derived by Spark from the driver tables.

The reference works on utility bills; the driver tables hold orders. Each order
becomes one statement document (Markdown, two pages), one model response (JSON whose
shape depends on the order key), optionally one reviewer correction and one work
item. The expected outcome of every document follows from the base tables, so an
oracle can check the Spark operators without re-running their logic.

Response classes by ``o_orderkey % 10``:
0 full valid record · 1 valid plus an unknown key · 2 total as a numeric string ·
3 account as a number · 4 long-form billing date · 5 line items as ``{}`` · 6 ``{}`` ·
7 truncated JSON · 8 empty line-item list · 9 blank document text.
Corrections for classes 3, 4, 5, 7 by ``(o_orderkey div 10) % 4``: 0 none, 1 valid,
2 still invalid, 3 ``{}``. Constraint cases: ``% 97`` amount too large, ``% 101``
document type too long, ``% 103`` account too long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_money, group_account
from ..schemas import DEFAULT_DOCUMENT_TYPE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer and its ordered line items.

    The narrow order rows meet their customer first (AQE broadcasts ``customer`` only when its runtime size
    is under the broadcast threshold) and are then hash-partitioned by order key, as the line items are before they
    are grouped (their lists would be no smaller than their rows): so items, and the texts and records that
    are made of them, are partitioned by document, and no later join on the document key moves them.
    """
    # The per-document work downstream (rendering, extraction, validation) is CPU-heavy per byte,
    # so it should not inherit the partitioning of a few large input files.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = (table(spark, sf_dir, "orders")
              .select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("d")))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    items = (table(spark, sf_dir, "lineitem")
             .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
             .repartition(parts, "l_orderkey")
             .groupBy("l_orderkey")
             .agg(F.array_sort(F.collect_list(F.struct(
                 "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("items")))
    named = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").repartition(parts, "o_orderkey")
    return (named.join(items, named.o_orderkey == items.l_orderkey, "left")
                 .select("o_orderkey", "o_custkey", "o_totalprice", "d", "items", "c_name", "c_acctbal"))


def payment_amount(f=F.col) -> Column:
    """Payment printed on odd layouts, as a positive amount."""
    return (f("o_custkey") % 500).cast("double") + 0.25


def statement_text(f=F.col) -> Column:
    """Markdown statement for one ``order_facts`` row, in layout ``o_orderkey % 4`` (see FIXTURES.md)."""
    d, layout = f("d"), f("o_orderkey") % 4
    long_date = lambda c: F.date_format(c, "MMMM d, yyyy")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    block = lambda when, *lines: F.when(when, F.concat_ws("\n", *lines))
    plain, headed = layout < 2, layout >= 2
    item_rows = F.transform(F.coalesce(f("items"), F.array()), lambda x: F.format_string(
        "|Part %d supplier %d|%s|", x["l_partkey"], x["l_suppkey"], format_money(x["l_extendedprice"])))
    has_items = F.size(F.coalesce(f("items"), F.array())) > 0
    account = group_account(F.lpad(f("o_custkey").cast("string"), 10, "0"))
    service = F.format_string("%d Elm Street", "o_custkey")
    mail = F.format_string("PO Box %d", "o_custkey")
    blank, total, due = F.lit(""), format_money(f("o_totalprice")), F.date_add(d, 14)
    return F.concat_ws(
        "\n",
        F.lit("# Total amount due"), blank, format_money(f("o_totalprice") + 100), blank,
        # The last layout leaves the first date empty and abbreviates the second.
        block(layout == 3, F.lit("Bill date:"), line("Billing date: ", F.date_format(d, "MMM'.' d, yyyy"))),
        block(layout != 3, line("Bill date: ", long_date(d))), blank,
        line("For the period: ", long_date(F.date_sub(d, 31)), " to ", long_date(F.date_sub(d, 1))), blank,
        F.format_string("Summary: order %d", "o_orderkey"), blank,
        block(plain, line("Service address: ", service)), block(headed, F.lit("# Service address"), blank, service), blank,
        block(plain, line("Mailing address: ", mail)), block(headed, F.lit("# Billing address"), blank, mail), blank,
        block(layout == 2, F.lit("# Please pay by"), blank, long_date(due), blank),
        block(layout == 3, line("Due date: ", F.date_format(due, "yyyy-MM-dd")), blank),
        line(F.when(plain, "|Balance from last bill|").otherwise("|Previous balance|"),
             F.coalesce(format_money(f("c_acctbal")), F.lit("")), "|"),
        F.lit("|---|---|"),
        block(layout % 2 == 1, line("|Payment received - thank you|", format_money(-payment_amount(f)), "|")),
        block(layout == 0, line("|Total amount due by ", F.date_format(due, "MMM d, yyyy"), "|", total, "|")),
        block(layout == 1, blank, line("# Total amount due by ", F.date_format(due, "MMM d, yyyy")), blank, total),
        F.lit("---"),
        line("# ", F.coalesce(f("c_name"), F.lit(""))), blank,
        block(plain, line("Your account number: ", account)), block(headed, F.lit("# Account number"), blank, account), blank,
        F.when(plain, "# Charges").otherwise("# This month's charges and credits"), blank,
        F.when(has_items, F.lit("|Description|Amount|\n|---|---|")),
        F.when(has_items, F.array_join(item_rows, "\n")),
        line(F.when(plain, "|Total charges|").otherwise("|This month's charges and credits|"), total, "|"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, document_path, text)``: one rendered statement per order."""
    facts = order_facts(spark, sf_dir)
    return facts.select(
        F.col("o_orderkey").alias("doc_id"),
        F.format_string("statements/%d.md", "o_orderkey").alias("document_path"),
        statement_text().alias("text"))


def wide_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: charges in two sections with three and four columns, by ``o_orderkey % 3``.

    Items of odd place are in the first section, the others and a service charge in the second, which states the
    total; a section of past charges follows. Layout 0 names its columns, 1 puts the amount first, 2 names none.
    """
    layout, total = F.col("o_orderkey") % 3, format_money(F.col("o_totalprice"))
    items = F.coalesce(F.col("items"), F.array())
    name = lambda x: F.format_string("Part %d \\| supplier %d", x["l_partkey"], x["l_suppkey"])
    money = lambda x: format_money(x["l_extendedprice"])
    rows = lambda odd, fn: F.array_join(F.transform(F.filter(items, lambda x, i: i % 2 == (0 if odd else 1)), fn), "")
    first = (F.when(layout == 0, F.concat(F.lit("|Description|Units|Rate|Amount|\n|---|---|---|---|\n"), rows(
                 True, lambda x: F.concat(F.lit("|"), name(x), F.lit("|3|$1.25|"), money(x), F.lit("|\n"))), F.lit("|Total delivery charges| | |$1.00|\n")))
             .when(layout == 1, F.concat(F.lit("|Amount|Rate|Service|\n|---|---|---|\n"), rows(
                 True, lambda x: F.concat(F.lit("|"), money(x), F.lit("|$0.50|"), name(x), F.lit("|\n"))), F.lit("|$2.00| |Subtotal|\n")))
             .otherwise(F.concat(F.lit("|Base fee, see below| | |\n|---|---|---|\n"), rows(
                 True, lambda x: F.concat(F.lit("|"), name(x), F.lit("|3 units x $0.374621|"), money(x), F.lit("|\n"))), F.lit("|Total delivery charges| |$3.00|\n"))))
    second = F.concat(F.lit("|Monthly service charge| |$5.84| |\n|---|---|---|---|\n"), rows(
        False, lambda x: F.concat(F.lit("| "), name(x), F.lit(" |2 units| "), money(x), F.lit(" | |\n"))), F.lit("|Sub-total| |$4.00| |\n|Total charges|"), total, F.lit("| | |\n"))
    text = F.concat(F.lit("# Account\n\n1\n\n# Delivery charges\n\n"), first, F.lit("\nNote: a | b\n\n# Supply charges\n\n"), second,
                    F.lit("---\n# Past charges\n\n|Old part|1|$9.99|\n|---|---|---|\n"))
    return order_facts(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def decoy_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: bills with two totals and two earlier balances, by ``o_orderkey % 4``.

    The total that ranks first is never right. 0: the other balances with the first earlier balance, 2: with
    the second, 1: nothing balances, 3: there is no payment and no earlier balance, and the other total is the charges.
    """
    kind, cents = F.col("o_orderkey") % 4, "decimal(18,2)"
    charges = F.col("o_totalprice").cast(cents)
    first = ((F.col("o_custkey") % 700).cast(cents) + F.lit("0.10").cast(cents)).cast(cents)
    second = (first + F.lit("33.33").cast(cents)).cast(cents)
    paid = payment_amount().cast(cents)
    right = F.when(kind == 0, first - paid + charges).when(kind == 2, second - paid + charges).when(kind == 3, charges).otherwise(
        first - paid + charges + F.lit("5000000.01").cast(cents)).cast(cents)
    wrong = (right + F.lit("1000000.07").cast(cents)).cast(cents)
    row = lambda name, amount: F.concat(F.lit(f"|{name}|"), format_money(amount), F.lit("|\n"))
    earlier = F.concat(row("Balance from last bill", first), F.lit("|---|---|\n"), row("Payment received - thank you", -paid), row("Previous balance", second))
    text = F.concat(F.lit("# Total amount due\n\n"), format_money(right), F.lit("\n\n"), F.when(kind == 3, F.lit("")).otherwise(earlier),
                    row("Total amount due by Jan 5, 2020", wrong), F.lit("---\n# Name\n\n# Charges\n\n"), row("Total charges", charges))
    return order_facts(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def document_files(spark: SparkSession, sf_dir: str, root: str) -> int:
    """Write every document as ``<root>/<lang>/<source>/<doc_id>.md``, each tenth without content; returns how many."""
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for doc_id, lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
                folder = f"{base}/{lang}/{source}"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/{doc_id}.md") as out:
                    out.write(b"" if doc_id % 10 == 0 else (text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return docs.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, html)``: a web page per order with nested lists, a link, a table, a ``pre`` block and named references."""
    cell = lambda *parts: F.concat(F.lit("<td>"), *parts, F.lit("</td>"))
    text = lambda c: c.cast("string")
    rows = F.array_join(F.transform(F.coalesce("items", F.array()), lambda x: F.concat(
        F.lit("<tr>"), cell(F.lit("Part "), text(x["l_partkey"])), cell(text(x["l_suppkey"]), F.lit("|"), text(x["l_linenumber"])),
        cell(F.lit("<p>"), text(x["l_extendedprice"].cast("decimal(18,2)")), F.lit("</p>")), F.lit("</tr>"))), "")
    key, customer = text(F.col("o_orderkey")), text(F.col("o_custkey"))
    html = F.concat(
        F.lit("<html><head><title>Order</title></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><h1>Order &num;"), key,
        F.lit("</h1><p>For <a href=\"/customer/"), customer, F.lit("?x=1&amp;y=2\"><b>"), F.coalesce("c_name", F.lit("")),
        F.lit("</b> &amp; Co</a>, caf&eacute; &frac12;&hearts;</p><ul><li>Date<ul><li>"), text(F.col("d")),
        F.lit("</li></ul></li><li>Total<ol><li>"), text(F.col("o_totalprice").cast("decimal(18,2)")),
        F.lit("</li></ol></li></ul><table><tr><th>Part</th><th>Supplier|Line</th><th>Amount</th></tr>"), rows,
        F.lit("</table><pre>ref  "), key, F.lit("\n\n\n  &lt;end&gt;</pre><footer>x</footer></body></html>"))
    return order_facts(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), html.alias("html"))


# ---- model responses -----------------------------------------------------------------

LONG_TYPE = DEFAULT_DOCUMENT_TYPE + "_" + "X" * 110


def _klass(key: Column) -> Column:
    return key % 10


def _review(key: Column) -> Column:
    return F.floor(key / 10) % 4


def _valid_fields(f=F.col) -> dict[str, Column]:
    """The full valid record of an order as named columns, with constraint overrides."""
    key = f("o_orderkey")
    d = f("d")
    account = F.when(key % 103 == 0, F.lit("9" * 300)).otherwise(F.lpad(f("o_custkey").cast("string"), 10, "0"))
    total = F.when(key % 97 == 0, F.lit(100000000.0)).otherwise(f("o_totalprice"))
    items = F.transform(f("items"), lambda x: F.struct(
        F.format_string("Part %d supplier %d", x["l_partkey"], x["l_suppkey"]).alias("description"),
        x["l_extendedprice"].alias("amount")))
    return {
        "account_number": account,
        "customer_name": f("c_name"),
        "billing_date": F.date_format(d, "yyyy-MM-dd"),
        "billing_period_start_date": F.date_format(F.date_sub(d, 31), "yyyy-MM-dd"),
        "billing_period_end_date": F.date_format(F.date_sub(d, 1), "yyyy-MM-dd"),
        "due_date": F.date_format(F.date_add(d, 14), "yyyy-MM-dd"),
        "total_amount_due": total,
        "previous_balance": f("c_acctbal"),
        "current_charges": f("o_totalprice"),
        "line_items": items,
    }


def _json(fields: dict[str, Column], **changes: Column) -> Column:
    merged = {**fields, **changes}
    return F.to_json(F.struct(*[c.alias(n) for n, c in merged.items()]))


def valid_record_json(f=F.col) -> Column:
    return _json(_valid_fields(f))


def response_json(f=F.col) -> Column:
    """The first model response of an order, shaped by its class."""
    key = f("o_orderkey")
    k = _klass(key)
    base = _valid_fields(f)
    full = _json(base)
    total = F.when(key % 97 == 0, F.lit(1e8)).otherwise(f("o_totalprice"))
    empty_items = F.array().cast("array<struct<description:string,amount:double>>")
    return (F.when(k == 1, _json(base, confidence=F.lit(0.87)))
            .when(k == 2, _json(base, total_amount_due=F.format_string("%.2f", total)))
            .when(k == 3, _json(base, account_number=f("o_custkey")))
            .when(k == 4, _json(base, billing_date=F.date_format(f("d"), "MMMM d, yyyy")))
            .when(k == 5, _json(base, line_items=F.create_map()))
            .when(k == 6, F.lit("{}"))
            .when(k == 7, full.substr(F.lit(1), (F.length(full) / 2).cast("int")))
            .when(k == 8, _json(base, line_items=empty_items))
            .otherwise(full))


def responses(spark: SparkSession, sf_dir: str, retries: bool = False) -> DataFrame:
    """``(doc_id, attempt, response)``; with ``retries`` classes 3 and 4 of even
    ``o_orderkey div 10`` get a second, valid attempt."""
    facts = order_facts(spark, sf_dir)
    first = facts.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("attempt"),
                         response_json().alias("response"))
    if not retries:
        return first
    key = F.col("o_orderkey")
    second = (facts.where(_klass(key).isin(3, 4) & (F.floor(key / 10) % 2 == 0))
                   .select(key.alias("doc_id"), F.lit(2).alias("attempt"), valid_record_json().alias("response")))
    return first.unionByName(second)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, corrected)`` reviewer corrections for failing classes (none for review class 0)."""
    facts = order_facts(spark, sf_dir)
    key = F.col("o_orderkey")
    r = _review(key)
    still_invalid = _json(_valid_fields(), billing_date=F.date_format(F.col("d"), "MMMM d, yyyy"))
    return (facts.where(_klass(key).isin(3, 4, 5, 7) & (r != 0))
                 .select(key.alias("doc_id"),
                         F.when(r == 1, valid_record_json()).when(r == 2, still_invalid)
                          .otherwise(F.lit("{}")).alias("corrected")))


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, item)``: work-item JSON text per order; the type hint key is absent
    (so it defaults) except for the long-type constraint case."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    path = F.format_string("statements/%d.md", key)
    item = (F.when(key % 101 == 0, F.to_json(F.struct(path.alias("document_path"),
                                                        F.lit(LONG_TYPE).alias("document_type_hint"))))
            .otherwise(F.to_json(F.struct(path.alias("document_path")))))
    return orders.select(key.alias("doc_id"), item.alias("item"))


def mixed_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items exercising every key shape, by ``o_orderkey % 7``: 0 hint absent,
    1 hint null, 2 other type, 3 path absent, 4 path empty, 5 path null, 6 explicit default."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    m = key % 7
    path = F.format_string("statements/%d.md", key)
    item = (F.when(m == 0, F.format_string('{"document_path": "%s"}', path))
            .when(m == 1, F.format_string('{"document_path": "%s", "document_type_hint": null}', path))
            .when(m == 2, F.format_string('{"document_path": "%s", "document_type_hint": "GENERIC_INVOICE"}', path))
            .when(m == 3, F.lit('{"document_type_hint": "PSEG_BILL"}'))
            .when(m == 4, F.lit('{"document_path": "", "document_type_hint": "PSEG_BILL"}'))
            .when(m == 5, F.lit('{"document_path": null}'))
            .otherwise(F.format_string('{"document_path": "%s", "document_type_hint": "PSEG_BILL"}', path)))
    return orders.select(key.alias("doc_id"), item.alias("item"))


def pipeline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with class 9 blanked: ``(doc_id, document_path, text)``."""
    st = statements(spark, sf_dir)
    return st.withColumn("text", F.when(F.col("doc_id") % 10 == 9, F.lit(" \n\t 　\n"))
                         .otherwise(F.col("text")))


def storage_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, payload_json)``: a storage payload per order around its model response, by class:
    3 to 5 hold an invalid record, 6 an empty one, 7 is an empty payload, 8 has no text, 9 is absent."""
    facts = order_facts(spark, sf_dir)
    k = _klass(F.col("o_orderkey"))
    text = F.when(k == 8, F.lit("null")).otherwise(F.lit('"bill text"'))
    payload = F.concat(F.lit('{"pseg_data_dict": '), response_json(), F.lit(', "full_ocr_text": '), text,
                       F.lit(', "document_type": "PSEG_BILL"}'))
    return facts.select(F.col("o_orderkey").alias("doc_id"),
                        F.when(k == 7, F.lit("{}")).when(k != 9, payload).alias("payload_json"))
