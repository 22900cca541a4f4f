"""Statements made from the star schema, so that layout results can be held against plain relational ones.

One statement per customer, 25 transactions a page in order of date and order key: description from priority, market
segment and nation, amount from the order's total, credit where the status is P, balance as the running sum. Every
fourth order key has a second description line, 12 points below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# The place of each column, the labels, and the geometry of a text.
COLUMNS = {"date": (50.0, "Date"), "description": (110.0, "Description"), "paid_out": (340.0, "Paid out"), "paid_in": (430.0, "Paid in"), "balance": (510.0, "Balance")}
HEADER_Y, FIRST_Y, STEP_Y, WRAP_Y, PAGE_ROWS = 110.0, 140.0, 22.0, 12.0, 25
FURNITURE = ((60.0, "Sort Code 12-34-56"), (80.0, "Jane Smith"))
CHAR_WIDTH, ABOVE, BELOW = 5.5, 11.0, 4.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statement_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, i, order_key, day, description, wrap, amount, is_credit, balance)."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", "c_mktsegment", "n_name")
    t = orders.join(named, orders.o_custkey == F.col("c_custkey"))
    n = F.row_number().over(w) - 1
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    credit = F.col("o_orderstatus") == "P"
    return t.select(
        F.col("o_custkey").cast("string").alias("doc_id"),
        F.floor(n / PAGE_ROWS).cast("int").alias("page_no"),
        (n % PAGE_ROWS).cast("int").alias("i"),
        F.col("o_orderkey").alias("order_key"),
        F.date_format("o_orderdate", "d MMM yyyy").alias("day"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment", "n_name").alias("description"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("REF "), F.col("o_orderkey"))).alias("wrap"),
        amount.alias("amount"),
        credit.alias("is_credit"),
        F.sum(F.when(credit, amount).otherwise(-amount)).over(w).cast("decimal(18,2)").alias("balance"),
    )


def _box(df: DataFrame) -> DataFrame:
    """Adds the box of text at (x, y)."""
    return df.withColumns({"x0": F.col("x"), "y0": F.col("y") - ABOVE, "x1": F.col("x") + CHAR_WIDTH * F.length("text"), "y1": F.col("y") + BELOW})


def statement_spans(tx: DataFrame, jitter: bool = False) -> DataFrame:
    """The spans of the statements' pages; jitter moves rows by up to 2 points, differently for each cell."""
    money = lambda c: F.format_number(c, 2)
    y = FIRST_Y + STEP_Y * F.col("i")
    cell = lambda k, role, text, at=y: F.struct(F.lit(k).alias("k"), F.lit(COLUMNS[role][0]).alias("x"), at.alias("y"), text.alias("text"))
    cells = F.array(
        cell(0, "date", F.col("day")),
        cell(1, "description", F.col("description")),
        cell(2, "paid_out", F.when(~F.col("is_credit"), money(F.col("amount")))),
        cell(3, "paid_in", F.when(F.col("is_credit"), money(F.col("amount")))),
        cell(4, "balance", money(F.col("balance"))),
        cell(5, "description", F.col("wrap"), y + WRAP_Y),
    )
    seq = lambda c: (10 + 10 * F.col("i") + c.k).cast("int")
    moved = lambda c: c.y + (((F.col("i") * 7 + c.k) % 5) * 0.5 if jitter else F.lit(0.0))
    body = F.transform(F.filter(cells, lambda c: c.text.isNotNull()), lambda c: F.struct(seq(c).alias("seq"), c.x.alias("x"), moved(c).alias("y"), c.text.alias("text")))
    fixed = [(k, x, HEADER_Y, text) for k, (x, text) in enumerate(COLUMNS.values())] + [(5 + k, 50.0, fy, text) for k, (fy, text) in enumerate(FURNITURE)]
    head = F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(x).alias("x"), F.lit(hy).alias("y"), F.lit(t).alias("text")) for s, x, hy, t in fixed])
    # a page's first transaction brings its header and furniture along
    all_ = F.concat(F.when(F.col("i") == 0, head).otherwise(F.slice(head, 1, 0)), body)
    return _box(tx.select("doc_id", "page_no", F.explode(all_).alias("c")).select("doc_id", "page_no", "c.*")).select("doc_id", "page_no", "seq", "text", "x0", "y0", "x1", "y1")
