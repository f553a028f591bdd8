"""The benchmark tables as a source of raw rows."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.text import parse_date
from weirflow.operators.normalize import look_back
from weirflow.sources.registry import SourceAdapter, registry

#: Currency texts before amounts, by order key.
PREFIXES = ["$", "€", "£", "₪", "RON", "USD ", "JPY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_raw(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """Orders as raw rows: coarse dates and amounts, so that rows repeat as they do in statements.

    ``since``: a day before which no row is wanted; the scan gets it as a filter on its own column (a row's date is never
    after its order's). The join keeps every order; Spark broadcasts the customers while they are small.
    """
    scan = table(spark, sf_dir, "orders")
    orders = (scan if since is None else scan.where(F.col("o_orderdate") >= F.lit(since).cast(scan.schema["o_orderdate"].dataType))).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    coarse = (F.floor(F.col("o_totalprice") / 100000) * 100000 + F.lit(97.3)).cast("decimal(18,2)")
    day = F.date_trunc("year", "o_orderdate")
    return orders.join(customers, "o_custkey", "left").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("acct_"), (F.col("o_custkey") % 4).cast("string")).alias("provider_account_id"),
        F.concat(F.date_format(day, "dd/MM/yy"), F.lit(" 10:30")).alias("transaction_ts_raw"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.date_format(F.date_add(day, 30), "dd/MM/yy")).alias("charge_date_raw"),
        F.col("c_mktsegment").alias("card_name"),
        F.col("o_orderpriority").alias("business_name"),
        F.col("o_orderstatus").alias("expense_type"),
        F.concat(prefix, coarse.cast("string")).alias("amount_raw"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("₪"), (coarse * 3).cast("decimal(18,2)").cast("string"))).alias("charge_amount_raw"),
        F.lit("regular").alias("transaction_type"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("status: amount not final")).otherwise(F.lit("status: settled")).alias("panel_text"),
    )


class TableSource(SourceAdapter):
    """The rows of ``orders_raw`` within the look-back."""

    name = "tables"

    def __init__(self, sf_dir: str) -> None:
        self.sf_dir = sf_dir

    def read(self, spark: SparkSession, as_of: str, days_back: int) -> DataFrame:
        since = (date.fromisoformat(as_of) - timedelta(days=days_back)).isoformat()
        raw = orders_raw(spark, self.sf_dir, since).withColumn("_date", parse_date(F.col("transaction_ts_raw")))
        return look_back(raw, as_of, days_back, "_date").drop("_date")


registry.register("tables", TableSource)
