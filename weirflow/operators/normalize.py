"""From raw rows to transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.text import PENDING_MARKERS, detect_currency, parse_amount, parse_date, pending_marker
from weirflow.schema import with_defaults

#: Label of a detail, field it fills.
DETAIL_LABELS = {
    "שם בית עסק": "business_name",
    "תאריך ושעה": "transaction_ts_raw",
    "סכום העסקה": "amount_raw",
    "סוג העסקה": "transaction_type",
    "מועד החיוב": "charge_date_raw",
    "סכום החיוב": "charge_amount_raw",
    "ענף בית העסק": "expense_type",
}
PROVIDER = "CAL"


def extract_details(pairs: DataFrame, key: Sequence[str], labels: dict[str, str] = DETAIL_LABELS) -> DataFrame:
    """A row for each ``key`` from (key..., position, label, value) rows: of a label's values the last counts, blank ones never.

    One aggregation over all labels: no pivot, so no pass to find the labels.
    """
    label, value = F.trim("label"), F.trim("value")
    usable = (F.coalesce(label, F.lit("")) != "") & (F.coalesce(value, F.lit("")) != "")
    return pairs.groupBy(*key).agg(*[F.coalesce(F.max_by(value, F.when(usable & (label == name), F.col("position"))), F.lit("")).alias(field) for name, field in labels.items()])


def recognized(children: Column) -> Column:
    """Whether an element is a transaction's row: it has exactly five children."""
    return F.size(children) == 5


def mark_pending(raw: DataFrame, markers: Sequence[str] = PENDING_MARKERS, text: str = "panel_text") -> DataFrame:
    return raw.withColumn("pending_marker", pending_marker(F.col(text), markers))


def split_pending(raw: DataFrame, markers: Sequence[str] = PENDING_MARKERS, text: str = "panel_text") -> tuple[DataFrame, DataFrame]:
    """(final rows, how many were left out as pending)."""
    marked = mark_pending(raw, markers, text)
    return marked.where("pending_marker is null").drop("pending_marker"), marked.agg(F.count_if(F.col("pending_marker").isNotNull()).alias("pending_skipped"))


def normalize(raw: DataFrame, provider: str = PROVIDER, keep: Sequence[str] = ()) -> DataFrame:
    """Transactions: fields renamed, amounts and currencies read from text, status by whether there is a charge date.

    ``provider`` is what the rows' source says it is; columns named in ``keep`` stay.
    """
    amount, charged = parse_amount(F.col("amount_raw")), parse_amount(F.col("charge_amount_raw"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    charge_date = parse_date(F.col("charge_date_raw"))
    return with_defaults(
        raw.select(
            "seq",
            F.lit(provider).alias("provider"),
            text("card_name").alias("account_id"),
            text("provider_account_id").alias("provider_account_id"),
            parse_date(F.col("transaction_ts_raw")).alias("transaction_date"),
            charge_date.alias("charge_date"),
            text("business_name").alias("merchant_name"),
            text("expense_type").alias("category"),
            amount.alias("amount"),
            detect_currency(F.col("amount_raw")).alias("currency"),
            # 0 is no amount.
            F.coalesce(F.nullif(charged, F.lit(0.0)), amount).alias("charge_amount"),
            detect_currency(F.col("charge_amount_raw")).alias("charge_currency"),
            text("transaction_type").alias("transaction_type"),
            F.when(charge_date != "", "completed").otherwise("pending").alias("status"),
            "amount_raw",
            "charge_amount_raw",
            *keep,
        )
    )


def stamp_source(txn: DataFrame, account: str, display_name: str, provider: str) -> DataFrame:
    """The account that rows were read from; the provider only where there is none. Hashes don't depend on these."""
    return txn.withColumns(
        {
            "provider_account_id": F.lit(account),
            "provider_display_name": F.lit(display_name),
            "provider": F.when(F.coalesce(F.col("provider"), F.lit("")) == "", F.lit(provider)).otherwise(F.col("provider")),
        }
    )


def resume_slice(rows: DataFrame, next_index: int) -> DataFrame:
    """Rows from a position on."""
    return rows.where(F.col("seq") >= next_index)


def look_back(rows: DataFrame, as_of: str, days_back: int | Column, date: str = "transaction_date") -> DataFrame:
    """Rows of the last ``days_back`` days before ``as_of`` (no upper bound). Where the ISO date is a column of the source, the scan gets the comparison."""
    start = F.date_sub(F.to_date(F.lit(as_of)), days_back if isinstance(days_back, Column) else F.lit(days_back))
    return rows.where(F.col(date) >= F.date_format(start, "yyyy-MM-dd"))


def union_accounts(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of all accounts as one table, to be classified in one plan; a column that some lack is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def joined_warnings(prior: Column, new: Column) -> Column:
    """Warnings of an earlier segment, then those of this one; null counts as none."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(prior, none), F.coalesce(new, none))


def segments(prior: DataFrame, fetched: DataFrame) -> DataFrame:
    """All rows of an earlier segment before those of this one: (segment, seq) is the order."""
    return prior.withColumn("segment", F.lit(0)).unionByName(fetched.withColumn("segment", F.lit(1)), allowMissingColumns=True)
