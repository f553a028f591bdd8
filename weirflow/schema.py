"""Record types of the engine, and the defaults of a transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    """From "name type, ..."; unlike Spark's own parser, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(", "))])


RAW = _struct(
    "seq bigint, provider_account_id string, transaction_ts_raw string, charge_date_raw string, card_name string, business_name string, "
    "expense_type string, amount_raw string, charge_amount_raw string, transaction_type string, panel_text string"
)
TXN = _struct(
    "seq bigint, provider string, account_id string, provider_account_id string, provider_display_name string, transaction_date string, "
    "charge_date string, merchant_name string, category string, amount double, currency string, charge_amount double, "
    "charge_currency string, transaction_type string, status string, dedup_key string, amount_raw string, charge_amount_raw string"
)
SEEN = _struct("provider string, provider_account_id string, dedup_key string, content_hash string, last_seen_at timestamp, updated_at timestamp")
LEDGER = _struct(
    "provider string, provider_account_id string, dedup_key string, finance_status string, reason string, content_hash string, api_status int, "
    "finance_transaction_id string, sent_at timestamp, last_attempt_at timestamp, attempts int"
)
RESULT = _struct("provider string, provider_account_id string, dedup_key string, seq bigint, content_hash string, ok boolean, classification string, api_status int, finance_transaction_id string, message string")
RUN_REPORT = _struct(
    "record_seq bigint, provider string, account_id string, provider_account_id string, display_name string, started_at timestamp, finished_at timestamp, "
    "duration_ms bigint, status string, transactions_fetched bigint, transactions_skipped bigint, pending_skipped_count bigint, retry_count bigint, "
    "re_auth_occurred boolean, session_reused boolean, warnings array<string>, fatal_error string, export_path string, resumed boolean, checkpoint_used boolean, "
    "checkpoint_path string, total_transactions_considered bigint, created_count bigint, updated_count bigint, unchanged_count bigint, "
    "new_transactions_exported bigint, duplicates_skipped bigint"
)
SOURCE_ACCOUNT = _struct("seq bigint, provider string, provider_account_id string, display_name string, enabled boolean, is_default boolean, days_back int, credential_key string")

#: What a transaction's fields are where nothing is known.
TXN_DEFAULTS: dict[str, object] = {
    "provider": "",
    "account_id": "",
    "provider_account_id": "",
    "provider_display_name": "",
    "transaction_date": "",
    "charge_date": "",
    "merchant_name": "",
    "category": "",
    "amount": 0.0,
    "currency": "ILS",
    "charge_amount": 0.0,
    "charge_currency": "ILS",
    "transaction_type": "",
    "status": "pending",
    "dedup_key": "",
}


def with_defaults(df: DataFrame) -> DataFrame:
    """Every field of a transaction, with its default where the column is missing or null; other columns stay."""
    filled: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in TXN_DEFAULTS.items()}
    return df.withColumns(filled)
