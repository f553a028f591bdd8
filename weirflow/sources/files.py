"""JSON files in: transactions, accounts, settings, state."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.text import parse_date
from weirflow.operators.accounts import DAYS_BACK_DEFAULT, sanitize_finance, stored_accounts, validate_days_back
from weirflow.operators.normalize import look_back
from weirflow.schema import RAW, TXN
from weirflow.sources.arrays import SPLIT, NotAnArray, elements
from weirflow.sources.registry import Fetched, SourceAdapter, registry
from weirflow.sources.sinks import write_text


class InputError(ValueError):
    """A file that isn't what it should be."""


def load_transactions(spark: SparkSession, path: str, schema: T.StructType = TXN) -> DataFrame:
    """A JSON file that holds an array of transactions; anything else is an ``InputError``."""
    # The first line that isn't blank tells; only its task reads anything.
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if first is None or first.c != "[":
        raise InputError(f"{path}: not an array of transactions")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("multiLine", True).json(path).cache()
    try:
        if not rows.where("_corrupt_record is not null").isEmpty():
            raise InputError(f"{path}: not valid JSON")
    finally:
        rows.unpersist()
    return rows.drop("_corrupt_record")


def load_array(spark: SparkSession, path: str, schema: T.StructType = TXN, split: int = SPLIT) -> DataFrame:
    """``load_transactions`` for one huge file: its ranges are read by many tasks (``sources.arrays``), twice."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    try:
        found = elements(spark, path, split)
    except NotAnArray as error:
        raise InputError(str(error)) from error
    parsed = found.select(F.from_json("value", kept, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | (F.trim(F.col("value")) == "")
    if not parsed.where(bad).isEmpty():
        raise InputError(f"{path}: not valid JSON")
    return parsed.select("r.*").drop("_corrupt_record")


def read_valid(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, warnings) of JSON lines: a bad line is a warning, and the scan goes on."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).select(F.from_json("value", kept, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return lines.where("_corrupt_record is null").drop("_corrupt_record"), lines.where("_corrupt_record is not null").select(F.col("_corrupt_record").alias("warning"))


def _accounts_of(text: str | None) -> list[dict[str, Any]] | None:
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return None
    found = found.get("accounts") if isinstance(found, dict) else found
    return found if isinstance(found, list) and found else None


def configured_accounts(env: dict[str, str] | None = None, path: str | None = None) -> list[dict[str, Any]] | None:
    """Account descriptors of SOURCE_ACCOUNTS in the environment, else of the file; None where neither lists any.

    A source that can't be read, or holds no list, is passed over.
    """
    env = dict(os.environ) if env is None else env
    sources = [env.get("SOURCE_ACCOUNTS"), Path(path).read_text(encoding="utf-8") if path and Path(path).exists() else None]
    return next((found for text in sources if (found := _accounts_of(text))), None)


def load_accounts(explicit: list[dict[str, Any]] | None = None, env: dict[str, str] | None = None, path: str | None = None) -> list[dict[str, Any]]:
    """Account descriptors: given ones, else configured ones, else one made of the environment's PROVIDER and <PROVIDER>_ACCOUNT_ID."""
    env = dict(os.environ) if env is None else env
    if found := explicit or configured_accounts(env, path):
        return found
    provider = env.get("PROVIDER") or "cal"
    prefix = provider.upper()
    direct = {"username": env.get(f"{prefix}_USERNAME", ""), "password": env.get(f"{prefix}_PASSWORD", "")}
    return [{"provider": provider, "providerAccountId": env.get(f"{prefix}_ACCOUNT_ID") or "default", "default": True, "credentials": direct}]


def resolve_credentials(account: dict[str, Any], env: dict[str, str] | None = None) -> dict[str, str]:
    """Username and password of a descriptor: what stands there, else the variable it names, else ''.

    They may lie under ``credentials`` or in the descriptor itself.
    """
    env = dict(os.environ) if env is None else env
    given = account["credentials"] if isinstance(account.get("credentials"), dict) else account

    def one(name: str) -> str:
        if given.get(name) is not None:
            return str(given[name])
        return env.get(str(given.get(f"{name}Env")), "")

    return {name: one(name) for name in ("username", "password")}


def load_settings(path: str, env: dict[str, str] | None = None) -> dict[str, Any]:
    """daysBack, accounts and finance of a settings file, in stored form; without accounts there, a row for each configured one.

    A file that can't be read counts as empty.
    """
    env = dict(os.environ) if env is None else env
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        raw = None
    block = raw if isinstance(raw, dict) else {}
    listed = raw if isinstance(raw, list) else block.get("accounts")
    if not isinstance(listed, list) or not listed:
        listed = [{"provider": a.get("provider"), "providerAccountId": a.get("providerAccountId") or a.get("accountId"), "displayName": shown_name(a)} | {"enabled": True, "default": True} for a in load_accounts(None, env)]
    days = block.get("daysBack")
    fallback = env.get("DAYS_BACK", "")
    given = days if isinstance(days, int) and not isinstance(days, bool) else int(fallback) if fallback.isdigit() else DAYS_BACK_DEFAULT
    return {"daysBack": given, "accounts": stored_accounts(listed), "finance": sanitize_finance(block.get("finance") or {})}


def save_settings(settings: dict[str, Any], path: str) -> dict[str, Any]:
    """Write settings in stored form, the whole file or none; returns what was written. Bad days back are a ValueError."""
    listed = settings.get("accounts")
    stored = {
        "daysBack": validate_days_back(settings.get("daysBack")),
        "accounts": stored_accounts(listed if isinstance(listed, list) else []),
        "finance": sanitize_finance(settings.get("finance") or {}),
    }
    write_text(path, json.dumps(stored, indent=2, ensure_ascii=False))
    return stored


def shown_name(account: dict[str, Any]) -> str:
    """The name of an account that was given none."""
    return account.get("displayName") or f"{str(account.get('provider') or '').upper()} ({account.get('providerAccountId') or account.get('accountId') or 'default'})"


def account_frame(spark: SparkSession, accounts: list[dict[str, Any]]) -> DataFrame:
    """Descriptors as rows for ``operators.accounts.normalize_accounts``; secrets aren't among the columns."""
    schema = "seq bigint, provider string, provider_account_id string, account_id string, display_name string, enabled boolean, default boolean, is_default boolean, days_back double"
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    rows = [(i, a.get("provider"), a.get("providerAccountId"), a.get("accountId"), a.get("displayName"), a.get("enabled") is not False, a.get("default") is True, a.get("isDefault") is True, number(a.get("daysBack"))) for i, a in enumerate(accounts)]
    return spark.createDataFrame(rows, schema)


class JsonLines(SourceAdapter):
    """Raw rows of JSON lines; a line that can't be read is a warning, and the scan goes on."""

    name = "jsonl"

    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, spark: SparkSession, as_of: str, days_back: int) -> DataFrame:
        return self.fetch(spark, as_of, days_back).rows

    def fetch(self, spark: SparkSession, as_of: str, days_back: int, start_index: int = 0) -> Fetched:
        """Rows of the look-back by the date in ``transaction_ts_raw``; the filter comes before anything is kept of a row."""
        rows, warnings = read_valid(spark, self.path, RAW)
        recent = look_back(rows.withColumn("_date", parse_date(F.col("transaction_ts_raw"))), as_of, days_back, "_date").drop("_date")
        return Fetched(recent.where(F.col("seq") >= start_index), warnings.select(F.concat(F.lit("row skipped: "), F.substring("warning", 1, 80)).alias("warning")))


registry.register(JsonLines.name, JsonLines)
