"""Reports over runs: metrics, summaries, texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a reason code says.
REASON_TEXT = {
    "run_mode_fetch_only": "Fetch Only run — finance was not contacted",
    "finance_disabled": "finance integration is disabled",
    "missing_api_url": "the finance API URL is not set",
    "missing_api_key": "no finance API key is saved",
    "fetch_failed": "the fetch failed, so nothing was synced",
    "transaction_not_completed": "transaction is not completed yet",
    "charge_amount_zero_or_negative": "no positive charge amount",
    "already_sent_successfully": "already sent to finance previously",
    "already_sent_content_changed": "already sent, but details changed since — review needed",
    "duplicate_in_current_batch": "duplicate within this batch",
    "api_validation_failed": "finance API rejected the transaction",
    "api_error": "finance API/network error",
}

#: Columns of the audit report, in order.
AUDIT_COLUMNS = [
    "runId",
    "timestamp",
    "provider",
    "accountId",
    "accountLabel",
    "transactionDate",
    "merchant",
    "amount",
    "chargeAmount",
    "currency",
    "status",
    "localDedupStatus",
    "financeStatus",
    "reason",
    "apiStatus",
    "financeTransactionId",
    "dedupKey",
]


def reason_text(reason: Column) -> Column:
    """The text of a code; an unknown code as it is; 'unknown reason' for none."""
    text = F.lit(None).cast("string")
    for code, said in REASON_TEXT.items():
        text = F.when(reason == code, said).otherwise(text)
    return F.coalesce(text, F.nullif(reason, F.lit("")), F.lit("unknown reason"))


def duration_ms(started: Column, finished: Column) -> Column:
    return F.unix_millis(finished) - F.unix_millis(started)


def _total(column: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(F.col(column), F.lit(0))), F.lit(0)).cast("long")


def _flagged(column: str) -> Column:
    return F.count_if(F.coalesce(F.col(column), F.lit(False)))


def metrics(runs: DataFrame) -> DataFrame:
    """Totals over run reports, and four fields of the last: one aggregation, combined before the shuffle."""
    last = F.max_by(F.struct("finished_at", "duration_ms", "status", "provider"), "record_seq")
    totals = runs.agg(
        F.count("*").alias("total_runs"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("success", "successful_runs"), ("partial", "partial_runs"), ("failed", "failed_runs"))],
        _total("retry_count").alias("total_retries"),
        _flagged("re_auth_occurred").alias("total_re_auths"),
        _total("transactions_fetched").alias("total_transactions_fetched"),
        _total("transactions_skipped").alias("total_transactions_skipped"),
        _total("pending_skipped_count").alias("total_pending_skipped"),
        _flagged("resumed").alias("resumed_runs"),
        _total("duplicates_skipped").alias("total_duplicates_skipped"),
        _total("unchanged_count").alias("total_unchanged"),
        _total("updated_count").alias("total_updated"),
        _flagged("checkpoint_used").alias("checkpoint_recoveries"),
        last.alias("_last"),
    )
    names = {"finished_at": "last_run_at", "duration_ms": "last_run_duration_ms", "status": "last_run_status", "provider": "last_run_provider"}
    return totals.select("*", *[F.col(f"_last.{a}").alias(b) for a, b in names.items()]).drop("_last")


def last_run(runs: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("finished_at", "duration_ms", "status", "provider"), "record_seq").alias("r")
    return runs.agg(last).select(F.col("r.finished_at").alias("last_run_at"), F.col("r.duration_ms").alias("last_run_duration_ms"), F.col("r.status").alias("last_run_status"), F.col("r.provider").alias("last_run_provider"))


def run_summary(accounts: DataFrame) -> DataFrame:
    """Over the accounts of a run (status, exported, considered)."""
    return accounts.agg(
        F.count("*").alias("total_accounts"),
        F.count_if(F.col("status").isin("success", "partial")).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        _total("exported").alias("total_transactions_exported"),
        _total("considered").alias("total_transactions_considered"),
    )


def account_sums(accounts: DataFrame) -> DataFrame:
    """What the summary page shows: sums over the accounts of a run."""
    return accounts.agg(*[_total(c).alias(c) for c in ("transactions_fetched", "created", "updated", "unchanged", "exported")])


def account_result(runs: DataFrame) -> DataFrame:
    """A run report as it is shown: no secrets, and 0 or null for what is missing."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return runs.select(
        "provider",
        "provider_account_id",
        "display_name",
        "status",
        F.col("fatal_error").alias("error"),
        F.coalesce("session_reused", F.lit(False)).alias("session_reused"),
        count("transactions_fetched").alias("transactions_fetched"),
        count("pending_skipped_count").alias("pending_skipped"),
        count("transactions_skipped").alias("skipped"),
        count("created_count").alias("created"),
        count("updated_count").alias("updated"),
        count("unchanged_count").alias("unchanged"),
        count("duplicates_skipped").alias("duplicates"),
        count("new_transactions_exported").alias("exported"),
        "export_path",
    )


def account_event(runs: DataFrame) -> DataFrame:
    """The counts of a report that its last event carries."""
    names = ["session_reused", "transactions_fetched", "pending_skipped", "skipped", "created", "updated", "unchanged", "duplicates", "exported", "export_path"]
    return account_result(runs).select("provider", "provider_account_id", *names)


#: The line of each kind of event. A field stands in braces; what stands in brackets is said only if its field
#: is there and not 0 or ''. Kinds that aren't here have no line.
EVENT_LINES = {
    "account-start": "▶ {who} — starting (days back {days_back})…",
    "visible-browser-notice": "   {who} — CAL login requires a visible browser window. Keep it open until login completes.",
    "login": "   {who} — {login}.",
    "fetched": "   {who} — fetched {fetched} transaction(s)[, {pending} pending skipped][, {skipped} extraction skip(s)].",
    "dedup": "   {who} — {created} new, {updated} updated, {unchanged} unchanged, {duplicates} duplicate(s).",
    "export": "   {who} — exported {exported} transaction(s)[ → {file_path}].",
    "export nothing": "   {who} — nothing new to export.",
    "account-done": "✔ {who} — done ({status}).",
    "account-error": "✖ {who} — {error}",
    "finance-start": "▶ Finance sync — evaluating {considered} transaction(s) against the finance ledger…",
    "finance-done": "✔ Finance sync — sent {sent}, already sent {already_sent}, skipped {finance_skipped}, failed {failed} (of {considered}).",
    "finance-not-attempted": "• Finance sync not attempted — {reason_text}.",
    "finance-error": "✖ Finance sync — {error}",
}
SESSION_REUSED, LOGGED_IN, ANY_DAYS, NOBODY = "reused saved session", "logged in", "global", "account"


def _line(template: str, fields: dict[str, Column]) -> Column:
    """A template of ``EVENT_LINES`` as an expression."""
    parts: list[Column] = []
    for piece in re.findall(r"\[[^\]]*\]|\{\w+\}|[^\[{]+", template):
        if piece[0] == "[":
            own = fields[re.search(r"\{(\w+)\}", piece)[1]]
            there = own.isNotNull() & ~own.isin("", "0")
            parts.append(F.when(there, _line(piece[1:-1], fields)).otherwise(F.lit("")))
        else:
            parts.append(F.coalesce(fields[piece[1:-1]], F.lit("")) if piece[0] == "{" else F.lit(piece))
    return F.concat(*parts)


def event_text(kind: Column, said: dict[str, Column]) -> Column:
    """One line for an event, null for a kind without one.

    ``said`` has the fields of the event by name: display_name, provider_account_id, provider, days_back, session_reused,
    fetched, pending, skipped, created, updated, unchanged, duplicates, exported, file_path, status, error, considered, sent,
    already_sent, finance_skipped, failed, reason; those that a kind doesn't need may be missing.
    """
    names = set(re.findall(r"\{(\w+)\}", " ".join(EVENT_LINES.values())))
    fields = {n: said[n].cast("string") if n in said else F.lit(None).cast("string") for n in names}
    given = [F.nullif(said[n], F.lit("")) for n in ("display_name", "provider_account_id", "provider") if n in said]
    fields["who"] = F.coalesce(*given, F.lit(NOBODY))
    fields["login"] = F.when(F.coalesce(said["session_reused"], F.lit(False)), SESSION_REUSED).otherwise(LOGGED_IN) if "session_reused" in said else F.lit(LOGGED_IN)
    fields["days_back"] = F.coalesce(fields["days_back"], F.lit(ANY_DAYS))
    fields["reason_text"] = reason_text(said["reason"] if "reason" in said else F.lit(None).cast("string"))
    exported = F.coalesce(said["exported"], F.lit(0)) > 0 if "exported" in said else F.lit(False)
    named = F.when((kind == "export") & ~exported, "export nothing").otherwise(kind)
    out = F.lit(None).cast("string")
    for k, template in EVENT_LINES.items():
        out = F.when(named == k, _line(template, fields)).otherwise(out)
    return out


def export_path(root: Column | str, provider: Column, account: Column, day: Column) -> Column:
    """Where a run's delta goes: a file for each provider, account and UTC day; the day's later runs overwrite it."""
    from weirflow.functions.text import state_name

    base = F.lit(root) if isinstance(root, str) else root
    return F.concat(base, F.lit("/"), state_name(provider, account), F.lit("_"), day, F.lit(".json"))


def report_name(run_id: Column) -> Column:
    return F.concat(F.lit("finance-sync-"), run_id)
