"""The registered queries of the engine: each applies one operator to whole benchmark tables."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions import http, identity, text
from weirflow.functions.retry import wait_ms
from weirflow.operators import accounts, cdc, ledger, normalize, outbound, reports
from weirflow.plans import pipeline
from weirflow.schema import LEDGER, RAW, SEEN, with_defaults
from weirflow.sources.buckets import Bucketed
from weirflow.sources.registry import Fetched, Registry, SourceAdapter
from weirflow.sources.sinks import export_json, write_report
from weirflow.sources.store import Checkpoints, Fenced, Files, Journal, Versioned, shared_dir, written
from weirflow.sources.tables import TableSource, orders_raw, table

Query = Callable[[SparkSession, str], DataFrame]

NOW = "2026-01-02 03:04:05"
AS_OF = "1996-06-15"
#: Words that play the part of status markers in the benchmark's texts, and of secrets.
MARKERS = ["with the of", "the that", "and of", "de la", "der die"]
SECRETS = ["token", "the", None, "", "que"]

_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_queries)


#: Tables that play a part of the input (state, ledger, an earlier run's rows), by session, tables and name. They are written
#: once, so that a query's plan, and its time, is that of its operator.
_fixtures: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def fixture(build: Query) -> Query:
    def read(s: SparkSession, d: str) -> DataFrame:
        key = (s.sparkContext.applicationId, d, build.__name__)
        if key not in _fixtures:
            frame, path = build(s, d), f"{scratch_folder(s)}/{build.__name__}"
            frame.write.parquet(path)
            _fixtures[key] = path, frame.schema
        path, schema = _fixtures[key]
        return s.read.schema(schema).parquet(path)

    return read


def scratch_folder(s: SparkSession) -> str:
    """A fresh folder in the shared one, gone when the session is."""
    path = f"{shared_dir(s)}/weirflow/q-{uuid.uuid4().hex}"
    Files(s).create(f"{path}/_OWNER", s.sparkContext.applicationId)
    Files(s).delete_on_exit(path)
    return path


def _txn(s: SparkSession, d: str) -> DataFrame:
    return normalize.normalize(orders_raw(s, d))


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return cdc.occurrence_keys(_txn(s, d))


@fixture
def _seen(s: SparkSession, d: str) -> DataFrame:
    """State as if a first run had read 7 of 10 rows; some hashes are stale, some of a version that stored none."""
    first = cdc.occurrence_keys(_txn(s, d).where(F.col("seq") % 10 < 7))
    stale = F.when(F.col("seq") % 10 == 5, F.lit(None).cast("string")).when(F.col("seq") % 10 == 3, F.lit("0000000000000000")).otherwise(F.col("content_hash"))
    return first.select(*cdc.KEY, stale.alias("content_hash"), F.lit("2025-12-01 00:00:00").cast("timestamp").alias("last_seen_at"), F.lit(None).cast("timestamp").alias("updated_at"))


def _classified(s: SparkSession, d: str) -> DataFrame:
    state = _in_buckets(s, d, "seen")
    return cdc.keyed_against(_txn(s, d), state.read(), buckets=state.buckets)


@fixture
def _ledger(s: SparkSession, d: str) -> DataFrame:
    """Entries for 4 of 10 rows: sent, sent with another hash, sent without a hash, failed."""
    rows = _keyed(s, d).where(F.col("seq") % 10 < 4)
    kind = F.col("seq") % 10
    return rows.select(
        *cdc.KEY,
        F.when(kind == 3, "failed").otherwise("sent").alias("finance_status"),
        F.when(kind == 3, "api_error").otherwise(ledger.SENT).alias("reason"),
        F.when(kind == 1, F.lit("0000000000000000")).when(kind == 0, F.col("content_hash")).alias("content_hash"),
        F.when(kind == 3, 500).otherwise(201).alias("api_status"),
        F.when(kind != 3, F.concat(F.lit("fin_"), F.col("seq").cast("string"))).alias("finance_transaction_id"),
        F.when(kind != 3, F.lit("2025-12-01 00:00:00").cast("timestamp")).alias("sent_at"),
        F.lit("2025-12-01 00:00:00").cast("timestamp").alias("last_attempt_at"),
        F.lit(1).alias("attempts"),
    )


_buckets: dict[tuple[str, str, str], Bucketed] = {}


def _in_buckets(s: SparkSession, d: str, name: str) -> Bucketed:
    """The state or the ledger in buckets, written once."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _buckets:
        held = Bucketed(s, f"{scratch_folder(s)}/{name}", SEEN if name == "seen" else LEDGER)
        held.write((_seen if name == "seen" else _ledger)(s, d))
        _buckets[key] = held
    return _buckets[key]


def _decided(s: SparkSession, d: str) -> DataFrame:
    state, book = _in_buckets(s, d, "seen"), _in_buckets(s, d, "ledger").read()
    return ledger.decide(cdc.keyed_against(_txn(s, d), state.read(), book, buckets=state.buckets), book)


@fixture
def _finished(s: SparkSession, d: str) -> DataFrame:
    """As if the system had answered: 500 to one in 17, 422 to one in 19, else 201."""
    decided = _decided(s, d)
    status = F.when(F.col("seq") % 17 == 0, 500).when(F.col("seq") % 19 == 0, 422).otherwise(201)
    sent = decided.where("decision = 'send'").select(*cdc.KEY, "seq", status.alias("api_status"))
    results = sent.select("*", F.col("api_status").between(200, 299).alias("ok"), http.classify_status(F.col("api_status")).alias("classification"), F.when(F.col("api_status") == 201, F.concat(F.lit("new_"), F.col("seq").cast("string"))).alias("finance_transaction_id"))
    return ledger.with_results(decided, results)


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# Scalars


@query
def parse_amount(s: SparkSession, d: str) -> DataFrame:
    return orders_raw(s, d).select("seq", "amount_raw", text.parse_amount(F.col("amount_raw")).alias("amount"), text.parse_amount(F.col("charge_amount_raw")).alias("charge_amount"))


@query
def detect_currency(s: SparkSession, d: str) -> DataFrame:
    return orders_raw(s, d).select("seq", text.detect_currency(F.col("amount_raw")).alias("currency"), text.detect_currency(F.col("card_name")).alias("card_currency"), text.detect_currency(F.col("charge_amount_raw")).alias("charge_currency"))


@query
def parse_date(s: SparkSession, d: str) -> DataFrame:
    return orders_raw(s, d).select("seq", text.parse_date(F.col("transaction_ts_raw")).alias("transaction_date"), text.parse_date(F.col("charge_date_raw")).alias("charge_date"))


@query
def pending_marker(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.pending_marker(F.col("text"), MARKERS).alias("marker"))


@query
def pending_filter(s: SparkSession, d: str) -> DataFrame:
    marked = normalize.mark_pending(orders_raw(s, d), ["amount not final"])
    return marked.groupBy("provider_account_id").agg(F.count_if(F.col("pending_marker").isNotNull()).alias("pending_skipped"), F.count_if(F.col("pending_marker").isNull()).alias("kept"))


@query
def pending_text(s: SparkSession, d: str) -> DataFrame:
    section = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("lang"))
    return table(s, d, "documents").select("doc_id", text.pending_text([section, F.lit("")], F.col("source")).alias("status_text"))


@query
def number_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", identity.number_text(F.col("l_extendedprice")).alias("price"), identity.number_text(F.col("l_quantity")).alias("quantity"), identity.number_text(-F.col("l_discount")).alias("discount"))


@query
def redact_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.redact(F.col("text"), SECRETS).alias("redacted"))


@query
def safe_url(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", text.safe_url(F.col("url")).alias("url"))


@query
def truncate_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("snippet"))


@query
def one_line(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.one_line(F.col("text")).alias("line"))


@query
def csv_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.csv_line([F.col("doc_id"), F.col("text"), F.col("lang"), F.lit(None)]).alias("line"))


@query
def html_escape(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query
def file_name(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", text.file_name(F.col("url")).alias("name"))


@query
def state_name(s: SparkSession, d: str) -> DataFrame:
    account = F.when(F.col("c_custkey") % 3 == 0, F.lit("default")).when(F.col("c_custkey") % 3 == 1, F.lit("")).otherwise(F.col("c_name"))
    return table(s, d, "customer").select("c_custkey", text.state_name(F.lit("cal"), account).alias("name"))


@query
def secret_scrub(s: SparkSession, d: str) -> DataFrame:
    nested = F.struct(F.col("source").alias("a"), F.array("lang", "source").alias("b"))
    return table(s, d, "documents").select("doc_id", text.scrub(nested, "a string, b array<string>", ["src1"]).alias("r")).select("doc_id", F.col("r.a").alias("a"), F.array_join("r.b", ",").alias("b"))


@query
def auth_failure(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    message = F.concat(F.col("event_type"), F.when(k == 0, F.lit(": Login verification failed")).when(k == 1, F.lit(": request Timed Out")).otherwise(F.lit("")))
    name = F.when(F.col("event_id") % 7 == 0, F.lit(text.LOGIN_ERROR)).when(F.col("event_id") % 7 == 1, F.lit("Error"))
    return table(s, d, "events").select("event_id", text.is_auth_failure(name, message).alias("auth"), text.is_timeout(message).alias("timeout"))


@query
def backoff_schedule(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select("n_nationkey", wait_ms(F.col("n_nationkey")).alias("wait"), wait_ms(F.col("n_nationkey"), 100, 2.0).alias("doubling"))


# Normalization


@query
def extract_detail(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders")
    pairs = rows.select("o_orderkey", F.posexplode(F.array(
        F.struct(F.lit("status").alias("label"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("priority").alias("label"), F.col("o_orderpriority").alias("value")),
        F.struct(F.lit("status").alias("label"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" ")).otherwise(F.lit(" later ")).alias("value")),
    )).alias("position", "e")).select("o_orderkey", "position", "e.label", "e.value")
    return normalize.extract_details(pairs, ["o_orderkey"], {"status": "status", "priority": "priority", "missing": "missing"})


@query
def normalize_txn(s: SparkSession, d: str) -> DataFrame:
    return _txn(s, d).drop("provider_display_name", "dedup_key", "amount_raw", "charge_amount_raw")


@query
def source_stamp(s: SparkSession, d: str) -> DataFrame:
    rows = _txn(s, d).withColumn("provider", F.when(F.col("seq") % 2 == 0, F.lit("")).otherwise(F.col("provider")))
    return normalize.stamp_source(rows, "main", "Main card", "other").select("seq", "provider", "provider_account_id", "provider_display_name")


@query
def lookback_window(s: SparkSession, d: str) -> DataFrame:
    return normalize.look_back(_txn(s, d), AS_OF, 365).select("seq", "transaction_date")


@query
def resume_slice(s: SparkSession, d: str) -> DataFrame:
    return normalize.resume_slice(_txn(s, d), 1000).select("seq", "merchant_name")


@query
def segment_union(s: SparkSession, d: str) -> DataFrame:
    rows = _txn(s, d).select("seq", "merchant_name")
    return normalize.segments(rows.where("seq < 1000"), rows.where("seq >= 1000"))


# Identity and change capture


@query
def fingerprint(s: SparkSession, d: str) -> DataFrame:
    return _txn(s, d).select("seq", identity.fingerprint().alias("fingerprint"))


@query
def content_hash(s: SparkSession, d: str) -> DataFrame:
    return _txn(s, d).select("seq", identity.content_hash().alias("content_hash"))


@query
def occurrence_keys(s: SparkSession, d: str) -> DataFrame:
    return _keyed(s, d).select("seq", "provider_account_id", "dedup_key")


@query
def within_run_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.col("event_id").alias("seq"), F.lit("CAL").alias("provider"), F.col("event_type").alias("provider_account_id"), F.col("user_id").cast("string").alias("dedup_key"))
    return cdc.repeats_in_run(rows).select("seq", "repeated")


@query
def classify_incremental(s: SparkSession, d: str) -> DataFrame:
    return _classified(s, d).select("seq", "dedup_key", "kind", "local_dedup_status")


@query
def full_fetch(s: SparkSession, d: str) -> DataFrame:
    return cdc.counters(cdc.keyed_against(_txn(s, d), _seen(s, d), full_fetch=True))


@query
def export_delta(s: SparkSession, d: str) -> DataFrame:
    return cdc.exported(_classified(s, d)).select("seq", "dedup_key", "local_dedup_status")


@query
def considered_counts(s: SparkSession, d: str) -> DataFrame:
    return cdc.counters(_classified(s, d))


@query
def new_rows_anti(s: SparkSession, d: str) -> DataFrame:
    return cdc.never_seen(_keyed(s, d), _seen(s, d)).select("seq", "dedup_key")


@query
def seen_rows_semi(s: SparkSession, d: str) -> DataFrame:
    return cdc.seen_before(_keyed(s, d), _seen(s, d)).select("seq", "dedup_key")


@fixture
def _exported(s: SparkSession, d: str) -> DataFrame:
    return cdc.exported(_classified(s, d))


@query
def seen_upsert(s: SparkSession, d: str) -> DataFrame:
    """State that lies in buckets, and a run's delta: only the delta is shuffled."""
    state = _in_buckets(s, d, "seen")
    after = cdc.upsert_seen(state.read(), state.aligned(_exported(s, d)), F.lit(NOW).cast("timestamp"))
    return after.select(*cdc.KEY, "content_hash", _stamp("last_seen_at"), _stamp("updated_at"))


@query
def seen_migrate(s: SparkSession, d: str) -> DataFrame:
    """Each customer's file: version 2, version 1, or broken."""
    key = F.col("c_custkey").cast("string")
    entry = F.concat(F.lit('{"entries": {"k'), key, F.lit('": {"contentHash": "h'), key, F.lit('", "lastSeenAt": "2026-01-02T03:04:05Z", "updatedAt": null}}}'))
    v1 = F.concat(F.lit('{"fingerprints": ["a'), key, F.lit('", "b'), key, F.lit('"]}'))
    data = F.when(F.col("c_custkey") % 3 == 0, entry).when(F.col("c_custkey") % 3 == 1, v1).otherwise(F.lit("not json"))
    files = table(s, d, "customer").select(F.lit("cal").alias("provider"), key.alias("provider_account_id"), data.alias("data"))
    return cdc.seen_from_files(files).select(*cdc.KEY, "content_hash", _stamp("last_seen_at"), _stamp("updated_at"))


@query
def run_status(s: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.lit("boom"))
    warnings = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("row skipped"))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "events").select("event_id", cdc.run_status(error, warnings).alias("status"))


# Sending


@query
def should_send(s: SparkSession, d: str) -> DataFrame:
    return _txn(s, d).select("seq", outbound.should_send().alias("send"))


@query
def plan_export(s: SparkSession, d: str) -> DataFrame:
    return outbound.plan(_txn(s, d))


@query
def resolve_amount(s: SparkSession, d: str) -> DataFrame:
    amount = F.when(F.col("seq") % 5 == 0, F.lit(0.0)).when(F.col("seq") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("amount"))
    raw = F.when(F.col("seq") % 2 == 0, F.lit("none")).otherwise(F.col("amount_raw"))
    return _txn(s, d).withColumns({"amount": amount, "amount_raw": raw}).select("seq", outbound.original_amount().alias("original_amount"))


@query
def payload(s: SparkSession, d: str) -> DataFrame:
    return _keyed(s, d).where(outbound.should_send()).select("seq", outbound.payload().alias("p")).select("seq", "p.*")


@query
def http_classify(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("int")).otherwise((F.floor(F.col("value")) % 400 + 200).cast("int"))
    return table(s, d, "events").select("event_id", http.classify_status(status, F.col("event_id") % 11 != 0).alias("classification"), http.classify_probe(status).alias("reachable"))


@query
def response_id(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    body = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"id": "'), k, F.lit('"}')))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"transaction_id": "t'), k, F.lit('"}')))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"data": {"id": "d'), k, F.lit('"}}')))
        .when(F.col("event_id") % 5 == 3, F.lit("not json"))
        .otherwise(F.col("props"))
    )
    return table(s, d, "events").select("event_id", http.response_id(body).alias("found"))


# Ledger


@query
def ledger_decide(s: SparkSession, d: str) -> DataFrame:
    return _decided(s, d).select("seq", "decision", "reason")


@query
def ledger_merge(s: SparkSession, d: str) -> DataFrame:
    book = _in_buckets(s, d, "ledger")
    after = ledger.merge(book.read(), book.aligned(_finished(s, d)), F.lit(NOW).cast("timestamp"))
    return after.select(*cdc.KEY, "finance_status", "reason", "content_hash", "api_status", "finance_transaction_id", _stamp("sent_at"), _stamp("last_attempt_at"), "attempts")


@query
def audit_rows(s: SparkSession, d: str) -> DataFrame:
    return ledger.audit(_finished(s, d), "run-1", NOW).withColumn("apiStatus", F.col("apiStatus").cast("string"))


@query
def sync_counts(s: SparkSession, d: str) -> DataFrame:
    return ledger.sync_counts(_finished(s, d))


@query
def sync_gates(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", ledger.gate_column(k % 2 == 0, F.when(k % 3 == 0, F.lit("u")), F.when(k % 5 != 0, F.lit("k")), k % 7 != 0).alias("gate"))


@query
def reason_text(s: SparkSession, d: str) -> DataFrame:
    codes = [*reports.REASON_TEXT, "other", ""]
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("event_id") % len(codes) + 1).cast("int"))
    return table(s, d, "events").select("event_id", reports.reason_text(code).alias("said"))


# Accounts


def _accounts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k.alias("seq"),
        F.lit("CAL").alias("provider"),
        F.when(k % 3 != 0, F.col("c_name")).alias("provider_account_id"),
        F.when(k % 6 == 0, F.lit("old")).alias("account_id"),
        F.when(k % 4 != 0, F.col("c_mktsegment")).alias("display_name"),
        F.when(k % 5 != 0, k % 5 != 1).alias("enabled"),
        F.when(k % 7 == 0, F.lit(True)).alias("default"),
        (k % 50 == 0).alias("is_default"),
        F.when(k % 2 == 0, k / 4.0).alias("days_back"),
        F.col("c_nationkey"),
    )


@query
def account_normalize(s: SparkSession, d: str) -> DataFrame:
    return accounts.normalize_accounts(_accounts(s, d)).withColumn("days_back", F.col("days_back").cast("string"))


@query
def account_select(s: SparkSession, d: str) -> DataFrame:
    return accounts.select_accounts(accounts.normalize_accounts(_accounts(s, d)), "all", check=False).select("seq", "provider_account_id")


@query
def default_account(s: SparkSession, d: str) -> DataFrame:
    return accounts.select_accounts(accounts.normalize_accounts(_accounts(s, d)), "default", check=False).select("seq", "is_default")


@query
def single_default(s: SparkSession, d: str) -> DataFrame:
    return accounts.single_default(_accounts(s, d), ("c_nationkey",)).select("seq", "c_nationkey", "is_default")


@query
def effective_days_back(s: SparkSession, d: str) -> DataFrame:
    rows = accounts.normalize_accounts(_accounts(s, d))
    return rows.select("seq", accounts.days_back(F.col("days_back"), None, 9).alias("days_back"), accounts.valid_days_back(F.concat(F.lit(" "), F.col("days_back").cast("string"))).cast("string").alias("valid"))


@query
def unused_credentials(s: SparkSession, d: str) -> DataFrame:
    stored = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("credential_key"))
    named = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("credential_key"))
    return accounts.unused_credentials(stored, named)


# Reports


def _runs(s: SparkSession, d: str) -> DataFrame:
    e, v = F.col("event_id"), F.floor(F.col("value"))
    return table(s, d, "events").select(
        e.alias("record_seq"),
        F.lit("CAL").alias("provider"),
        F.col("user_id").cast("string").alias("provider_account_id"),
        F.col("event_type").alias("display_name"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + e % 100).alias("finished_at"),
        (e % 100 * 1000).alias("duration_ms"),
        F.when(F.col("event_type") == "error", "failed").when(e % 3 == 0, "partial").otherwise("success").alias("status"),
        F.when(e % 9 != 0, v).alias("transactions_fetched"),
        (e % 4).alias("transactions_skipped"),
        (e % 2).alias("pending_skipped_count"),
        F.when(e % 5 != 0, e % 3).alias("retry_count"),
        F.when(e % 6 != 0, e % 10 == 1).alias("re_auth_occurred"),
        (e % 2 == 0).alias("session_reused"),
        F.when(F.col("event_type") == "error", F.lit("boom")).alias("fatal_error"),
        F.lit(None).cast("string").alias("export_path"),
        (e % 8 == 0).alias("resumed"),
        (e % 16 == 0).alias("checkpoint_used"),
        (e % 12).alias("created_count"),
        (e % 7).alias("updated_count"),
        (e % 13).alias("unchanged_count"),
        (e % 12 + e % 7).alias("new_transactions_exported"),
        (e % 3).alias("duplicates_skipped"),
    )


@query
def metrics_rollup(s: SparkSession, d: str) -> DataFrame:
    return reports.metrics(_runs(s, d)).withColumn("last_run_at", F.date_format("last_run_at", "yyyy-MM-dd HH:mm:ss"))


@query
def last_run(s: SparkSession, d: str) -> DataFrame:
    return reports.last_run(_runs(s, d)).withColumn("last_run_at", F.date_format("last_run_at", "yyyy-MM-dd HH:mm:ss"))


@query
def run_duration(s: SparkSession, d: str) -> DataFrame:
    return _runs(s, d).select("record_seq", reports.duration_ms(F.col("started_at"), F.col("finished_at")).alias("ms"))


def _account_runs(s: SparkSession, d: str) -> DataFrame:
    counts = cdc.counters(_classified(s, d))
    return counts.withColumns({"status": F.when(F.col("provider_account_id") == "acct_0", "failed").when(F.col("provider_account_id") == "acct_1", "partial").otherwise("success"), "transactions_fetched": F.col("considered")})


@query
def run_summary(s: SparkSession, d: str) -> DataFrame:
    return reports.run_summary(_account_runs(s, d))


@query
def account_sums(s: SparkSession, d: str) -> DataFrame:
    return reports.account_sums(_account_runs(s, d))


@query
def account_results(s: SparkSession, d: str) -> DataFrame:
    return reports.account_result(_runs(s, d))


@query
def account_events(s: SparkSession, d: str) -> DataFrame:
    return reports.account_event(_runs(s, d))


@query
def event_text(s: SparkSession, d: str) -> DataFrame:
    kinds = [*(k for k in reports.EVENT_LINES if k != "export nothing"), "finance-progress"]
    e = F.col("record_seq")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (e % len(kinds) + 1).cast("int"))
    said = {
        "display_name": F.when(e % 5 != 0, F.col("display_name")),
        "provider_account_id": F.col("provider_account_id"),
        "days_back": F.when(e % 2 == 0, e % 30),
        "session_reused": F.col("session_reused"),
        "fetched": e,
        "pending": F.col("pending_skipped_count"),
        "skipped": F.col("transactions_skipped"),
        "created": F.col("created_count"),
        "updated": F.col("updated_count"),
        "unchanged": F.col("unchanged_count"),
        "duplicates": F.col("duplicates_skipped"),
        "exported": F.col("new_transactions_exported"),
        "file_path": F.when(e % 3 == 0, F.lit("out/f.json")),
        "status": F.col("status"),
        "error": F.lit("boom"),
        "considered": e,
        "sent": e % 3,
        "already_sent": e % 4,
        "finance_skipped": e % 5,
        "failed": e % 2,
        "reason": F.when(e % 2 == 0, F.lit("finance_disabled")).otherwise(F.lit("missing_api_key")),
    }
    return _runs(s, d).select("record_seq", reports.event_text(kind, said).alias("line"))


@query
def export_path(s: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(s, d, "orders").select("o_orderkey", reports.export_path("out", F.lit("cal"), F.when(F.col("o_custkey") % 2 == 0, F.lit("default")).otherwise(F.col("o_custkey").cast("string")), day).alias("path"))


@query
def warnings_concat(s: SparkSession, d: str) -> DataFrame:
    prior = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("earlier")))
    return table(s, d, "orders").select("o_orderkey", F.array_join(normalize.joined_warnings(prior, F.array("o_orderpriority")), ";").alias("warnings"))


@query
def account_union(s: SparkSession, d: str) -> DataFrame:
    """Each account's rows on their own, as a run reads them, classified in one plan."""
    parts = [_txn(s, d).where(F.col("provider_account_id") == f"acct_{i}") for i in range(4)]
    return cdc.keyed_against(normalize.union_accounts(parts), _seen(s, d)).select("seq", "provider_account_id", "local_dedup_status")


@query
def landing_scan(s: SparkSession, d: str) -> DataFrame:
    """Each account's rows written down by its own fetch, and classified from one scan of all that was."""
    folder = scratch_folder(s)
    names = [r[0] for r in orders_raw(s, d).select("provider_account_id").distinct().orderBy("provider_account_id").limit(100).collect()]
    for name in names:
        rows = normalize.mark_pending(orders_raw(s, d).where(F.col("provider_account_id") == name).withColumn("panel_text", F.lit("")).select(*RAW.fieldNames()))
        rows = cdc.hashed(normalize.normalize(rows, "CAL", keep=("pending_marker",)))
        normalize.stamp_source(rows, name, name, "cal").withColumn("segment", F.lit(0)).write.parquet(f"{folder}/{name}")
    state = _in_buckets(s, d, "seen")
    txn = pipeline.landed(s, [f"{folder}/{name}" for name in names])
    return cdc.keyed_against(txn, state.read(state.touched(txn)), None, ("segment", "seq"), buckets=state.buckets).select("seq", "provider_account_id", "local_dedup_status")


# Runs


def _marked_raw(s: SparkSession, d: str) -> DataFrame:
    """Raw rows, one in 13 with a marker of a pending row."""
    return orders_raw(s, d).withColumn("panel_text", F.when(F.col("seq") % 13 == 0, F.lit(f"x {text.PENDING_MARKERS[2]} y")).otherwise(F.lit("settled"))).select(*RAW.fieldNames())


@query
def capture_final(s: SparkSession, d: str) -> DataFrame:
    """A capture leaves pending rows out, before keys are numbered."""
    return pipeline.capture(_marked_raw(s, d), _seen(s, d)).considered.select("seq", "dedup_key", "local_dedup_status")


@query
def capture_pending(s: SparkSession, d: str) -> DataFrame:
    return pipeline.capture(_marked_raw(s, d), _seen(s, d)).pending


def _adapter(rows: Callable[[SparkSession], Fetched], label: str | None) -> type[SourceAdapter]:
    class Given(SourceAdapter):
        def read(self, spark: SparkSession, as_of: str, days_back: int) -> DataFrame:
            return rows(spark).rows

        def fetch(self, spark: SparkSession, as_of: str, days_back: int, start_index: int = 0) -> Fetched:
            got = rows(spark)
            return Fetched(got.rows.where(F.col("seq") >= start_index), got.warnings)

    Given.label = label
    return Given


def _run(s: SparkSession, d: str) -> pipeline.RunResult:
    """Three providers with an account of the same name: one fine, one with a warning, one that breaks while it is read."""
    raw = _marked_raw(s, d)
    sources = Registry()
    sources.register("cal", _adapter(lambda spark: Fetched(raw), normalize.PROVIDER))
    sources.register("other", _adapter(lambda spark: Fetched(raw.where("seq % 2 = 0"), spark.createDataFrame([("row 7 skipped",)], "warning string")), None))
    sources.register("broken", _adapter(lambda spark: Fetched(raw.withColumn("card_name", F.raise_error(F.lit("the source is down")).cast("string"))), None))
    listed = [{"provider": p, "provider_account_id": "default", "display_name": p.title()} for p in ("cal", "broken", "other")]
    folder = scratch_folder(s)
    return pipeline.run_accounts(s, listed, sources, f"{folder}/state", None, AS_OF, NOW)


@query
def run_accounts(s: SparkSession, d: str) -> DataFrame:
    names = ["provider", "provider_account_id", "display_name", "status", "transactions_fetched", "pending_skipped", "skipped", "created", "exported", "considered"]
    return s.createDataFrame([tuple(a[n] for n in names) for a in _run(s, d).accounts], "provider string, provider_account_id string, display_name string, status string, transactions_fetched bigint, pending_skipped bigint, skipped bigint, created bigint, exported bigint, considered bigint")


@query
def run_considered(s: SparkSession, d: str) -> DataFrame:
    """Accounts of different providers keep their rows apart, whatever their names."""
    return _run(s, d).considered.groupBy("provider", "provider_account_id", "provider_display_name").agg(F.count("*").alias("rows"), F.count_if(F.contains("dedup_key", F.lit("|#"))).alias("repeats"))


@query
def fetch_succeeded(s: SparkSession, d: str) -> DataFrame:
    runs = _runs(s, d)
    return ledger.fetch_succeeded(runs).crossJoin(ledger.fetch_succeeded(runs.where("status = 'failed'")).withColumnRenamed("fetch_succeeded", "of_failed"))


@query
def sync_ok(s: SparkSession, d: str) -> DataFrame:
    gate = F.when(F.col("event_id") % 3 == 0, F.lit("fetch_failed"))
    return table(s, d, "events").select("event_id", ledger.sync_ok(gate, F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 2)).alias("ok"))


@query
def report_name(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select("n_nationkey", reports.report_name(F.col("n_name")).alias("name"))


@query
def row_recognizer(s: SparkSession, d: str) -> DataFrame:
    children = F.when(F.col("o_orderkey") % 7 != 0, F.array_repeat(F.lit("c"), (F.col("o_orderkey") % 7).cast("int")))
    return table(s, d, "orders").select("o_orderkey", F.coalesce(normalize.recognized(children), F.lit(False)).alias("is_row"))


@query
def failure_after_success(s: SparkSession, d: str) -> DataFrame:
    """Every entry of the ledger is tried again, and fails."""
    book = _ledger(s, d)
    tried = book.select(*cdc.KEY, F.lit("failed").alias("finance_status"), F.lit("api_error").alias("reason"), F.lit("h").alias("content_hash"), F.lit(500).alias("api_status"), F.lit(None).cast("string").alias("finance_transaction_id"))
    return ledger.merge(book, tried, F.lit(NOW).cast("timestamp")).select(*cdc.KEY, "finance_status", "reason", "api_status", "attempts", _stamp("sent_at"), _stamp("last_attempt_at"))


@query
def ledger_load(s: SparkSession, d: str) -> DataFrame:
    """Each customer's ledger file; one in four is broken."""
    key = F.col("c_custkey").cast("string")
    entry = F.format_string('{"entries": {"k%s": {"financeStatus": "sent", "contentHash": "h%s", "apiStatus": 201, "sentAt": "2026-01-02T03:04:05Z", "attempts": 2}}}', key, key)
    files = table(s, d, "customer").select(F.lit("cal").alias("provider"), key.alias("provider_account_id"), F.when(F.col("c_custkey") % 4 != 0, entry).otherwise(F.lit("{broken")).alias("data"))
    return ledger.ledger_from_files(files).select(*cdc.KEY, "finance_status", "content_hash", "api_status", _stamp("sent_at"), "attempts")


@query
def state_versions(s: SparkSession, d: str) -> DataFrame:
    """State in buckets, written and then merged into, bucket by bucket, and read again."""
    state = Bucketed(s, f"{scratch_folder(s)}/seen", SEEN)
    state.write(_seen(s, d).where("content_hash is not null"))
    state.merge(_seen(s, d).where("content_hash is null"), lambda old, new: old.unionByName(new))
    return state.read().select(*cdc.KEY, "content_hash", _stamp("last_seen_at"))


@query
def ledger_versions(s: SparkSession, d: str) -> DataFrame:
    """The ledger in one piece, as earlier releases wrote it, put into buckets by its next write."""
    path = f"{scratch_folder(s)}/ledger"
    Versioned(s, path, LEDGER).write(_ledger(s, d).where("finance_status = 'sent'"))
    book = Bucketed(s, path, LEDGER)
    book.merge(_ledger(s, d).where("finance_status <> 'sent'"), lambda old, new: old.unionByName(new))
    return book.read().select(*cdc.KEY, "finance_status", "api_status", "finance_transaction_id", "attempts")


@query
def checkpoint_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Each account's rows written down as a first segment of a fetch, with where to go on; loaded and read again. One account is cleared."""
    kept = Checkpoints(s, f"{scratch_folder(s)}/checkpoints")
    raw, rows = orders_raw(s, d), []
    names = [r[0] for r in raw.select("provider_account_id").distinct().orderBy("provider_account_id").limit(100).collect()]
    for name in names:
        folder = kept.rows_path()
        raw.where(F.col("provider_account_id") == name).select("seq", "amount_raw").write.parquet(folder)
        last = s.read.parquet(folder).agg(F.max("seq")).first()[0]
        kept.save("cal", name, last + 1, [folder], [f"up to {last}"])
    kept.clear("cal", "acct_2")
    parts = []
    for name in names:
        if (found := kept.load("cal", name)) is not None:
            segment = s.read.parquet(*found["rows"])
            parts.append(segment.agg(F.lit(name).alias("account"), F.lit(found["next_index"]).cast("long").alias("next_index"), F.count("*").alias("rows"), F.sum("seq").alias("seqs"), F.lit(";".join(found["warnings"])).alias("warnings")))
    return normalize.union_accounts(parts)


@query
def json_scan(s: SparkSession, d: str) -> DataFrame:
    """All transactions in files that hold an array each, of a thousand or less."""
    from weirflow.sources.files import load_transactions

    path = f"{scratch_folder(s)}/arrays"
    rows = _txn(s, d).select("seq", F.struct("seq", "merchant_name", "amount", "status").alias("t"))
    rows.groupBy(F.expr("seq div 1000").alias("file")).agg(F.to_json(F.collect_list("t"), {"pretty": "true"}).alias("value")).write.partitionBy("file").text(path)
    return load_transactions(s, path).select("seq", "merchant_name", "amount", "status")


@query
def array_splits(s: SparkSession, d: str) -> DataFrame:
    """All transactions as one array in one file, read in ranges of 64 KB."""
    from weirflow.sources.files import load_array

    path = f"{scratch_folder(s)}/one"
    t = F.to_json(F.struct("seq", F.concat(F.col("merchant_name"), F.lit('"],[{\\')).alias("merchant_name"), "amount", "status"))
    lines = _txn(s, d).select(F.col("seq").alias("o"), F.concat(t, F.lit(",")).alias("value"))
    # The executors write the lines, a comma and a line break behind each; their files are put together stream by stream.
    files = Files(s)
    lines.orderBy("o").select("value").write.text(path)
    parts = [f"{path}/{x}" for x in files.names(path) if x.startswith("part-")]
    files.assemble(f"{path}/one.json", "[\n", parts, "]\n", cut=2)
    return load_array(s, f"{path}/one.json", split=1 << 16).select("seq", "merchant_name", "amount", "status")


@query
def valid_rows(s: SparkSession, d: str) -> DataFrame:
    """A scan of JSON lines of which one in nine is broken: rows within the look-back, and warnings."""
    from weirflow.sources.files import JsonLines

    path = f"{scratch_folder(s)}/lines"
    raw = orders_raw(s, d)
    raw.select(F.when(F.col("seq") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(*RAW.fieldNames()))).alias("value")).write.text(path)
    got = JsonLines(path).fetch(s, AS_OF, 700)
    both = got.rows.select("seq", F.lit(0).alias("bad")).unionByName(got.warnings.select(F.lit(None).cast("long").alias("seq"), F.lit(1).alias("bad")))
    return both.agg(F.count("seq").alias("rows"), F.sum("seq").alias("seqs"), F.count_if(F.col("bad") == 1).alias("warnings"))


@query
def journal_once(s: SparkSession, d: str) -> DataFrame:
    """Outcomes of sends, journalled one by one, read back once each, and merged into an empty ledger."""
    from weirflow.schema import RESULT

    journal = Journal(s, f"{scratch_folder(s)}/journal", RESULT)
    for r in table(s, d, "supplier").select("s_name", "s_suppkey").orderBy("s_suppkey").toLocalIterator():
        journal.add({"provider": "cal", "provider_account_id": "default", "dedup_key": r.s_name, "seq": r.s_suppkey, "content_hash": "h", **outbound.outcome(422 if r.s_suppkey % 4 == 0 else 201, f"id{r.s_suppkey}")})
    empty = s.createDataFrame([], LEDGER)
    return ledger.merge(empty, ledger.attempts_of(journal.read()), F.lit(NOW).cast("timestamp")).select("dedup_key", "finance_status", "reason", "api_status", "finance_transaction_id", "attempts")


@query
def statement_source(s: SparkSession, d: str) -> DataFrame:
    """Raw rows as JSON lines, one in nine broken, read through the data source from a resume index on, within the look-back; with warnings."""
    from weirflow.sources.connector import PUSH_DOWN, StatementSource

    s.conf.set(PUSH_DOWN, "true")
    path = f"{scratch_folder(s)}/lines"
    orders_raw(s, d).select(F.when(F.col("seq") % 9 == 0, F.concat(F.lit("{broken "), F.col("seq").cast("string"))).otherwise(F.to_json(F.struct(*RAW.fieldNames()))).alias("value")).write.text(path)
    got = StatementSource(path).fetch(s, AS_OF, 700, 1000)
    return got.rows.select("seq", "transaction_ts_raw", F.lit(None).cast("string").alias("warning")).unionByName(got.warnings.select("warning"), allowMissingColumns=True)


@query
def table_source(s: SparkSession, d: str) -> DataFrame:
    """The rows of an adapter within the look-back."""
    return TableSource(d).read(s, AS_OF, 700).select("seq", "transaction_ts_raw")


@query
def export_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """The delta as JSON under provider, account and day, written twice and read back."""
    root = f"{scratch_folder(s)}/out"
    delta = _exported(s, d)
    export_json(delta.limit(1), root, "2026-01-02")
    export_json(delta, root, "2026-01-02")
    return s.read.json(root).groupBy("provider", "provider_account_id", F.col("export_date").cast("string").alias("export_date")).agg(F.count("*").alias("rows"), F.countDistinct("dedup_key").alias("keys"))


@query
def audit_report(s: SparkSession, d: str) -> DataFrame:
    """The audit report written by the executors, its JSON read back."""
    path, _ = write_report(ledger.audit(_finished(s, d), "run-1", NOW), {}, "run-1", scratch_folder(s), one_file=False)
    return s.read.json(path).groupBy("financeStatus", "reason").agg(F.count("*").alias("rows"), F.min("dedupKey").alias("first_key"))


def _descriptor() -> Column:
    """Each customer's account descriptor, full of secrets, as JSON text; one in eleven can't be read."""
    key = F.col("c_custkey")
    day = F.when(key % 4 == 0, F.lit("1.5")).when(key % 4 == 1, F.lit('"7"')).otherwise((key % 400).cast("string"))
    said = F.concat(
        F.lit('{"provider": "'), F.col("c_mktsegment"), F.lit('", "accountId": " '), key.cast("string"), F.lit(' ", "displayName": "'), F.col("c_name"),
        F.lit('", "isDefault": '), (key % 7 == 3).cast("string"), F.lit(', "enabled": '), F.when(key % 3 == 0, F.lit("false")).when(key % 3 == 1, F.lit('"false"')).otherwise(F.lit("true")),
        F.lit(', "daysBack": '), day, F.lit(', "password": "secret", "credentials": {"username": "secret", "usernameEnv": "'), F.concat(F.lit("USER_"), F.col("c_nationkey").cast("string")),
        F.lit('"}, "passwordEnv": " PASS_'), (key % 5).cast("string"), F.lit(' "}'),
    )
    return F.when(key % 11 == 0, F.lit("{broken")).otherwise(said)


@query
def account_sanitize(s: SparkSession, d: str) -> DataFrame:
    """The stored form of every customer's descriptor, one default a nation."""
    rows = table(s, d, "customer").select("c_nationkey", F.col("c_custkey").alias("seq"), _descriptor().alias("data"))
    stored = accounts.stored_table(rows, ("c_nationkey",))
    return stored.withColumn("leaks", F.to_json(F.struct("*")).contains("secret"))


@query
def credentials_resolve(s: SparkSession, d: str) -> DataFrame:
    """Names of variables in every customer's descriptor, looked up among the nations' variables."""
    rows = table(s, d, "customer").select("c_nationkey", F.col("c_custkey").alias("seq"), _descriptor().alias("data"))
    direct = F.when(F.col("seq") % 6 == 0, F.concat(F.lit("own"), F.col("seq").cast("string")))
    env = table(s, d, "nation").where("n_nationkey <> 4").select(F.explode(F.array(F.struct(F.concat(F.lit("USER_"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("value")), F.struct(F.concat(F.lit("PASS_"), F.col("n_nationkey").cast("string")).alias("name"), F.lower("n_name").alias("value")))).alias("e")).select("e.*")
    found = accounts.resolved(accounts.stored_table(rows, ("c_nationkey",)).withColumn("username", direct), env)
    return found.select("seq", "username", "password")


def _settings(s: SparkSession, d: str) -> DataFrame:
    """A settings file for each customer: an object, a bare list of accounts, one without accounts, a broken one."""
    key, one = F.col("c_custkey"), F.when(F.col("c_custkey") % 11 == 0, F.lit("{}")).otherwise(_descriptor())
    listed = F.concat(F.lit("["), one, F.lit(', {"provider": "MAX", "providerAccountId": "second", "default": '), (key % 2 == 0).cast("string"), F.lit("}]"))
    whole = F.concat(F.lit('{"daysBack": '), (key % 500 - 50).cast("string"), F.lit(', "accounts": '), listed, F.lit(', "finance": {"enabled": '), (key % 3 == 0).cast("string"), F.lit(', "apiUrl": " https://x/'), key.cast("string"), F.lit(' ", "apiKey": "secret"}}'))
    data = F.when(key % 10 == 0, F.lit("{broken")).when(key % 10 == 1, listed).when(key % 10 == 2, F.lit('{"daysBack": 9, "accounts": []}')).otherwise(whole)
    return table(s, d, "customer").select(key.cast("string").alias("name"), data.alias("data"))


@query
def account_load(s: SparkSession, d: str) -> DataFrame:
    """The accounts that all settings files list, in normal form."""
    v = F.col("_v")
    listed = accounts.listed_in(_settings(s, d), "name").withColumn("_v", F.try_parse_json("data"))
    form = accounts.stored_form(v)
    raw = listed.select("name", "seq", *[form[c].alias(c) for c in ("provider", "provider_account_id", "enabled")], F.nullif(form["display_name"], F.lit("")).alias("display_name"), F.lit(None).cast("string").alias("account_id"), form["is_default"].alias("default"), F.lit(False).alias("is_default"), form["days_back"].cast("double").alias("days_back"))
    return accounts.normalize_accounts(raw.withColumn("seq", F.col("name").cast("long") * 10 + F.col("seq")))


@query
def settings_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """All settings files in stored form, written, and read again; the days back that can't be used are left out."""
    files, path = _settings(s, d), f"{scratch_folder(s)}/settings"
    v = F.col("_v")
    days = accounts.valid_days_back(F.try_variant_get(v, "$.daysBack", "string"))
    listed = accounts.stored_table(accounts.listed_in(files, "name"), ("name",)).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seq", "provider", "provider_account_id", "is_default", "days_back", "username_env"))).alias("accounts"))
    stored = files.withColumn("_v", F.try_parse_json("data")).select("name", days.alias("days_back"), *[c.alias(n) for n, c in accounts.finance_form(v).items()]).join(listed, "name", "left")
    stored.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    again = s.read.schema("name string, days_back int, finance_enabled boolean, api_url string, finance_credential_key string, accounts array<struct<seq: bigint, provider: string, provider_account_id: string, is_default: boolean, days_back: bigint, username_env: string>>").json(path)
    first = F.filter("accounts", lambda a: a["is_default"])[0]
    leaks = s.read.text(path).where(F.col("value").contains("secret")).select(F.get_json_object("value", "$.name").alias("name"), F.lit(True).alias("_leaks"))
    return again.join(leaks, "name", "left").select("name", "days_back", "finance_enabled", "api_url", "finance_credential_key", F.coalesce(F.size("accounts"), F.lit(0)).alias("accounts"), first["provider_account_id"].alias("default_account"), first["username_env"].alias("username_env"), F.coalesce("_leaks", F.lit(False)).alias("leaks"))


@query
def registry_resolve(s: SparkSession, d: str) -> DataFrame:
    """Which source every customer's provider means."""
    sources = Registry()
    for name in ("Building", "MACHINERY", "machinery", "tables"):
        sources.register(name, TableSource)
    return sources.resolve(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "source")


@query
def post_requests(s: SparkSession, d: str) -> DataFrame:
    """What is posted for every qualifying row, read back from its JSON."""
    sent = outbound.requests(_keyed(s, d))
    read = F.from_json("body", "type string, amount double, date string, description string, charge_date string, payment_source_name string, currency string, original_amount double, external_id string")
    return sent.select("seq", read.alias("p")).select("seq", "p.type", "p.amount", "p.date", "p.description", "p.payment_source_name", "p.currency", "p.original_amount", "p.external_id")


@query
def post_messages(s: SparkSession, d: str) -> DataFrame:
    """What is told of answers that refuse, whose bodies are the documents."""
    key = F.col("doc_id")
    status = F.when(key % 5 == 0, F.lit(None).cast("int")).when(key % 5 == 1, 422).otherwise(500)
    return table(s, d, "documents").select("doc_id", outbound.failure_message(status, F.col("text"), SECRETS).alias("message"))


@query
def send_all_or_stop(s: SparkSession, d: str) -> DataFrame:
    """A dry run, a run that sends all, and one that the 5th answer stops."""
    rows = _txn(s, d)
    dry, sent = pipeline.run_export(rows), pipeline.run_export(rows, lambda p: (201, None), dry_run=False)
    calls: list[int] = []
    try:
        pipeline.run_export(rows, lambda p: (calls.append(1), (500 if len(calls) == 5 else 201, None))[1], dry_run=False)
        stopped = False
    except outbound.SendError:
        stopped = True
    return s.createDataFrame([(dry["total"], dry["qualifying"], dry["sent"], sent["sent"], len(calls), stopped)], "total bigint, qualifying bigint, dry_sent bigint, sent bigint, calls bigint, stopped boolean")


@query
def sync_not_attempted(s: SparkSession, d: str) -> DataFrame:
    """A sync behind each gate: nothing is sent; a fetch-only run hasn't even a report."""
    # As a run leaves them: written once, whatever is then asked of them.
    rows, folder = written(_classified(s, d), "considered"), scratch_folder(s)
    out = []
    for gate in (ledger.FETCH_ONLY, *ledger.GATES):
        got = pipeline.sync(rows, f"{folder}/state", f"{folder}/reports", "r", NOW, lambda p: (201, None), gate, one_file=False)
        out.append((gate, got["executed"], got["reason"], got["counts"] and got["counts"]["not_attempted"], got["report"] is not None))
    return s.createDataFrame(out, "gate string, executed boolean, reason string, not_attempted bigint, reported boolean")


@query
def one_run_at_a_time(s: SparkSession, d: str) -> DataFrame:
    """All customers' balances sent by two runs that overlap: half way through, the first one's lease has run out, and a second
    run takes over. Who sent each row, and what the ledger has of it once a third run has found what came late."""
    folder = scratch_folder(s)
    balance = F.col("c_acctbal").cast("double")
    rows = with_defaults(table(s, d, "customer").select(F.col("c_custkey").alias("seq"), F.lit("cal").alias("provider"), F.col("c_mktsegment").alias("provider_account_id"), F.col("c_name").alias("dedup_key"), F.lit("completed").alias("status"), balance.alias("charge_amount"), balance.alias("amount")))
    rows = rows.withColumns({c: F.lit("") for c in ("amount_raw", "charge_amount_raw")} | {"local_dedup_status": F.lit("new"), "content_hash": F.md5("dedup_key")})
    written_rows = f"{folder}/rows"
    rows.write.parquet(written_rows)
    rows = s.read.parquet(written_rows)
    half, sent = rows.where(outbound.should_send()).count() // 2, []
    run = lambda name, sender: pipeline.sync(rows, f"{folder}/state", f"{folder}/reports", name, NOW, sender, one_file=False, lease=-1)

    def second(p: dict) -> tuple:
        sent.append((p["external_id"], "second"))
        return 201, None

    def first(p: dict) -> tuple:
        sent.append((p["external_id"], "first"))
        if len(sent) == half:
            run("second", second)
        return 201, None

    with contextlib.suppress(Fenced):
        run("first", first)
    run("third", lambda p: 1 / 0)
    book = Bucketed(s, f"{folder}/state/ledger", LEDGER).read().select("dedup_key", "finance_status")
    return book.join(s.createDataFrame(sent, "dedup_key string, sent_by string"), "dedup_key", "full_outer")


@query
def capture_stream(s: SparkSession, d: str) -> DataFrame:
    """The stream over all raw rows, in one go: its delta. Equals the batch capture against an empty state."""
    from weirflow.streaming.incremental import capture_stream as run

    at = scratch_folder(s)
    orders_raw(s, d).select(*RAW.fieldNames()).write.parquet(f"{at}/raw")
    run(s, f"{at}/raw", RAW, f"{at}/state", f"{at}/delta", f"{at}/checkpoint", NOW)
    return s.read.parquet(f"{at}/delta").select("seq", "dedup_key", "local_dedup_status")
