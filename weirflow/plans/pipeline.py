"""Whole runs: capture changes, export the delta, sync to finance.

All accounts of a run are one DataFrame, keyed by account, so they are classified in one plan; each account is read, and can
fail, by itself.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.retry import retry
from weirflow.operators import accounts as accounts_ops
from weirflow.operators import cdc, ledger, normalize, outbound
from weirflow.operators.reports import run_summary
from weirflow.schema import LEDGER, RAW, RESULT, SEEN
from weirflow.sources.buckets import Bucketed
from weirflow.sources.lease import LEASE, Lease, single_flight
from weirflow.sources.registry import Registry, SourceAdapter
from weirflow.sources.sinks import export_json, write_report
from weirflow.sources.store import Checkpoints, Journal

#: What a run does with an event: its kind and what it says. Errors of a listener never break a run.
Listener = Callable[[str, dict[str, Any]], None]
#: Asks the finance system for what was sent under an external id (``outbound.settled``).
Find = Callable[[str], tuple[int, str | None] | None]


@dataclass
class Capture:
    """What one run found; DataFrames are lazy."""

    considered: DataFrame
    delta: DataFrame
    counts: DataFrame
    pending: DataFrame


def capture(raw: DataFrame, seen: DataFrame, full_fetch: bool = False, prior: DataFrame | None = None, ledger_rows: DataFrame | None = None, provider: str = normalize.PROVIDER) -> Capture:
    """Raw rows to classified rows, delta and counters. Pending rows are left out and counted; transactions of an earlier
    segment, kept whole in a checkpoint, come first."""
    final, pending = normalize.split_pending(raw)
    txn = normalize.normalize(final, provider)
    order: tuple[str, ...] = ("seq",)
    if prior is not None:
        txn, order = normalize.segments(prior, txn), ("segment", "seq")
    classified = cdc.keyed_against(txn, seen, ledger_rows, order, full_fetch)
    return Capture(classified, cdc.exported(classified), cdc.counters(classified), pending)


@dataclass
class RunResult:
    summary: dict[str, Any]
    accounts: list[dict[str, Any]]
    considered: DataFrame | None
    warnings: list[str] = field(default_factory=list)


def _teller(listener: Listener | None) -> Listener:
    def tell(kind: str, said: dict[str, Any]) -> None:
        if listener is not None:
            with contextlib.suppress(Exception):
                listener(kind, said)

    return tell


#: Counters of an account that its report and its events carry.
COUNTS = ("created", "updated", "unchanged", "duplicates", "exported", "considered")


class _Account:
    """One account of a run: its rows in the shared folder, and its report."""

    def __init__(self, account: dict[str, Any], adapter: SourceAdapter | None = None) -> None:
        self.provider, self.id, self.adapter = account["provider"].lower(), account["provider_account_id"], adapter
        self.display_name, self.days_back = account.get("display_name") or "", account.get("days_back")
        self.stamped = self.provider
        self.folders: list[str] = []
        self.report: dict[str, Any] = account | {
            "status": "running", "error": None, "warnings": [], "transactions_fetched": 0, "skipped": 0, "pending_skipped": 0,
            "retry_count": 0, "re_auth_occurred": False, "session_reused": False, "resumed": False, "checkpoint_path": None,
        } | dict.fromkeys(COUNTS, 0)

    def who(self) -> dict[str, Any]:
        return {"provider": self.provider, "provider_account_id": self.id, "display_name": self.display_name}

    def fail(self, error: Exception, say: Listener) -> None:
        self.report |= {"status": "failed", "error": str(error)}
        say("account-error", self.who() | {"error": str(error)})

    def _login(self, delay_ms: float) -> None:
        def again() -> None:
            self.report["retry_count"] += 1

        self.report["session_reused"] = bool(retry(self.adapter.login, 2, delay_ms, on_retry=again))

    def fetch(self, spark: SparkSession, as_of: str, days_back: int, checkpoints: Checkpoints, resume: bool, delay_ms: float, tell: Listener) -> None:
        """Log in, read the rows and write them down, so that whatever fails fails here. A lost login is renewed once."""
        found = checkpoints.load(self.provider, self.id) if resume else None
        if found:
            self.report |= {"resumed": True, "checkpoint_path": checkpoints.path(self.provider, self.id)}
        start = int((found or {}).get("next_index") or 0)
        self.folders, self.report["warnings"] = list((found or {}).get("rows") or []), list((found or {}).get("warnings") or [])
        self._login(delay_ms)
        tell("login", self.who() | {"session_reused": self.report["session_reused"]})
        folder = checkpoints.rows_path()

        def read() -> list[str]:
            got = self.adapter.fetch(spark, as_of, days_back, start)
            # Hashes come before the stamp of the account: what it says of itself isn't part of a row's identity.
            marked = normalize.mark_pending(got.rows.select(*RAW.fieldNames()))
            txn = cdc.hashed(normalize.normalize(marked, self.adapter.label or "", keep=("pending_marker",)))
            landed = normalize.stamp_source(txn, self.id, self.display_name, self.provider)
            landed.withColumn("segment", F.lit(len(self.folders))).write.mode("overwrite").parquet(folder)
            return [] if got.warnings is None else [r.warning for r in got.warnings.select("warning").toLocalIterator()]

        try:
            warnings = read()
        except Exception as error:
            if not self.adapter.is_auth_error(error):
                raise
            self.report["re_auth_occurred"] = True
            self._login(delay_ms)
            warnings = read()
        rows = spark.read.parquet(folder)
        pending = F.col("pending_marker").isNotNull()
        got = rows.agg(F.count_if(~pending).alias("fetched"), F.count_if(pending).alias("pending"), F.max("seq").alias("last"), F.min("provider").alias("provider")).first()
        self.stamped = got.provider or self.adapter.label or self.provider
        self.report |= {"transactions_fetched": got.fetched, "pending_skipped": got.pending, "skipped": len(warnings)}
        self.report["warnings"] += warnings
        self.report["status"] = "partial" if warnings else "success"
        self.folders.append(folder)
        checkpoints.save(self.provider, self.id, start if got.last is None else int(got.last) + 1, self.folders, self.report["warnings"])
        tell("fetched", self.who() | {k: self.report[k] for k in ("transactions_fetched", "pending_skipped", "skipped")})


def landed(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The final rows of all accounts and segments, in one scan: the plan is the same for three accounts and for three
    hundred. ``segment`` puts rows of an earlier, cut-off fetch before those of the one that went on."""
    empty = normalize.mark_pending(spark.createDataFrame([], RAW))
    schema = normalize.stamp_source(cdc.hashed(normalize.normalize(empty, "", keep=("pending_marker",))), "", "", "").withColumn("segment", F.lit(0)).schema
    rows = spark.read.schema(schema).parquet(*folders).where("pending_marker is null").drop("pending_marker")
    return rows.withColumn("segment", F.coalesce("segment", F.lit(0)))  # none in those of an earlier release


def run_accounts(
    spark: SparkSession,
    accounts: list[dict[str, Any]],
    sources: Registry,
    state_root: str,
    export_root: str | None,
    as_of: str,
    now: str,
    full_fetch: bool = False,
    options: dict[str, Any] | None = None,
    resume: bool = False,
    days_back: int | None = None,
    listener: Listener | None = None,
    ledger_rows: DataFrame | None = None,
    delay_ms: float = 2000,
    lease: float = LEASE,
    parallel: int = 4,
) -> RunResult:
    """Fetch all accounts, export what is new or changed, then move the state on, in this order: a crash between the two exports
    a delta again, and never loses one.

    Up to ``parallel`` accounts are fetched side by side, each in a scheduler pool of its own, so that a slow source or a large
    account doesn't hold up the others; what is told of them still comes account by account, in the order of ``accounts``.
    An account whose source fails is reported, and the others go on: its rows are read and written down by themselves. An
    account's rows stay in its checkpoint until the state has moved on; ``resume`` goes on from there. ``considered`` is a
    table in the shared folder, for the sync that may follow.
    """
    tell = _teller(listener)
    with single_flight(spark, state_root, lease) as held, contextlib.closing(Bucketed(spark, f"{state_root}/seen", SEEN, lease=held)) as state:
        checkpoints = Checkpoints(spark, f"{state_root}/checkpoints")
        done: list[_Account] = []

        def fetch(one: _Account, days: int | None, said: list[tuple[str, dict[str, Any]]]) -> None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fetch-{one.provider}-{one.id}")
            say = lambda kind, what: said.append((kind, what))
            say("account-start", one.who() | {"days_back": days})
            try:
                if one.report["error"] is not None:
                    raise ValueError(one.report["error"])
                one.adapter = sources.create(one.provider, **(options or {}))
                one.fetch(spark, as_of, days or accounts_ops.DAYS_BACK_DEFAULT, checkpoints, resume, delay_ms, say)
            except Exception as error:  # noqa: BLE001 - one account's failure is its result
                one.fail(error, say)
            finally:
                if one.adapter is not None:
                    one.adapter.close()

        with ThreadPoolExecutor(max(1, parallel)) as pool:
            fetches = []
            for a in accounts:
                one, said = _Account(a), []
                if any((x.provider, x.id) == (one.provider, one.id) for x, _, _ in fetches):
                    one.report["error"] = "the account is listed twice"
                days = one.days_back if one.days_back is not None else days_back
                fetches.append((one, said, pool.submit(inheritable_thread_target(fetch), one, days, said)))
            for one, said, future in fetches:
                future.result()
                if one.report["status"] != "failed" and any((x.stamped, x.id) == (one.stamped, one.id) for x in done if x.report["status"] != "failed"):
                    one.fail(ValueError("another account of the run has rows under the same names"), lambda kind, what, said=said: said.append((kind, what)))
                for kind, what in said:
                    tell(kind, what)
                done.append(one)
        considered = None
        fine = [x for x in done if x.report["status"] != "failed"]
        if fine:
            txn = landed(spark, [f for x in fine for f in x.folders])
            # Only buckets that the run's rows touch are read, and of the state no row is shuffled.
            seen = state.read(state.touched(txn))
            # Computed once and written down; what counts it rides along, and whatever is read of it later is read from there.
            considered, totals = _kept(cdc.keyed_against(txn, seen, ledger_rows, ("segment", "seq"), full_fetch, state.buckets), checkpoints)
            if len(fine) == 1:
                counts = {(fine[0].stamped, fine[0].id): totals}
            else:
                counts = {(r.provider, r.provider_account_id): r.asDict() for r in cdc.counters(considered).collect()}
            for x in fine:
                x.report |= {c: counts.get((x.stamped, x.id), {}).get(c, 0) for c in COUNTS}
                tell("dedup", x.who() | {c: x.report[c] for c in ("created", "updated", "unchanged", "duplicates")})
            delta = cdc.exported(considered)
            if export_root and totals["exported"]:
                export_json(delta, export_root, as_of)
            for x in fine:
                x.report["export_path"] = f"{export_root}/provider={x.stamped}/provider_account_id={x.id}/export_date={as_of}" if export_root and x.report["exported"] else None
                tell("export", x.who() | {"exported": x.report["exported"], "file_path": x.report["export_path"]})
            if not full_fetch and totals["exported"]:
                state.merge(delta, lambda old, new: cdc.upsert_seen(old, new, F.lit(now).cast("timestamp")))
            for x in fine:
                tell("account-done", x.who() | {"status": x.report["status"]})
        rows = spark.createDataFrame([(x.report["status"], int(x.report["exported"]), int(x.report["considered"])) for x in done], "status string, exported bigint, considered bigint")
        summary = run_summary(rows).first().asDict()
        result = RunResult(summary, [x.report for x in done], considered, [w for x in done for w in x.report["warnings"]])
        for x in fine:
            checkpoints.clear(x.provider, x.id)
        return result


def _kept(considered: DataFrame, checkpoints: Checkpoints) -> tuple[DataFrame, dict[str, int]]:
    """The rows as a table of their own, which outlives the checkpoints and lost executors and goes with the session; and the
    counters of all of them, observed on the pass that writes it."""
    path, seen = checkpoints.rows_path(), Observation()
    considered.observe(seen, *[c.alias(n) for n, c in cdc.counted().items()]).write.parquet(path)
    checkpoints.files.delete_on_exit(path)
    return considered.sparkSession.read.schema(considered.schema).parquet(path), {n: seen.get[n] for n in cdc.counted()}


def export_plan(txn: DataFrame) -> DataFrame:
    """The dry run: how many rows qualify, how many don't."""
    return outbound.plan(txn)


def run_export(txn: DataFrame, sender: outbound.Sender | None = None, dry_run: bool = True) -> dict[str, Any]:
    """Plan, and, if it isn't a dry run, send all or stop at the first failure."""
    planned = export_plan(txn).first().asDict()
    if dry_run:
        return planned | {"dry_run": True, "sent": 0}
    if sender is None:
        raise ValueError("sending needs a sender")
    outbound.send_all(txn, sender)
    # What was planned; the sender raised if not all were sent.
    return planned | {"dry_run": False, "sent": planned["qualifying"]}


def open_ledger(spark: SparkSession, state_root: str, now: str, find: Find | None = None, lease: Lease | None = None) -> tuple[Bucketed, DataFrame]:
    """The ledger, with what runs that were cut off have sent; their journals go once the ledger has them.

    Such a run may have been cut off within a send. What came of it is asked of the system by external id (``find``), now or
    in a later run; until then the row is in the ledger as in doubt, and isn't sent.
    """
    book = Bucketed(spark, f"{state_root}/ledger", LEDGER, lease=lease)
    for journal in Journal.leftovers(spark, f"{state_root}/journal", RESULT):
        if journal.name not in book.notes().get("journals", []):
            doubted = journal.in_doubt()
            _record(book, journal.name, journal.read(), now)
            if doubted is not None:
                _record(book, f"{journal.name}-doubt", _results(spark, [outbound.settled(doubted, find)]), now)
        journal.drop()
    entries = book.read()
    if find is not None:
        # At most one a run that was cut off.
        open_ = [outbound.settled(r.asDict() | {"seq": None}, find) for r in entries.where(ledger.in_doubt()).select(*cdc.KEY, "content_hash").toLocalIterator()]
        known = [r for r in open_ if r["classification"] != outbound.IN_DOUBT]
        if known:
            _record(book, None, _results(spark, known), now)
            entries = book.read()
    return book, entries


def _results(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in RESULT.fieldNames()) for r in rows], RESULT)


def _record(book: Bucketed, journal: str | None, results: DataFrame, now: str) -> None:
    notes = {"journals": [*book.notes().get("journals", []), journal][-20:]} if journal else None
    book.merge(ledger.attempts_of(results), lambda old, new: ledger.merge(old, new, F.lit(now).cast("timestamp")), notes)


def sync(
    considered: DataFrame,
    state_root: str,
    report_folder: str,
    run_id: str,
    now: str,
    sender: outbound.Sender,
    gate: str | None = None,
    on_event: Listener | None = None,
    one_file: bool = True,
    entries_of: int | None = None,
    lease: float = LEASE,
) -> dict[str, Any]:
    """Send what the ledger doesn't have yet, record it, and write the audit report.

    What is about to be sent is in the journal before the first of it is, and each outcome before the next send; the journal is
    merged into the ledger at the end, or by the next run if this one is cut off: it then sends none of them again, and the one
    that may have been under way only after a check by its external id (the sender's ``find``). A run that another has taken
    over from sends nothing more and raises ``Fenced``. ``entries_of``: the ledger version that the rows' own
    ``ledger_entry`` is of; while it is the last, the rows needn't be joined with the ledger again. Behind a gate only the sorted
    report is kept and ``considered`` is read twice, so it had better be a table than a long plan.
    """
    spark = considered.sparkSession
    tell = _teller(on_event)
    if gate == ledger.FETCH_ONLY:
        tell("finance-not-attempted", {"reason": gate})
        return {"executed": False, "reason": gate, "counts": None, "report": None}
    with single_flight(spark, f"{state_root}/sync", lease) as held:
        book, before = open_ledger(spark, state_root, now, getattr(sender, "find", None), held)
        current = entries_of is not None and entries_of == book.current()["number"]
        decided = ledger.decide(considered if current else considered.drop("ledger_entry"), before, gate)
        journal, report = Journal(spark, f"{state_root}/journal", RESULT, lease=held), None
        try:
            if gate is None:
                decided.persist()
                tell("finance-start", {"considered": decided.count()})
                outbound.send_each(decided.where("decision = 'send'"), sender, journal.add, lambda n: tell("finance-progress", {"sent": n}), journal.intend, journal.check)
                finished = ledger.with_results(decided, journal.read())
            else:
                tell("finance-not-attempted", {"reason": gate})
                finished = decided.withColumns({"finance_status": F.col("decision"), "api_status": F.lit(None).cast("int"), "finance_transaction_id": F.lit(None).cast("string")})
            # Sorted once, for the counts and both forms of the report.
            report = ledger.audit(finished, run_id, now).orderBy("dedupKey").persist()
            counts = ledger.sync_counts(report.withColumnRenamed("financeStatus", "finance_status")).first().asDict()
            paths = write_report(report, counts, run_id, report_folder, one_file)
            if journal.n:
                _record(book, journal.name, journal.read(), now)
            journal.drop()
            tell("finance-done", counts)
            return {"executed": gate is None, "reason": gate, "ok": gate is None and counts["failed"] == 0, "counts": counts, "report": paths}
        except Exception as error:
            tell("finance-error", {"error": str(error)})
            raise
        finally:
            decided.unpersist()
            if report is not None:
                report.unpersist()
            book.close()


def run_all(
    spark: SparkSession,
    settings: dict[str, Any],
    sources: Registry,
    state_root: str,
    export_root: str,
    report_folder: str,
    as_of: str,
    now: str,
    run_id: str,
    mode: str = "all",
    finance_mode: str = "fetch-only",
    finance: dict[str, Any] | None = None,
    sender: outbound.Sender | None = None,
    days_back: Any = None,
    listener: Listener | None = None,
    **options: Any,
) -> dict[str, Any]:
    """A whole run from stored settings: pick the accounts, fetch them, and, if asked to, sync what was found.

    Bad days back, or no account to run, are an answer with ``ok`` false; so is whatever a sync ends in, which never undoes
    the fetch. ``finance``: enabled, api_url, api_key; its gates are asked in the order of ``ledger.GATES``.
    """
    try:
        days = accounts_ops.validate_days_back(settings.get("daysBack") if days_back is None else days_back)
    except ValueError as error:
        return {"ok": False, "error": f"Invalid days back: {error}"}
    listed = settings.get("accounts") or []
    first = next((a for a in listed if a.get("default") is True), listed[0] if listed else None)
    chosen = ([first] if first else []) if mode == "default" else [a for a in listed if a.get("enabled") is not False]
    if not chosen:
        return {"ok": False, "error": "no account to run"}
    picked = [{"provider": a["provider"], "provider_account_id": a["providerAccountId"], "display_name": a.get("displayName"), "days_back": a.get("daysBack")} for a in chosen]
    entries, version = None, None
    if finance_mode == "sync":
        # Only read: what earlier runs left behind is merged under the sync's own lease.
        book = Bucketed(spark, f"{state_root}/ledger", LEDGER)
        entries, version = book.read(), book.base
    result = run_accounts(spark, picked, sources, state_root, export_root, as_of, now, days_back=days, listener=listener, ledger_rows=entries, **options)
    statuses = spark.createDataFrame([(a["status"],) for a in result.accounts], "status string")
    fetched = ledger.fetch_succeeded(statuses).first().fetch_succeeded
    block = finance or {}
    gate = ledger.run_gate(block.get("enabled") is True, block.get("api_url"), block.get("api_key"), fetched) if finance_mode == "sync" else ledger.FETCH_ONLY
    considered = result.considered if result.considered is not None else spark.createDataFrame([], _considered_schema(spark))
    try:
        synced = sync(considered, state_root, report_folder, run_id, now, sender, gate, listener, entries_of=version)
    except Exception as error:  # noqa: BLE001 - a sync never aborts the run
        synced = {"executed": True, "ok": False, "error": str(error)}
    finally:
        if entries is not None:
            book.close()
    return {"ok": True, "mode": "default" if mode == "default" else "all", "finance_mode": finance_mode, "days_back": days, "summary": result.summary, "accounts": result.accounts, "finance": synced}


def _considered_schema(spark: SparkSession) -> Any:
    return cdc.keyed_against(normalize.normalize(spark.createDataFrame([], RAW)), spark.createDataFrame([], SEEN)).schema
