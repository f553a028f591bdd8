from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from weirflow.functions import identity
from weirflow.operators import accounts, cdc, ledger, normalize, outbound, reports
from weirflow.plans import pipeline
from weirflow.schema import LEDGER, RAW, SEEN, TXN, with_defaults
from weirflow.sources.files import InputError, account_frame, JsonLines, configured_accounts, load_accounts, load_settings, load_transactions, read_valid, resolve_credentials, save_settings
from weirflow.sources.registry import Registry, SourceAdapter, UnknownSource
from weirflow.sources.sinks import csv_rows, export_file, export_json, write_report
from weirflow.sources.lease import single_flight
from weirflow.sources.store import Busy, Checkpoints, Files, Journal, Lost, Moved, Versioned
from weirflow.streaming.incremental import capture_stream

STAMP = "2026-01-02 03:04:05"
REGULAR = "רגיל"
X1 = {"provider": "CAL", "account_id": "Visa 1234", "transaction_date": "2026-04-15", "merchant_name": "SuperMarket", "amount": 50.5, "currency": "ILS", "transaction_type": REGULAR, "status": "completed", "charge_date": "2026-04-20", "charge_amount": 50.5, "charge_currency": "ILS", "category": "Food"}
X2 = X1 | {"transaction_date": "2026-04-16", "merchant_name": "Gas Station", "amount": 200.0, "status": "pending", "charge_date": "", "charge_amount": 200.0, "category": "Fuel"}
X3 = X1 | {"account_id": "ויזה5304", "transaction_date": "2026-05-10", "merchant_name": "TOPSTEP", "amount": 85.0, "currency": "USD", "transaction_type": "הוראת קבע", "charge_date": "2026-06-10", "charge_amount": 254.68, "category": ""}
X4 = X1 | {"status": "pending", "charge_date": ""}
X5A = X1 | {"transaction_date": "2026-05-01", "merchant_name": "Café Central", "amount": 42.0, "status": "pending", "charge_date": "", "charge_amount": 42.0, "category": ""}
X5B = X5A | {"status": "completed", "charge_date": "2026-05-05"}


def x6(i):
    return X1 | {"transaction_date": f"2026-05-{i + 1:02d}", "merchant_name": f"Shop {i}", "amount": float(i + 1), "charge_date": "2026-05-31", "charge_amount": float(i + 1), "category": ""}


def txns(spark, rows, account="main"):
    data = [{"seq": i, "provider_account_id": account} | r for i, r in enumerate(rows)]
    return with_defaults(spark.createDataFrame([tuple(r.get(f.name) for f in TXN.fields) for r in data], TXN))


def seen(spark, rows, account="main"):
    return spark.createDataFrame([("CAL", account, k, h, None, None) for k, h in rows], SEEN)


def tags(frame):
    return [r.local_dedup_status for r in frame.orderBy("seq").collect()]


def test_pinned_hashes(spark):
    rows = txns(spark, [X1, X2, X3, X4, X5A, X5B, x6(0)]).select("seq", identity.fingerprint().alias("f"), identity.content_hash().alias("c")).orderBy("seq").collect()
    assert [(r.f, r.c) for r in rows] == [
        ("0fc4e5b06842ec62", "8db9ce176f498d65"),
        ("fb2a6ebce27be4e8", "2b35e75c89f6c4f2"),
        ("ef1d7e8ebd331a71", "28c41289d6e05514"),
        ("0fc4e5b06842ec62", "0be5d75bd136ade5"),
        ("0246507eb9c007a8", "2b09fb59eb235851"),
        ("0246507eb9c007a8", "ac14785d7c105666"),
        ("295697b51b6d3d1a", "17e89eda0f451187"),
    ]


def test_legacy_entry_is_unchanged(spark):
    out = cdc.against_seen(cdc.occurrence_keys(txns(spark, [X1, X2])), seen(spark, [("0fc4e5b06842ec62", None)]))
    assert tags(out) == ["unchanged", "new"]


def test_equal_rows_get_their_own_keys(spark):
    keyed = cdc.occurrence_keys(txns(spark, [X3, X3]))
    keys = [r.dedup_key for r in keyed.orderBy("seq").collect()]
    assert keys == ["ef1d7e8ebd331a71", "ef1d7e8ebd331a71|#2"]
    h = "28c41289d6e05514"
    assert tags(cdc.against_seen(keyed, seen(spark, []))) == ["new", "new"]
    assert tags(cdc.against_seen(keyed, seen(spark, [(k, h) for k in keys]))) == ["unchanged", "unchanged"]
    assert tags(cdc.against_seen(keyed, seen(spark, [(keys[0], h)]))) == ["unchanged", "new"]


def test_full_window(spark):
    keyed = cdc.occurrence_keys(txns(spark, [x6(i) for i in range(10)])).cache()
    rows = {r.seq: r for r in keyed.collect()}
    state = [(rows[i].dedup_key, rows[i].content_hash) for i in range(8)] + [(rows[8].dedup_key, "stale")]
    out = cdc.against_seen(keyed, seen(spark, state))
    counts = cdc.counters(out).first()
    assert (counts.unchanged, counts.updated, counts.created, counts.exported, counts.considered) == (8, 1, 1, 2, 10)
    assert tags(cdc.against_seen(keyed, seen(spark, state), full_fetch=True)) == ["new"] * 10


def test_update_and_duplicate(spark):
    out = cdc.against_seen(cdc.occurrence_keys(txns(spark, [X5B])), seen(spark, [("0246507eb9c007a8", "2b09fb59eb235851")]))
    assert tags(out) == ["updated"]
    twice = cdc.occurrence_keys(txns(spark, [X1, X2])).withColumn("dedup_key", F.lit("k"))
    assert tags(cdc.against_seen(twice, seen(spark, []))) == ["new", "duplicate"]


def test_accounts_dont_collide(spark):
    both = txns(spark, [X1], "a").unionByName(txns(spark, [X1], "b"))
    out = cdc.against_seen(cdc.occurrence_keys(both), seen(spark, [("0fc4e5b06842ec62", "8db9ce176f498d65")], "a"))
    assert {r.provider_account_id: r.local_dedup_status for r in out.collect()} == {"a": "unchanged", "b": "new"}


def test_upsert(spark):
    old = spark.sql("select 'CAL' provider, 'main' provider_account_id, k dedup_key, h content_hash, timestamp'2025-01-01' last_seen_at, timestamp'2025-01-01' updated_at from values ('same', 'h'), ('changed', 'h'), ('legacy', null), ('other', 'h') t(k, h)")
    delta = spark.createDataFrame([("CAL", "main", k, h, i) for i, (k, h) in enumerate([("same", "h"), ("changed", "g"), ("legacy", "g"), ("fresh", "g")])], "provider string, provider_account_id string, dedup_key string, content_hash string, seq long")
    got = {r.dedup_key: (r.content_hash, r.last_seen_at.year, r.updated_at and r.updated_at.year) for r in cdc.upsert_seen(old, delta, F.lit(STAMP).cast("timestamp")).collect()}
    assert got == {"same": ("h", 2026, 2025), "changed": ("g", 2026, 2026), "legacy": ("g", 2026, 2025), "other": ("h", 2025, 2025), "fresh": ("g", 2026, None)}


def test_state_files(spark):
    v2 = json.dumps({"entries": {"k": {"contentHash": "h", "lastSeenAt": "2026-01-01T00:00:00.000Z", "updatedAt": None}}, "savedAt": "x"})
    files = spark.createDataFrame([("cal", "a", v2), ("cal", "b", '{"fingerprints": ["p", "q", "p"]}'), ("cal", "c", "{broken"), ("cal", "d", "[]")], "provider string, provider_account_id string, data string")
    rows = {(r.provider_account_id, r.dedup_key): r.content_hash for r in cdc.seen_from_files(files).collect()}
    assert rows == {("a", "k"): "h", ("b", "p"): None, ("b", "q"): None}
    book = json.dumps({"entries": {"k": {"financeStatus": "sent", "apiStatus": 201, "attempts": 2, "sentAt": "2026-01-01T00:00:00Z"}}})
    entry = ledger.ledger_from_files(spark.createDataFrame([("cal", "a", book), ("cal", "b", "")], files.schema)).collect()
    assert [(r.dedup_key, r.finance_status, r.api_status, r.attempts) for r in entry] == [("k", "sent", 201, 2)]


def raw(spark, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in RAW.fields) for r in rows], RAW)


def test_normalize(spark):
    rows = [
        {"seq": 0, "amount_raw": "RON72.50", "charge_amount_raw": "₪46.79", "transaction_ts_raw": "15/04/26 10:00", "charge_date_raw": "20/04/26", "card_name": "Visa", "business_name": "M"},
        {"seq": 1, "amount_raw": "USD 97.30", "charge_amount_raw": "₪284.62"},
        {"seq": 2, "amount_raw": "$5", "charge_amount_raw": ""},
        {"seq": 3},
    ]
    got = normalize.normalize(raw(spark, rows)).orderBy("seq").collect()
    assert [(r.amount, r.currency, r.charge_amount, r.charge_currency, r.status) for r in got] == [(72.5, "RON", 46.79, "ILS", "completed"), (97.3, "USD", 284.62, "ILS", "pending"), (5.0, "USD", 5.0, "ILS", "pending"), (0.0, "ILS", 0.0, "ILS", "pending")]
    assert (got[0].transaction_date, got[0].charge_date, got[3].account_id, got[3].transaction_date) == ("2026-04-15", "2026-04-20", "", "")


def test_details_and_pending(spark):
    pairs = spark.createDataFrame([(1, 0, " a ", " x "), (1, 1, "a", "y"), (1, 2, "a", " "), (1, 3, "", "z"), (2, 0, "b", "q")], "id int, position int, label string, value string")
    got = {r.id: (r.f, r.g) for r in normalize.extract_details(pairs, ["id"], {"a": "f", "b": "g"}).collect()}
    assert got == {1: ("y", ""), 2: ("", "q")}
    kept, count = normalize.split_pending(raw(spark, [{"seq": 0, "panel_text": "a PENDING b"}, {"seq": 1, "panel_text": "done"}, {"seq": 2}]), ["PENDING"])
    assert sorted(r.seq for r in kept.collect()) == [1, 2] and count.first().pending_skipped == 1


def test_send_plan(spark):
    rows = [X3, X3 | {"status": "pending", "charge_amount": 0.0}, X3 | {"charge_amount": float("nan")}, X3 | {"charge_amount": -1.0}]
    assert outbound.plan(txns(spark, rows)).first().asDict() == {"total": 4, "qualifying": 1, "skipped": 3}
    amounts = [X1 | {"amount": 0.0, "amount_raw": "$7.5"}, X1 | {"amount": float("nan"), "amount_raw": "x"}, X1 | {"amount": 0.0, "charge_amount": 0.0}]
    got = [r.a for r in txns(spark, amounts).select("seq", outbound.original_amount().alias("a")).orderBy("seq").collect()]
    assert got == [7.5, 50.5, None]


FINE = X1 | {"provider": "CAL", "dedup_key": "k"}


def book(spark, rows):
    return spark.createDataFrame([tuple(({"provider": "CAL", "provider_account_id": "main", "attempts": 1} | r).get(f.name) for f in LEDGER.fields) for r in rows], LEDGER)


def considered(spark, rows):
    frame = txns(spark, rows).withColumn("content_hash", identity.content_hash())
    return frame.withColumn("local_dedup_status", F.lit("unchanged"))


def test_ledger_rules(spark):
    import datetime

    at = datetime.datetime(2025, 1, 1)
    rows = [FINE | {"dedup_key": k} for k in ("never", "sent", "failed", "changed", "nohash")]
    rows += [FINE | {"dedup_key": "p", "status": "pending"}, FINE | {"dedup_key": "z", "charge_amount": 0.0}, FINE | {"dedup_key": "never"}]
    h = "8db9ce176f498d65"
    entries = book(spark, [{"dedup_key": "sent", "finance_status": "sent", "sent_at": at, "content_hash": h}, {"dedup_key": "failed", "finance_status": "failed"}, {"dedup_key": "changed", "finance_status": "sent", "sent_at": at, "content_hash": "old"}, {"dedup_key": "nohash", "finance_status": "sent", "sent_at": at}])
    got = [(r.decision, r.reason) for r in ledger.decide(considered(spark, rows), entries).orderBy("seq").collect()]
    assert got == [
        ("send", None),
        ("already_sent", "already_sent_successfully"),
        ("send", None),
        ("skipped", "already_sent_content_changed"),
        ("already_sent", "already_sent_successfully"),
        ("skipped", "transaction_not_completed"),
        ("skipped", "charge_amount_zero_or_negative"),
        ("skipped", "duplicate_in_current_batch"),
    ]


def test_gates():
    assert ledger.run_gate(False, "", "", False) == "finance_disabled"
    assert ledger.run_gate(True, "", "k", True) == "missing_api_url"
    assert ledger.run_gate(True, "u", None, True) == "missing_api_key"
    assert ledger.run_gate(True, "u", "k", False) == "fetch_failed"
    assert ledger.run_gate(True, "u", "k", True) is None


def test_failure_after_success_keeps_it(spark):
    import datetime

    old = book(spark, [{"dedup_key": "k", "finance_status": "sent", "sent_at": datetime.datetime(2025, 1, 1), "content_hash": "h", "api_status": 201, "finance_transaction_id": "i", "reason": "already_sent_successfully"}])
    tried = spark.createDataFrame([("CAL", "main", "k", "failed", "api_error", "g", 500, None)], "provider string, provider_account_id string, dedup_key string, finance_status string, reason string, content_hash string, api_status int, finance_transaction_id string")
    r = ledger.merge(old, tried, F.lit(STAMP).cast("timestamp")).first()
    assert (r.finance_status, r.content_hash, r.api_status, r.finance_transaction_id, r.attempts, r.sent_at.year, r.last_attempt_at.year) == ("sent", "h", 201, "i", 2, 2025, 2026)


def test_sync(spark, tmp_path):
    rows = considered(spark, [FINE | {"dedup_key": k} for k in "abc"])
    calls = []

    def sender(p):
        calls.append(p["external_id"])
        return (500, None) if len(calls) == 2 else (201, f"id{len(calls)}")

    run = lambda n: pipeline.sync(rows, str(tmp_path / "state"), str(tmp_path / "reports"), n, "2026-01-02 03:04:05", sender)
    first = run("r1")
    assert calls == ["a", "b", "c"] and first["counts"] == {"considered": 3, "sent": 2, "already_sent": 0, "skipped": 0, "failed": 1, "not_attempted": 0} and not first["ok"]
    report = json.loads((tmp_path / "reports/finance-sync-r1.json").read_text())
    assert [t["financeStatus"] for t in report["transactions"]] == ["sent", "failed", "sent"]
    assert (tmp_path / "reports/finance-sync-r1.csv").read_text().splitlines()[0] == ",".join(reports.AUDIT_COLUMNS)
    second = run("r2")
    assert calls == ["a", "b", "c", "b"] and second["counts"]["already_sent"] == 2 and second["ok"]
    gated = pipeline.sync(rows, str(tmp_path / "state"), str(tmp_path / "reports"), "r3", "x", sender, gate="finance_disabled")
    assert gated["counts"]["not_attempted"] == 3 and not gated["executed"] and len(calls) == 4
    assert pipeline.sync(rows, "", "", "r4", "x", sender, gate=ledger.FETCH_ONLY)["report"] is None


def test_send_all_stops(spark):
    rows = txns(spark, [FINE, FINE, FINE])
    calls = []
    with pytest.raises(outbound.SendError):
        pipeline.run_export(rows, lambda p: (calls.append(1), (400, None) if len(calls) == 2 else (200, None))[1], dry_run=False)
    assert len(calls) == 2
    assert pipeline.run_export(rows) == {"total": 3, "qualifying": 3, "skipped": 0, "dry_run": True, "sent": 0}


def test_http_sender():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append((self.headers["Authorization"], body))
            self.send_response(body["status"])
            self.end_headers()
            self.wfile.write(body["answer"].encode())

        def do_GET(self):
            self.send_response(403 if self.path == "/no" else 404)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    send = outbound.HttpSender(f"{url}/yes", "secret")
    assert send({"status": 201, "answer": '{"data": {"id": 5}}'}) == (201, "5", None) and got[0][0] == "Bearer secret"
    assert send({"status": 200, "answer": "no json"}) == (200, None, None)
    assert send({"status": 422, "answer": "bad secret " + "x" * 300}) == (422, None, "HTTP 422 — bad [REDACTED] " + "x" * 185 + "…[truncated]")
    assert send.probe() and not outbound.HttpSender(f"{url}/no", "k").probe()
    server.shutdown()
    server.server_close()
    assert send({"status": 200, "answer": ""})[:2] == (None, None) and not send.probe()
    with pytest.raises(ValueError):
        outbound.HttpSender("", "k")


def test_accounts(spark):
    found = account_frame(spark, [{"provider": "CAL", "providerAccountId": "a", "enabled": False, "default": True}, {"provider": "cal", "accountId": "b", "daysBack": 30}, {"provider": "cal", "daysBack": 2.5}])
    rows = accounts.normalize_accounts(found)
    got = [(r.provider, r.provider_account_id, r.display_name, r.enabled, r.is_default, r.days_back) for r in rows.orderBy("seq").collect()]
    assert got == [("cal", "a", "CAL (a)", False, True, None), ("cal", "b", "CAL (b)", True, False, 30), ("cal", "default", "CAL (default)", True, False, None)]
    assert accounts.select_accounts(rows, "default").first().provider_account_id == "a"
    assert accounts.select_accounts(rows, "all").count() == 2
    with pytest.raises(accounts.NoAccounts):
        accounts.select_accounts(rows.where("seq = 0"), "all")
    assert [r.d for r in rows.orderBy("seq").select(accounts.days_back(F.col("days_back"), 7).alias("d")).collect()] == [7, 30, 7]
    for bad in (None, "", "3.5", "abc", 0, -1, 366):
        with pytest.raises(ValueError):
            accounts.validate_days_back(bad)
    assert [accounts.validate_days_back(x) for x in (1, 365, " 7 ")] == [1, 365, 7]
    kept = accounts.sanitize_account({"provider": "CAL", "username": "u", "password": "p", "credentialKey": "k", "usernameEnv": "U", "daysBack": 5})
    assert kept == {"provider": "cal", "providerAccountId": "default", "displayName": "", "enabled": True, "default": False, "daysBack": 5, "credentialKey": "k", "credentials": {"usernameEnv": "U"}}
    assert accounts.sanitize_finance({"enabled": True, "apiUrl": " u ", "apiKey": "secret"}) == {"enabled": True, "apiUrl": "u", "credentialKey": "finance-default"}


def test_loading(spark, tmp_path):
    assert load_accounts([{"a": 1}]) == [{"a": 1}]
    assert load_accounts(None, {"SOURCE_ACCOUNTS": '{"accounts": [{"b": 1}]}'}) == [{"b": 1}]
    (tmp_path / "a.json").write_text('[{"c": 1}]')
    assert load_accounts(None, {"SOURCE_ACCOUNTS": "broken"}, str(tmp_path / "a.json")) == [{"c": 1}]
    assert load_accounts(None, {}, str(tmp_path / "none"))[0]["providerAccountId"] == "default"
    (tmp_path / "t.json").write_text(json.dumps([{"seq": 1, "amount": 2.5, "status": "completed", "charge_amount": 3}]))
    assert load_transactions(spark, str(tmp_path / "t.json")).first().amount == 2.5
    (tmp_path / "o.json").write_text('{"seq": 1}')
    with pytest.raises(InputError):
        load_transactions(spark, str(tmp_path / "o.json"))
    (tmp_path / "l.json").write_text('{"seq": 1}\nbroken\n{"seq": 2}\n')
    rows, warnings = read_valid(spark, str(tmp_path / "l.json"), TXN)
    assert sorted(r.seq for r in rows.collect()) == [1, 2] and [r.warning for r in warnings.collect()] == ["broken"]


def test_sinks(spark, tmp_path):
    state = Versioned(spark, str(tmp_path / "s"), SEEN)
    assert state.read().count() == 0
    state.write(seen(spark, [("k", "h")]))
    state.write(state.read().unionByName(seen(spark, [("l", "h")])))
    assert sorted(r.dedup_key for r in state.read().collect()) == ["k", "l"]
    rows = txns(spark, [X1])
    assert export_json(rows, str(tmp_path / "out"), "2026-01-01") and not export_json(rows.limit(0), str(tmp_path / "none"), "x")
    export_json(rows, str(tmp_path / "out"), "2026-01-01")
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    export_file(rows.select("seq", "status"), str(tmp_path / "f.json"))
    assert json.loads((tmp_path / "f.json").read_text()) == [{"seq": 0, "status": "completed"}]
    assert csv_rows(rows, ["seq", "merchant_name"]).first().line == "0,SuperMarket"
    empty = ledger.audit(considered(spark, []).withColumns({"finance_status": F.lit("x"), "reason": F.lit("x")}), "r", "t")
    _, path = write_report(empty, {}, "r", str(tmp_path))
    assert open(path).read() == ",".join(reports.AUDIT_COLUMNS) + "\n"
    root = str(tmp_path / "locked")
    with single_flight(spark, root), pytest.raises(Busy), single_flight(spark, root):
        pass
    with single_flight(spark, root):
        pass
    Files(spark).create(f"{root}/lock", "a driver that was lost")
    with pytest.raises(Busy), single_flight(spark, root):
        pass
    with single_flight(spark, root, lease=-1):
        pass


class Fixed(SourceAdapter):
    def __init__(self, rows=None):
        self.rows = rows

    def read(self, spark, as_of, days_back):
        if self.rows is None:
            raise OSError("portal is down")
        return raw(spark, self.rows)


def test_runs(spark, tmp_path):
    one = [{"seq": i, "amount_raw": f"${i + 1}", "transaction_ts_raw": "01/05/26", "charge_date_raw": "31/05/26", "business_name": "S"} for i in range(3)]
    sources = Registry()
    sources.register("good", type("Good", (Fixed,), {"__init__": lambda self: Fixed.__init__(self, one)}))
    sources.register("bad", Fixed)
    listed = [{"provider": "GOOD", "provider_account_id": "a", "display_name": "A"}, {"provider": "bad", "provider_account_id": "b", "display_name": "B"}]
    run = lambda **o: pipeline.run_accounts(spark, listed, sources, str(tmp_path / "state"), str(tmp_path / "out"), "2026-06-01", "2026-06-01 00:00:00", **o)
    first = run()
    assert first.summary == {"total_accounts": 2, "succeeded": 1, "failed": 1, "total_transactions_exported": 3, "total_transactions_considered": 3}
    assert first.accounts[1]["error"] == "portal is down"
    assert run().summary["total_transactions_exported"] == 0
    assert run(full_fetch=True).summary["total_transactions_exported"] == 3
    with pytest.raises(UnknownSource):
        sources.create("none")
    assert sources.has("Good") and sources.names() == ["good", "bad"]


def test_resumed_run_loses_nothing(spark):
    prior = normalize.normalize(raw(spark, [{"seq": 5, "amount_raw": "$1", "business_name": "S"}]))
    found = pipeline.capture(raw(spark, [{"seq": 0, "amount_raw": "$1", "business_name": "S"}]), seen(spark, []), prior=prior)
    rows = found.considered.orderBy("segment").collect()
    assert len(rows) == 2 and rows[1].dedup_key == rows[0].dedup_key + "|#2"


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"seq": i, "provider_account_id": "a", "amount_raw": f"${i % 3}", "business_name": "S"} for i in range(9)]
    raw(spark, rows).coalesce(1).write.parquet(str(tmp_path / "raw"))
    go = lambda: capture_stream(spark, str(tmp_path / "raw"), RAW, str(tmp_path / "state"), str(tmp_path / "delta"), str(tmp_path / "check"), "2026-01-01 00:00:00")
    assert go() == 1
    batch = cdc.exported(cdc.against_seen(cdc.occurrence_keys(normalize.normalize(raw(spark, rows))), seen(spark, [])))
    want = sorted((r.seq, r.dedup_key) for r in batch.collect())
    assert sorted((r.seq, r.dedup_key) for r in spark.read.parquet(str(tmp_path / "delta")).collect()) == want
    assert go() == 0


def test_metrics(spark):
    schema = "record_seq long, status string, retry_count long, re_auth_occurred boolean, transactions_fetched long, transactions_skipped long, pending_skipped_count long, resumed boolean, checkpoint_used boolean, duplicates_skipped long, unchanged_count long, updated_count long, finished_at timestamp, duration_ms long, provider string"
    rows = [(1, "success", 1, True, 5, 0, 1, False, False, 0, 1, 2, None, 10, "a"), (2, "failed", None, None, None, 1, None, True, True, None, None, None, None, 20, "b")]
    r = reports.metrics(spark.createDataFrame(rows, schema)).first()
    assert (r.total_runs, r.successful_runs, r.failed_runs, r.total_retries, r.total_re_auths, r.total_transactions_fetched, r.resumed_runs, r.checkpoint_recoveries, r.last_run_status, r.last_run_provider) == (2, 1, 1, 1, 1, 5, 1, 1, "failed", "b")
    assert reports.metrics(spark.createDataFrame([], schema)).first().total_runs == 0


ROW = {"transaction_ts_raw": "01/05/26", "charge_date_raw": "31/05/26", "business_name": "S"}


def listed(*names):
    return [{"provider": n, "provider_account_id": "default", "display_name": n.title()} for n in names]


class Given(SourceAdapter):
    """Rows, a warning for each of ``bad``, and errors in turn."""

    rows, bad, errors, reads, logins = (), (), (), [], []

    def read(self, spark, as_of, days_back):
        raise NotImplementedError

    def fetch(self, spark, as_of, days_back, start_index=0):
        self.reads.append(start_index)
        if len(self.reads) <= len(self.errors):
            raise self.errors[len(self.reads) - 1]
        from weirflow.sources.registry import Fetched

        return Fetched(raw(spark, [r for r in self.rows if r["seq"] >= start_index]), spark.createDataFrame([(b,) for b in self.bad], "warning string"))

    def login(self):
        self.logins.append(1)
        return False

    def is_auth_error(self, error):
        return "session" in str(error)


def registered(**kinds):
    sources = Registry()
    for name, fields in kinds.items():
        sources.register(name, type(name, (Given,), fields | {"reads": [], "logins": []}))
    return sources


def test_pending_rows_stay_out_of_runs(spark, tmp_path):
    from weirflow.functions.text import PENDING_MARKERS

    rows = [ROW | {"seq": 0, "amount_raw": "$1"}, ROW | {"seq": 1, "amount_raw": "$1", "panel_text": f"x {PENDING_MARKERS[0]}"}, ROW | {"seq": 2, "amount_raw": "$1"}]
    found = pipeline.capture(raw(spark, rows), seen(spark, []))
    assert sorted(r.dedup_key[16:] for r in found.delta.collect()) == ["", "|#2"] and found.pending.first().pending_skipped == 1
    out = pipeline.run_accounts(spark, listed("cal"), registered(cal={"rows": rows}), str(tmp_path), None, "2026-06-01", STAMP)
    assert (out.accounts[0]["transactions_fetched"], out.accounts[0]["pending_skipped"], out.accounts[0]["exported"]) == (2, 1, 2)


def test_accounts_of_different_providers_stay_apart(spark, tmp_path):
    rows = [ROW | {"seq": 0, "amount_raw": "$1"}]
    sources = registered(cal={"rows": rows, "label": "CAL"}, other={"rows": rows})
    out = pipeline.run_accounts(spark, listed("cal", "other"), sources, str(tmp_path), None, "2026-06-01", STAMP)
    assert sorted((r.provider, "|#" in r.dedup_key, r.local_dedup_status) for r in out.considered.collect()) == [("CAL", False, "new"), ("other", False, "new")]
    assert [a["exported"] for a in out.accounts] == [1, 1]
    twice = pipeline.run_accounts(spark, listed("cal", "cal"), sources, str(tmp_path), None, "2026-06-01", STAMP)
    assert [a["status"] for a in twice.accounts] == ["success", "failed"] and twice.accounts[0]["unchanged"] == 1


def test_one_bad_account_fails_alone_even_late(spark, tmp_path):
    class Late(SourceAdapter):
        def read(self, spark, as_of, days_back):
            return raw(spark, [{"seq": 0}]).withColumn("card_name", F.raise_error(F.lit("down")).cast("string"))

    sources = registered(good={"rows": [ROW | {"seq": 0, "amount_raw": "$1"}], "bad": ["row 3 skipped"]})
    sources.register("late", Late)
    events = []
    out = pipeline.run_accounts(spark, listed("late", "good"), sources, str(tmp_path / "s"), str(tmp_path / "out"), "2026-06-01", STAMP, listener=lambda kind, said: (events.append(kind), 1 / 0))
    assert [a["status"] for a in out.accounts] == ["failed", "partial"] and "down" in out.accounts[0]["error"]
    assert out.summary == {"total_accounts": 2, "succeeded": 1, "failed": 1, "total_transactions_exported": 1, "total_transactions_considered": 1}
    assert out.warnings == ["row 3 skipped"] and out.accounts[1]["skipped"] == 1
    assert events == ["account-start", "login", "account-error", "account-start", "login", "fetched", "dedup", "export", "account-done"]
    assert spark.read.json(out.accounts[1]["export_path"]).count() == 1


def test_a_lost_login_is_renewed_once(spark, tmp_path):
    sources = registered(cal={"rows": [ROW | {"seq": 0, "amount_raw": "$1"}], "errors": [OSError("session gone")]}, bad={"errors": [OSError("session gone")] * 2}, worse={"errors": [OSError("other")]})
    out = pipeline.run_accounts(spark, listed("cal", "bad", "worse"), sources, str(tmp_path), None, "2026-06-01", STAMP)
    assert [(a["status"], a["re_auth_occurred"]) for a in out.accounts] == [("success", True), ("failed", True), ("failed", False)]
    assert [len(sources._classes[n].logins) for n in ("cal", "bad", "worse")] == [2, 2, 1]


def test_a_run_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    rows = [ROW | {"seq": i, "amount_raw": "$1"} for i in range(3)]
    first = registered(cal={"rows": rows[:2], "bad": ["prior warning"]})
    go = lambda sources, **o: pipeline.run_accounts(spark, listed("cal"), sources, str(tmp_path), None, "2026-06-01", STAMP, **o)
    monkeypatch.setattr(cdc, "upsert_seen", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        go(first)
    monkeypatch.undo()
    kept = Checkpoints(spark, f"{tmp_path}/checkpoints")
    assert kept.load("cal", "default")["next_index"] == 2
    second = registered(cal={"rows": rows})
    out = go(second, resume=True)
    assert second._classes["cal"].reads == [2] and kept.load("cal", "default") is None
    a = out.accounts[0]
    assert a["resumed"] and a["checkpoint_path"] and (a["transactions_fetched"], a["considered"], a["exported"]) == (1, 3, 3) and out.warnings == ["prior warning"]
    assert go(registered(cal={"rows": rows}), resume=True).accounts[0]["unchanged"] == 3
    kept.clear("cal", "nobody")


def test_state_is_never_lost(spark, tmp_path):
    root = str(tmp_path / "s")
    state, files = Versioned(spark, root, SEEN, keep=2), Files(spark)
    for k in "abcd":
        state.write(state.read().unionByName(seen(spark, [(k, "h")])), {"last": k})
    assert state.read().count() == 4 and state.notes() == {"last": "d"}
    assert len([n for n in files.names(root) if n.startswith("v-")]) == 2
    # A pointer cut short while it was written doesn't count, nor does its number come again.
    files.create(f"{root}/pointers/5", '{"folder": "v-')
    assert state.read().count() == 4
    state.write(seen(spark, [("e", "h")]))
    assert state.current()["number"] == 6 and state.read().count() == 1
    for n in state._numbers():
        files.delete(f"{root}/pointers/{n}")
    with pytest.raises(Lost):
        state.read()
    # Of two writers from the same version one is refused.
    one, other = (Versioned(spark, str(tmp_path / "t"), SEEN) for _ in range(2))
    assert one.read().isEmpty() and other.read().isEmpty()
    one.write(seen(spark, [("a", "h")]))
    with pytest.raises(Moved):
        other.write(seen(spark, [("b", "h")]))
    assert [r.dedup_key for r in one.read().collect()] == ["a"]


def test_sends_of_a_lost_run_are_not_repeated(spark, tmp_path):
    rows = considered(spark, [FINE | {"dedup_key": k} for k in "abc"])
    calls = []

    def sender(p):
        calls.append(p["external_id"])
        if len(calls) == 3:
            raise KeyboardInterrupt
        return (500, None) if len(calls) == 2 else (201, "i")

    asked = []
    sender.find = asked.append  # not there: the send that was cut off didn't reach the system
    run = lambda n: pipeline.sync(rows, str(tmp_path / "state"), str(tmp_path / "reports"), n, STAMP, sender)
    with pytest.raises(KeyboardInterrupt):
        run("r1")
    assert calls == ["a", "b", "c"]
    second = run("r2")
    assert calls == ["a", "b", "c", "b", "c"] and second["counts"] == {"considered": 3, "sent": 2, "already_sent": 1, "skipped": 0, "failed": 0, "not_attempted": 0}
    book = {r.dedup_key: (r.finance_status, r.attempts) for r in Versioned(spark, str(tmp_path / "state/ledger"), LEDGER).read().collect()}
    assert asked == ["c"] and book == {"a": ("sent", 1), "b": ("sent", 2), "c": ("sent", 2)} and not Files(spark).names(str(tmp_path / "state/journal"))


def test_journal_counts_each_outcome_once(spark, tmp_path):
    from weirflow.schema import RESULT

    journal = Journal(spark, str(tmp_path), RESULT)
    journal.GATHER = 3
    for i in range(7):
        journal.add({"dedup_key": str(i), "seq": i, "ok": True})
    Files(spark).create(f"{journal.path}/one-000000000001.json", '{"dedup_key": "1", "seq": 1, "ok": true}\n')
    assert sorted(r.seq for r in Journal.leftovers(spark, str(tmp_path), RESULT)[0].read().collect()) == list(range(7))


def test_stream_batch_run_again_keeps_its_delta(spark, tmp_path):
    raw(spark, [ROW | {"seq": i, "provider_account_id": "a", "amount_raw": f"${i}"} for i in range(9)]).coalesce(1).write.parquet(str(tmp_path / "raw"))
    go = lambda: capture_stream(spark, str(tmp_path / "raw"), RAW, str(tmp_path / "state"), str(tmp_path / "delta"), str(tmp_path / "check"), STAMP)
    assert go() == 1
    for f in (tmp_path / "check/commits").iterdir():
        f.unlink()
    assert go() == 0 and spark.read.parquet(str(tmp_path / "delta")).count() == 9


def test_rows_are_shuffled_once(spark, tmp_path):
    raw(spark, [ROW | {"seq": i, "amount_raw": f"${i}"} for i in range(9)]).write.parquet(str(tmp_path / "raw"))
    seen(spark, [("k", "h")]).write.parquet(str(tmp_path / "seen"))
    book(spark, [{"dedup_key": "k"}]).write.parquet(str(tmp_path / "book"))
    read = lambda n, schema: spark.read.schema(schema).parquet(str(tmp_path / n))
    entries = read("book", LEDGER)
    decided = ledger.decide(cdc.keyed_against(normalize.normalize(read("raw", RAW)), read("seen", SEEN), entries), entries)
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_one_shuffle_says_what_the_joins_say(spark):
    rows = txns(spark, [X1, X1, X2, X3, X5A]).unionByName(txns(spark, [X1, X5B], "b"))
    keyed = cdc.occurrence_keys(rows)
    state = seen(spark, [("0fc4e5b06842ec62", "8db9ce176f498d65"), ("0fc4e5b06842ec62|#2", "old"), ("fb2a6ebce27be4e8", None)]).unionByName(seen(spark, [("0246507eb9c007a8", "x")], "b"))
    pick = lambda f: sorted((r.provider_account_id, r.dedup_key, r.kind, r.local_dedup_status) for r in f.collect())
    assert pick(cdc.keyed_against(rows, state)) == pick(cdc.against_seen(keyed, state))
    assert pick(cdc.keyed_against(rows, state, full_fetch=True)) == pick(cdc.against_seen(keyed, state, full_fetch=True))


def test_accounts_are_fetched_side_by_side(spark, tmp_path):
    import threading

    together, busy, most = threading.Barrier(3, timeout=60), [], []

    class Slow(Fixed):
        def read(self, spark, as_of, days_back):
            busy.append(1)
            most.append(len(busy))
            if self.rows:
                together.wait()  # passes only if three are under way at once
            busy.pop()
            return super().read(spark, as_of, days_back)

    sources = Registry()
    for i in range(6):
        sources.register(f"p{i}", type(f"P{i}", (Slow,), {"__init__": lambda self, i=i: Fixed.__init__(self, [ROW | {"seq": 0, "amount_raw": f"${i}"}] if i < 3 else None)}))
    events = []
    names = [f"p{i}" for i in range(6)]
    out = pipeline.run_accounts(spark, listed(*names), sources, str(tmp_path / "a"), None, "2026-06-01", STAMP, listener=lambda kind, said: events.append((kind, said["provider"])), parallel=3)
    assert [a["status"] for a in out.accounts] == ["success"] * 3 + ["failed"] * 3 and out.considered.count() == 3
    assert max(most) == 3 and [p for kind, p in events if kind in ("fetched", "account-error")] == names
    busy.clear()
    most.clear()
    out = pipeline.run_accounts(spark, listed("p3", "p3", "p4"), sources, str(tmp_path / "b"), None, "2026-06-01", STAMP, parallel=1)
    assert max(most) == 1 and [a["error"] for a in out.accounts] == ["portal is down", "the account is listed twice", "portal is down"]


def test_counters_come_from_the_pass_that_writes(spark, tmp_path):
    rows = [ROW | {"seq": i, "amount_raw": f"${i % 4}"} for i in range(9)]
    go = lambda: pipeline.run_accounts(spark, listed("cal"), registered(cal={"rows": rows, "label": "CAL"}), str(tmp_path), str(tmp_path / "out"), "2026-06-01", STAMP)
    first = go()
    assert {c: first.accounts[0][c] for c in pipeline.COUNTS} == {"created": 9, "updated": 0, "unchanged": 0, "duplicates": 0, "exported": 9, "considered": 9}
    assert not first.considered.is_cached and "InMemoryTableScan" not in first.considered._jdf.queryExecution().executedPlan().toString()
    names = Files(spark).names(str(tmp_path / "seen/pointers"))
    second = go()
    assert (second.accounts[0]["unchanged"], second.accounts[0]["exported"]) == (9, 0)
    assert Files(spark).names(str(tmp_path / "seen/pointers")) == names  # a run without a delta writes no state


def test_plan_is_the_same_for_three_accounts_and_three_hundred(spark, tmp_path):
    marked = normalize.mark_pending(raw(spark, [ROW | {"seq": 0, "amount_raw": "$1"}]))
    rows = normalize.stamp_source(cdc.hashed(normalize.normalize(marked, "CAL", keep=("pending_marker",))), "a", "A", "cal")
    folders = []
    for i in range(300):
        folders.append(str(tmp_path / str(i)))
        if i:
            os.makedirs(folders[-1])
    rows.write.parquet(folders[0])  # as an earlier release did, without a segment
    plans = [cdc.keyed_against(pipeline.landed(spark, folders[:n]), None, None, ("segment", "seq"))._jdf.queryExecution().optimizedPlan().toString() for n in (3, 300)]
    assert plans[0].count("\n") == plans[1].count("\n")
    got = pipeline.landed(spark, folders).collect()
    assert len(got) == 1 and got[0].segment == 0


def test_settings(tmp_path):
    path = str(tmp_path / "deep/accounts.json")
    stored = save_settings({"daysBack": "7", "accounts": [{"provider": "CAL", "password": "p", "providerAccountId": " a "}, {"default": True}, {"default": True}], "finance": {"enabled": True, "apiKey": "secret"}}, path)
    assert stored == load_settings(path, {}) and "secret" not in open(path).read()
    assert [(a["providerAccountId"], a["default"]) for a in stored["accounts"]] == [("a", False), ("default", True), ("default", False)]
    with pytest.raises(ValueError, match="at most"):
        save_settings({"daysBack": 400}, path)
    assert load_settings(path, {}) == stored
    (tmp_path / "bad.json").write_text("{")
    derived = load_settings(str(tmp_path / "bad.json"), {"PROVIDER": "max", "MAX_ACCOUNT_ID": "m", "DAYS_BACK": "9", "MAX_PASSWORD": "p"})
    assert derived == {"daysBack": 9, "accounts": [{"provider": "max", "providerAccountId": "m", "displayName": "MAX (m)", "enabled": True, "default": True}], "finance": {"enabled": False, "apiUrl": "", "credentialKey": "finance-default"}}
    assert configured_accounts({}, None) is None and configured_accounts({"SOURCE_ACCOUNTS": '[{"a": 1}]'}) == [{"a": 1}]
    env = {"U": "from env", "P": "pe"}
    assert resolve_credentials({"credentials": {"username": "direct", "usernameEnv": "U", "passwordEnv": "P"}}, env) == {"username": "direct", "password": "pe"}
    assert resolve_credentials({"usernameEnv": "none"}, env) == {"username": "", "password": ""}


def test_whole_run(spark, tmp_path):
    rows = [ROW | {"seq": i, "amount_raw": f"${i + 1}", "charge_amount_raw": "₪5"} for i in range(3)]
    sources = registered(cal={"rows": rows, "label": "CAL"})
    sent, events = [], []
    stored = {"daysBack": 4, "accounts": [{"provider": "cal", "providerAccountId": "default", "default": True}, {"provider": "cal", "providerAccountId": "off", "enabled": False}]}
    go = lambda run_id, **o: pipeline.run_all(spark, stored, sources, str(tmp_path / "s"), str(tmp_path / "out"), str(tmp_path / "r"), "2026-06-01", STAMP, run_id, sender=lambda p: (sent.append(p), (201, None))[1], listener=lambda kind, said: events.append(kind), **o)
    fetched = go("r0")
    assert fetched["finance"]["reason"] == ledger.FETCH_ONLY and fetched["summary"]["total_transactions_exported"] == 3 and not sent
    block = {"enabled": True, "api_url": "u", "api_key": "k"}
    synced = go("r1", finance_mode="sync", finance=block)
    assert synced["finance"]["ok"] and len(sent) == 3 and synced["accounts"][0]["unchanged"] == 3
    again = go("r2", finance_mode="sync", finance=block, mode="default")
    assert len(sent) == 3 and again["finance"]["counts"]["already_sent"] == 3 and "finance-done" in events
    assert go("r3", finance_mode="sync", finance=block | {"api_key": ""})["finance"]["reason"] == "missing_api_key"
    assert go("r4", days_back=0)["error"].startswith("Invalid days back") and not pipeline.run_all(spark, {"daysBack": 4}, sources, "", "", "", "", "", "")["ok"]


def test_report_in_one_file(spark, tmp_path, monkeypatch):
    """Put together from many parts, in order, without a row at the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows = considered(spark, [FINE | {"dedup_key": f"k{i:03d}", "merchant_name": 'a "b", c\nd é'} for i in range(200)]).withColumns({"finance_status": F.lit("sent"), "reason": F.lit("sent")})
    audit = ledger.audit(rows.repartition(7), "r", "t").repartitionByRange(5, "dedupKey").sortWithinPartitions("dedupKey")
    for name in ("collect", "toLocalIterator", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: pytest.fail("rows at the driver"))
    monkeypatch.setattr(DataFrame, "isEmpty", lambda self: False)
    path, csv = write_report(audit, {"sent": 200}, "r", str(tmp_path / "deep"))
    text = open(path, encoding="utf-8").read()
    found = json.loads(text)
    assert found["runId"] == "r" and found["summary"] == {"sent": 200} and [t["dedupKey"] for t in found["transactions"]] == [f"k{i:03d}" for i in range(200)]
    assert list(found["transactions"][0]) == reports.AUDIT_COLUMNS and found["transactions"][3]["merchant"] == 'a "b", c\nd é' and found["transactions"][0]["apiStatus"] is None
    assert text.startswith('{\n  "runId": "r",') and ",\n    {\n      \"runId\"" in text and text.endswith("\n    }\n  ]\n}")
    lines = open(csv, encoding="utf-8").read()
    assert lines.startswith(",".join(reports.AUDIT_COLUMNS) + "\n") and lines.count("k1") >= 100 and lines.endswith("\n")
    assert sorted(x for x in os.listdir(tmp_path / "deep") if not x.startswith(".")) == ["finance-sync-r.csv", "finance-sync-r.json"]


def test_report_folders(spark, tmp_path):
    rows = considered(spark, [FINE | {"dedup_key": "k"}]).withColumns({"finance_status": F.lit("sent"), "reason": F.lit("sent")})
    path, csv = write_report(ledger.audit(rows, "r", "t"), {"sent": 1}, "r", str(tmp_path), one_file=False)
    assert spark.read.json(path).first().dedupKey == "k" and spark.read.option("header", True).csv(csv).count() == 1


@pytest.mark.parametrize("gate", [None, "finance_disabled"])
def test_report_is_sorted_once(spark, tmp_path, monkeypatch, gate):
    """The counts and both forms of the report come from one sorted table; only a run that sends keeps its decisions beside it."""
    names = [f"k{i:03d}" for i in range(40)]
    rows = considered(spark, [FINE | {"dedup_key": k} for k in reversed(names)]).repartition(7)
    held, kept = (lambda: spark.sparkContext._jsc.getPersistentRDDs().size()), []
    before = held()
    monkeypatch.setattr(pipeline, "write_report", lambda audit, *a: (kept.append((audit.storageLevel.useMemory, held() - before)), write_report(audit, *a))[1])
    got = pipeline.sync(rows, str(tmp_path / "state"), str(tmp_path / "reports"), "r", STAMP, lambda p: (201, None), gate)
    assert kept == [(True, 1 if gate else 2)] and held() == before
    assert got["counts"] == dict.fromkeys(("sent", "already_sent", "skipped", "failed", "not_attempted"), 0) | {"considered": 40, "not_attempted" if gate else "sent": 40}
    assert [t["dedupKey"] for t in json.loads((tmp_path / "reports/finance-sync-r.json").read_text())["transactions"]] == names
    assert [line.rsplit(",", 1)[1] for line in (tmp_path / "reports/finance-sync-r.csv").read_text().splitlines()[1:]] == names
