"""Leases, fences and intents: what runs that overlap, or were cut off, may still do."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.test_engine import FINE, STAMP, considered
from weirflow.operators import cdc, ledger, outbound
from weirflow.plans import pipeline
from weirflow.schema import LEDGER, RESULT, SEEN
from weirflow.sources.buckets import Bucketed
from weirflow.sources.lease import Lease, single_flight
from weirflow.sources.store import Busy, Fenced, Files, Journal, Versioned


def entries(spark, root):
    return {r.dedup_key: (r.finance_status, r.reason, r.attempts) for r in Versioned(spark, f"{root}/ledger", LEDGER).read().collect()}


def sync(spark, root, keys, sender, run="r", **o):
    return pipeline.sync(considered(spark, [FINE | {"dedup_key": k} for k in keys]), str(root / "state"), str(root / "reports"), run, STAMP, sender, **o)


def test_numbers_grow_and_one_holds(spark, tmp_path):
    root = str(tmp_path)
    with single_flight(spark, root) as one:
        assert one.number == 1 and one.held()
        with pytest.raises(Busy), single_flight(spark, root):
            pass
    with single_flight(spark, root) as two, single_flight(spark, str(tmp_path / "other")) as other:
        assert (two.number, other.number) == (2, 1) and not one.held()
    late = Lease(spark, root, seconds=-1).take()  # never renewed in time
    three = Lease(spark, root, seconds=-1).take()
    assert three.number == late.number + 1 and three.held()
    with pytest.raises(Fenced):
        late.check()
    late.release()  # doesn't give back what it hasn't
    assert three.held() and not Files(spark).exists(f"{root}/lease/{three.number}.done")


def test_a_lease_is_renewed_while_its_run_lives(spark, tmp_path):
    held = Lease(spark, str(tmp_path), seconds=0.9).take()
    time.sleep(2)
    with pytest.raises(Busy):
        Lease(spark, str(tmp_path), seconds=0.9).take()
    held._stop.set()  # the driver is lost
    time.sleep(1.5)
    assert Lease(spark, str(tmp_path), seconds=0.9).take().number == held.number + 1
    with pytest.raises(Fenced):
        held.check()


def test_of_two_that_make_the_same_number_one_is_fenced(spark, tmp_path):
    one, other = Lease(spark, str(tmp_path)), Lease(spark, str(tmp_path))
    one.take()
    # A file system that lets both make the file: the one whose name it doesn't hold is out.
    Files(spark).create(f"{one.folder}/{one.number}", json.dumps({"owner": other.owner}), replace=True)
    assert not one.held()


def test_many_takers(spark, tmp_path):
    got = []

    def take():
        try:
            got.append(Lease(spark, str(tmp_path)).take())
        except (Busy, Fenced):
            pass

    threads = [threading.Thread(target=take) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len([x for x in got if x.held()]) == 1


def test_a_run_that_was_taken_over_sends_nothing_more(spark, tmp_path):
    calls, second = [], {}

    def first(p):
        calls.append(("first", p["external_id"]))
        if len(calls) == 2:  # while this one is under way its lease runs out, and another run takes over
            second.update(sync(spark, tmp_path, "abcd", lambda q: (calls.append(("second", q["external_id"])), (201, "s"))[1], "r2", lease=-1))
        return 201, "f"

    with pytest.raises(Fenced):
        sync(spark, tmp_path, "abcd", first, "r1", lease=-1)
    # b was under way: the second run doesn't send it without knowing, and the first sends neither c nor d.
    assert calls == [("first", "a"), ("first", "b"), ("second", "c"), ("second", "d")]
    assert second["counts"] | {"sent": 2, "already_sent": 1, "skipped": 1} == second["counts"]
    assert entries(spark, tmp_path / "state")["b"][:2] == ("failed", outbound.IN_DOUBT)
    # The outcome that came late wasn't lost: the next run finds it.
    third = sync(spark, tmp_path, "abcd", lambda q: 1 / 0, "r3")
    assert third["counts"]["already_sent"] == 4 and entries(spark, tmp_path / "state")["b"][0] == "sent"


def test_state_of_a_run_that_was_taken_over_is_refused(spark, tmp_path):
    row = spark.createDataFrame([("cal", "a", "k", "h", None, None)], SEEN)
    with single_flight(spark, str(tmp_path), -1) as one:
        state = Bucketed(spark, str(tmp_path / "s"), SEEN, buckets=2, lease=one)
        state.write(row)
        assert state.current()["fence"] == 1
        with single_flight(spark, str(tmp_path), -1) as two:
            with pytest.raises(Fenced):
                state.write(row)
            other = Bucketed(spark, str(tmp_path / "s"), SEEN, buckets=2, lease=two)
            other.merge(row.withColumns({"dedup_key": F.lit("l"), "seq": F.lit(1).cast("long")}), lambda a, b: cdc.upsert_seen(a, b, F.lit(STAMP).cast("timestamp")))
            assert other.current()["fence"] == 2
    assert Versioned(spark, str(tmp_path / "s"), SEEN).read().count() == 2
    with pytest.raises(Fenced):  # its number is too low, even if it could be given the lease again
        one.held = lambda: True
        Versioned(spark, str(tmp_path / "s"), SEEN, lease=one).write(row)


def cut_off(spark, root, at="c"):
    """A run that ends within the send of ``at``; returns what it sent."""
    calls = []

    def sender(p):
        calls.append(p["external_id"])
        if p["external_id"] == at:
            raise KeyboardInterrupt
        return 201, "i"

    with pytest.raises(KeyboardInterrupt):
        sync(spark, root, "abcde", sender, "r1")
    return calls


def test_a_send_in_doubt_isnt_repeated_without_a_check(spark, tmp_path):
    assert cut_off(spark, tmp_path) == ["a", "b", "c"]
    calls = []
    plain = lambda p: (calls.append(p["external_id"]), (201, "j"))[1]
    second = sync(spark, tmp_path, "abcde", plain, "r2")
    assert calls == ["d", "e"] and second["counts"]["skipped"] == 1 and second["counts"]["already_sent"] == 2
    assert entries(spark, tmp_path / "state")["c"] == ("failed", outbound.IN_DOUBT, 1)
    sync(spark, tmp_path, "abcde", plain, "r3")
    assert calls == ["d", "e"]

    def cannot_tell(key):
        raise OSError("down")

    plain_with = lambda find: type("S", (), {"__call__": lambda self, p: plain(p), "find": staticmethod(find)})()
    sync(spark, tmp_path, "abcde", plain_with(cannot_tell), "r4")
    assert calls == ["d", "e"] and entries(spark, tmp_path / "state")["c"][1] == outbound.IN_DOUBT
    asked = []
    fifth = sync(spark, tmp_path, "abcde", plain_with(lambda key: (asked.append(key), (200, "there"))[1]), "r5")
    assert asked == ["c"] and calls == ["d", "e"] and fifth["counts"]["already_sent"] == 5
    assert entries(spark, tmp_path / "state")["c"][0] == "sent"


def test_a_send_that_is_surely_not_there_is_made_again(spark, tmp_path):
    cut_off(spark, tmp_path)
    calls, asked = [], []

    class Sender:
        def __call__(self, p):
            calls.append(p["external_id"])
            return 201, "j"

        def find(self, key):
            asked.append(key)

    again = sync(spark, tmp_path, "abcde", Sender(), "r2")
    assert asked == ["c"] and calls == ["c", "d", "e"] and again["counts"]["sent"] == 3
    assert not Files(spark).names(str(tmp_path / "state/journal"))


def test_intents_are_told_from_outcomes(spark, tmp_path):
    journal = Journal(spark, str(tmp_path), RESULT)
    assert journal.in_doubt() is None
    journal.intend([{"dedup_key": k} for k in "ab"])
    found = lambda: Journal.leftovers(spark, str(tmp_path), RESULT)
    assert [j.in_doubt() for j in found()] == [{"dedup_key": "a"}]
    journal.add({"dedup_key": "a", "ok": True})
    journal.GATHER = 1
    journal.add({"dedup_key": "b", "ok": True})
    assert found()[0].in_doubt() is None and found()[0].read().count() == 2
    journal.intend([{"dedup_key": "c"}])
    assert found()[0].in_doubt() == {"dedup_key": "c"}
    Files(spark).create(f"{journal.intents}/000000000002.json", '{"n": 2, "dedu', replace=True)
    assert found()[0].in_doubt() is None  # cut short: its sends hadn't begun
    journal.drop()
    assert not found()


def test_a_row_in_doubt_is_held_back(spark):
    rows = considered(spark, [FINE | {"dedup_key": k} for k in "abc"])
    base = {f.name: None for f in LEDGER.fields} | {"provider": "", "provider_account_id": "default"}
    who = rows.first()
    base |= {"provider": who.provider, "provider_account_id": who.provider_account_id}
    book = spark.createDataFrame([tuple((base | x)[f.name] for f in LEDGER.fields) for x in ({"dedup_key": "a", "finance_status": "failed", "reason": outbound.IN_DOUBT}, {"dedup_key": "b", "finance_status": "failed", "reason": outbound.NOT_THERE})], LEDGER)
    got = {r.dedup_key: (r.decision, r.reason) for r in ledger.decide(rows, book).collect()}
    assert got == {"a": ("skipped", ledger.DOUBTED), "b": ("send", None), "c": ("send", None)}


def test_http_lookup(monkeypatch):
    answers = {"https://x/find?id=a%7C%232": (200, b'{"id": 7}'), "https://x/find?id=b": (404, b""), "https://x/find?id=c": (500, b"key")}
    sender = outbound.HttpSender("https://x", "key", lookup="https://x/find?id={}")
    monkeypatch.setattr(sender, "_ask", lambda body, url=None: answers[url])
    assert sender.find("a|#2") == (200, "7") and sender.find("b") is None
    with pytest.raises(OSError, match="REDACTED"):
        sender.find("c")
    assert outbound.HttpSender("https://x", "key").find is None


@pytest.mark.parametrize("grows", [True, False])
def test_a_journal_is_read_while_it_is_written(spark, tmp_path, monkeypatch, grows):
    """A line of one open file a send, where the file system shows it at once; a file each, where it doesn't."""
    if not grows:
        monkeypatch.setattr(Files, "lines", lambda self, path: None)
    monkeypatch.setattr(Journal, "FILE", 40)
    journal = Journal(spark, f"file://{tmp_path}/journal", RESULT)
    who = lambda i: {"provider": "cal", "provider_account_id": "default", "dedup_key": f"k{i}", "seq": i, "content_hash": "h"}
    for at in range(0, 100, 20):
        journal.intend([who(i) for i in range(at, at + 20)])
    for i in range(70):
        journal.add(who(i) | outbound.outcome(201, f"id{i}"))
    left = Journal(spark, journal.root, RESULT, journal.name)  # as a later run finds it
    assert sorted(r.seq for r in left.read().collect()) == list(range(70))
    assert left.in_doubt()["dedup_key"] == "k70"
    files = [x for x in journal.files.names(journal.path) if x.endswith(".json")]
    assert len(files) == (1 if grows else 70)
    journal.drop()
    assert not Journal.leftovers(spark, journal.root, RESULT)
