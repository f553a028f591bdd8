"""Sending to the finance system: which rows qualify, what is sent, and what an outcome means."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from itertools import batched
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.http import classify_status
from weirflow.functions.text import parse_amount


def positive(x: Column) -> Column:
    """Above zero; NaN, which Spark puts above all numbers, isn't."""
    return F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))


def should_send() -> Column:
    return F.coalesce(F.col("status") == "completed", F.lit(False)) & positive(F.col("charge_amount"))


def original_amount() -> Column:
    """The first positive one of the amount, the amount read again from its text, and the charged amount; null for none."""
    again = parse_amount(F.col("amount_raw"))
    return F.coalesce(F.when(positive(F.col("amount")), F.col("amount")), F.when(positive(again), again), F.when(positive(F.col("charge_amount")), F.col("charge_amount")))


def plan(txn: DataFrame) -> DataFrame:
    """(total, qualifying, skipped): nothing is sent."""
    return txn.agg(F.count("*").alias("total"), F.count_if(should_send()).alias("qualifying"), F.count_if(~should_send()).alias("skipped"))


def payload() -> Column:
    """What is sent for a row."""
    return F.struct(
        F.lit("expense").alias("type"),
        F.col("charge_amount").alias("amount"),
        F.col("transaction_date").alias("date"),
        F.col("merchant_name").alias("description"),
        F.col("charge_date"),
        F.col("account_id").alias("payment_source_name"),
        F.col("currency"),
        original_amount().alias("original_amount"),
        F.col("dedup_key").alias("external_id"),
    )


def requests(txn: DataFrame) -> DataFrame:
    """(seq, external_id, body) of the rows that qualify: the JSON that is posted for each."""
    return txn.where(should_send()).select("seq", F.col("dedup_key").alias("external_id"), F.to_json(payload(), {"ignoreNullFields": "false"}).alias("body"))


def failure_message(status: Column, body: Column, secrets: list[str]) -> Column:
    """``safe_message`` for a table of answers: secrets taken out of the body, the body cut to 200 characters, null status for
    no answer."""
    shown = F.coalesce(body, F.lit(""))
    for s in secrets:
        shown = F.replace(shown, F.lit(s), F.lit("[REDACTED]")) if s else shown
    cut = F.when(F.char_length(shown) <= 200, shown).otherwise(F.concat(F.left(shown, F.lit(200)), F.lit("…[truncated]")))
    said = F.concat(F.lit("HTTP "), status.cast("string"), F.when(cut == "", F.lit("")).otherwise(F.concat(F.lit(" — "), cut)))
    return F.when(status.isNull(), F.concat(F.lit(NO_ANSWER.format("")), shown)).otherwise(said)


#: Sends one payload and returns (status, body id) or (status, body id, message): status None if there was no answer.
Sender = Callable[[dict[str, Any]], tuple]

#: What is said of a row without an amount, of a request without an answer, of an answer that refuses.
NO_AMOUNT, NO_ANSWER, REFUSED = "no positive amount available", "Finance request failed: {}", "HTTP {}{}"


def outcome(status: int | None, found: str | None, has_amount: bool = True, message: str | None = None) -> dict[str, Any]:
    """The result of one send, classified."""
    ok = has_amount and status is not None and 200 <= status < 300
    rejected = not has_amount or status is not None and 400 <= status < 500
    said = None if ok else NO_AMOUNT if not has_amount else message or (REFUSED.format(status, "") if status is not None else NO_ANSWER.format("no answer"))
    return {"ok": ok, "classification": None if ok else "api_validation_failed" if rejected else "api_error", "api_status": status if has_amount else None, "finance_transaction_id": found if ok else None, "message": said}


#: Rows whose intent is noted at once.
INTENDED = 200
WHO = ("provider", "provider_account_id", "dedup_key", "seq", "content_hash")


def send_each(
    to_send: DataFrame,
    sender: Sender,
    record: Callable[[dict[str, Any]], None],
    on_sent: Callable[[int], None] | None = None,
    intend: Callable[[list[dict[str, Any]]], None] | None = None,
    check: Callable[[], None] | None = None,
) -> int:
    """Send every row once, in the order of seq, from the driver; a failure doesn't stop the rest. Returns how many.

    Sends can't be taken back, and tasks may run twice, so they aren't left to executors. The rows are the delta of a run;
    they are read a partition at a time. ``intend`` gets what is about to be sent, some rows at once, before the first of
    them is; ``check`` is asked before each send, and ends the run by raising; ``record`` gets each outcome
    (``schema.RESULT``) before the next send is made.
    """
    rows = to_send.select(*WHO, payload().alias("p"), original_amount().isNotNull().alias("fine")).orderBy("seq", "provider", "provider_account_id", "dedup_key")
    n = 0
    for some in batched(rows.toLocalIterator(), INTENDED):
        if intend is not None:
            intend([{k: r[k] for k in WHO} for r in some])
        for r in some:
            if check is not None:
                check()
            answer = sender(r.p.asDict()) if r.fine else (None, None)
            record({k: r[k] for k in WHO} | outcome(answer[0], answer[1], r.fine, answer[2] if len(answer) > 2 else None))
            n += 1
            if on_sent is not None:
                on_sent(n)
    return n


#: What is told of a send that may or may not have been made.
IN_DOUBT, NOT_THERE = "outcome_unknown", "not_found_after_unknown_outcome"


def settled(row: dict[str, Any], find: Callable[[str], tuple[int, str | None] | None] | None) -> dict[str, Any]:
    """The outcome of a send in doubt. ``find`` asks the system by external id: the answer of the send if it is there, None if
    it surely isn't; it raises where it can't tell. Without an answer the row stays in doubt, and isn't sent again."""
    who = {k: row.get(k) for k in WHO}
    unknown = who | outcome(None, None) | {"classification": IN_DOUBT, "message": "the run was cut off while this was sent"}
    if find is None:
        return unknown
    try:
        found = find(row["dedup_key"])
    except Exception as error:  # noqa: BLE001 - no answer is no answer
        return unknown | {"message": f"asked for, without an answer: {error}"}
    if found is None:
        return unknown | {"classification": NOT_THERE, "message": "asked for, and not there"}
    return who | outcome(found[0], found[1])


def safe_message(status: int | None, body: str, secrets: list[str]) -> str:
    """What is told of a failed send: secrets taken out, the body cut to 200 characters."""
    for s in secrets:
        body = body.replace(s, "[REDACTED]") if s else body
    if status is None:
        return NO_ANSWER.format(body)
    cut = body if len(body) <= 200 else body[:200] + "…[truncated]"
    return REFUSED.format(status, f" — {cut}" if cut else "")


class HttpSender:
    """POSTs a payload as JSON with a bearer key. The key and the payload are in no message; no answer is (None, None)."""

    def __init__(self, url: str, key: str, timeout: float = 30, lookup: str | None = None) -> None:
        """``lookup``: a URL with ``{}`` for the external id, which answers 404 for one that isn't there."""
        if not url or not key:
            raise ValueError("sending needs the finance API's URL and key")
        self._url, self._key, self.timeout, self._lookup = url, key, timeout, lookup
        if lookup is None:
            self.find = None

    def find(self, external_id: str) -> tuple[int, str | None] | None:
        """What was sent under an external id: its status and the system's id; None if there is none."""
        status, body = self._ask(None, self._lookup.replace("{}", urllib.parse.quote(external_id, safe="")))
        if status == 404:
            return None
        if status is None or not 200 <= status < 300:
            raise OSError(safe_message(status, body.decode("utf-8", "replace"), [self._key, self._url]))
        return status, self._id(body)

    def _ask(self, body: bytes | None, url: str | None = None) -> tuple[int | None, bytes]:
        headers = {"Authorization": f"Bearer {self._key}"} | ({"Content-Type": "application/json"} if body else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url or self._url, body, headers), timeout=self.timeout) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as error:
            return error.code, error.read()
        except OSError as error:
            return None, str(error).encode()

    def __call__(self, sent: dict[str, Any]) -> tuple[int | None, str | None, str | None]:
        status, body = self._ask(json.dumps(sent).encode())
        if status is None or not 200 <= status < 300:
            return status, None, safe_message(status, body.decode("utf-8", "replace"), [self._key, self._url])
        return status, self._id(body), None

    @staticmethod
    def _id(body: bytes) -> str | None:
        try:
            found = json.loads(body)
        except ValueError:
            return None
        inner = found.get("data") if isinstance(found, dict) else None
        ids = [found.get("id"), found.get("transaction_id"), inner.get("id") if isinstance(inner, dict) else None] if isinstance(found, dict) else []
        first = next((x for x in ids if x is not None), None)
        return None if first is None else str(first)

    def probe(self) -> bool:
        """Whether the system answers, and doesn't refuse the key; nothing is sent."""
        status, _ = self._ask(None)
        return status is not None and status not in (401, 403)


class SendError(Exception):
    """The first failure of ``send_all``; earlier rows stay sent."""


def send_all(txn: DataFrame, sender: Sender) -> int:
    """Send all qualifying rows in order; stop with an error at the first failure. Returns how many were sent."""
    n = 0
    for r in txn.where(should_send()).select("seq", "merchant_name", payload().alias("p"), original_amount().isNotNull().alias("fine")).orderBy("seq").toLocalIterator():
        answer = sender(r.p.asDict()) if r.fine else (None, None)
        result = outcome(answer[0], answer[1], r.fine, answer[2] if len(answer) > 2 else None)
        if not result["ok"]:
            raise SendError(f'Failed to export "{r.merchant_name}": {result["message"]} ({n} sent before)')
        n += 1
    return n


def classified(answers: DataFrame, status: str = "api_status", has_amount: Column | None = None) -> DataFrame:
    return answers.withColumn("classification", classify_status(F.col(status), has_amount))
