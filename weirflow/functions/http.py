"""What an answer of the finance system means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify_status(status: Column, has_amount: Column | None = None) -> Column:
    """null for success; api_validation_failed for 4xx or no amount to send; api_error for all else, no answer included."""
    found = F.when(status.between(200, 299), F.lit(None).cast("string")).when(status.between(400, 499), "api_validation_failed").otherwise("api_error")
    return found if has_amount is None else F.when(~has_amount, "api_validation_failed").otherwise(found)


def response_id(body: Column) -> Column:
    """id, transaction_id or data.id of a JSON body, the first there is; null for any other body."""
    return F.coalesce(*[F.get_json_object(body, p) for p in ("$.id", "$.transaction_id", "$.data.id")])


def classify_probe(status: Column) -> Column:
    """Whether the system can be reached with the key: any answer but 401 and 403."""
    return F.coalesce(~status.isin(401, 403), F.lit(False))
