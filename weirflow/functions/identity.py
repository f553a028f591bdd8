"""What makes two rows the same transaction, and what makes its content the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Below this doubles have fewer digits than 15 that tell them apart.
LEAST_NORMAL = 2.2250738585072014e-308


def _rounded(x: Column, digits: int) -> Column:
    """d.ddde+xx of an integer from 2**53 up to 2**95, rounded from its exact value: the JVM's digits may be rounded already."""
    high = F.floor(x / 2.0**32).cast("decimal(20,0)")
    low = (x - F.floor(x / 2.0**32).cast("double") * 2.0**32).cast("decimal(10,0)")
    exact = (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(38,0)")
    n = F.length(exact.cast("string"))
    unit = F.rpad(F.lit("1"), n - digits + 1, F.lit("0")).cast("decimal(38,0)")
    half = F.when(n > digits, F.rpad(F.lit("5"), n - digits, F.lit("0"))).otherwise(F.lit("0")).cast("decimal(38,0)")
    kept = F.call_function("div", (exact + half).cast("decimal(38,0)"), unit).cast("string")
    return F.concat(F.left(kept, F.lit(1)), F.lit("."), F.substr(kept, F.lit(2)), F.lit("e+"), (F.length(kept) + n - digits - 1).cast("string"))


def _next_up(t: Column) -> Column:
    """d.ddde+xx with one more in its last digit."""
    digits = F.replace(F.substring_index(t, "e", 1), F.lit("."), F.lit(""))
    more = (digits.cast("decimal(18,0)") + 1).cast("string")
    exponent = F.substring_index(t, "e", -1).cast("int") + F.length(more) - F.length(digits)
    return F.concat(F.left(more, F.lit(1)), F.lit("."), F.substr(more, F.lit(2)), F.lit("e"), exponent.cast("string"))


def _scientific(x: Column) -> Column:
    """d.ddde+xx of the fewest digits that read back as ``x``: those of 15 digits tell all normal doubles apart that have so
    few, so only 15, 16 and 17 are tried; of the tiny ones every number of digits. Of texts as short the closest counts; a
    power of two has more room above than below, so there the next one up may read back where the closest doesn't."""
    m = F.abs(x)
    read = lambda text: F.when(text.try_cast("double") == m, text)
    both = lambda text: [read(text), read(_next_up(text))]
    tried = lambda digits: F.coalesce(*[c for n in digits for c in both(F.format_string(f"%.{n - 1}e", m))])
    large = F.coalesce(*[c for n in (15, 16, 17) for c in both(_rounded(m, n))])
    text = F.when(m < LEAST_NORMAL, tried(range(1, 18))).when((m >= 2.0**53) & (m < 2.0**95), large).otherwise(tried((15, 16, 17)))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), text)


def _shortest(x: Column) -> Column:
    """The text of a finite number other than 0."""

    def laid_out(t: Column) -> Column:
        digits = F.rtrim(F.replace(F.substring_index(F.ltrim(t, F.lit("-")), "e", 1), F.lit("."), F.lit("")), F.lit("0"))
        exponent = F.substring_index(t, "e", -1).cast("int")
        k, point = F.length(digits), exponent + 1
        rest = F.substr(digits, F.lit(2))
        wide = F.concat(F.left(digits, F.lit(1)), F.when(k > 1, F.concat(F.lit("."), rest)).otherwise(F.lit("")), F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(exponent).cast("string"))
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(k <= point, F.concat(digits, F.repeat(F.lit("0"), point - k)))
            .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
        )
        return F.concat(F.when(F.startswith(t, F.lit("-")), F.lit("-")).otherwise(F.lit("")), F.when((point > 21) | (point < -5), wide).otherwise(plain))

    return F.transform(F.array(_scientific(x)), laid_out)[0]  # the digits are searched once


def number_text(x: Column) -> Column:
    """A double as the shortest text that reads back the same, without exponent from 1e-6 up to 1e21 (the rule of ECMAScript),
    on any JDK.

    A value of at most two decimals is its decimal text: of 15 digits or fewer only one text reads back as a double. For others
    the digits are searched.
    """
    x = x.cast("double")
    cents = x.try_cast("decimal(15,2)")
    money = F.rtrim(F.rtrim(cents.cast("string"), F.lit("0")), F.lit("."))
    return (
        F.when(F.isnan(x), F.lit("NaN"))
        .when(x == F.lit(float("inf")), F.lit("Infinity"))
        .when(x == F.lit(float("-inf")), F.lit("-Infinity"))
        .when(x == 0, F.lit("0"))
        .when(cents.cast("double") == x, money)
        .when(x.isNotNull(), _shortest(x))
    )


def _digest(*fields: Column) -> Column:
    """16 hex digits of the SHA-256 of the fields, joined by | without escaping; null is an empty field."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields]), 256), 1, 16)


def fingerprint() -> Column:
    """Identity of a row, from fields that never change. The account it was read from isn't one of them."""
    amount = F.coalesce(number_text(F.col("amount")), F.lit("undefined"))
    return _digest(F.col("provider"), F.col("account_id"), F.col("transaction_date"), F.col("merchant_name"), amount, F.col("currency"), F.col("transaction_type"))


def content_hash() -> Column:
    """Fields that may change while the row stays the same transaction."""
    return _digest(F.col("status"), F.col("charge_date"), number_text(F.col("charge_amount")), F.col("charge_currency"), F.col("category"))


def classify(seen: Column, stored: Column, current: Column, full_fetch: bool = False) -> Column:
    """created, updated or unchanged. ``seen``: whether there is a stored entry; one without a hash counts as unchanged."""
    if full_fetch:
        return F.lit("created")
    return F.when(~F.coalesce(seen, F.lit(False)), "created").when(stored.isNull() | (stored == current), "unchanged").otherwise("updated")


#: The tag of a row by its class.
LOCAL_TAGS = {"created": "new", "updated": "updated", "unchanged": "unchanged"}


def local_tag(kind: Column, repeated: Column) -> Column:
    tag = F.lit(None).cast("string")
    for k, v in LOCAL_TAGS.items():
        tag = F.when(kind == k, v).otherwise(tag)
    return F.when(repeated, "duplicate").otherwise(tag)
