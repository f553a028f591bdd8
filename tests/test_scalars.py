from __future__ import annotations

import decimal
import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.functions import http, identity, retry, text


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_parse_amount(spark):
    cases = {"$97.30": 97.3, "€97.30": 97.3, "£12.34": 12.34, "₪46.79": 46.79, "RON72.50": 72.5, "USD 97.30": 97.3, "97.30 USD": 97.3, "1,234.56": 1234.56, "abc": 0, "—": 0, "": 0, None: 0, "-₪5": 5, ".50": 50, "1.234,56": 1.234, "-12": -12}
    assert column(spark, list(cases), text.parse_amount) == list(cases.values())


def test_detect_currency(spark):
    cases = {"$125.60": "USD", "€99.00": "EUR", "£42.50": "GBP", "387.45 ₪": "ILS", "125.60": "ILS", "": "ILS", None: "ILS", "RON72.50": "RON", "97.30 USD": "USD", "JPY1200": "ILS", "US$7": "USD", "eur 5": "EUR", "XEUR 5": "ILS"}
    assert column(spark, list(cases), text.detect_currency) == list(cases.values())


def test_parse_date(spark):
    cases = {"15/04/26": "2026-04-15", "at 15/04/26 10:30": "2026-04-15", "15/04/2026": "2020-04-15", "99/99/99": "2099-99-99", "": "", None: "", "1/2/26": ""}
    assert column(spark, list(cases), text.parse_date) == list(cases.values())


def test_pending_marker(spark):
    first, second = text.PENDING_MARKERS[:2]
    assert column(spark, [f"x {first} y", second, "settled", "", None], text.pending_marker) == [first, second, None, None, None]


def test_text_helpers(spark):
    assert column(spark, ['Cafe, "The Best"', "plain", None, "a\nb", "a\rb"], text.csv_field) == ['"Cafe, ""The Best"""', "plain", "", '"a\nb"', '"a\rb"']
    assert column(spark, ["key=ABC123 again ABC123", None, "a.c abc"], lambda c: text.redact(c, ["ABC123", "", None, "a.c"])) == ["key=[REDACTED] again [REDACTED]", "", "[REDACTED] abc"]
    assert column(spark, ["https://u:p@Host.com:8443/a?b#c", "not a url", "http://e.com", None], text.safe_url) == ["https://host.com:8443/a", "[invalid-url]", "http://e.com/", "[invalid-url]"]
    odd = {
        "https://Héllo.com/x": "https://xn--hllo-bpa.com/x", "http://h/a b": "http://h/a%20b", "https://h:443/a/../b": "https://h/b", "http://h:443/": "http://h:443/", "HTTP://H:080/./a/%2e%2E/é": "http://h/%C3%A9",
        " http://h/x\n ": "http://h/x", "http:\\\\h\\p": "http://h/p", "http://h:99999/": "[invalid-url]", "http:///h/": "http://h/", "http://a b/": "[invalid-url]", "custom://Host:5/P?q": "custom://Host:5/P", "http://": "[invalid-url]",
        "http://h/a/..": "http://h/", "http://h/a/b/.": "http://h/a/b/", "ftp://u@h:21": "ftp://h/",
    }
    assert dict(zip(odd, column(spark, list(odd), text.safe_url), strict=True)) == odd
    assert column(spark, ["😀😀", "a😀b", "ab😀", "abc"], lambda c: text.truncate(c, 3)) == ["😀\ufffd…[truncated]", "a😀…[truncated]", "ab\ufffd…[truncated]", "abc"]
    assert column(spark, ["\u00a0a\u2003\u00a0b\ufeff"], text.one_line) == ["a b"]
    assert column(spark, ["abcdef", "abc", None], lambda c: text.truncate(c, 3)) == ["abc…[truncated]", "abc", ""]
    assert column(spark, ["  a \n b\t"], text.one_line) == ["a b"]
    assert column(spark, ["Cal/My Acc-1"], text.file_name) == ["cal_my_acc-1"]
    assert column(spark, ["default", "", None, "x"], lambda c: text.state_name(F.lit("cal"), c)) == ["cal", "cal", "cal", "cal_x"]
    assert column(spark, ["<a href=\"x\">'&"], text.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;"]
    assert column(spark, ["Timed out", "TIMEOUT", "no"], text.is_timeout) == [True, True, False]


def test_number_text(spark):
    cases = {85.0: "85", 50.5: "50.5", -0.0: "0", 10000000.0: "10000000", 1e-7: "1e-7", 1e21: "1e+21", 123456789012.34: "123456789012.34", 0.1: "0.1", 1.5e-5: "0.000015", 97.3: "97.3", 1e20: "100000000000000000000", 2e22: "2e+22", -1234.5: "-1234.5", math.inf: "Infinity", math.nan: "NaN"}
    assert column(spark, list(cases), identity.number_text, "double") == list(cases.values())


def ecma(v):
    """The text of a double by its shortest digits, as Python finds them."""
    if v == 0:
        return "0"
    sign, digits, exponent = decimal.Decimal(repr(v)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    exponent += len(digits) - len(text)
    point, minus = len(text) + exponent, "-" if sign else ""
    if -6 < point <= 21:
        plain = f"0.{'0' * -point}{text}" if point <= 0 else text + "0" * (point - len(text)) if len(text) <= point else f"{text[:point]}.{text[point:]}"
        return minus + plain
    return f"{minus}{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'-' if point < 1 else '+'}{abs(point - 1)}"


def test_number_text_is_the_shortest(spark):
    """Random bit patterns, powers of two, and what JDKs before 19 give one digit too many."""
    rng = random.Random(8)
    patterns = [struct.unpack("<d", rng.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(100_000)]
    values = [v for v in patterns if math.isfinite(v)] + [2.0**e for e in range(-1074, 1024)] + [2e23, 8.41e21, 2.2e-322, 5e-324, 1.1e-5, 9007199254740993.0, 123456.789, 0.1 + 0.2, 1 / 3, 1e-6, 9.99e-7, 123e18]
    values += [rng.uniform(-1e6, 1e6) for _ in range(5000)]
    assert column(spark, values, identity.number_text, "double") == [ecma(v) for v in values]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.integers(-(10**11), 10**11), min_size=200, max_size=200))
def test_number_text_of_money(spark, cents):
    values = [c / 100 for c in cents]
    expected = [repr(v).removesuffix(".0").replace("-0", "0") if v == 0 else repr(v).removesuffix(".0") for v in values]
    assert column(spark, values, identity.number_text, "double") == expected


def test_http(spark):
    assert column(spark, [200, 204, 400, 499, 500, 302, None], http.classify_status, "int") == [None, None, "api_validation_failed", "api_validation_failed", "api_error", "api_error", "api_error"]
    assert column(spark, [401, 403, 200, 500, None], http.classify_probe, "int") == [False, False, True, True, False]
    bodies = ['{"id": "a"}', '{"transaction_id": 7}', '{"data": {"id": "d"}}', "no", "", None, '{"id": null, "transaction_id": "t"}']
    assert column(spark, bodies, http.response_id) == ["a", "7", "d", None, None, None, "t"]


def test_retry(spark):
    assert retry.waits(3, 100, 2) == [100, 200]
    assert retry.waits() == [1000, 1500]
    assert column(spark, [0, 1, 2], retry.wait_ms, "int") == [1000, 1500, 2250]
    calls, slept = [], []

    def fail():
        calls.append(1)
        raise OSError(len(calls))

    with pytest.raises(OSError, match="3"):
        retry.retry(fail, 3, 100, 2, slept.append)
    assert slept == [0.1, 0.2]
    assert retry.retry(lambda: 5, sleep=slept.append) == 5
