"""Text, amount and date expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency symbols in the order they are looked for, and codes that may stand in text.
CURRENCY_SYMBOLS = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("₪", "ILS")]
CURRENCY_CODES = ["ILS", "USD", "EUR", "GBP", "RON"]
HOME_CURRENCY = "ILS"

#: Texts that mark a row as not final, in the order they are looked for.
PENDING_MARKERS = [
    "העסקה עדיין לא נקלטה",
    "עדיין לא נקלטה",
    "הסכום לא סופי",
    "עדיין בתהליך קליטה",
    "תהליך קליטה",
]

#: Name of a login error, and what other errors about a lost login say.
LOGIN_ERROR = "CalLoginError"
AUTH_FAILURES = ["Login verification failed", "login iframe did not appear", "Missing credentials"]


def parse_amount(raw: Column) -> Column:
    """The first number in the text (thousands' commas dropped), 0 without one."""
    number = F.regexp_replace(F.regexp_extract(raw, r"-?\d[\d,]*(?:\.\d+)?", 0), ",", "")
    return F.coalesce(F.nullif(number, F.lit("")).try_cast("double"), F.lit(0.0))


def detect_currency(raw: Column) -> Column:
    """By symbol, else the first known code that stands alone, else the home currency."""
    text = F.coalesce(raw, F.lit(""))
    by_symbol = F.lit(None).cast("string")
    for symbol, code in reversed(CURRENCY_SYMBOLS):
        by_symbol = F.when(F.contains(text, F.lit(symbol)), F.lit(code)).otherwise(by_symbol)
    runs = F.regexp_extract_all(F.upper(text), F.lit(r"(?<![A-Z])([A-Z]{3})(?![A-Z])"), F.lit(1))
    return F.coalesce(by_symbol, F.get(F.filter(runs, lambda c: c.isin(CURRENCY_CODES)), F.lit(0)), F.lit(HOME_CURRENCY))


def parse_date(text: Column) -> Column:
    """The first dd/dd/dd in the text as 20yy-mm-dd, '' without one; the calendar isn't asked."""
    part = lambda i: F.regexp_extract(text, r"(\d{2})/(\d{2})/(\d{2})", i)
    return F.when(F.coalesce(part(0), F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("20"), part(3), F.lit("-"), part(2), F.lit("-"), part(1)))


def pending_marker(text: Column, markers: Sequence[str] = PENDING_MARKERS) -> Column:
    """The first of the markers, in list order, that the text contains; null for none."""
    found = F.lit(None).cast("string")
    for m in reversed(markers):
        found = F.when(F.contains(text, F.lit(m)), F.lit(m)).otherwise(found)
    return found


def pending_text(sections: Sequence[Column], panel: Column) -> Column:
    """The status sections joined by spaces, or the whole panel's text if they are blank."""
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", *sections)), F.lit("")), panel)


def redact(text: Column, secrets: Sequence[str | None]) -> Column:
    """Every occurrence of each non-empty secret replaced, literally and in turn; null becomes ''."""
    out = F.coalesce(text, F.lit(""))
    for s in secrets:
        if isinstance(s, str) and s:
            out = F.replace(out, F.lit(s), F.lit("[REDACTED]"))
    return out


#: Schemes whose URLs have a host, and the port that such a URL needn't name.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
#: White space as ECMAScript has it; characters that a path holds in escaped form.
SPACES = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
ESCAPED = r"[\x00-\x20\x22\x3C\x3E\x5E\x60\x7B\x7D\x7F]|[^\x00-\x7F]"


def _escaped_path(path: Column) -> Column:
    one = lambda c: F.when(c.rlike(ESCAPED), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return F.when(path.rlike(ESCAPED), F.array_join(F.transform(F.split(path, ""), one), "")).otherwise(path)


def _plain_path(path: Column) -> Column:
    """``path`` without . and .. segments (also escaped ones); one of them at the end leaves the slash."""
    raw = F.split(F.substring(path, 2, 1 << 30), "/")
    steps = F.transform(raw, lambda s: F.regexp_replace(s, "(?i)%2e", "."))
    last = F.size(raw) - 1

    def step(done: Column, i: Column) -> Column:
        s, end = F.get(steps, i), F.when(i == last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s == ".", F.concat(done, end)).when(s == "..", F.concat(shorter, end)).otherwise(F.concat(done, F.array(F.get(raw, i))))

    walked = F.aggregate(F.sequence(F.lit(0), last), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(path)


def _plain_host(host: Column) -> Column:
    """Lower case; a host beyond ASCII in its ASCII form; null for what is no host name."""
    lower = F.lower(host)
    ascii_form = F.lower(F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), lower))
    found = F.when(host.rlike(r"^[\x00-\x7F]*$"), lower).otherwise(ascii_form)
    return F.when((found != "") & ~found.rlike(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]") | found.rlike(r"^\[[0-9a-f:.]+\]$"), found)


def safe_url(url: Column) -> Column:
    """scheme://host[:port]/path without user, query and fragment, in normal form; '[invalid-url]' for what is none.

    Normal form: blanks around and line ends within go; scheme and host in lower case, hosts beyond ASCII in their ASCII form;
    no port that is the scheme's own; no . and .. segments; unsafe characters of the path escaped. Of the schemes of
    ``DEFAULT_PORTS``; of other schemes with a host only scheme, host and path are told apart.
    """
    u = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    known = scheme.isin(*DEFAULT_PORTS)
    web = F.replace(F.regexp_extract(u, r"^[^:]*:([^?#]*)", 1), F.lit("\\"), F.lit("/"))
    rest = F.when(known, F.regexp_replace(web, "^/*", "")).otherwise(F.regexp_extract(u, r"^[^:]*://([^?#]*)", 1))
    authority = F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), "^.*@", "")
    host, port = F.regexp_extract(authority, r"^(.*?)(:[0-9]*)?$", 1), F.regexp_replace(F.regexp_extract(authority, r":([0-9]*)$", 1), "^0+(?=[0-9])", "")
    own = F.lit(None).cast("string")
    for name, number in DEFAULT_PORTS.items():
        own = F.when(scheme == name, number).otherwise(own)
    shown_port = F.when((port == "") | F.coalesce(port == own, F.lit(False)), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_extract(rest, r"^[^/]*(/.*)$", 1)
    web_path = _escaped_path(_plain_path(F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))))
    shown = F.when(known, F.concat(scheme, F.lit("://"), _plain_host(host), shown_port, web_path))
    other = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), F.concat(scheme, F.lit("://"), F.nullif(host, F.lit("")), shown_port, path))
    fine = (port == "") | (F.length(port) <= 5) & (port.try_cast("int") <= 65535)
    return F.coalesce(F.when(fine, F.when(known, shown).otherwise(other)), F.lit("[invalid-url]"))


#: Characters that count as two of the units in which lengths are measured, and what is shown of one that was cut apart.
WIDE, HALF = r"[\x{10000}-\x{10FFFF}]", "\ufffd"


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(text) + F.regexp_count(text, F.lit(WIDE))


def first_units(text: Column, most: int) -> Column:
    """The first ``most`` UTF-16 units; a character that this cuts apart is shown as a replacement character."""
    head = F.substring(text, 1, most)

    def step(done: Column, c: Column) -> Column:
        wide = c.rlike(WIDE)
        room = F.lit(most) - done["n"]
        shown = F.when(room <= 0, F.lit("")).when(wide & (room == 1), F.lit(HALF)).otherwise(c)
        return F.struct(F.concat(done["t"], shown).alias("t"), (done["n"] + F.when(wide, 2).otherwise(1)).alias("n"))

    cut = F.aggregate(F.split(head, ""), F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), step)["t"]
    return F.when(head.rlike(WIDE), cut).otherwise(head)


def truncate(text: Column, most: int = 200) -> Column:
    """At most so many UTF-16 units, and a note if any were cut; null becomes ''."""
    s = F.coalesce(text, F.lit(""))
    return F.when(units(s) > most, F.concat(first_units(s, most), F.lit("…[truncated]"))).otherwise(s)


def csv_field(value: Column) -> Column:
    """A CSV field: quoted if it has a comma, quote or line end; null becomes ''."""
    s = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_line(values: Sequence[Column]) -> Column:
    return F.concat_ws(",", *[csv_field(v) for v in values])


def one_line(text: Column, most: int = 200) -> Column:
    """White space collapsed and trimmed, the first ``most`` UTF-16 units."""
    return first_units(F.regexp_replace(F.regexp_replace(text, SPACES + "+", " "), "^ | $", ""), most)


def file_name(text: Column) -> Column:
    """Anything but ASCII letters, digits, - and _ becomes _, all in lower case."""
    return F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9_-]", "_"))


def state_name(provider: Column, account: Column) -> Column:
    """Name of an account's state: the suffix only for an account that is named and not 'default'."""
    return F.concat(provider, F.when((F.coalesce(account, F.lit("")) != "") & (account != "default"), F.concat(F.lit("_"), account)).otherwise(F.lit("")))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def is_timeout(message: Column) -> Column:
    return F.coalesce(message.rlike("(?i)timeout|timed out"), F.lit(False))


def is_auth_failure(name: Column, message: Column, phrases: Sequence[str] = AUTH_FAILURES) -> Column:
    """Whether a stored session is of no more use: by the error's name, or what it says."""
    found = F.coalesce(name == LOGIN_ERROR, F.lit(False))
    for p in phrases:
        found = found | F.coalesce(F.contains(message, F.lit(p)), F.lit(False))
    return found


def scrub(value: Column, schema: str, secrets: Sequence[str | None]) -> Column:
    """A nested value with secrets replaced at any depth: through its JSON text and back."""
    return F.from_json(redact(F.to_json(value), secrets), schema)
