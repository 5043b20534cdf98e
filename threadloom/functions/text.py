"""Text functions as Column expressions: lengths in UTF-16 units, token estimates, abridging, paths, code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 2.5

# What counts as a path, a file name, a URL, code or a reference.
FILE_SUFFIX = r"(?:[cm]?[jt]sx?|py|go|rs|rb|java|kt|swift|c|cc|cpp|h|hpp|cs|php|sh|json|ya?ml|toml|md|sql|env|txt|css|html)"
PATH_LIKE = r"(?:[\w@.-]+/)+[\w.-]+"
FILE_NAME = rf"\b[\w-]+\.{FILE_SUFFIX}\b"
URL = r"https?://\S+"
# PATH_LIKE for Java: where it fails at the start of a run of its characters it fails in all of the run, which is not tried again (a long run would take the square of its length).
PATH_SEARCH = r"(?:\G|(?<![\w@.-]))(?:[\w@.-]++/)+[\w.-]+"
MIN_PATH_CHARS = 4
DIFF_HEADER = r"(?m)(?:^|\\n)(?:\+\+\+ |--- |@@ )"
DIFF_LINE = r"(?m)(?:^|\\n)[+-](?![+-])"
REFERENCE = rf"(?i)^(?:https?://|(?:[\w@.-]+/)+[\w.-]+\.\w{{1,8}}\z|[\w-]+\.{FILE_SUFFIX}\z)"
BRAND = r"^[A-Z][A-Za-z]+\.js\z"
JOINED = r"(?<=\.[A-Za-z0-9]{1,8})/(?=[\w.-]+\.[A-Za-z0-9]{1,8}\z)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def u16len(text: Column | str) -> Column:
    """Length in UTF-16 code units: characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("int")


def est_tokens(text: Column | str) -> Column:
    return F.ceil(u16len(text) / CHARS_PER_TOKEN).cast("int")


def excerpt(text: Column | str, n: int) -> Column:
    """The first 7 and last 3 tenths of n characters, with a note of what lies between; a text of at most n as it is.

    Cuts count characters, not UTF-16 units, so a character is never halved.
    """
    t, n = _c(text), max(0, n)
    head, tail = -(-7 * n // 10), 3 * n // 10
    size = F.length(t)
    end = F.substring(t, -tail, tail) if tail else F.lit("")
    if tail:
        end = F.when(size > tail, end).otherwise(t)
    return F.when(size <= n, t).otherwise(F.concat(F.substring(t, 1, head), F.lit(" […"), (size - head - tail).cast("string"), F.lit(" chars omitted…] "), end))


def one_line(text: Column | str, n: int) -> Column:
    flat = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, max(0, n - 1)), F.lit("…")))


def result_head(result: Column | str, n: int) -> Column:
    r, n = _c(result), max(0, n)
    return F.when(F.length(r) <= n, r).otherwise(F.concat(F.substring(r, 1, n), F.lit(" ("), F.length(r).cast("string"), F.lit(" chars total)")))


def result_omitted(result: Column | str) -> Column:
    return F.concat(F.lit("ok, "), F.length(_c(result)).cast("string"), F.lit(" chars (omitted)"))


def paths(text: Column | str) -> Column:
    """Paths, then file names, then URLs, distinct, in order of appearance."""
    t = _c(text)
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), 0) for p in (PATH_SEARCH, FILE_NAME, URL)])
    return F.array_distinct(F.filter(found, lambda p: F.length(p) >= MIN_PATH_CHARS))


def has_code(text: Column | str) -> Column:
    t = _c(text)
    return t.contains("```") | t.rlike(DIFF_HEADER) | (F.regexp_count(t, F.lit(DIFF_LINE)) >= 3)


def is_reference(token: Column | str) -> Column:
    t = _c(token)
    return t.rlike(REFERENCE) & ~t.rlike(BRAND)


def split_joined(token: Column | str) -> Column:
    """A token of several file names joined by slashes as its parts, if each is a reference."""
    t = _c(token)
    parts = F.split(t, JOINED)
    return F.when((F.size(parts) > 1) & F.forall(parts, is_reference), parts).otherwise(F.array(t))


def content_hash(role: Column | str, text: Column | str) -> Column:
    return F.sha1(F.concat(_c(role), F.lit("\0"), _c(text)))


def between(text: Column | str, tag: str) -> Column:
    """What stands between the first opening and the last closing tag; null without both."""
    t = _c(text)
    start = F.locate(f"<{tag}>", t)
    end = F.length(t) - F.locate(f">{tag[::-1]}/<", F.reverse(t)) - len(tag) - 1
    return F.when((start > 0) & (F.locate(f"</{tag}>", t) > 0) & (end >= start + len(tag) + 2), t.substr(start + len(tag) + 2, end - start - len(tag) - 2))


def redact(text: Column | str, secret: str | None) -> Column:
    """The text without a secret of 8 characters or more."""
    return F.replace(_c(text), F.lit(secret), F.lit("[redacted]")) if secret and len(secret) >= 8 else _c(text)


def xml_escape(text: Column | str) -> Column:
    t = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def clip_middle(text: Column | str, limit: int = 6000, head: int = 4000, tail: int = 1500) -> Column:
    t = _c(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, head), F.lit("\n...[truncated]...\n"), F.substring(t, -tail, tail)))


def tokens_by_chars(text: Column | str, chars: float = 4.0) -> Column:
    return F.ceil(u16len(text) / F.lit(chars)).cast("int")


def tokens_by_bytes(text: Column | str) -> Column:
    return F.ceil(F.octet_length(_c(text)) / 4).cast("int")


def tokens_per_message(text: Column | str) -> Column:
    """3.3 characters a token, rounded up, and 3 for the message."""
    return (F.ceil(u16len(text) / 3.3) + 3).cast("int")


def tokens_rough(text: Column | str) -> Column:
    """4 characters a token and 10 for the message."""
    return (F.floor(u16len(text) / 4) + 10).cast("int")
