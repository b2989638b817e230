"""Text normalisation and extraction, as nested built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
#: Fixed patterns of lines that tell an error, of paths, and of secrets.
ERROR_LINE = r"(?i)(error|exception|failed|failure|fatal|panic|traceback|not found|denied|cannot|unable to)"
PATH = r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z0-9]+"
SECRETS = (("(?i)bearer [a-z0-9._-]+", "bearer <redacted>"), ("(?i)(api[_-]?key|token|secret)=[^ ]+", "$1=<redacted>"), ("/(home|Users)/[^/ ]+", "~"), ("[0-9a-f]{32,}", "<hash>"))


def normalize(text: Column) -> Column:
    """Lower case, hex runs of 8 and more as <hex>, whole numbers as <num>, white space collapsed."""
    t = F.regexp_replace(F.lower(text), "[0-9a-f]{8,}", "<hex>")
    t = F.regexp_replace(t, f"(?<!{_WORD})[0-9]+(?!{_WORD})", "<num>")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def command_signature(text: Column) -> Column:
    """Normalised and cut to 240 characters."""
    return F.substring(normalize(text), 1, 240)


def error_signatures(text: Column, most: int = 8) -> Column:
    """The first distinct normalised lines that tell an error."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(ERROR_LINE))
    return F.slice(F.array_distinct(F.transform(lines, lambda x: F.substring(normalize(x), 1, 240))), 1, most)


def file_paths(text: Column, most: int | None = 12) -> Column:
    """The first distinct file paths; all of them without `most`."""
    paths = F.array_distinct(F.regexp_extract_all(text, F.lit(PATH), F.lit(0)))
    return paths if most is None else F.slice(paths, 1, most)


def tokens(text: Column) -> Column:
    """Search terms: lower case, split at everything but letters, digits and ./:_-, longer than one character."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_./:-]+"), lambda x: F.length(x) > 1)


def bounded_terms(terms: Column, head: int = 96, tail: int = 32) -> Column:
    """At most head + tail terms: a long query keeps its first distinct terms and its last ones not among them."""
    first = F.slice(F.array_distinct(terms), 1, head)
    rest = F.reverse(F.slice(F.array_except(F.array_distinct(F.reverse(terms)), first), 1, tail))
    return F.when(F.size(terms) <= head + tail, terms).otherwise(F.concat(first, rest))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of the sets of normalised words longer than two characters; 1 if both are empty."""
    words = lambda t: F.array_distinct(F.filter(F.split(normalize(t), " "), lambda w: F.length(w) > 2))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def family_signature(command: Column, output: Column) -> Column:
    """Command and first error line, normalised; without both the first line that isn't blank, else `recovery`."""
    first_error = F.element_at(F.concat(error_signatures(output, 1), F.array(F.lit(""))), 1)
    cmd = command_signature(F.coalesce(command, F.lit("")))
    both = F.substring(F.trim(F.concat_ws(" ", cmd, F.nullif(first_error, F.lit("")))), 1, 240)
    line = F.try_element_at(F.filter(F.transform(F.split(output, "\n"), lambda x: F.substring(normalize(x), 1, 240)), lambda x: x != ""), F.lit(1))
    return F.coalesce(F.nullif(both, F.lit("")), line, F.lit("recovery"))


def redact(text: Column) -> Column:
    """Secrets and home folders replaced."""
    for pattern, to in SECRETS:
        text = F.regexp_replace(text, pattern, to)
    return text


def clip_middle(text: Column, most: int) -> Column:
    """White space collapsed; a longer text keeps 65 % from its head, ` ... `, and its tail."""
    t = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    head = int(most * 0.65)
    tail = most - head - 5
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, head), F.lit(" ... "), F.substring(t, -tail, tail)))


def fnv1a32(text: Column) -> Column:
    """FNV-1a of 32 bits over the characters of an ASCII text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")))


def slug(text: Column) -> Column:
    """Lower case, everything but letters and digits as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def session_part(session: Column, part: int) -> Column:
    """Part (from 1) of a session id of three or four parts, else null."""
    parts = F.split(F.lower(F.trim(session)), "::")
    return F.when(F.size(parts).isin(3, 4), F.nullif(F.trim(F.try_element_at(parts, F.lit(part))), F.lit("")))
