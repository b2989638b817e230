"""Typed access to the dynamic JSON payload of a trace event, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Payload keys that carry text, in the order in which they are read.
TEXT_KEYS = ("text", "output", "stdout", "stderr", "content", "error", "message")

_SCHEMA = ", ".join(f"{k} STRING" for k in ("command", "toolName", "toolCallId", *TEXT_KEYS)) + ", isError BOOLEAN"
#: White space of any kind, the invisible characters included (Java's \s is ASCII only).
SPACE = r"[\s\u0085\u00a0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+"
_ANSI = r"\u001b\[[0-9;?]*[A-Za-z]"


def parsed(payload: Column) -> Column:
    """The payload as a struct; a field of another type (`isError` as a string) is null."""
    return F.from_json(payload, _SCHEMA)


def _one(value: Column) -> Column:
    """A text field: a string as it is, a list of content chunks as their texts in lines (chunks without text add none)."""
    chunk = lambda c: F.when(c.startswith("{"), F.get_json_object(c, "$.text")).otherwise(c)
    listed = F.from_json(value, "ARRAY<STRING>")
    return F.when(value.startswith("[") & listed.isNotNull(), F.array_join(F.transform(listed, chunk), "\n")).otherwise(value)


def text_of(p: Column) -> Column:
    """All texts of a parsed payload in the order of TEXT_KEYS, joined by line ends; empty where there is none."""
    return F.concat_ws("\n", *[_one(p[k]) for k in TEXT_KEYS])


def squeeze(text: Column) -> Column:
    """Text without colour codes and layout: every run of white space is one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _ANSI, ""), SPACE, " "))


def is_blank(text: Column) -> Column:
    """True for null and for text of nothing but white space of any kind."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))) == 0


def valid(payload: Column) -> Column:
    """Whether a payload is one JSON value (a parser alone would stop at the first value of several); false for null."""
    whole = F.trim(F.regexp_replace(payload, r"[\s]+", " ")).rlike(r'^(\{.*\}|\[.*\]|".*"|-?[0-9][0-9.eE+-]*|true|false|null)$')
    return F.coalesce(F.try_parse_json(payload).isNotNull() & whole, F.lit(False))


def string_at(variant: Column, key: str) -> Column:
    """The string under a key of a parsed payload; null for values of another type."""
    return F.when(F.schema_of_variant(F.try_variant_get(variant, f"$.{key}", "variant")) == "STRING", F.try_variant_get(variant, f"$.{key}", "string"))


def flag_at(variant: Column, key: str) -> Column:
    """The boolean under a key; null for values of another type."""
    return F.when(F.schema_of_variant(F.try_variant_get(variant, f"$.{key}", "variant")) == "BOOLEAN", F.try_variant_get(variant, f"$.{key}", "boolean"))


#: The order in which the first text that is not blank is picked from a payload (fixed values).
OUTCOME_KEYS = ("output", "stderr", "stdout", "text", "content", "error", "message")


def first_text(variant: Column, keys: tuple[str, ...] = OUTCOME_KEYS) -> Column:
    """The first string under `keys` that is not blank; empty where there is none."""
    filled = lambda c: F.when(c.rlike(r"\S"), c)
    return F.coalesce(*[filled(string_at(variant, k)) for k in keys], F.lit(""))
