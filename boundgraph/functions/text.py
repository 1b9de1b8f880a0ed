"""Rows as text and back: escapes, shaped lines, lines between bars, names made from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import nickname
from . import props as P

#: Characters that would end a line or field, and how they are written.
ESCAPES = {
    "\\": "\\\\",
    "|": "\\|",
    "\n": "\\n",
    "\r": "\\r",
    "\x0b": "\\v",
    "\x0c": "\\f",
    "\x1c": "\\x1c",
    "\x1d": "\\x1d",
    "\x1e": "\\x1e",
    "\x85": "\\x85",
    "\u2028": "\\u2028",
    "\u2029": "\\u2029",
}


def escaped(text: Column) -> Column:
    """A value as it stands between bars."""
    for raw, safe in ESCAPES.items():
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    """The value behind an escaped one: pieces between escaped backslashes are restored one by one."""

    def piece(part: Column) -> Column:
        for raw, safe in ESCAPES.items():
            if raw != "\\":
                part = F.replace(part, F.lit(safe), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def fields(line: Column) -> Column:
    """The values of a line, split at bars that no backslash escapes."""
    pieces = F.regexp_extract_all(F.concat(F.lit("|"), line), F.lit(r"\|((?:[^|\\]|\\.)*)"), F.lit(1))
    return F.transform(pieces, unescaped)


def quoted(text: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.concat(F.lit("'"), text, F.lit("'"))


def literal(text: Column) -> Column:
    """A value in a shaped line: numbers and truth values bare, JSON as it is, the rest quoted."""
    bare = F.rlike(text, F.lit(r"\A(true|false|-?\d+|-?\d+\.\d+)\z"))
    nested = F.rlike(text, F.lit(r"(?s)\A(\{.*\}|\[.*\])\z")) & F.try_parse_json(text).isNotNull()
    return F.when(bare | nested, text).otherwise(quoted(text))


def shown(props: str = "props", with_nickname: bool = True) -> Column:
    """Pairs that a shaped line shows, by key, the nickname first: none that are empty, no life cycle that never ends."""
    keep = F.map_filter(props, lambda k, v: ~k.isin(*P.IDENTITY_KEYS) & (v != "") & ~((k == "recycle") & (v == "persistent")))
    pairs = F.array_sort(F.map_entries(keep))
    if not with_nickname:
        return pairs
    own = F.array(F.struct(F.lit("id").alias("key"), nickname(props).alias("value")))
    return F.when(nickname(props).isNull(), pairs).otherwise(F.concat(own, pairs))


def braces(pairs: Column) -> Column:
    body = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(": "), literal(p["value"]))), ", ")
    return F.when(F.size(pairs) > 0, F.concat(F.lit("{"), body, F.lit("}"))).otherwise("")


def shaped_node(tag: Column, pairs: Column) -> Column:
    """``(:TAG {key: value})``."""
    label = F.when(tag == "", F.lit("")).otherwise(F.concat(F.lit(":"), tag))
    return F.concat(F.lit("("), label, F.when((label != "") & (F.size(pairs) > 0), F.lit(" ")).otherwise(""), braces(pairs), F.lit(")"))


def slug(kind: str, text: Column) -> Column:
    """``KIND_name`` from any text: runs of other characters are one underscore."""
    clean = F.trim(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.concat(F.lit(f"{kind}_"), clean)


def leftover_nick(kind: Column, seed: Column) -> Column:
    """A nickname for a row that came without one: ``sn_<kind>_`` and 16 digits of a SHA-256."""
    return F.concat(F.lit("sn_"), F.lower(kind), F.lit("_"), F.substring(F.sha2(seed.cast("binary"), 256), 1, 16))


def without_secret(text: Column, secret: str) -> Column:
    """A message without a session's name, which is a capability."""
    return F.replace(text, F.lit(secret), F.lit("<session>")) if secret else text


def canonical(json: Column) -> Column:
    """A JSON value as the text that is stored: strings as they are, null empty, the rest compact."""
    parsed = F.try_parse_json(json)
    plain = F.schema_of_variant(parsed)
    return F.when(parsed.isNull() | (plain == "VOID"), F.lit("")).when(plain == "STRING", F.variant_get(parsed, "$", "string")).otherwise(F.to_json(parsed))


def unquoted(text: Column) -> Column:
    """The value of a quoted literal: the inverse of :func:`quoted`."""
    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    pieces = F.transform(F.split(inner, r"\\\\"), lambda p: F.replace(F.replace(F.replace(F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\\t"), F.lit("\t")), F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')))
    return F.array_join(pieces, "\\")


def phrase(text: Column, limit: int = 80) -> Column:
    """White space collapsed, cut to ``limit`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def attributes(text: Column) -> Column:
    """A map from ``k=v;k2=v2``; what has no sign is left out, of equal keys the last counts."""
    parts = F.filter(F.split(text, ";"), lambda p: F.contains(p, F.lit("=")))
    pair = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substr(p, F.locate("=", p) + 1)).alias("value"))
    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    # The pairs are the one element of an array, so that they are made once and not for every pair that asks for those after it.
    return F.map_from_entries(F.element_at(F.transform(F.array(F.transform(parts, pair)), last), 1))
