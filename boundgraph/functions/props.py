"""Columns over the property map: values, three-valued predicates, names, rank."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import RECYCLABLE, GraphError

#: Keys that identify a row and are no part of what it says.
IDENTITY_KEYS = ("id", "src", "dist", "hid", "elementId")
#: Fixed value: what counts as a number in a stored text.
NUMBER = r"\A-?\d+(\.\d+)?([eE][+-]?\d+)?\z"


def raw(key: str, props: str = "props") -> Column:
    """A property's text, null if it is missing.

    Where a map is made from columns, Catalyst puts the column in its place, so that
    only that column is read and tests of it reach the scan.
    """
    return F.col(props)[key]


def value(key: str, props: str = "props") -> Column:
    """A property's text; a missing one is the empty text."""
    return F.coalesce(raw(key, props), F.lit(""))


def equals(key: str, text: str) -> Column:
    return raw(key).eqNullSafe(text) if text else value(key) == ""


def differs(key: str, text: str) -> Column:
    return ~equals(key, text)


def contains(key: str, text: str) -> Column:
    return F.contains(value(key), F.lit(text))


def starts_with(key: str, text: str) -> Column:
    return F.startswith(value(key), F.lit(text))


def ends_with(key: str, text: str) -> Column:
    return F.endswith(value(key), F.lit(text))


def matches(key: str, pattern: str) -> Column:
    """An unanchored regular expression; what Java and Python write differently is refused."""
    if "(?P" in pattern:
        raise GraphError("unsupported_predicate", "named groups")
    try:
        re.compile(pattern)
    except re.error as wrong:
        raise GraphError("unsupported_predicate", str(wrong)) from wrong
    return F.rlike(value(key), F.lit(pattern))


def lists(key: str, text: str) -> Column:
    """Whether a property that holds a JSON array, or text between commas, has the element ``text``."""
    own = value(key)
    comma = F.filter(F.transform(F.split(own, ","), F.trim), lambda s: s != "")
    parsed = F.coalesce(F.from_json(own, "array<string>"), comma)
    return F.array_contains(F.when(F.startswith(F.trim(own), F.lit("[")), parsed).otherwise(comma), text)


_COMPARISONS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def compares(key: str, op: str, other: float | str) -> Column:
    """A range test: null (unknown) where the property is missing, or not a number and ``other`` is.

    Against a text the order is that of code points; numbers stored there are a caller's
    mistake, which :func:`mistyped` finds beforehand.
    """
    if key == "id":
        raise GraphError("unsupported_predicate", "ids have no order")
    if op not in _COMPARISONS:
        raise GraphError("unsupported_predicate", op)
    own, test = F.nullif(value(key), F.lit("")), _COMPARISONS[op]
    if isinstance(other, str):
        return getattr(own, test)(F.lit(other))
    number = F.when(F.rlike(own, F.lit(NUMBER)), own.try_cast("double"))
    rough = getattr(F.when(F.abs(number) < float("inf"), number), test)(F.lit(float(other)))
    if isinstance(other, int) and abs(other) < 10**37:  # whole numbers beyond 2 ** 53 compare exactly
        whole = F.when(F.rlike(own, F.lit(r"\A-?\d{1,37}\z")), own.try_cast("decimal(38,0)"))
        return F.coalesce(getattr(whole, test)(F.lit(str(other)).cast("decimal(38,0)")), rough)
    return rough


def mistyped(key: str) -> Column:
    """Rows on which a range test of ``key`` against a text has no meaning: the property is a number."""
    return F.rlike(value(key), F.lit(NUMBER))


def holds(predicate: Column) -> Column:
    """A predicate as a filter: unknown counts as false."""
    return F.coalesce(predicate, F.lit(False))


def glob(key: str, pattern: str) -> Column:
    """Exact text, or with ``*``, ``?`` and ``[..]`` a pattern for the whole of it."""
    if not any(c in pattern for c in "*?["):
        return equals(key, pattern)
    inner = pattern.strip("*")
    if pattern == f"*{inner}*" and inner and not any(c in inner for c in "*?["):
        return contains(key, inner)
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[" and (end := pattern.find("]", at + 2)) > 0:
            body = pattern[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]")
            at = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() else f"\\{c}"))
        at += 1
    return F.rlike(value(key), F.lit(rf"(?s)\A{''.join(out)}\z"))


def keyword(text: str) -> Column:
    """Whether any property holds ``text``, whatever the case."""
    return F.exists(F.map_values("props"), lambda v: F.contains(F.lower(v), F.lit(text.strip().lower())))


def recyclable(props: str = "props") -> Column:
    return value("recycle", props).isin(*RECYCLABLE)


def payload(props: str = "props") -> Column:
    """Pairs of key and value without what identifies the row, sorted: comparable and groupable, as maps are not."""
    return F.array_sort(F.map_entries(F.map_filter(props, lambda k, v: ~k.isin(*IDENTITY_KEYS))))


def fold_relation(name: Column) -> Column:
    """One spelling of a relation's name: HAS_FACT is hasFact; others lose a capital at their start.

    What is no name stays as it is.
    """
    parts = F.filter(F.split(F.lower(name), "_"), lambda p: p != "")
    camel = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), ""))
    return F.when(~F.rlike(name, F.lit(r"^[A-Za-z][A-Za-z0-9_]*$")), name).when(F.rlike(name, F.lit(r"^[A-Z][A-Z0-9_]*$")), camel).otherwise(F.concat(F.lower(F.substring(name, 1, 1)), F.substr(name, F.lit(2))))


def overlaid(under: str, over: str) -> Column:
    """One map of two; where both have a key, that of ``over`` counts unless it is empty."""
    return F.map_zip_with(under, over, lambda k, a, b: F.coalesce(F.nullif(b, F.lit("")), a, b))
