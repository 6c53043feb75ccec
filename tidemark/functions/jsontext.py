"""Tolerant reading of JSON text columns (plain Python, used inside Arrow maps)."""

from __future__ import annotations

import json
import re
from decimal import Decimal

MISSING = object()
_PLAIN = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?\Z")


def decode(text: str | None) -> object:
    """The value of a JSON text; a text that holds JSON text is parsed once more.

    ``MISSING`` for null, text that doesn't parse, and text nested deeper than the
    parser goes.
    """
    if text is None:
        return MISSING
    try:
        value = json.loads(text)
        return json.loads(value) if type(value) is str else value
    except (ValueError, RecursionError):
        return MISSING


def records_of(text: str | None) -> list | None:
    """The list in a records column; one bare object is a list of one, else None."""
    value = decode(text)
    if type(value) is dict:
        return [value]
    return value if type(value) is list else None


def _number_text(sign: str, whole: str, part: str) -> str:
    whole, part = whole.lstrip("0") or "0", part.rstrip("0")
    body = f"{whole}.{part}" if part else whole
    return body if body == "0" else sign + body


def canonical(value: object) -> str | None:
    """One text per value, equal for equal texts and for numbers of the same value.

    Numbers and plain decimal texts of numbers share the prefix ``n``; other texts
    have ``s``. None for null, booleans, objects and lists.
    """
    kind = type(value)
    if kind is str:
        if value and value[-1] in "0123456789" and _PLAIN.match(value):
            sign = "-" if value[0] == "-" else ""
            whole, _, part = value.lstrip("+-").partition(".")
            return "n" + _number_text(sign, whole, part)
        return "s" + value
    if kind is int:
        return f"n{value}"
    if kind is float:
        if value != value or value in (float("inf"), float("-inf")):
            return f"s{value}"
        text = repr(value)
        if "e" in text:
            text = format(Decimal(text), "f")
        sign = "-" if text[0] == "-" else ""
        whole, _, part = text.lstrip("-").partition(".")
        return "n" + _number_text(sign, whole, part)
    return None


def canonical_any(value: object) -> str | None:
    """Like :func:`canonical`, also for booleans, lists and objects; None only for null."""
    if value is None:
        return None
    scalar = canonical(value)
    return scalar if scalar is not None else "j" + json.dumps(value, sort_keys=True)


def key_text(value: object) -> str | None:
    """The text that stands for a key value; None for null."""
    if value is None or type(value) is str:
        return value
    scalar = canonical(value)
    return scalar[1:] if scalar is not None else json.dumps(value, sort_keys=True)


def clean(text: str | None) -> str | None:
    """Text with lone surrogates escaped, since UTF-8 columns can't hold them."""
    return None if text is None else text.encode("utf-8", "backslashreplace").decode("utf-8")
