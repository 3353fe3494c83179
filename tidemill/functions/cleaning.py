"""String cleaning rules as Column expressions; a null stays null."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide the cleaning results.
SPECIAL_CHARACTERS = r"(?U)[^a-zA-Z0-9\s]"
DIGITS = r"(?U)\d+"
WHITESPACE = r"(?U)\s+"
OUTER_WHITESPACE = r"(?U)^\s+|\s+\z"
PUNCTUATION = r"(?U)[^\w\s]"
HTML_TAG = r"<[^>]+>"
URL = r"https?://[$-_a-z!]+"

# Accepted spellings of each rule.
RULE_SPELLINGS = {
    "trim": ("trim",),
    "remove_special": ("remove_special", "remove_special_chars"),
    "lowercase": ("lowercase", "lower"),
    "uppercase": ("uppercase", "upper"),
    "remove_numbers": ("remove_numbers",),
    "remove_spaces": ("remove_spaces",),
    "normalize_whitespace": ("normalize_whitespace",),
    "remove_punctuation": ("remove_punctuation",),
    "remove_html": ("remove_html",),
    "remove_urls": ("remove_urls",),
    "custom_regex": ("custom_regex",),
}
_CANONICAL = {word: name for name, words in RULE_SPELLINGS.items() for word in words}


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_WHITESPACE, "")


def java_replacement(replacement: str) -> str:
    r"""Replacement text with ``\1`` back-references in the form Spark expects (``$1``)."""
    return re.sub(r"\\(\d+)", r"$\1", replacement.replace("$", r"\$"))


def _custom(text: Column, params: Mapping[str, Any]) -> Column:
    if "pattern" not in params:
        return text
    return F.regexp_replace(text, params["pattern"], java_replacement(params.get("replacement", "")))


_RULES: dict[str, Callable[[Column, Mapping[str, Any]], Column]] = {
    "trim": lambda c, p: _strip(c),
    "remove_special": lambda c, p: F.regexp_replace(c, p.get("pattern", SPECIAL_CHARACTERS), ""),
    "lowercase": lambda c, p: F.lower(c),
    "uppercase": lambda c, p: F.upper(c),
    "remove_numbers": lambda c, p: F.regexp_replace(c, DIGITS, ""),
    "remove_spaces": lambda c, p: F.regexp_replace(c, WHITESPACE, ""),
    "normalize_whitespace": lambda c, p: F.trim(F.regexp_replace(c, WHITESPACE, " ")),
    "remove_punctuation": lambda c, p: F.regexp_replace(c, PUNCTUATION, ""),
    "remove_html": lambda c, p: F.regexp_replace(c, HTML_TAG, ""),
    "remove_urls": lambda c, p: F.regexp_replace(c, URL, ""),
    "custom_regex": _custom,
}


def cleaned(col: Column, rule_type: str, parameters: Mapping[str, Any] | None = None) -> Column:
    """``col`` as text after one cleaning rule."""
    name = _CANONICAL.get(str(rule_type).lower())
    if name is None:
        raise ValueError(f"Unknown cleaning rule: {rule_type}")
    return _RULES[name](col.cast("string"), parameters or {})


def value_transformed(col: Column, kind: str, old: str = "", new: str = "") -> Column:
    """Value change of a synchronised column: upper case, lower case or literal replacement."""
    if kind in ("uppercase", "upper"):
        return F.upper(col)
    if kind in ("lowercase", "lower"):
        return F.lower(col)
    if kind == "replace":
        return F.replace(col, F.lit(old), F.lit(new))
    raise ValueError(f"Unknown value transform: {kind}")
