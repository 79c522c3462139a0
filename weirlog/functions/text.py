"""Column expressions on messages and templates; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RULES, Rule, resolve
from .dialect import java_pattern, java_replacement

_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_GAP = r"(?U)[\s\x1c-\x1f]+"
WILDCARD = "<*>"
NO_ANCHOR = "NO_ANCHOR"


def strip_text(text: Column) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(text, _EDGE, "")


def mask(text: Column, rules: str | Sequence[Rule], strip: bool = True) -> Column:
    """Apply a format's rules (or the given ones) in order, in one projection."""
    for r in RULES[resolve(rules)] if isinstance(rules, str) else rules:
        text = F.regexp_replace(text, java_pattern(r), java_replacement(r.replacement))
    return strip_text(text) if strip else text


#: A masking function of a column for each format.
MASKS = {name: partial(mask, rules=name) for name in RULES}


def tokens(text: Column) -> Column:
    """White-space tokens, none of them empty."""
    return F.filter(F.split(text, _GAP), lambda t: t != "")


def bucket_key(toks: Column, anchors: Iterable[int]) -> Column:
    """P{position}:{token} of every anchor position that the message reaches, joined by underscores."""
    parts = [F.when(F.size(toks) > p, F.concat(F.lit(f"P{p}:"), F.get(toks, F.lit(p)))) for p in sorted(anchors)]
    if not parts:
        return F.lit(NO_ANCHOR)
    key = F.concat_ws("_", *parts)
    return F.when(key == "", F.lit(NO_ANCHOR)).otherwise(key)


def template_key(template: Column) -> Column:
    """Key under which templates are one event: letters, digits and asterisks, lower case."""
    return F.lower(F.regexp_replace(template, "[^a-zA-Z0-9*]", ""))


def evaluation_key(template: Column) -> Column:
    """Key for comparing templates with ground truth: every <...> is a wildcard, then as template_key; null is empty."""
    wild = F.regexp_replace(F.coalesce(template, F.lit("")), r"<[^>\n]*>", "*")
    return F.lower(F.regexp_replace(wild, "[^a-zA-Z0-9*]", ""))


def canonical_key(text: Column) -> Column:
    """Tokens with a slash become wildcards; in the others every run of digits does."""
    one = lambda t: F.when(t.contains("/"), F.lit(WILDCARD)).otherwise(F.regexp_replace(t, r"(?U)\d+", WILDCARD))
    return F.array_join(F.transform(tokens(text), one), " ")


#: What a token must match to be of a type, first match wins.
TYPES = (
    ("number", r"(?Ud)\A-?\d+(\.\d+)?\n?\z"),
    ("ip", r"(?Ud)\A\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\n?\z"),
    ("path", r"(?Ud)\A(?:(/[\w\-./]+)|([A-Za-z]:\\[\w\-\\.]+)\n?\z)"),
    ("url", r"\A(http|https|ftp)://"),
    ("hex", r"\A0x[0-9a-fA-F]+\n?\z"),
    ("date", r"(?U)\A\d{4}-\d{2}-\d{2}\n?\z"),
    ("time", r"(?U)\A\d{2}:\d{2}:\d{2}\n?\z"),
)


def semantic_type(token: Column) -> Column:
    """number, ip, path, url, hex, date, time or literal; anything that starts like a path is one."""
    out = F.lit("literal")
    for name, pattern in reversed(TYPES):
        out = F.when(token.rlike(pattern), F.lit(name)).otherwise(out)
    return out
