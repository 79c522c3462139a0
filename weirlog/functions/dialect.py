"""Regular expressions as rule files write them, for the JVM."""

from __future__ import annotations

import re

from ..config import Rule

_SPACE_CLASS = r"[\s\x1c-\x1f]"
_FLAGS = {"IGNORECASE": "iu", "DOTALL": "s", "MULTILINE": "m", "VERBOSE": "x"}


def java_pattern(rule: Rule) -> str:
    r"""Unicode classes and \n as the only line end (unless ASCII is asked for); \s also covers the four separators U+001C-U+001F."""
    flags = "d" + ("" if "ASCII" in rule.flags else "U") + "".join(_FLAGS[f] for f in rule.flags if f in _FLAGS)
    out, i, inside = [], 0, False
    p = rule.pattern
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            two = p[i : i + 2]
            if two == r"\s" and "ASCII" not in rule.flags:
                out.append(r"\s\x1c-\x1f" if inside else _SPACE_CLASS)
            elif two == r"\@":
                out.append("@")
            else:
                out.append(two)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            # a bracket right after the opening one is a member of the class
            if p[i + 1 : i + 2] == "^":
                out.append("[^")
                i += 2
                continue
        elif c == "[" and inside:
            out.append(r"\[")
            i += 1
            continue
        elif c == "]" and inside:
            inside = False
        elif c == "&" and inside and p[i + 1 : i + 2] == "&":
            out.append(r"\&")
            i += 1
            continue
        out.append(c)
        i += 1
    body = "".join(out)
    # in a negated class, \S or [^\s] must leave the separators out too, which the listing above does
    return f"(?{flags}){body}"


def java_replacement(text: str) -> str:
    r"""\1 becomes $1; other backslashes and dollars are literal."""
    out, i = [], 0
    while i < len(text):
        m = re.match(r"\\(\d+)", text[i:])
        if m:
            out.append("$" + m[1])
            i += m.end()
            continue
        out.append({"\\": r"\\", "$": r"\$"}.get(text[i], text[i]))
        i += 1
    return "".join(out)
