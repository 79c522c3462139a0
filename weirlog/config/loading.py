"""Rule and parameter files: the same structures as the built-in ones, validated on load."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from . import DEFAULT_FORMAT, RULES, Params, Rule

FLAGS = {"ASCII": re.ASCII, "DOTALL": re.DOTALL, "IGNORECASE": re.IGNORECASE, "MULTILINE": re.MULTILINE, "VERBOSE": re.VERBOSE}


@dataclass(frozen=True)
class RuleBook:
    """Ordered rules and strip option by format, aliases and the default format."""

    rules: Mapping[str, tuple[Rule, ...]]
    strip: Mapping[str, bool]
    aliases: Mapping[str, str]
    default: str

    def resolve(self, name: str) -> str:
        key = name.strip().lower()
        key = self.aliases.get(key, key)
        return key if key in self.rules else self.default


def builtin() -> RuleBook:
    from . import ALIASES

    return RuleBook(RULES, dict.fromkeys(RULES, True), ALIASES, DEFAULT_FORMAT)


def _object(value: object, where: str) -> Mapping:
    if not isinstance(value, Mapping):
        raise ValueError(f"{where} must be an object")
    return value


def compile_rules(raw: object, where: str) -> tuple[Rule, ...]:
    """Rules from their JSON form; every pattern must compile and its replacement must fit it."""
    if not isinstance(raw, list):
        raise ValueError(f"{where} must be a list")
    out = []
    for i, item in enumerate(raw):
        at = f"{where}[{i}]"
        r = _object(item, at)
        name = r.get("name", f"rule_{i + 1:02d}")
        if not isinstance(name, str) or not name.strip():
            raise ValueError(f"{at}.name must be a non-empty string")
        if not isinstance(r.get("pattern"), str) or not isinstance(r.get("replacement"), str):
            raise ValueError(f"{at} needs a pattern and a replacement")
        flags = r.get("flags", [])
        if not isinstance(flags, list) or not set(flags) <= set(FLAGS):
            raise ValueError(f"{at}.flags must be among {sorted(FLAGS)}")
        try:
            bits = 0
            for f in flags:
                bits |= FLAGS[f]
            re.compile(r["pattern"], bits).sub(r["replacement"], "")
            re.compile("(?:" + r["pattern"] + ")|()", bits)
        except re.error as e:
            raise ValueError(f"{at} is not a valid rule: {e}") from e
        out.append(Rule(r["pattern"], r["replacement"], tuple(flags), name))
    return tuple(out)


def load_rules(path: str) -> RuleBook:
    """A rule file: schema_version 1, default_dataset, aliases, datasets {name: {strip, rules}}."""
    with open(path, encoding="utf-8") as f:
        doc = _object(json.load(f), "the rule file")
    if doc.get("schema_version") != 1:
        raise ValueError("schema_version must be 1")
    sets = _object(doc.get("datasets"), "datasets")
    rules = {k.lower(): compile_rules(_object(v, f"datasets.{k}").get("rules"), f"datasets.{k}.rules") for k, v in sets.items()}
    default = str(doc.get("default_dataset", DEFAULT_FORMAT)).lower()
    if default not in rules:
        raise ValueError("default_dataset must name one of datasets")
    aliases = {str(a).lower(): str(b).lower() for a, b in _object(doc.get("aliases", {}), "aliases").items()}
    if not set(aliases.values()) <= set(rules):
        raise ValueError("aliases must name datasets")
    return RuleBook(rules, {k.lower(): bool(v.get("strip", True)) for k, v in sets.items()}, aliases, default)


def load_params(path: str, name: str) -> Params:
    """Parameters of one data set from a file: schema_version 1, default {...}, datasets {name: {...}}."""
    with open(path, encoding="utf-8") as f:
        doc = _object(json.load(f), "the parameter file")
    if doc.get("schema_version") != 1:
        raise ValueError("schema_version must be 1")
    known = {f.name for f in fields(Params)}
    base, sets = _object(doc.get("default"), "default"), _object(doc.get("datasets", {}), "datasets")
    for where, values in [("default", base), *((f"datasets.{k}", _object(v, f"datasets.{k}")) for k, v in sets.items())]:
        if not set(values) <= known:
            raise ValueError(f"{where} has unknown fields: {sorted(set(values) - known)}")
    lower = {k.lower(): v for k, v in sets.items()}
    return Params(**{**base, **lower.get(name.strip().lower(), {})})
