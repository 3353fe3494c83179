"""Step configs: the accepted dialects, brought to one form."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

# Accepted spellings of the step types.
STEP_SPELLINGS = {
    "filter": ("filter",), "clean": ("clean", "cleaning"), "aggregate": ("aggregate", "aggregation"),
    "join": ("join",), "split": ("split", "column_split", "split_column"),
    "merge": ("merge", "column_merge", "merge_columns"), "type_conversion": ("type_conversion", "convert"),
    "rename": ("rename",), "drop": ("drop",), "fill_null": ("fill_null",),
    "custom_sql": ("custom_sql", "sql"), "custom_python": ("custom_python", "python"),
}
_CANONICAL = {word: name for name, words in STEP_SPELLINGS.items() for word in words}


def step_type(word: str) -> str:
    """Internal step type for any accepted spelling."""
    try:
        return _CANONICAL[str(getattr(word, "value", word)).lower()]
    except KeyError:
        raise ValueError(f"Unknown step type: {word}") from None


def _listed(config: Mapping[str, Any], *names: str) -> list[dict[str, Any]]:
    for name in names:
        if name in config:
            value = config[name]
            return [dict(value)] if isinstance(value, Mapping) else [dict(v) for v in value]
    return [dict(config)]


def filter_config(config: Mapping[str, Any]) -> dict[str, Any]:
    """``{rules, logical_operator}``."""
    rules = []
    for rule in _listed(config, "rules", "conditions"):
        rule.setdefault("operator", rule.pop("op", None))
        rules.append(rule)
    logic = config.get("logical_operator", config.get("logic", "AND"))
    return {"rules": rules, "logical_operator": str(getattr(logic, "value", logic)).upper()}


def clean_config(config: Mapping[str, Any]) -> dict[str, Any]:
    """``{rules: [{column, rule_type, parameters}]}``."""
    rules = []
    for rule in _listed(config, "rules", "operations"):
        kind = rule.get("rule_type", rule.get("operation"))
        params = dict(rule.get("parameters") or {})
        params |= {k: rule[k] for k in ("pattern", "replacement") if k in rule}
        rules.append({"column": rule["column"], "rule_type": kind, "parameters": params})
    return {"rules": rules}


def conversion_configs(config: Mapping[str, Any]) -> list[dict[str, Any]]:
    """List of ``{column, target_type, format, default_value}``."""
    return [
        {
            "column": c["column"], "target_type": c.get("target_type", c.get("to_type")),
            "format": c.get("format"), "default_value": c.get("default_value"),
        }
        for c in _listed(config, "conversions")
    ]


def aggregate_config(config: Mapping[str, Any]) -> dict[str, Any]:
    """``{group_by, aggregations, having, order_by, keep_null_keys}``."""
    group_by = config.get("group_by") or []
    having = config.get("having") or []
    return {
        "group_by": [group_by] if isinstance(group_by, str) else list(group_by),
        "aggregations": config["aggregations"],
        "having": [having] if isinstance(having, Mapping) else list(having),
        "order_by": list(config.get("order_by", [])), "keep_null_keys": bool(config.get("keep_null_keys", False)),
    }


def join_config(config: Mapping[str, Any]) -> dict[str, Any]:
    """``{right, on, how, ...}``; the right side is a frame or a source name."""
    on = config.get("join_conditions", config.get("on", config.get("conditions", [])))
    return {
        "left": config.get("left_source"), "right": config.get("right", config.get("right_source")),
        "on": [on] if isinstance(on, Mapping) else on,
        "how": str(config.get("join_type", config.get("how", config.get("type", "inner")))).lower(),
        "null_safe": config.get("null_safe", True),
        "suffixes": tuple(config.get("suffixes", ("_left", "_right"))),
    }
