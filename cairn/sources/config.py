"""Extraction rules in YAML."""

from __future__ import annotations


def parse_rules(text: str) -> dict:
    """selectors, version and threshold of a rule file."""
    import yaml

    data = yaml.safe_load(text) or {}
    meta = data.get("metadata") or {}
    return {"selectors": {f: {"selector": r.get("selector", ""), "type": r.get("type", "css")} if isinstance(r, dict) else {"selector": str(r), "type": "css"} for f, r in (data.get("selectors") or {}).items()}, "version": int(meta.get("version", 1)), "threshold": float(meta.get("acceptance_threshold", 0.9))}


def rules_text(config: dict) -> str:
    import yaml

    return yaml.safe_dump({"selectors": config["selectors"], "metadata": {"version": config["version"], "acceptance_threshold": config["threshold"]}}, sort_keys=False, allow_unicode=True)
