"""Feature maps and policies from JSON or YAML files."""

import json
import os

_HERE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "config")


def load_config(path: str) -> dict | None:
    """Parsed file, None when there is none. YAML needs the yaml module."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as missing:
                raise RuntimeError(f"{path} needs the yaml module") from missing
            return yaml.safe_load(f) or {}
    raise ValueError(f"unsupported configuration file: {path}")


def default_feature_map() -> dict:
    return load_config(os.path.join(_HERE, "feature_map.json"))


def default_policy() -> dict:
    return load_config(os.path.join(_HERE, "policy.json"))
