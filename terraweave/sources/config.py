"""Run configuration (YAML or JSON)."""

from __future__ import annotations

import json
import os


def load_config(path: str) -> dict:
    if not os.path.exists(path):
        raise FileNotFoundError(f"config file not found: {path}")
    with open(path, encoding="utf-8") as handle:
        body = handle.read()
    try:
        import yaml
        return yaml.safe_load(body) or {}
    except ImportError:
        return json.loads(body)
