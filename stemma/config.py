"""Job configuration: a YAML or JSON file, environment references expanded, defaults for what is missing."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

# Defaults of a job.
DEFAULTS = {
    "processing": {"batch_size": 10, "chunk_chars": 8000, "chunk_tokens": 512, "overlap_tokens": 128},
    "graph": {"similarity": 0.6, "neighbors": 10, "layout_iterations": 10},
    "bridges": {"alpha": 1.7, "min_strength": 0.6},
    "storage": {"root": "store"},
}


def expand(value):
    """Replace ${VAR} and ${VAR:-default} in every string of a nested value."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m.group(1), m.group(2) or ""), value)
    return value


def _over(base: dict, top: dict) -> dict:
    return {k: _over(base[k], top[k]) if isinstance(base.get(k), dict) and isinstance(top.get(k), dict) else top.get(k, base.get(k)) for k in {**base, **top}}


def find(env: str = "STEMMA_CONFIG") -> Path | None:
    named = os.environ.get(env)
    if named:
        return Path(named)
    for p in (Path("config.yaml"), Path("config.json"), Path.home() / ".stemma" / "config.yaml"):
        if p.exists():
            return p
    return None


def load(path: str | Path | None = None) -> dict:
    """Any unreadable file leaves the defaults."""
    p = Path(path) if path else find()
    try:
        text = p.read_text() if p else ""
        if p and p.suffix == ".json":
            given = json.loads(text)
        else:
            import yaml

            given = yaml.safe_load(text)
        return _over(DEFAULTS, expand(given or {}))
    except Exception:  # noqa: BLE001 - a broken file must not stop a job
        return _over(DEFAULTS, {})


def save(config: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(config, indent=2))
