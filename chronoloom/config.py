"""Layered configuration and the registry of encoders.

Names are looked up in the registry; nothing is imported or evaluated from a
configuration.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path


def merged(base: dict, *layers: dict) -> dict:
    """base with the layers laid over it, dicts merged key by key."""
    out = dict(base)
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def get_path(config: dict, path: str, default=None):
    """The value at a dotted path."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def set_path(config: dict, path: str, value: str | object) -> dict:
    """A copy with the value at a dotted path; a string is cast to the type of
    the value that it replaces."""
    old = get_path(config, path)
    if isinstance(value, str) and old is not None and not isinstance(old, str):
        value = value.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(value)
    for part in reversed(path.split(".")):
        value = {part: value}
    return merged(config, value)


def load(*paths: str) -> dict:
    """JSON or YAML files, later ones over earlier ones."""
    out: dict = {}
    for p in map(Path, paths):
        if p.suffix == ".json":
            layer = json.loads(p.read_text())
        else:
            import yaml

            layer = yaml.safe_load(p.read_text()) or {}
        out = merged(out, layer)
    return out


def encoder(name: str) -> Callable:
    """An encoder by its name in a configuration."""
    from chronoloom.operators import encoders

    known = {"gcn": encoders.gcn, "gat": encoders.gat, "node_gru": encoders.node_gru, "tna": encoders.tna, "egcn": encoders.egcn, "subgraph": encoders.subgraph_scores}
    if name not in known:
        raise ValueError(f"no encoder {name!r}; there are {', '.join(sorted(known))}")
    return known[name]
