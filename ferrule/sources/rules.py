"""Rule packs: YAML in, plain values out.

A pack may hold sources, sinks, sanitizers, propagators, labels, secrets and barriers. Lists of several packs are joined in the order of their
paths; labels and secrets of a later pack replace those of the same name; barriers are joined without repetitions. Unknown keys are ignored,
a missing required key is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path
from typing import Any

import yaml

REQUIRED = {
    "sources": ("id", "kind", "layers"),
    "sinks": ("id", "kind", "callee", "layers"),
    "sanitizers": ("id", "kind", "callee"),
    "propagators": ("id", "kind", "callee"),
}
DEFAULTS: dict[str, dict[str, Any]] = {
    "sources": {"base": None, "attributes": [], "callee": [], "confidence": "high", "cwe": None},
    "sinks": {"taint_args": [0], "cwe": None, "severity": "medium", "confidence": "high", "fqn_hint": []},
    "sanitizers": {"clears": "return", "applies_to_layers": []},
    "propagators": {"from_args": ["any"], "to": "return"},
}
SECRET_DEFAULTS = {"patterns": [], "deny_values": [], "test_path_globs": [], "min_length": 16, "max_length": 512, "base64_threshold": 4.5, "hex_threshold": 3.0, "confidence": "medium"}
BARRIERS = ("decorators", "callables", "test_attrs", "aborts")


@dataclass
class Rules:
    sources: list[dict] = field(default_factory=list)
    sinks: list[dict] = field(default_factory=list)
    sanitizers: list[dict] = field(default_factory=list)
    propagators: list[dict] = field(default_factory=list)
    labels: dict[str, dict] = field(default_factory=dict)
    secrets: dict | None = None
    barriers: dict[str, list[str]] = field(default_factory=lambda: {k: [] for k in BARRIERS})

    def guard_terms(self) -> list[str]:
        """What can stand in a guard set, each with a bit of its own (see plans/taint.py)."""
        return sorted({*self.barriers["decorators"], *self.barriers["callables"], *self.barriers["test_attrs"]})

    def frame(self, spark, kind: str):
        """sources, sinks, sanitizers or propagators as a DataFrame: ord, id, callee (one row per entry), attribute rows as base.attribute."""
        rows = []
        for i, r in enumerate(getattr(self, kind)):
            entries = [f"{r['base']}.{a}" for a in r.get("attributes") or []] if r["kind"] != "call" else r["callee"]
            rows += [(i, r["id"], r["kind"], e.lstrip(".") if e.startswith(".") else None, None if e.startswith(".") else e) for e in entries]
        return spark.createDataFrame(rows, "ord int, id string, kind string, method string, fqn string")


def _need(d: dict, keys, where: str) -> None:
    for k in keys:
        if k not in d:
            raise ValueError(f"{where}: {k!r} is missing in {d.get('id', d)!r}")


def load_rule_file(path: str | Path) -> Rules:
    path = Path(path)
    return parse_rules(path.read_text(encoding="utf-8"), path.name)


def parse_rules(text: str, where: str = "rules") -> Rules:
    data = yaml.safe_load(text) or {}
    rules = Rules()
    for kind, keys in REQUIRED.items():
        for d in data.get(kind) or []:
            _need(d, keys, where)
            row = DEFAULTS[kind] | {k: v for k, v in d.items() if v is not None}
            for k in ("callee", "attributes", "layers", "taint_args", "from_args"):
                if k in row and not isinstance(row[k], (list, tuple)):
                    row[k] = [row[k]]
            getattr(rules, kind).append(row)
    for layer, d in (data.get("labels") or {}).items():
        _need(d, ("identifiers",), where)
        rules.labels[layer] = {"confidence": "medium"} | d
    if data.get("secrets"):
        rules.secrets = SECRET_DEFAULTS | data["secrets"]
        for p in rules.secrets["patterns"]:
            _need(p, ("id", "regex", "layers"), where)
        rules.secrets["patterns"] = [{"confidence": "high", "validator": None} | p for p in rules.secrets["patterns"]]
    if data.get("barriers"):
        rules.barriers = {k: list(data["barriers"].get(k) or []) for k in BARRIERS}
    return rules


def merge(a: Rules, b: Rules) -> Rules:
    return Rules(
        *(getattr(a, k) + getattr(b, k) for k in REQUIRED),
        labels=a.labels | b.labels,
        secrets=b.secrets or a.secrets,
        barriers={k: list(dict.fromkeys(a.barriers[k] + b.barriers[k])) for k in BARRIERS},
    )


def load_rules(paths) -> Rules:
    """A file, a folder (its *.yml and *.yaml, at any depth, in order of path) or a list of these."""
    if isinstance(paths, (list, tuple)):
        files = [Path(p) for p in paths]
    elif Path(paths).is_dir():
        files = sorted(p for p in Path(paths).rglob("*") if p.suffix in (".yml", ".yaml"))
    else:
        files = [Path(paths)]
    out = Rules()
    for f in files:
        out = merge(out, load_rule_file(f))
    return out


def default_rules() -> Rules:
    """The packs that come with the library."""
    out = Rules()
    for f in sorted((f for f in resources.files("ferrule.packs").iterdir() if f.name.endswith(".yml")), key=lambda f: f.name):
        out = merge(out, parse_rules(f.read_text(encoding="utf-8"), f.name))
    return out
