"""Product configuration: YAML (or JSON) with relative includes, checked before anything runs."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from slotwise.operators.extract import TIMESTAMP, ModuleConfig
from slotwise.sources.discovery import DiscoveryConfig

KINDS = ("lifecycle", "correlation")


class ConfigError(ValueError):
    """A configuration that can't be used; the message names the field."""


@dataclass(frozen=True)
class Mechanism:
    """A module and what it needs: lifecycles are split by the first kind, correlated to by the second; others name a class."""

    key: str
    kind: str
    module: ModuleConfig
    depends_on: tuple[str, ...] = ()
    enabled: bool = True


@dataclass(frozen=True)
class Product:
    name: str
    discovery: DiscoveryConfig
    mechanisms: tuple[Mechanism, ...]
    timestamp_regex: str = TIMESTAMP
    active_gap_seconds: int = 300
    extra: dict = field(default_factory=dict, hash=False)


def load(path: str | Path) -> dict:
    """A document with its includes filled in: ``$include`` is relative, stays inside the folder, and stands alone in its mapping."""
    path = Path(path)
    root = path.parent.resolve()
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)

    def filled(node):
        if isinstance(node, list):
            return [filled(v) for v in node]
        if not isinstance(node, dict):
            return node
        if "$include" not in node:
            return {k: filled(v) for k, v in node.items()}
        if len(node) > 1:
            raise ConfigError("$include can't stand beside other fields")
        name = Path(node["$include"])
        target = (root / name).resolve()
        if name.is_absolute() or root not in target.parents:
            raise ConfigError(f"$include leaves the folder: {name}")
        return load(target) if target.suffix == ".json" else filled(yaml.safe_load(target.read_text(encoding="utf-8")))

    return filled(data)


def _only(where: str, node: dict, allowed: set[str], needed: set[str] = frozenset()) -> None:
    if not isinstance(node, dict):
        raise ConfigError(f"{where} must be a mapping")
    if more := set(node) - allowed:
        raise ConfigError(f"{where}: unknown fields {sorted(more)}")
    if less := needed - set(node):
        raise ConfigError(f"{where}: missing fields {sorted(less)}")


def checked_pattern(where: str, pattern: str, names: tuple[str, ...] = (), groups: tuple[int, ...] = ()) -> str:
    """A pattern that compiles, with the named groups or one of the numbers of groups that are asked for."""
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        raise ConfigError(f"{where}: {e}") from e
    if less := set(names) - set(compiled.groupindex):
        raise ConfigError(f"{where}: groups {sorted(less)} are missing")
    if groups and compiled.groups not in groups:
        raise ConfigError(f"{where}: {compiled.groups} groups, not {' or '.join(map(str, groups))}")
    return pattern


def _names(value) -> tuple[str, ...]:
    """A list of names; null is none, a single text is one."""
    return () if value is None else (value,) if isinstance(value, str) else tuple(map(str, value))


def module(key: str, kind: str, node: dict, timestamp_regex: str = TIMESTAMP) -> ModuleConfig:
    where = f"mechanisms.{key}"
    _only(where, node, {"module_name", "diag_pattern", "sequence_pattern", "active_master_keyword", "identifying_keyword", "lifecycle_split", "journal"}, {"module_name", "diag_pattern"})
    checked_pattern(f"{where}.diag_pattern", node["diag_pattern"], ("Slot", "CPU_Id", "ProcessName", "Context"))
    journal, split = node.get("journal") or {}, node.get("lifecycle_split") or {}
    _only(f"{where}.journal", journal, {"line_pattern", "line_pattern2", "line_pattern2_required_substrings", "identifying_keyword"})
    _only(f"{where}.lifecycle_split", split, {"process_name_mapping", "reliable_processes", "multi_instance_processes"})
    for name in ("line_pattern", "line_pattern2"):
        if journal.get(name):
            checked_pattern(f"{where}.journal.{name}", journal[name], groups=(3, 4))
    sequence = checked_pattern(f"{where}.sequence_pattern", node.get("sequence_pattern", r"No\[(\d+)\]"))
    reliable, multi = _names(split.get("reliable_processes")), _names(split.get("multi_instance_processes"))
    if both := {n.casefold() for n in reliable} & {n.casefold() for n in multi}:
        raise ConfigError(f"{where}: both reliable and multi-instance: {sorted(both)}")
    return ModuleConfig(
        key, node["module_name"], node["diag_pattern"], sequence, node.get("active_master_keyword") or "", journal.get("identifying_keyword") or node.get("identifying_keyword") or "",
        journal.get("line_pattern") or None, journal.get("line_pattern2") or None, _names(journal.get("line_pattern2_required_substrings")), timestamp_regex,
        {k: list(_names(v)) for k, v in (split.get("process_name_mapping") or {}).items()}, reliable, multi,
    )


def product(name: str, node: dict) -> Product:
    """A checked product; mechanisms must form no cycle and depend only on one another."""
    _only(name, node, {"discovery", "parser", "mechanisms", "archive"}, {"discovery", "parser", "mechanisms"})
    d, p = node["discovery"], node["parser"]
    _only(f"{name}.discovery", d, {f for f in DiscoveryConfig.__dataclass_fields__}, {"diagnostic_dir", "diagnostic_globs", "private_dir", "journal_globs"})
    _only(f"{name}.parser", p, {"timestamp_regex", "active_period_gap_seconds"})
    stamp = checked_pattern(f"{name}.parser.timestamp_regex", p.get("timestamp_regex", TIMESTAMP), groups=(2,))
    mechanisms = []
    for key, m in node["mechanisms"].items():
        _only(f"mechanisms.{key}", m, {"kind", "enabled", "depends_on", "config"}, {"kind", "config"})
        if m["kind"] not in KINDS and ":" not in m["kind"]:
            raise ConfigError(f"mechanisms.{key}.kind must be one of {KINDS} or a class path")
        mechanisms.append(Mechanism(key, m["kind"], module(key, m["kind"], m["config"], stamp), _names(m.get("depends_on")), m.get("enabled", True)))
    discovery = DiscoveryConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})
    out = Product(name, discovery, tuple(mechanisms), stamp, int(p.get("active_period_gap_seconds", 300)))
    execution_order(out.mechanisms)
    return out


def execution_order(mechanisms: tuple[Mechanism, ...]) -> list[Mechanism]:
    """Enabled mechanisms, each after those it depends on, otherwise as configured."""
    todo = [m for m in mechanisms if m.enabled]
    known = {m.key for m in todo}
    for m in todo:
        if less := set(m.depends_on) - known:
            raise ConfigError(f"mechanisms.{m.key} depends on {sorted(less)}, which are missing or off")
    done: list[Mechanism] = []
    while todo:
        ready = next((m for m in todo if set(m.depends_on) <= {d.key for d in done}), None)
        if ready is None:
            raise ConfigError(f"mechanisms depend on one another in a circle: {sorted(m.key for m in todo)}")
        done.append(ready)
        todo.remove(ready)
    return done


def explain(config: Product) -> dict:
    """The effective configuration and the order in which mechanisms run."""
    return {
        "product": config.name, "discovery": dict(config.discovery.__dict__), "timestamp_regex": config.timestamp_regex, "active_gap_seconds": config.active_gap_seconds,
        "execution_order": [m.key for m in execution_order(config.mechanisms)], "mechanisms": {m.key: {"kind": m.kind, "depends_on": list(m.depends_on), "module_name": m.module.module_name} for m in config.mechanisms},
    }
