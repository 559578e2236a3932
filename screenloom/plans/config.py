"""Strict configuration: nested dataclasses, YAML bases, overlays and ``key=value`` overrides."""

from __future__ import annotations

import copy
import dataclasses
import types
import typing
from collections.abc import Mapping, Sequence
from typing import Any

import yaml


def strict(cls: type, values: Mapping[str, Any], at: str = "") -> Any:
    """``cls`` from a mapping; unknown, missing or mistyped keys are errors that name their place."""
    if not isinstance(values, Mapping):
        raise ValueError(f"{at or cls.__name__} is no mapping")
    fields = {f.name: f for f in dataclasses.fields(cls)}
    if unknown := sorted(set(values) - set(fields)):
        raise ValueError(f"unknown keys: {[at + k for k in unknown]}")
    hints, made = typing.get_type_hints(cls), {}
    for name, f in fields.items():
        if name not in values:
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                raise ValueError(f"missing key: {at}{name}")
            continue
        made[name] = _value(hints[name], values[name], f"{at}{name}")
    return cls(**made)


def _value(hint: Any, value: Any, at: str) -> Any:
    if dataclasses.is_dataclass(hint):
        return strict(hint, value, f"{at}.")
    options = typing.get_args(hint) if isinstance(hint, types.UnionType) else (hint,)
    for option in options:
        if dataclasses.is_dataclass(option) and isinstance(value, Mapping):
            return strict(option, value, f"{at}.")
    plain = [typing.get_origin(o) or o for o in options]
    if float in plain and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if bool not in plain and isinstance(value, bool) or not isinstance(value, tuple(plain)):
        raise ValueError(f"{at}: {value!r} is not {hint}")
    return value


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` laid on ``base``, mappings merged key by key."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def compose(base: Mapping[str, Any], overlays: Sequence[Mapping[str, Any]] = (), overrides: Sequence[str] = ()) -> dict[str, Any]:
    """Base, overlays in order, then ``a.b=value`` (YAML values); the keys of an override must exist."""
    out = dict(base)
    for o in overlays:
        out = merged(out, o)
    for text in overrides:
        key, eq, value = text.partition("=")
        *path, last = key.split(".")
        if not eq:
            raise ValueError(f"not key=value: {text!r}")
        node = out
        for p in path:
            node = node.get(p) if isinstance(node, Mapping) else None
        if not isinstance(node, Mapping) or last not in node:
            raise ValueError(f"unknown key: {key}")
        out = merged(out, {})
        node = out
        for p in path:
            node = node[p]
        node[last] = yaml.safe_load(value)
    return out


def read_yaml(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


# --- the commands' settings -----------------------------------------------------------------------


@dataclasses.dataclass(frozen=True)
class Filter:
    enabled: bool = False
    output: str | None = None
    residual: float = 0.30
    cell_residual: float = 0.50
    min_cells: int = 30
    control: str = "non-targeting"


@dataclasses.dataclass(frozen=True)
class Normalize:
    enabled: bool = False
    output: str | None = None
    target: float = 10_000.0


@dataclasses.dataclass(frozen=True)
class Effects:
    enabled: bool = False
    output: str | None = None
    target: float = 10_000.0
    control: str = "non-targeting"


@dataclasses.dataclass(frozen=True)
class Process:
    """Folder with tables ``cells`` and ``counts``; stages with their outputs."""

    input: str
    overwrite: bool = False
    filter: Filter = dataclasses.field(default_factory=Filter)
    normalize: Normalize = dataclasses.field(default_factory=Normalize)
    effects: Effects = dataclasses.field(default_factory=Effects)

    def __post_init__(self) -> None:
        on = [s for s in (self.filter, self.normalize, self.effects) if s.enabled]
        outputs = [s.output for s in on]
        if not on or None in outputs or len(set(outputs)) != len(outputs):
            raise ValueError("at least one stage, each with an output of its own")


@dataclasses.dataclass(frozen=True)
class LabelTable:
    """Roles to columns, where contexts come from, and how values are written."""

    columns: dict
    context_from: str = "column"
    lower: bool = False
    context_map: dict | None = None
    drug_dose: bool = False
    space: str = "linear"

    def __post_init__(self) -> None:
        if ("context" in self.columns) != (self.context_from == "column"):
            raise ValueError("a context column is named exactly when the context comes from one")


@dataclasses.dataclass(frozen=True)
class Prep:
    name: str
    matrix: str
    output: str
    labels: str | None = None
    table: LabelTable | None = None
    genes: str | None = None
    control: str = "non-targeting"
    controls_only: bool = False
    overwrite: bool = False

    def __post_init__(self) -> None:
        if not self.controls_only and (self.labels is None or self.table is None):
            raise ValueError("labels are needed unless only controls are prepared")


@dataclasses.dataclass(frozen=True)
class Statistics:
    fdr: float = 0.05
    sign: float = 1.0
    clip_percentile: float = 95.0
    max_percentile: float = 99.9
    ratio: float = 1.1
    override: float | None = None
