"""Configurations: which stage stands at which port, read from dicts or TOML files and checked at once.

The ports come from the registry's table; this module adds which of them a configuration must fill, which have a
default, and which hold several stages.
"""

from __future__ import annotations

import itertools
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from weftmark.plans.registry import PORTS, check

# Names of the file format, and what stands at a port that a file leaves out.
DEFAULTS = {"graph_integrator": "in-memory", "concept_store": "in-memory", "embedder": "hashing"}
LISTS = {"metrics": "metric", "document_metrics": "document_metric"}
POLICIES = {"on_error": ("fail", "skip")}


@dataclass(frozen=True)
class Choice:
    """A stage by name, with its parameters."""

    name: str
    params: dict[str, Any] = field(default_factory=dict)

    def plain(self) -> dict[str, Any]:
        return {"name": self.name, "params": self.params}


def _choice(port: str, given: Any) -> Choice:
    if isinstance(given, Choice):
        given = given.plain()
    if not isinstance(given, Mapping) or not isinstance(given.get("name"), str) or not isinstance(given.get("params", {}), Mapping):
        raise ValueError(f"{port} must be a table with a name and, at will, params")
    _known(port, given, {"name", "params"})
    check(port, given["name"])
    return Choice(given["name"], dict(given.get("params", {})))


def _known(where: str, given: Mapping, allowed: set[str]) -> None:
    unknown = sorted(set(given) - allowed)
    if unknown:
        raise ValueError(f"unknown in {where}: {', '.join(unknown)}")


class Config:
    """Stages by port (``config["scorer"]``), metrics by family, and the policies ``on_error`` and ``seed``.

    ``on_error``: "fail" raises; "skip" gives a document that cannot be processed an error and no change. A
    configuration with a data set is an experiment and may have metrics.
    """

    def __init__(self, data: Mapping[str, Any], experiment: bool = False):
        single = [p for p in PORTS if p not in LISTS.values() and (experiment or p != "dataset")]
        _known("the configuration", data, {*single, "run", *(LISTS if experiment else ())})
        filled = {p: {"name": n} for p, n in DEFAULTS.items()} | {p: data[p] for p in single if p in data}
        missing = [p for p in single if p not in filled]
        if missing:
            raise ValueError(f"the configuration lacks {', '.join(missing)}")
        self._stages = {p: _choice(p, filled[p]) for p in single}
        self.families = {name: [_choice(port, m) for m in data.get(name, [])] for name, port in LISTS.items()} if experiment else {}
        twice = set.intersection(*({m.name for m in f} for f in self.families.values())) if self.families else set()
        if twice:
            raise ValueError(f"metric names in both families: {', '.join(sorted(twice))}")
        run = data.get("run", {})
        _known("run", run, {"on_error", "seed"})
        self.on_error, self.seed = run.get("on_error", "fail"), run.get("seed", 0)
        if self.on_error not in POLICIES["on_error"] or not isinstance(self.seed, int):
            raise ValueError(f"run.on_error is one of {', '.join(POLICIES['on_error'])}, run.seed a whole number")

    def __getitem__(self, port: str) -> Choice:
        return self._stages[port]

    def plain(self) -> dict[str, Any]:
        """The same as dicts and lists, all defaults filled in."""
        out = {p: c.plain() for p, c in self._stages.items()} | {name: [m.plain() for m in f] for name, f in self.families.items()}
        return out | {"run": {"on_error": self.on_error, "seed": self.seed}}


def read(given: Config | Mapping[str, Any] | str | Path, experiment: bool = False) -> Config:
    """A configuration from a dict or the path of a TOML file; a configuration is returned as it is."""
    if isinstance(given, Config):
        return given
    return Config(given if isinstance(given, Mapping) else toml(given), experiment)


def toml(path: str | Path) -> dict[str, Any]:
    return tomllib.loads(Path(path).read_text())


def combinations(sweep: Mapping[str, Any]) -> list[tuple[dict[str, Choice], Config]]:
    """Experiments of a sweep: ``base`` with every combination of ``axes``, by sorted axis name.

    A value of an axis replaces the whole stage at its port.
    """
    _known("the sweep", sweep, {"base", "axes"})
    base, axes = Config(sweep["base"], True).plain(), sweep["axes"]
    strange = sorted(a for a in axes if not (a in base and isinstance(base[a], dict) and a in PORTS))
    if strange:
        raise ValueError(f"axes that are no ports: {', '.join(strange)}")
    names = sorted(axes)
    values = [[_choice(n, v) for v in axes[n]] for n in names]
    return [(dict(zip(names, row)), Config(base | {n: c.plain() for n, c in zip(names, row)}, True)) for row in itertools.product(*values)]


_UNION = {"name": "union", "params": {"members": [{"name": "hearst"}, {"name": "compound"}]}}
# The two shipped pipelines.
PROFILES: dict[str, dict] = {
    profile: {
        "segmenter": {"name": "block"}, "extractor": {"name": extractor}, "scorer": {"name": "embedding-cosine"}, "resolver": {"name": "embedding-nn", "params": {"threshold": 0.9}},
        "relation_inducer": _UNION, "embedder": {"name": embedder},
    }
    for profile, extractor, embedder in (("lite", "token", "hashing"), ("standard", "noun-chunk", "sentence-transformer"))
}
