"""A project's configuration: layers, modules, exclusions, thresholds."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from lodestone.functions.paths import DEFAULT_LAYER, Rule
from lodestone.operators.retrieval import IMPORT_NOISE, LITERAL_NOISE

CONFIG_NAME = ".lodestone.json"


@dataclass(frozen=True)
class ProjectConfig:
    layer_rules: tuple[Rule, ...] = ()
    default_layer: str = DEFAULT_LAYER
    translations: tuple[str, ...] = ()
    extra_excluded_dirs: frozenset[str] = frozenset()
    forced_add: frozenset[str] = frozenset()
    module_depth: int = 1
    module_rules: tuple[Rule, ...] = ()
    literal_noise_threshold: int = LITERAL_NOISE
    import_noise_threshold: int = IMPORT_NOISE
    source: str = field(default="defaults")

    @property
    def layers(self) -> list[str]:
        """All layers in the order of their rules, the default one last."""
        return list(dict.fromkeys([*(r[0] for r in self.layer_rules), self.default_layer]))


def _rules(entries: list[dict]) -> tuple[Rule, ...]:
    return tuple((e["name"], tuple(e.get("dirs", ())), tuple(e.get("files", ()))) for e in entries)


def parse_config(raw: dict, source: str = "given") -> ProjectConfig:
    return ProjectConfig(
        _rules(raw.get("layers", [])),
        raw.get("default_layer", DEFAULT_LAYER),
        tuple(raw.get("translations", {}).get("files", ())),
        frozenset(raw.get("extra_excluded_dirs", ())),
        frozenset(raw.get("forced_add", ())),
        raw.get("module_depth", 1),
        _rules(raw.get("modules", [])),
        raw.get("literal_noise_threshold", LITERAL_NOISE),
        raw.get("import_noise_threshold", IMPORT_NOISE),
        source,
    )


def load_config(root: str) -> ProjectConfig:
    """The configuration in ``root``, or the defaults; read anew at every call."""
    path = os.path.join(root, CONFIG_NAME)
    if not os.path.isfile(path):
        return ProjectConfig()
    with open(path, encoding="utf-8") as f:
        return parse_config(json.load(f), path)
