"""Settings as frozen dataclasses: unknown names are refused, files are JSON, overrides nest."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class SplitConfig:
    """How texts become word slots. slots: K hash slots for a triple among `vocab_size`; shared_slots: P of them taken from the lower-case form."""

    vocab_size: int = 32_000
    slots: int = 4
    shared_slots: int = 0
    lowercase: bool = False
    sequence_length: int = 2048
    end_of_text: str = "<|endoftext|>"
    entire_words: bool = False
    classic: bool = False
    word_edge_weight: float = 1.0


@dataclass(frozen=True)
class PackConfig:
    separators: str = " .,!?"
    max_bytes: int = 20_000
    tolerance_bytes: int = 100


@dataclass(frozen=True)
class SampleConfig:
    seed: int = 42
    micro_batch: int = 1
    world: int = 1
    consumed: int = 0


@dataclass(frozen=True)
class ScheduleConfig:
    """Learning-rate schedule; style: constant, linear or cosine."""

    rate: float = 1e-3
    minimum: float = 0.0
    warmup_steps: int = 100
    decay_steps: int = 1000
    style: str = "cosine"


@dataclass(frozen=True)
class CorpusConfig:
    split: SplitConfig = SplitConfig()
    pack: PackConfig = PackConfig()
    sample: SampleConfig = SampleConfig()
    schedule: ScheduleConfig = ScheduleConfig()


def from_dict(kind: type, values: dict[str, Any]) -> Any:
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(fields)):
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    nested = {f.name: type(getattr(kind(), f.name)) for f in fields.values() if dataclasses.is_dataclass(getattr(kind(), f.name))}
    return kind(**{k: from_dict(nested[k], v) if k in nested and isinstance(v, dict) else v for k, v in values.items()})


def overridden(values: dict[str, Any], more: dict[str, Any]) -> dict[str, Any]:
    out = dict(values)
    for k, v in more.items():
        out[k] = overridden(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(kind: type, source: str | Path | dict, overrides: dict[str, Any] | None = None) -> Any:
    """From a dict, a JSON text, or a JSON or YAML file (YAML only where a reader is installed)."""
    if isinstance(source, dict):
        values = source
    elif isinstance(source, str) and source.lstrip().startswith("{"):
        values = json.loads(source)
    else:
        text = Path(source).read_text()
        if str(source).endswith((".yaml", ".yml")):
            import yaml

            values = yaml.safe_load(text)
        else:
            values = json.loads(text)
    return from_dict(kind, overridden(values, overrides or {}))


def save(config: Any, path: str | Path) -> None:
    Path(path).write_text(json.dumps(dataclasses.asdict(config), indent=2))


def template(kind: type) -> str:
    """A commented template: every field with its type and default."""
    lines = []
    for f in dataclasses.fields(kind):
        value = getattr(kind(), f.name)
        if dataclasses.is_dataclass(value):
            lines += [f"{f.name}:", *["  " + x for x in template(type(value)).splitlines()]]
        else:
            lines += [f"# {f.type}", f"{f.name}: {json.dumps(value)}"]
    return "\n".join(lines)
