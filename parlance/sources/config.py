"""Strict configuration: unknown keys and wrong types are errors, not surprises."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class TurnOptions:
    max_gap_ms: int = 5000
    merge_when_timestamp_missing: bool = False
    merge_unknown_speakers: bool = False


@dataclass(frozen=True)
class SegmentOptions:
    smooth: int = 3
    std: float = 1.0
    min_size: int = 4
    char_floor: int = 1500
    char_cap: int = 10_000
    min_gain: float = 0.022
    max_chars: int = 35_000


@dataclass(frozen=True)
class LabelOptions:
    max_title_chars: int = 1024
    max_retry_attempts: int = 3
    title_blacklist: tuple[str, ...] = ()


@dataclass(frozen=True)
class VerifierOptions:
    rounds: int = 3
    tool_calls: int = 3
    top_k: int = 5
    enabled: bool = True
    evidence_check: bool = True


@dataclass(frozen=True)
class Config:
    turn_builder: TurnOptions = field(default_factory=TurnOptions)
    segmenter: SegmentOptions = field(default_factory=SegmentOptions)
    topic_labeler: LabelOptions = field(default_factory=LabelOptions)
    verifier: VerifierOptions = field(default_factory=VerifierOptions)

    @classmethod
    def of(cls, values: dict) -> Config:
        sections = {f.name: f.default_factory for f in fields(cls)}
        if extra := set(values) - set(sections):
            raise ValueError(f"unknown sections: {sorted(extra)}")
        return cls(**{name: _section(kind, values.get(name, {}), name) for name, kind in sections.items()})

    @classmethod
    def load(cls, path: str | Path) -> Config:
        return cls.of(json.loads(Path(path).read_text()))


def _section(kind: type, values: dict, name: str) -> object:
    known = {f.name: getattr(kind(), f.name) for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown keys in {name}: {sorted(extra)}")
    for key, value in values.items():
        want = type(known[key])
        good = isinstance(value, bool) == (want is bool) and isinstance(value, (int, float) if want is float else list if want is tuple else want)
        if not good:
            raise ValueError(f"{name}.{key} must be {want.__name__}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
